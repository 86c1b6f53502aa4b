"""MinHash near-duplicates with odd sketches.

Texts become sets of word shingles. Equal sets are one node from the start, so copies cost one
aggregation. MinHash samples of every set are banded; sets that share a band are candidates. The
samples are also folded into an odd sketch, a bitmap of parities: the population count of the XOR
of two sketches estimates how many samples differ, precisely so where sets are much alike. Only
candidates that the estimate leaves possible are confirmed, on the full sets.

A band may hold very many nodes. It is never expanded into pairs: in each round its nodes are
compared with one pivot of the band, and links are merged into components; bands inside one
component are done. What is still divided after the rounds is compared in blocks, sketches first and then
full sets inside the same tasks, so no pair that shares a band and could link is left out and no
task sends pairs on.

The pivot of a band is the node that shares most bands with others: the text that copies were made
from is nearer to all of them than they are to each other.

With 40 bands of 5 samples a pair at 0.8 shares no band with probability 1.2e-7; the sketch margin
is more than four standard deviations of the estimate.

Defined cases: a null or empty text has an empty set and is a group of its own; with fewer words
than a shingle the whole sequence is the one shingle; null ids are allowed, the smallest id that is
not null names the group; rows that share an id are one document as far as ``kept`` goes; further
columns are ignored; an empty table gives an empty one. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.marks import marked, marks
from gleaner.llm.words import longs, mix, positions_in_text, slices
from gleaner.operators.components import connected_components
from gleaner.storage import materialize, passing

BANDS, BAND_ROWS = 40, 5
SAMPLES = BANDS * BAND_ROWS
SKETCH_BITS = 1024
SKETCH_MARGIN = 0.15
ROUNDS = 3
BLOCK = 512

_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACE = mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(1 << 40))


# --- sets and sketches ----------------------------------------------------------------------


def shingle_sets(words: np.ndarray, of_text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, offsets per text): each text's distinct shingles in order."""
    counts = np.diff(of_text)
    n = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    place = positions_in_text(of_text)
    starts = np.flatnonzero(place < np.repeat(n, counts))
    size = np.minimum(np.repeat(counts, counts)[starts], width)
    sums = mix(size.astype(np.uint64) + np.uint64(7))
    for i in range(width):
        inside = i < size
        step = mix(sums + words[np.minimum(starts + i, len(words) - 1)])
        sums = np.where(inside, step, sums)
    ends = np.concatenate([[0], np.cumsum(n)])
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        sums[a:b].sort()
    if not len(sums):
        return sums, ends
    new = np.concatenate([[True], sums[1:] != sums[:-1]])
    new[ends[:-1][n > 0]] = True
    return sums[new], np.concatenate([[0], np.cumsum(new)])[ends]


def samples(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash samples, one row per non-empty set."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((SAMPLES, len(starts)), np.uint64)
    for k in range(SAMPLES):
        np.minimum.reduceat(shingles * _FACTORS[k], starts, out=out[k])
    return out.T


def band_keys(sampled: np.ndarray) -> np.ndarray:
    parts = sampled.reshape(len(sampled), BANDS, BAND_ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(BAND_ROWS):
        keys = mix(keys + parts[:, :, i])
    return keys.view(np.int64)


def odd_sketches(sampled: np.ndarray) -> np.ndarray:
    """Bitmaps of 8-bit words: every sample toggles the bit that its place and value name."""
    bits = (mix(sampled + _PLACE) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flat = bits + np.arange(len(sampled))[:, None] * SKETCH_BITS
    toggles = np.bincount(flat.ravel(), minlength=len(sampled) * SKETCH_BITS) & 1
    return np.packbits(toggles.astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1)


def estimate(differing_bits: np.ndarray) -> np.ndarray:
    """The similarity that a population count of the XOR of two sketches stands for."""
    odd = np.minimum(2 * differing_bits / SKETCH_BITS, 0.999999)
    toggles = np.log1p(-odd) / np.log1p(-2 / SKETCH_BITS)
    return 1 - toggles / (2 * SAMPLES)


def _sketch_words(column: pa.Array) -> np.ndarray:
    joined = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
    return joined.reshape(len(column), SKETCH_BITS // 64)


def _band_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy().reshape(-1, BANDS)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Byte strings ``data[offsets[i]:offsets[i+1]]`` without a Python loop."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())]
    )


def _set_keys(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set."""
    one = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles + np.uint64(1)), dtype=np.uint64)])
    two = np.concatenate([[np.uint64(0)], np.cumsum(mix(~shingles), dtype=np.uint64)])
    return (
        (one[offsets[1:]] - one[offsets[:-1]]).view(np.int64),
        (two[offsets[1:]] - two[offsets[:-1]]).view(np.int64),
    )


def prints(docs: DataFrame, width: int, identity: str, text: str) -> DataFrame:
    """(id, n, key1, key2, bands, sketch) per row; no bands and sketch for an empty set."""
    kind = docs.schema[identity].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            shingles, offsets = shingle_sets(s.hashes(fold=True), s.of_text, width)
            n = np.diff(offsets)
            key1, key2 = _set_keys(shingles, offsets)
            full = n > 0
            sampled = samples(shingles, offsets)
            ends = np.concatenate([[0], np.cumsum(full)])
            bands = pa.ListArray.from_arrays(
                pa.array((ends * BANDS).astype(np.int32)), pa.array(band_keys(sampled).ravel())
            )
            sketch = _binary(odd_sketches(sampled).ravel(), ends * (SKETCH_BITS // 8))
            yield pa.RecordBatch.from_arrays(
                [s.column("id"), pa.array(n.astype(np.int64)), pa.array(key1), pa.array(key2), bands, sketch],
                ["id", "n", "key1", "key2", "bands", "sketch"],
            )

    return docs.select(F.col(identity).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, n bigint, key1 bigint, key2 bigint, bands array<bigint>, sketch binary"
    )


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, key1, key2, set) of (id, text): the sorted shingles as bytes."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            shingles, offsets = shingle_sets(s.hashes(fold=True), s.of_text, width)
            key1, key2 = _set_keys(shingles, offsets)
            yield pa.RecordBatch.from_arrays(
                [s.column("id"), pa.array(key1), pa.array(key2), _binary(shingles, offsets * 8)], ["id", "key1", "key2", "set"]
            )

    return docs.mapInArrow(run, f"id {kind}, key1 bigint, key2 bigint, set binary")


# --- candidates and confirmation ------------------------------------------------------------


def _sketch_filter(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The (hub, member) pairs whose sketches leave the similarity possible."""
    sketches = nodes.select("node", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                differ = np.bitwise_count(_sketch_words(b.column(2)) ^ _sketch_words(b.column(3))).sum(axis=1)
                possible = estimate(differ) >= least - SKETCH_MARGIN
                yield b.select(["hub", "member"]).filter(pa.array(possible))

    both = pairs.join(sketches.toDF("hub", "one"), "hub").join(sketches.toDF("member", "two"), "member")
    return both.select("hub", "member", "one", "two").mapInArrow(run, "hub bigint, member bigint")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): the pairs whose full sets are similar enough.

    A hub's set meets its members' sets; a hub with many members is dealt out in parts.
    """
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt = materialize(
        pairs.join(parts, "hub").select(
            "hub", "member", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part")
        ),
        "pairs",
    )
    nodes = sets.select("node", "set")
    members = dealt.join(nodes, dealt["member"] == nodes["node"]).select("hub", "part", "member", "set")
    hubs = (
        dealt.select("hub", "part").distinct().join(nodes, F.col("hub") == nodes["node"])
        .select("hub", "part", F.lit(None).cast("bigint").alias("member"), "set")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for b in batches:
            src, dst = [], []
            for h, m, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                got = np.frombuffer(data.as_buffer(), np.uint64)
                if m is None:
                    hub, own = h, got.copy()
                    continue
                if h != hub:
                    raise RuntimeError(f"the set of {h} is missing")
                small, large = (own, got) if len(own) < len(got) else (got, own)
                if 100 * len(small) < percent * len(large):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int(np.count_nonzero(large[at] == small))
                if 100 * shared >= percent * (len(small) + len(large) - shared):
                    src.append(h)
                    dst.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    together = (
        members.unionByName(hubs)
        .repartition("hub", "part")
        .sortWithinPartitions("hub", "part", F.col("member").asc_nulls_first())
    )
    return together.mapInArrow(run, "src bigint, dst bigint")


def _with_pivots(members: DataFrame, used: DataFrame) -> DataFrame:
    """(hub, member): nodes against one pivot per divided bucket, one that was none before."""
    fresh = members.join(used.withColumn("_used", F.lit(1)), "node", "left")
    order = F.struct(
        F.coalesce("_used", F.lit(0)).alias("u"), (-F.col("degree")).alias("d"), "node", "component"
    )
    pivots = (
        fresh.groupBy("bucket")
        .agg(F.min(order).alias("_p"), F.min("component").alias("_a"), F.max("component").alias("_b"))
        .filter("_a <> _b")
        .select("bucket", F.col("_p.node").alias("hub"), F.col("_p.component").alias("_of"))
    )
    return (
        members.join(pivots, "bucket")
        .filter(F.col("component") != F.col("_of"))
        .select("hub", F.col("node").alias("member"))
        .distinct()
    )


def _possible(block: pa.Table, others: pa.RecordBatch, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the block, the rows of ``others`` in other components that sketches leave possible.

    A pair counts in the first of the bands that it shares, and only there.
    """
    bucket = others.column("bucket")[0].as_py()
    bands, all_bands = (_band_rows(x.column("bands")) for x in (block, others))
    comp, sketch = block.column("component").to_numpy(), _sketch_words(block.column("sketch").combine_chunks())
    comps, sketches = others.column("component").to_numpy(), _sketch_words(others.column("sketch"))
    for i in range(len(comp)):
        apart = np.flatnonzero(comps != comp[i])
        differ = np.bitwise_count(sketches[apart] ^ sketch[i]).sum(axis=1)
        at = apart[estimate(differ) >= least - SKETCH_MARGIN]
        first = (all_bands[at] == bands[i]).argmax(axis=1)
        yield i, at[all_bands[at, first] == bucket]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.RecordBatch | None]]:
    """(block, others) for batches in order of (bucket, part, own first).

    Only the block of a group, bounded by ``BLOCK``, is held; its other rows pass by in batches,
    however many there are. A group ends with None.
    """
    key: tuple[int, int] | None = None
    block: list[pa.RecordBatch] = []
    table: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "part", "own")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist(), b.num_rows]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            bucket, part, own = keys[:, start].tolist()
            if (bucket, part) != key:
                if table is not None:
                    yield table, None
                key, block, table = (bucket, part), [], None
            piece = b.slice(start, end - start)
            if own:
                block.append(piece)
            elif block:
                table = table or pa.Table.from_batches(block)
                yield table, piece
    if table is not None:
        yield table, None


def _laid(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (bucket, part, own, node, component) with what ``nodes`` has, in the order of ``_groups``."""
    return (
        rows.join(nodes, "node")
        .repartition("bucket", "part")
        .sortWithinPartitions("bucket", "part", F.col("own").desc())
    )


def _worth_it(laid: DataFrame, least: float) -> DataFrame:
    """(bucket, part, own, node, component): the rows with a partner that sketches leave possible.

    Similar nodes share many bands; each is left only where it meets a partner first.
    """
    names = ["bucket", "part", "own", "node", "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: np.ndarray | None = None
        for block, others in _groups(batches):
            if some is None:
                some = np.zeros(block.num_rows, bool)
            if others is None:
                yield from block.select(names).filter(pa.array(some)).to_batches()
                some = None
                continue
            met = np.zeros(others.num_rows, bool)
            for i, at in _possible(block, others, least):
                some[i] |= len(at) > 0
                met[at] = True
            yield others.select(names).filter(pa.array(met))

    return laid.mapInArrow(run, "bucket bigint, part int, own boolean, node bigint, component bigint")


def _links_across(laid: DataFrame, least: float, percent: int) -> DataFrame:
    """(src, dst): for every row of a block and every other component, a node that it is linked with, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict[int, list[int]] = {}
        for block, others in _groups(batches):
            if others is None:
                reached = {}
                continue
            node, sets = (block.column(c) for c in ("node", "set"))
            nodes, comps = others.column("node").to_numpy(), others.column("component").to_numpy()
            all_sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in others.column("set")]
            sizes = np.array([len(x) for x in all_sets])
            src, dst = [], []
            for i, at in _possible(block, others, least):
                if i in reached:
                    at = at[~np.isin(comps[at], reached[i])]
                if not len(at):
                    continue
                own = np.frombuffer(sets[i].as_buffer(), np.uint64)
                low, high = np.minimum(sizes[at], len(own)), np.maximum(sizes[at], len(own))
                at = at[100 * low >= percent * high]
                if not len(at):
                    continue
                held = np.concatenate([all_sets[j] for j in at])
                found = own[np.minimum(np.searchsorted(own, held), len(own) - 1)] == held
                shared = np.add.reduceat(found.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[at])[:-1]]))
                linked = at[100 * shared >= percent * (sizes[at] + len(own) - shared)]
                fresh, first = np.unique(comps[linked], return_index=True)
                if len(fresh):
                    reached.setdefault(i, []).extend(fresh.tolist())
                    src.extend([node[i].as_py()] * len(fresh))
                    dst.extend(nodes[linked[first]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return laid.mapInArrow(run, "src bigint, dst bigint")


def _across(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): links that join all components of the divided buckets that can be joined.

    The nodes outside a bucket's main component, that of its pivot, are compared with all its nodes,
    in blocks: first by sketches, which leaves the nodes with a possible partner, then those on their
    full sets. Pairs are formed inside the tasks; only links leave them.
    """
    least = percent / 100
    main = (
        members.groupBy("bucket")
        .agg(
            F.min(F.struct((-F.col("degree")).alias("d"), "node", "component")).alias("_p"),
            F.min("component").alias("_a"),
            F.max("component").alias("_b"),
        )
        .filter("_a <> _b")
        .select("bucket", F.col("_p.component").alias("_main"))
    )
    placed = materialize(
        members.join(main, "bucket").select(
            "bucket", "node", "component", (F.col("component") != F.col("_main")).alias("apart")
        ),
        "divided",
    )
    sizes = placed.groupBy("bucket").agg(F.ceil(F.sum(F.col("apart").cast("int")) / BLOCK).cast("int").alias("blocks"))
    sized = placed.join(sizes, "bucket")
    everyone = sized.select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(False).alias("own"), "node", "component"
    )
    apart = sized.filter("apart").select(
        "bucket", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("part"), F.lit(True).alias("own"), "node", "component"
    )
    by_sketch = _laid(everyone.unionByName(apart), nodes.select("node", "bands", "sketch"))
    possible = materialize(_worth_it(by_sketch, least), "possible")
    whole = nodes.select("node", "bands", "sketch").join(sets, "node")
    return _links_across(_laid(possible, whole), least, percent)


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, identity: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(identity, n_shingles, component_id, kept) per row of ``docs``."""
    found = materialize(prints(docs, width, identity, text), "prints")
    with passing(docs.sparkSession):
        of_set = _components(found, docs, width, percent, identity, text)
    return (
        found.select("id", "n", "key1", "key2")
        .join(of_set, ["key1", "key2"], "left")
        .select(
            F.col("id").alias(identity),
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        )
        .withColumn("kept", F.col(identity).eqNullSafe(F.col("component_id")))
    )


def _components(found: DataFrame, docs: DataFrame, width: int, percent: int, identity: str, text: str) -> DataFrame:
    """(key1, key2, component_id) per distinct set."""
    nodes = materialize(
        found.filter("n > 0")
        .groupBy("key1", "key2")
        .agg(F.min("id").alias("least_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    found_members = materialize(banded.join(shared, "bucket").select("bucket", "node", "_n"), "members")
    degrees = found_members.groupBy("node").agg(F.sum("_n").alias("degree"))
    members = materialize(found_members.join(degrees, "node").select("bucket", "node", "degree"), "members")
    involved = materialize(
        nodes.join(members.select("node").distinct(), "node", "left_semi").select(
            "node", "least_id", "key1", "key2", "bands", "sketch"
        ),
        "involved",
    )
    # No text is shuffled: marks leave the texts that are wanted and few others, whose sets find no node.
    bits = materialize(marks(involved.select(F.col("least_id").alias("id"))), "marks")
    texts = docs.select(F.col(identity).alias("id"), F.col(text).alias("text")).filter(marked(F.col("id"), bits))
    wanted = involved.select("node", "least_id", F.col("key1").alias("_key1"), F.col("key2").alias("_key2"))
    one = (F.col("key1") == F.col("_key1")) & (F.col("key2") == F.col("_key2")) & F.col("id").eqNullSafe(F.col("least_id"))
    sets = materialize(_sets(texts, width).join(wanted, one).select("node", "set"), "sets")
    least = percent / 100
    everyone = involved.select("node")
    links = docs.sparkSession.createDataFrame([], "src bigint, dst bigint")
    labels = everyone.withColumn("component", F.col("node"))
    tried = docs.sparkSession.createDataFrame([], "hub bigint, member bigint")
    for turn in range(ROUNDS + 1):
        labelled = members.join(labels, "node")
        if turn < ROUNDS:
            used = tried.select(F.col("hub").alias("node")).distinct()
            again = tried.select(F.col("member").alias("hub"), F.col("hub").alias("member")).unionByName(tried)
            fresh = materialize(_with_pivots(labelled, used).join(again, ["hub", "member"], "left_anti"), "candidates")
            tried = tried.unionByName(fresh)
            found_links = _confirm(_sketch_filter(fresh, involved, least), sets, percent)
        else:
            found_links = _across(labelled, involved, sets, percent)
        confirmed = materialize(found_links, "links")
        if confirmed.isEmpty():
            continue
        links = links.unionByName(confirmed)
        labels = materialize(connected_components(everyone, links, "node"), "labels")
    grouped = nodes.select("node", "key1", "key2", "least_id").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    names = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return materialize(
        grouped.join(names, "component").select("key1", "key2", "component_id"), "groups", lasting=True
    )
