"""Language-model scoring by deleted interpolation.

The model mixes three estimates of a token: its share of the tokens that followed the word before
it, its share of all tokens, and an equal share for every type and one unknown. The mixture depends
on how often the word before was seen (buckets of powers of two). Its weights are learned by
expectation-maximisation on a deleted part of the training texts, with counts from the rest; scores
then use the counts of all training texts.

Counts are gathered for the whole corpus and never meet in one place. Texts become chunks of a
bounded number of tokens, with a dictionary each, written once. A chunk asks for the counts of its
distinct words and pairs, cut into blocks by hash; a block adds up what all chunks bring and sends
every chunk the counts it asked for, in the order asked. A frequent word is thus one number per chunk.

For EM, deleted tokens are counted in a grid of fixed size (bucket and both estimates at steps of a
sixteenth of a power of two), which is all that reaches the driver.

Defined cases: a null or empty text has one token, the end; a null id counts as the empty string
when texts are split; ids may repeat, every row gives one row; further columns are ignored; an empty
table gives an empty one; without training texts every token has the same probability. Words are
compared as 64-bit hashes, pairs by ``BLOCK_BITS + 8 * PAIR_BYTES`` bits.
"""

from __future__ import annotations

import secrets as randomness
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.words import longs, mix, slices
from gleaner.storage import materialize

PARTS = 10
HELD_OUT, DELETED, RETAINED = 0, 1, 2  # the part's number; all parts from 2 on are retained
CHUNK_TOKENS = 4_000_000
BLOCK_BITS = 10
WORD_BYTES, PAIR_BYTES = 7, 4
BUCKETS = 48
STEPS = 16  # grid steps per power of two
EM_ROUNDS = 60
_END = np.uint64(0x5851F42D4C957F2D)
_START = np.uint64(0x14057B7EF767814F)
_ROOT = np.uint64(0xD6E8FEB86659FD93)


# --- packing --------------------------------------------------------------------------------


def _squeeze(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte planes apart, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _low_bytes(keys: np.ndarray, width: int) -> np.ndarray:
    """The bytes of the keys below the block bits, ``width`` of them."""
    return (keys << np.uint64(BLOCK_BITS)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]


# --- chunks ---------------------------------------------------------------------------------


@dataclass
class Chunk:
    ids: list
    part: int
    sizes: np.ndarray  # tokens per text
    tokens: np.ndarray  # places in ``words``
    words: np.ndarray  # hashes of the distinct tokens

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pairs as context * (words + 1) + token, which of them each token ends, counts).

        The context after the last word is the start of a text.
        """
        n = len(self.words)
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = n
        return np.unique(before * (n + 1) + self.tokens, return_inverse=True, return_counts=True)

    def pair_keys(self, pairs: np.ndarray) -> np.ndarray:
        hashes = np.append(self.words, _START)
        before, token = np.divmod(pairs, len(self.words) + 1)
        return mix(hashes[before] * _ROOT + mix(hashes[token]))


def _chunk_rows(held: list[tuple], part: int) -> pa.RecordBatch:
    ids = pa.concat_arrays([h[0] for h in held])
    sizes = np.concatenate([h[1] for h in held])
    words, places, times = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([randomness.randbits(62)]),
            pa.array([part], pa.int32()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([sizes.astype("<i4").tobytes()], pa.binary()),
            pa.array([_squeeze(rank[places])], pa.binary()),
            pa.array([words[order].tobytes()], pa.binary()),
        ],
        ["chunk", "part", "ids", "sizes", "tokens", "words"],
    )


def chunks(docs: DataFrame, identity: str, text: str) -> DataFrame:
    kind = docs.schema[identity].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {HELD_OUT: [], DELETED: [], RETAINED: []}
        waiting = dict.fromkeys(held, 0)
        for s in slices(batches):
            words, counts = s.hashes(fold=True), s.counts()
            tokens = np.full(len(words) + s.texts, _END)
            tokens[np.arange(len(words)) + np.repeat(np.arange(s.texts), counts)] = words
            sizes = counts + 1
            of_part = np.minimum(longs(s.column("part"), 0), RETAINED)
            for part in held:
                mine = of_part == part
                if mine.any():
                    held[part].append((s.column("id").filter(pa.array(mine)), sizes[mine], tokens[np.repeat(mine, sizes)]))
                    waiting[part] += int(sizes[mine].sum())
                    if waiting[part] >= CHUNK_TOKENS:
                        yield _chunk_rows(held[part], part)
                        held[part], waiting[part] = [], 0
        for part, rows in held.items():
            if rows:
                yield _chunk_rows(rows, part)

    part = F.pmod(F.crc32(F.coalesce(F.col(identity).cast("string"), F.lit("")).cast("binary")), F.lit(PARTS))
    return docs.select(F.col(identity).alias("id"), F.col(text).alias("text"), part.cast("int").alias("part")).mapInArrow(
        run,
        f"chunk bigint, part int, ids array<{kind}>, sizes binary, tokens binary, words binary",
    )


def _read_chunk(row: dict) -> Chunk:
    sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
    tokens = _unsqueeze(row["tokens"], int(sizes.sum())).astype(np.int64)
    return Chunk(row["ids"], row["part"], sizes, tokens, np.frombuffer(row["words"], np.uint64))


# --- counts ---------------------------------------------------------------------------------


def _asked(chunk: Chunk) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(kind, keys, counts) for the words and for the pairs of a chunk."""
    yield "word", chunk.words, np.bincount(chunk.tokens, minlength=len(chunk.words))
    pairs, _, times = chunk.pairs()
    yield "pair", chunk.pair_keys(pairs), times


def _by_block(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by block, edges of the blocks): stable, so a chunk finds its answers again."""
    block = (keys >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)
    return np.argsort(block, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(block, minlength=1 << BLOCK_BITS))])


_WIDTHS = {"word": WORD_BYTES, "pair": PAIR_BYTES}


def requests(chunked: DataFrame) -> DataFrame:
    """(kind, block, chunk, part, keys, counts): what each chunk brings and asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                for kind, keys, counts in _asked(_read_chunk(row)):
                    order, edges = _by_block(keys)
                    data, counts = _low_bytes(keys[order], _WIDTHS[kind]), counts[order]
                    blocks = np.flatnonzero(np.diff(edges)).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([kind] * len(blocks), pa.string()),
                            pa.array(blocks, pa.int32()),
                            pa.array([row["chunk"]] * len(blocks), pa.int64()),
                            pa.array([row["part"]] * len(blocks), pa.int32()),
                            pa.array([data[edges[k] : edges[k + 1]].tobytes() for k in blocks], pa.binary()),
                            pa.array([_squeeze(counts[edges[k] : edges[k + 1]]) for k in blocks], pa.binary()),
                        ],
                        ["kind", "block", "chunk", "part", "keys", "counts"],
                    )

    return chunked.mapInArrow(run, "kind string, block int, chunk bigint, part int, keys binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """(chunk, part, kind, block, n, retained, deleted, types): counts in the order asked.

    ``types`` is the number of distinct training words of the block, given once per block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple]] = {}
        for b in batches:
            for row in b.to_pylist():
                held.setdefault((row["kind"], row["block"]), []).append(
                    (row["chunk"], row["part"], row["keys"], row["counts"])
                )
        for kind, block in list(held):
            rows, width = held.pop((kind, block)), _WIDTHS[kind]
            sizes = [len(r[2]) // width for r in rows]
            wide = np.zeros((sum(sizes), 8), np.uint8)
            wide[:, :width] = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, width)
            _, place = np.unique(wide.view(">u8").ravel(), return_inverse=True)
            counts = np.concatenate([_unsqueeze(r[3], n) for r, n in zip(rows, sizes, strict=True)]).astype(np.float64)
            part = np.repeat([r[1] for r in rows], sizes)
            retained = np.bincount(place, counts * (part == RETAINED)).astype(np.uint32)
            deleted = np.bincount(place, counts * (part == DELETED)).astype(np.uint32)
            types = int(np.count_nonzero(retained + deleted)) if kind == "word" else 0
            at = np.concatenate([[0], np.cumsum(sizes)])
            for i, (chunk, own, _, _) in enumerate(rows):
                mine = place[at[i] : at[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk], pa.int64()),
                        pa.array([own], pa.int32()),
                        pa.array([kind]),
                        pa.array([block], pa.int32()),
                        pa.array([len(mine)], pa.int32()),
                        pa.array([_squeeze(retained[mine])], pa.binary()),
                        pa.array([_squeeze(deleted[mine])], pa.binary()),
                        pa.array([types if i == 0 else 0], pa.int64()),
                    ],
                    ["chunk", "part", "kind", "block", "n", "retained", "deleted", "types"],
                )

    return asked.repartition("kind", "block").mapInArrow(
        run,
        "chunk bigint, part int, kind string, block int, n int, retained binary, deleted binary, types bigint",
    )


def _counts_of(table: pa.Table, kind: str, keys: np.ndarray, deleted: bool) -> np.ndarray:
    """The answers to a chunk's keys, from retained texts or, with ``deleted``, from all training texts."""
    order, edges = _by_block(keys)
    sorted_counts = np.zeros(len(keys), np.int64)
    names = ("kind", "block", "n", "retained", "deleted")
    for k, block, n, one, two in zip(*(table.column(c).to_pylist() for c in names), strict=True):
        if k == kind:
            here = _unsqueeze(one, n).astype(np.int64)
            sorted_counts[edges[block] : edges[block + 1]] = here + _unsqueeze(two, n) if deleted else here
    out = np.empty_like(sorted_counts)
    out[order] = sorted_counts
    return out


@dataclass
class Estimates:
    """Per token: how often it, the word before it and both were seen."""

    token: np.ndarray
    before: np.ndarray
    both: np.ndarray

    @property
    def bucket(self) -> np.ndarray:
        return np.frexp(self.before.astype(np.float64))[1]  # 0 for unseen, else 1 + floor(log2)

    def shares(self, total: int) -> tuple[np.ndarray, np.ndarray]:
        """(share after the word before, share of all tokens)."""
        return self.both / np.maximum(self.before, 1), self.token / max(total, 1)


def _estimates(chunk: Chunk, table: pa.Table, texts: int, deleted: bool) -> Estimates:
    """``texts`` is how often a text began in the counted texts."""
    words = _counts_of(table, "word", chunk.words, deleted)
    pairs, which, _ = chunk.pairs()
    both = _counts_of(table, "pair", chunk.pair_keys(pairs), deleted)
    before = np.append(words, texts)[pairs // (len(words) + 1)]
    return Estimates(words[chunk.tokens], before[which], both[which])


# --- weights --------------------------------------------------------------------------------


def _levels(share: np.ndarray) -> np.ndarray:
    """Grid steps below 1; -1 for a share of nothing."""
    with np.errstate(divide="ignore"):
        return np.where(share > 0, np.floor(-STEPS * np.log2(np.where(share > 0, share, 1))), -1).astype(np.int64)


def learn(cells: list[tuple[int, int, int, int]], types: int) -> np.ndarray:
    """Weights (bucket, estimate) by EM; estimates are after a word, alone, equal shares.

    ``cells`` are (bucket, level after the word, level alone, tokens). Starting from equal weights,
    every round shares each cell's tokens among the estimates and takes the shares as new weights.
    Buckets without deleted tokens take the weights of all buckets together.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not cells:
        return weights
    bucket, after, alone, n = np.array(sorted(cells), np.int64).T

    def share(level):
        return np.where(level < 0, 0.0, np.exp2(-(level + 0.5) / STEPS))

    p = np.stack([share(after), share(alone), np.full(len(n), 1 / (types + 1))], axis=1)

    def rounds(of: np.ndarray, size: int) -> np.ndarray:
        w = np.full((size, 3), 1 / 3)
        for _ in range(EM_ROUNDS):
            part = w[of] * p
            part *= (n / part.sum(axis=1))[:, None]
            summed = np.stack([np.bincount(of, part[:, j], size) for j in range(3)], axis=1)
            seen = summed.sum(axis=1)
            w = np.where(seen[:, None] > 0, summed / np.maximum(seen, 1e-300)[:, None], w)
        return w

    weights[:] = rounds(np.zeros(len(n), np.int64), 1)[0]
    own = rounds(bucket, BUCKETS)
    present = np.bincount(bucket, minlength=BUCKETS) > 0
    weights[present] = own[present]
    return weights


def _grid(chunked: DataFrame, answered: DataFrame, retained_tokens: int, retained_texts: int) -> DataFrame:
    """(bucket, after, alone, n) over the deleted tokens."""

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for row in left.to_pylist():
            e = _estimates(_read_chunk(row), right, retained_texts, deleted=False)
            after, alone = e.shares(retained_tokens)
            found.append(np.stack([e.bucket, _levels(after), _levels(alone)]))
        if not found:
            return pa.table({c: pa.array([], pa.int64()) for c in ("bucket", "after", "alone", "n")})
        cell, n = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
        return pa.table({"bucket": cell[0], "after": cell[1], "alone": cell[2], "n": n})

    mine = chunked.filter(F.col("part") == DELETED).groupBy("chunk")
    theirs = answered.filter(F.col("part") == DELETED).groupBy("chunk")
    return (
        mine.cogroup(theirs)
        .applyInArrow(cells, "bucket bigint, after bigint, alone bigint, n bigint")
        .groupBy("bucket", "after", "alone")
        .agg(F.sum("n").alias("n"))
    )


# --- scores ---------------------------------------------------------------------------------


def score(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(identity, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``."""
    kind = docs.schema[identity].dataType.simpleString()
    chunked = materialize(chunks(docs, identity, text), "chunks")
    answered = materialize(answers(requests(chunked)), "answers")
    sums = {
        r["part"]: (r["tokens"], r["texts"])
        for r in chunked.select(
            "part",
            F.size("ids").alias("texts"),
            "sizes",
        )
        .mapInArrow(_token_sums, "part int, tokens bigint, texts bigint")
        .groupBy("part")
        .agg(F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts"))
        .collect()
    }
    types = answered.agg(F.sum("types")).first()[0] or 0
    retained_tokens, retained_texts = sums.get(RETAINED, (0, 0))
    deleted_tokens, deleted_texts = sums.get(DELETED, (0, 0))
    total, begun = retained_tokens + deleted_tokens, retained_texts + deleted_texts
    cells = _grid(chunked, answered, retained_tokens, retained_texts).collect()  # a grid of fixed size
    weights = learn([tuple(c) for c in cells], types)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            chunk = _read_chunk(row)
            e = _estimates(chunk, right, begun, deleted=True)
            after, alone = e.shares(total)
            w = weights[e.bucket]
            p = w[:, 0] * after + w[:, 1] * alone + w[:, 2] / (types + 1)
            base = np.log10((e.token + 0.1) / (total + 0.1 * (types + 1)))
            starts = np.cumsum(chunk.sizes) - chunk.sizes
            n = len(starts)
            out.append(
                pa.table(
                    {
                        identity: left.column("ids")[len(out)].values,
                        "held_out": np.full(n, chunk.part == HELD_OUT),
                        "n_tokens": chunk.sizes,
                        "n_known": np.add.reduceat((e.token > 0).astype(np.int64), starts),
                        "train_tokens": np.full(n, total),
                        "base_score": np.add.reduceat(base, starts),
                        "score": np.add.reduceat(np.log10(p), starts),
                    }
                )
            )
        return pa.concat_tables(out)

    return (
        chunked.groupBy("chunk")
        .cogroup(answered.groupBy("chunk"))
        .applyInArrow(
            scored,
            f"`{identity}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
            "base_score double, score double",
        )
    )


def _token_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = [int(np.frombuffer(x, "<i4").sum()) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(tokens, pa.int64()), b.column(1).cast(pa.int64())], ["part", "tokens", "texts"]
        )
