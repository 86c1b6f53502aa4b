"""Phrase collocations by counting word sequences in burst tries.

A phrase is worth listing if its words follow each other far more often than its parts would by
chance. Every language is counted by itself: texts are lower-cased (A-Z), cut into pieces at
punctuation and line ends, and pieces into words.

Counting. A task keeps a shallow trie: the root is indexed by the number of a phrase's first word
and holds hash containers of the remaining words. A container that grows beyond ``BURST`` entries
bursts into one container per next word. When the trie holds more than ``HELD`` entries, its largest
subtrees leave whole, as sorted runs, and their room is free again. Runs are dealt by prefix (the
first word, and an eighth of what follows, so that a prefix with very many continuations is spread
out) and the counts of equal phrases are added up there. A phrase is one entry per run, however
often it occurs.

Nearly all phrases are rare, so they are first counted by keys of ``KEY_BITS`` bits, in packed runs of
about three bytes a phrase: words, then pairs of words that are frequent, then longer phrases all of
whose pairs are. Phrases that share a key are counted together, which only adds, and a part of a
frequent phrase is as frequent as the phrase, so nothing is lost. What may be frequent is told to the
tasks as bitmaps of ``BITMAP_BITS`` bits, whatever the corpus: a wrong bit costs an entry in a trie
and never a result. A last pass counts these phrases exactly, by their words.

Scores are exact: products are decimals of 38 digits, quotients are floored whole numbers.

Defined cases: a null or empty text has no words; a null language is ``und``; ids are not read, so
repeated rows count as often as they come; further columns are ignored; an empty table gives an empty
one; one text is never cut and is held whole by its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.splitting import alphabet, folded, resplit
from gleaner.llm.words import Slice, mix, slices
from gleaner.operators.ranking import rank_in_group
from gleaner.storage import materialize

LONGEST = 5
MIN_COUNT = 100
BURST = 4096
HELD = 1 << 20
KEY_BITS, PREFIX_BITS = 40, 16
BITMAP_BITS = 1 << 26
TAIL_PARTS = 8
# Punctuation and line ends part pieces; space and tab part words.
BREAKS = alphabet(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D))
INSIDE = ~(BREAKS | alphabet((0x20, 0x20), (0x09, 0x09)))

_REST_BITS = np.uint64(KEY_BITS - PREFIX_BITS)
PACKED = "part int, entries bigint, keys binary, counts binary"
RUN = "part int, run binary"
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


# --- the trie -------------------------------------------------------------------------------


class _Branch(dict):
    """Children by the number of the next word; each is a container."""


class BurstTrie:
    """Counts of word sequences given as a first word and the bytes of the other numbers."""

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.roots: dict[int, dict] = {}
        self.sizes: dict[int, int] = {}
        self.entries = 0

    def add(self, first: int, rests: list[bytes], counts: list[int]) -> None:
        node = self.roots.get(first)
        if node is None:
            node = self.roots[first] = {}
        before = self.sizes.get(first, 0)
        new = 0
        if isinstance(node, _Branch):
            for rest, c in zip(rests, counts, strict=True):
                child = node.setdefault(rest[:4], {})
                new += rest[4:] not in child
                child[rest[4:]] = child.get(rest[4:], 0) + c
        else:
            for rest, c in zip(rests, counts, strict=True):
                node[rest] = node.get(rest, 0) + c
            new = len(node) - before
            if len(node) > self.burst:
                self.roots[first] = branch = _Branch()
                for rest, c in node.items():
                    branch.setdefault(rest[:4], {})[rest[4:]] = c
        self.sizes[first] = before + new
        self.entries += new

    def take(self, first: int) -> tuple[list[bytes], list[int]]:
        """A whole subtree, which leaves the trie."""
        node = self.roots.pop(first)
        self.entries -= self.sizes.pop(first)
        if not isinstance(node, _Branch):
            return list(node), list(node.values())
        flat = [(head + rest, c) for head, child in node.items() for rest, c in child.items()]
        return [r for r, _ in flat], [c for _, c in flat]

    def spill(self, keep: int) -> Iterator[tuple[int, list[bytes], list[int]]]:
        """The largest subtrees, until at most ``keep`` entries are left."""
        for first in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.entries <= keep:
                return
            yield first, *self.take(first)


class _Lexicon:
    """Numbers of the (language, word) pairs a task meets, with their hashes and, if wanted, texts."""

    def __init__(self, texts: bool):
        self.number: dict[int, int] = {}
        self.texts, self.words, self.langs = texts, [], []

    def numbers(self, s: Slice, at: np.ndarray, hashes: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """One number for each of the words ``at``."""
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        number, out = self.number, []
        for key, j in zip(keys.tolist(), first.tolist(), strict=True):
            n = number.get(key)
            if n is None:
                n = number[key] = len(number)
                if self.texts:
                    self.words.append(folded(s, int(at[j])))
                    self.langs.append(int(langs[j]))
            out.append(n)
        return np.array(out, np.int64)[back]

    def hashes(self) -> np.ndarray:
        return np.fromiter(self.number, np.uint64, len(self.number))


def _chain(keys: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """The hash of a sequence from that of its beginning and its next word."""
    return mix(keys * np.uint64(3) + nexts)


def phrase_keys(first: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Keys that begin with the prefix: the first word and an eighth of the whole phrases."""
    prefix = mix(first + (whole & np.uint64(TAIL_PARTS - 1))) >> np.uint64(64 - PREFIX_BITS)
    return (prefix << _REST_BITS) | (whole >> (np.uint64(64) - _REST_BITS))


def _partition(keys: np.ndarray, partitions: int) -> np.ndarray:
    return ((keys >> _REST_BITS) * np.uint64(partitions) >> np.uint64(PREFIX_BITS)).astype(np.int64)


class _Counter:
    """The trie of one task, its lexicon and the runs that leave it."""

    def __init__(self, partitions: int, texts: bool):
        self.partitions, self.texts = partitions, texts
        self.trie, self.lexicon, self.languages = BurstTrie(), _Lexicon(texts), {}
        self.single: dict[int, int] = {}  # words alone, by hash or number

    def language(self, name: str) -> tuple[int, int]:
        """(number, 64-bit salt) of a language."""
        if name not in self.languages:
            digest = hashlib.sha256(name.encode()).digest()
            self.languages[name] = (len(self.languages), int.from_bytes(digest[:8], "little"))
        return self.languages[name]

    def insert_words(self, words: np.ndarray) -> None:
        single = self.single
        found, counts = np.unique(words, return_counts=True)
        for word, c in zip(found.tolist(), counts.tolist(), strict=True):
            single[word] = single.get(word, 0) + c

    def insert(self, sequences: np.ndarray) -> None:
        """Word numbers, one row per occurrence, two or more words each."""
        if not len(sequences):
            return
        if sequences.shape[1] == 2:
            pairs, counts = np.unique(sequences[:, 0] << 32 | sequences[:, 1], return_counts=True)
            ordered = np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1)
        else:
            ordered = sequences[np.lexsort(sequences.T[::-1])]
            new = np.flatnonzero(np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)]))
            counts = np.diff(np.append(new, len(ordered)))
            ordered = ordered[new]
        counts, firsts = counts.tolist(), ordered[:, 0]
        width = 4 * (ordered.shape[1] - 1)
        packed = np.ascontiguousarray(ordered[:, 1:].astype("<u4")).tobytes()
        rests = [packed[i : i + width] for i in range(0, len(packed), width)]
        bounds = np.append(np.flatnonzero(np.concatenate([[True], firsts[1:] != firsts[:-1]])), len(firsts)).tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            self.trie.add(int(firsts[a]), rests[a:b], counts[a:b])

    def full(self) -> bool:
        return self.trie.entries + len(self.single) > HELD

    def runs(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Subtrees as sorted runs of about ``HELD // 2`` entries; words alone all go."""
        if self.single:
            words, counts = list(self.single), list(self.single.values())
            self.single = {}
            if self.texts:
                yield self._run(np.array(words), [b""] * len(words), counts)
            else:
                hashes = np.array(words, np.uint64)
                yield self._pack(phrase_keys(hashes, hashes), np.array(counts))
        firsts, rests, counts = [], [], []
        for first, more, n in self.trie.spill(keep):
            firsts.append(np.full(len(n), first))
            rests += more
            counts += n
            if len(counts) >= HELD // 2:
                yield self._run(np.concatenate(firsts), rests, counts)
                firsts, rests, counts = [], [], []
        if counts:
            yield self._run(np.concatenate(firsts), rests, counts)
        if not self.trie.entries:
            self.lexicon = _Lexicon(self.texts)

    def _run(self, firsts: np.ndarray, rests: list[bytes], counts: list[int]) -> pa.RecordBatch:
        hashes, counted = self.lexicon.hashes(), np.array(counts)
        lengths = np.fromiter(map(len, rests), np.int64, len(rests)) // 4
        words = pa.array(self.lexicon.words, pa.binary()) if self.texts else None
        phrases, keys, order = [], [], []
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            others = np.frombuffer(b"".join([rests[i] for i in at]), "<u4").reshape(len(at), length).astype(np.int64)
            whole = hashes[firsts[at]]
            for i in range(length):
                whole = _chain(whole, hashes[others[:, i]])
            keys.append(phrase_keys(hashes[firsts[at]], whole))
            order.append(at)
            if self.texts:
                columns = [words.take(pa.array(firsts[at])), *(words.take(pa.array(others[:, i])) for i in range(length))]
                phrases.append(pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())) if length else columns[0])
        at, keys = np.concatenate(order), np.concatenate(keys)
        if not self.texts:
            return self._pack(keys, counted[at])
        named = pa.array(list(self.languages), pa.string())
        lang = named.take(pa.array(np.array(self.lexicon.langs)[firsts[at]]))
        return self._text(keys, lang, pa.chunked_array(phrases).cast(pa.string()), counted[at])

    def _text(self, keys: np.ndarray, lang: pa.Array, phrase, counts: np.ndarray) -> pa.RecordBatch:
        """A run sorted by phrase, cut by partition: Arrow streams, compressed."""
        part = _partition(keys, self.partitions)
        run = pa.table({"part": pa.array(part), "lang": lang, "phrase": phrase, "n": pa.array(counts)})
        run = run.sort_by([("part", "ascending"), ("phrase", "ascending")]).combine_chunks()
        parts, first = np.unique(run.column("part").to_numpy(), return_index=True)
        bounds = np.append(first, len(part)).tolist()
        rows = run.drop(["part"]).cast(COUNTS)
        packed = [_stream(rows.slice(a, b - a)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(packed, pa.binary())], ["part", "run"])

    def _pack(self, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """A sorted run, cut by partition: byte planes of key differences and of counts, compressed."""
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        part = _partition(keys, self.partitions)
        bounds = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
        rows = [
            (b - a, _planes(np.diff(keys[a:b], prepend=np.uint64(0)), KEY_BITS // 8), _planes(counts[a:b].astype(np.uint64), 6))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(part[bounds[:-1]].astype(np.int32)), *(pa.array(c) for c in zip(*rows, strict=True))],
            schema=_PACKED,
        )


_PACKED = pa.schema([("part", pa.int32()), ("entries", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _stream(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _planes(numbers: np.ndarray, width: int) -> bytes:
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width])
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes, n: int, width: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


# --- counting -------------------------------------------------------------------------------


def _known(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _feed(s: Slice, c: _Counter, widths: range, words, pairs, longer) -> None:
    """Count the sequences of a slice. A bitmap that is None lets everything pass."""
    names = s.column("lang").to_pylist()
    numbers = np.array([c.language(n)[0] for n in names], np.int64)
    salts = np.array([c.language(n)[1] for n in names], np.uint64)
    of = s.text_of_word()
    hashes = mix(s.hashes(fold=True) ^ salts[of])
    if words is None:
        c.insert_words(hashes)
        return
    # ``linked`` says that a word goes on with the next one, in one piece of one text.
    broken = np.concatenate([[0], np.cumsum(BREAKS[s.data])])
    good = _known(words, phrase_keys(hashes, hashes))
    linked = (broken[s.starts[1:]] == broken[s.starts[:-1]]) & (of[1:] == of[:-1]) & good[1:] & good[:-1]
    if pairs is not None:
        linked &= _known(pairs, phrase_keys(hashes[:-1], _chain(hashes[:-1], hashes[1:])))
    starts = np.flatnonzero(linked)
    used = np.flatnonzero(good) if 1 in widths else np.unique(np.concatenate([starts, starts + 1]))
    ids = np.zeros(len(hashes), np.int64)
    ids[used] = c.lexicon.numbers(s, used, hashes[used], numbers[of[used]])
    if 1 in widths:
        c.insert_words(ids[used])
    whole = _chain(hashes[starts], hashes[starts + 1])
    for width in range(2, widths.stop):
        # From each of ``starts`` on ``width`` words are linked; ``whole`` has their hashes.
        if width in widths:
            chosen = starts
            if longer is not None and width > 2:
                chosen = starts[_known(longer, phrase_keys(hashes[starts], whole))]
            c.insert(ids[chosen[:, None] + np.arange(width)])
        last = starts + width - 1
        more = last < len(linked)
        more[more] = linked[last[more]]
        starts, whole = starts[more], _chain(whole[more], hashes[starts[more] + width])


def _count(docs: DataFrame, widths: range, texts: bool, *bitmaps) -> DataFrame:
    """Runs of the sequences of ``widths`` words, by key or, with ``texts``, by phrase. These have a
    further entry without phrase per language, the number of its words."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(bitmaps + (None,) * (3 - len(bitmaps)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, totals = _Counter(partitions, texts), {}
        for s in slices(batches):
            s = resplit(s, INSIDE)
            if texts:
                for name, n in zip(s.column("lang").to_pylist(), s.counts().tolist(), strict=True):
                    totals[name] = totals.get(name, 0) + n
            _feed(s, counter, widths, *shared.value)
            if counter.full():
                yield from counter.runs(HELD // 4)
        yield from counter.runs(0)
        if totals:
            none = np.zeros(len(totals), np.uint64)
            yield counter._text(none, pa.array(list(totals)), pa.array([""] * len(totals)), np.array(list(totals.values())))

    return docs.mapInArrow(run, RUN if texts else PACKED)


def _frequent_keys(docs: DataFrame, widths: range, least: int, *bitmaps) -> np.ndarray:
    """The bitmap of keys that at least ``least`` sequences of ``widths`` words have.
    """

    def merged(runs: list[dict]) -> pa.RecordBatch:
        keys = np.concatenate([np.cumsum(_numbers(r["keys"], r["entries"], KEY_BITS // 8), dtype=np.uint64) for r in runs])
        counts = np.concatenate([_numbers(r["counts"], r["entries"], 6) for r in runs])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        often = np.add.reduceat(counts[order], new) >= least
        return pa.RecordBatch.from_arrays([pa.array(keys[new[often]].view(np.int64))], ["key"])

    return bitmap(_merge(_count(docs, widths, False, *bitmaps), merged, "key bigint"))


def _merge(runs: DataFrame, merged: Callable[[list[dict]], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``merged`` makes of the runs of each prefix partition, one partition after the other."""
    partitions = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["part"] != held[-1]["part"]:
                    yield merged(held)
                    held = []
                held.append(row)
        if held:
            yield merged(held)

    dealt = runs.repartitionById(partitions, F.col("part")).sortWithinPartitions("part")
    return dealt.mapInArrow(work, schema)


def bitmap(frequent: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """One bit per key, as bytes. At most ``bits / 64`` numbers reach the driver."""
    slot = F.expr(f"(key & {bits - 1}) div 64").alias("slot")
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")
    gathered = frequent.select(slot, bit).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[gathered.column("slot").to_numpy()] = gathered.column("bits").to_numpy()
    return out.view(np.uint8)


def frequent_phrases(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n) of all phrases with ``least`` occurrences, (lang, words) of all languages)."""
    words = _frequent_keys(docs, range(1, 2), least)
    pairs = _frequent_keys(docs, range(2, 3), least, words) if longest > 1 else words
    longer = _frequent_keys(docs, range(3, longest + 1), least, words, pairs) if longest > 2 else pairs

    def merged(runs: list[dict]) -> pa.RecordBatch:
        rows = pa.concat_tables([pa.ipc.open_stream(r["run"]).read_all() for r in runs])
        summed = rows.group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(COUNTS.names)
        kept = summed.filter((pc.field("n") >= least) | (pc.field("phrase") == ""))
        return kept.select(COUNTS.names).cast(COUNTS).combine_chunks().to_batches()[0] if len(kept) else pa.RecordBatch.from_pylist([], COUNTS)

    runs = _count(docs, range(1, longest + 1), True, words, pairs, longer)
    kept = materialize(_merge(runs, merged, "lang string, phrase string, n bigint"), "counts")
    # The entries without phrase tell how many words a language has.
    return kept.filter("phrase <> ''"), kept.filter("phrase = ''").select("lang", F.col("n").alias("words"))


# --- scores ---------------------------------------------------------------------------------


def _score() -> Column:
    """``floor(1000 * a * n / (l * r))``; a quotient is at most 1000 * n and fits a long."""
    return F.expr(
        "(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(words as decimal(16,0)))"
        " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    )


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = MIN_COUNT,
    inside_percent: int = 100,
    top: int = 2000,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of every language.

    A phrase's score is that of its worst cut in two, ties to the earliest. Phrases inside a longer
    one that occurs ``inside_percent`` as often or more are left out. If a longer one is, so is one
    with a single word more, since it occurs at least as often; only these are looked at.
    """
    texts = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    counts, totals = frequent_phrases(texts, longest, least)
    split = F.split("phrase", " ")
    held = counts.withColumn("words", split).withColumn("len", F.size("words")).filter("len > 1")
    larger = held.filter("len > 2").select(
        "lang",
        F.explode(
            F.array(
                F.array_join(F.expr("slice(words, 1, len - 1)"), " "),
                F.array_join(F.expr("slice(words, 2, len - 1)"), " "),
            )
        ).alias("phrase"),
        F.col("n").alias("larger"),
    )
    larger = larger.groupBy("lang", "phrase").agg(F.max("larger").alias("larger"))
    open_ = held.join(larger, ["lang", "phrase"], "left").filter(
        F.col("larger").isNull() | (100 * F.col("larger") < inside_percent * F.col("n"))
    )
    open_ = materialize(open_.select("lang", "phrase", "words", "len", F.col("n").alias("a")), "phrases")
    cuts = open_.withColumn("k", F.explode(F.expr("sequence(1, len - 1)"))).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.expr("slice(words, 1, k)"), " ").alias("first"),
        F.array_join(F.expr("slice(words, k + 1, len)"), " ").alias("rest"),
    )
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    worst = F.min(F.struct(_score().alias("score"), "k", "l", "r")).alias("cut")
    best = scored.groupBy("lang", "phrase", "a", "words").agg(worst)
    best = best.select("lang", "phrase", "a", F.col("cut.l"), F.col("cut.r"), F.col("words").alias("n"), F.col("cut.score"))
    ranked = rank_in_group(best, [F.desc("score"), F.desc("a"), F.asc("phrase")], ["lang"])
    ranked = ranked.withColumn("rank", F.col("rank").cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
