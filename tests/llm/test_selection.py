"""Nearest neighbours, importance resampling and phrases against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from gleaner.llm import importance, neighbours, phrases, queries

SF = "/root/testdata/sf0.01"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = "vec_id bigint, embedding array<double>, query_id int, score string, rank int"


# --- nearest neighbours ---------------------------------------------------------------------


def brute(rows, queries_, k):
    """{query: [(id, cosine)]} over plain lists of numbers."""
    out = {}
    for q, a in queries_:
        best = {}
        for i, b in rows:
            if i != q and len(a) == len(b):
                a_, b_ = np.array(a, float), np.array(b, float)
                c = (a_ * b_).sum() / (np.sqrt((a_ * a_).sum()) * np.sqrt((b_ * b_).sum()))
                best[i] = max(best.get(i, -2), c)
        out[q] = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k]
    return out


def answers(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_recall_and_scores_of_the_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    got = answers(queries.QUERIES["op11_nearest_neighbours"](spark, SF))
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        true = dict(brute(rows, [(q, dict(rows)[q])], len(rows))[q])
        assert all(abs(true[i] - s) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 5 * len(want)


def test_neighbours_of_a_larger_table_with_a_hot_bucket(spark):
    rng = np.random.default_rng(5)
    loose = rng.normal(size=(4000, 32))
    tight = rng.normal(size=32) + 0.01 * rng.normal(size=(2000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([loose, tight]))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(8)
    asked = [rows[i] for i in range(0, 6000, 100)]
    got = answers(neighbours.nearest(df.filter("vec_id % 100 = 0"), df))
    data = np.array([v for _, v in rows])
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hits = {True: 0, False: 0}
    for q, _ in asked:
        cosine = unit @ unit[q]
        cosine[q] = -2
        hits[q >= 4000] += len(set(np.argsort(-cosine)[:5].tolist()) & {i for _, i, _ in got[q]})
    assert hits[True] >= 0.99 * 100 and hits[False] >= 0.9 * 200


def test_pieces_of_a_large_cell_are_spread():
    plan = neighbours.Plan.of({0: 3000, 1: 10, 2: 3000, 5: 1}, 8, 10)
    parts = plan.partition[plan.offsets[0] : plan.offsets[1]]
    assert len(parts) == len(set(parts.tolist())) == 10
    assert plan.offsets[2] - plan.offsets[1] == 1


def test_probes_begin_with_the_own_code():
    shape = neighbours.Shape(3, 2, 7, 16)
    unit = np.random.default_rng(1).normal(size=(20, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    own, probed = shape.codes(unit), shape.probed(unit)
    assert all(set(own[i]) <= set(probed[i]) for i in range(20))
    # The cheapest codes by trying all of them.
    turned = [np.concatenate([r, -r], axis=1) for r in (neighbours.rotate(unit, 1, j) for j in (0, 1))]
    costs = [(t.max(axis=1, keepdims=True) - t) ** 2 for t in turned]
    total = (costs[0][:, :, None] + costs[1][:, None, :]).reshape(20, -1)
    for i in range(20):
        assert set(np.argsort(total[i])[:7] + shape.per_table) == set(probed[i, 7:14])


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 0, "x", 1), (2, [2.0, 0.0], 0, "x", 1), (2, [2.0, 0.0], 0, "x", 1), (2, [0.0, 1.0], 0, "x", 1),
        (3, [0.5, 0.5], None, None, None), (4, None, 0, "x", 1), (5, [], 0, "x", 1), (6, [0.0, 0.0], 0, "x", 1),
        (7, [float("nan"), 1.0], 0, "x", 1), (8, [None, 1.0], 0, "x", 1), (None, [1.0, 1.0], 0, "x", 1),
        (9, [1.0, 0.0, 0.0], 0, "x", 1), (10, [float("inf"), 1.0], 0, "x", 1),
    ]
    df = spark.createDataFrame(rows, VECTORS)
    fit = [(i, v) for i, v, *_ in rows if i in (1, 2, 3, 9)]
    got = answers(neighbours.nearest(df, df))
    # Vector 9 is alone in its length and has no answer.
    for q in (1, 2, 3):
        want = {}
        for own in [v for i, v in fit if i == q]:
            for i, c in brute(fit, [(q, own)], 9)[q]:
                want[i] = max(want.get(i, -2), c)
        assert {i: s for _, i, s in got[q]} == pytest.approx(want)
    assert got.keys() == {1, 2, 3}
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
    assert neighbours.nearest(df.limit(0), df).count() == 0


# --- importance resampling ------------------------------------------------------------------


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def drawn(docs, target, longest, buckets, percent, least):
    def count(texts):
        return collections.Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, longest)[1])

    s, t = count(x for _, x in docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)
    ]
    rows = []
    for i, x in docs:
        words, f = features(x, longest)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, len(words) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): n for n, r in enumerate(able[: len(able) * percent // 100], 1)}
    return sorted((str(r[0]), *r[1:4], rank.get(id(r))) for r in rows)


@pytest.mark.parametrize("longest", [1, 3])
@pytest.mark.parametrize("head", [0, 50, 1 << 14])
def test_resampling_against_brute_force(spark, monkeypatch, longest, head):
    monkeypatch.setattr(importance, "HEAD_WORDS", head)
    monkeypatch.setattr(importance, "HEAD_PAIRS", head)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = drawn(rows, [r.text for r in target.collect()], longest, 997, 10, 20)
    got = importance.resample(docs, target, longest=longest, buckets=997).collect()
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in got) == [tuple(w) for w in want]


def test_crc_of_joined_strings():
    a, b = [b"", b"abc", "é".encode()], [b" ", b"", b"xyz" * 20]
    got = importance.joined(
        np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32), np.array([len(x) for x in b])
    )
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


ODD = [
    (1, None, "en", None), (2, "", None, 3), (3, " \n\t.", "en", 3), (None, "some words here", None, None),
    (None, None, None, None), (4, "One", "de", 3), (4, "One", "de", 3), (5, "É l'Été a1 " * 30, "de", 3),
    (6, " ".join(f"w{i % 700}" for i in range(40000)), "c", 3), (7, "x" * 300 + " y" * 40, "en", 3),
]


def test_resampling_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, weight string, rank int")
    target = spark.createDataFrame([(1, "é a1"), (2, None)], "item_id int, text string")
    want = drawn([r[:2] for r in ODD], ["é a1", None], 2, 101, 50, 20)
    got = importance.resample(df, target, longest=2, buckets=101, percent=50).collect()
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in got) == [tuple(w) for w in want]
    assert importance.resample(df.limit(0), target).count() == 0
    assert importance.resample(df, target.limit(0)).count() == len(ODD)


# --- phrases --------------------------------------------------------------------------------


def listed(docs, longest, least, percent, top):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    held = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    gone = set()
    for (lang, p), a in held.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                if 100 * a >= percent * counts[lang, p[i : i + n]]:
                    gone.add((lang, p[i : i + n]))
    rows = collections.defaultdict(list)
    for (lang, p), a in held.items():
        if (lang, p) not in gone:
            cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], totals[lang]))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n, -score)
        for lang, found in rows.items()
        for i, (score, a, p, left, right, n) in enumerate(sorted(found)[:top], 1)
    )


@pytest.mark.parametrize(("longest", "least", "percent", "top", "held"), [(5, 100, 100, 2000, 1 << 20), (4, 5, 60, 50, 200), (2, 3, 100, 10, 1 << 20)])
def test_phrases_against_brute_force(spark, monkeypatch, longest, least, percent, top, held):
    monkeypatch.setattr(phrases, "HELD", held)  # subtrees leave the trie early
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = listed([(r.lang, r.text) for r in docs.collect()], longest, least, percent, top)
    got = phrases.collocations(docs, longest, least, percent, top).collect()
    assert sorted(tuple(r) for r in got) == want


def test_wrong_bits_cost_no_result(spark, monkeypatch):
    monkeypatch.setattr(phrases.bitmap, "__defaults__", (64,))  # nearly everything may be frequent
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = listed([(r.lang, r.text) for r in docs.collect()], 3, 20, 100, 100)
    assert sorted(tuple(r) for r in phrases.collocations(docs, 3, 20, 100, 100).collect()) == want


def test_trie_bursts_and_spills_whole_subtrees():
    trie = phrases.BurstTrie(burst=4)
    want = collections.Counter()
    rng = np.random.default_rng(0)
    for _ in range(300):
        first, rest = int(rng.integers(3)), rng.integers(6, size=rng.integers(1, 4)).astype("<u4").tobytes()
        trie.add(first, [rest], [2])
        want[first, rest] += 2
    assert trie.entries == len(want) and isinstance(trie.roots[0], phrases._Branch)
    got = {}
    for first, rests, counts in trie.spill(len(want) // 2):
        got |= {(first, r): c for r, c in zip(rests, counts, strict=True)}
        assert first not in trie.roots
    assert trie.entries == len(want) - len(got) <= len(want) // 2
    for first, rests, counts in trie.spill(0):
        got |= {(first, r): c for r, c in zip(rests, counts, strict=True)}
    assert got == dict(want)


def test_phrases_of_odd_rows(spark):
    rows = [(b, a, c, d) for (_, a, c, d), b in zip(ODD * 2, ["en", None] * len(ODD), strict=True)]
    df = spark.createDataFrame(rows, "lang string, text string, phrase string, n int")
    got = phrases.collocations(df, 3, 4, 100, 20).collect()
    assert sorted(tuple(r) for r in got) == listed([r[:2] for r in rows], 3, 4, 100, 20)
    assert phrases.collocations(df.limit(0)).count() == 0
