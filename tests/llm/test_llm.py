"""The numbered operators and the pipeline: SQL twins, brute force, planted and odd cases."""

import base64
import collections
import json
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalog.checking import compare, duck
from gleaner.llm import chat, decontaminate, lines, lm, marks, mixing, neardup, quality, queries, secrets, sharding, substrings

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id bigint, text string, source string, shingle string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows and ids, one long text."""
    long = " ".join(f"w{i % 9000}" for i in range(40000))
    rows = [
        (1, None, "a", None), (2, "", None, "x"), (3, " \n\t", "a", "x"), (None, "some words here", None, None),
        (None, None, None, None), (4, "one", "b", "x"), (4, "one", "b", "x"), (5, "other text", "b", "x"),
        (5, "Other text", "b", "x"), (6, long, "c", "x"), (7, long, "c", "x"), (8, "a\n\nb c\na", "c", None),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, name):
    _, rows, message = compare(spark, duck(SF), queries.QUERIES[name], queries.SQL[name], SF)
    assert (message, rows > 0) == ("", True)


def operators(spark, df):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r"), (2, None)], "item_id bigint, text string")
    return {
        "shard": (lambda: sharding.shard_rows(df, 3), df.count()),
        "clean": (lambda: decontaminate.clean(df, items), df.count()),
        "judge": (lambda: quality.judge(df, [0] * quality.SLOTS), df.count()),
        "secrets": (lambda: secrets.report(secrets.scan(df)), df.count()),
        "cut": (lambda: substrings.cut(df), df.count()),
        "near": (lambda: neardup.near_duplicates(df), df.count()),
        "lines": (lambda: lines.report(df), df.select("doc_id").distinct().count()),
        "score": (lambda: lm.score(df), df.count()),
        "mix": (lambda: mixing.mix(df), df.count()),
    }


@pytest.mark.parametrize("name", ["shard", "clean", "judge", "secrets", "cut", "near", "lines", "score", "mix"])
def test_odd_rows_and_empty_tables(spark, odd, name):
    make, rows = operators(spark, odd)[name]
    assert make().count() == rows
    empty, _ = operators(spark, odd.limit(0))[name]
    assert empty().count() == 0


def test_shards_follow_the_ring_key_by_key(spark, docs):
    shards = 7
    got = sharding.shard_rows(docs.select("doc_id"), shards, virtual_nodes=8).collect()
    points = [(r.point, r.shard) for r in sharding.ring(spark, shards, 8).orderBy("arc").collect()]
    keys = [(r.h, r.doc_id) for r in docs.select("doc_id", sharding._hash("doc_id").alias("h")).collect()]
    room = sharding.bounds(len(keys), shards)
    left = [(sum(p < h for p, _ in points), h, k) for h, k in sorted(keys)]
    want, step = {}, 0
    while left:
        waiting = []
        for arc, h, key in left:
            shard = points[(arc + step) % len(points)][1]
            if room[shard]:
                room[shard] -= 1
                want[key] = shard
            else:
                waiting.append((arc, h, key))
        left, step = waiting, step + 1
    assert {r.doc_id: r.shard for r in got} == want
    counts = collections.Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))


def test_one_more_shard_moves_few_rows(spark, docs):
    before, after = (
        {r.doc_id: r.shard for r in sharding.shard_rows(docs.select("doc_id"), n, slack=0.25).collect()} for n in (10, 11)
    )
    assert sum(before[k] != after[k] for k in before) < 0.5 * len(before)


def test_decontamination_finds_whole_and_edited_items(spark, docs, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in texts.items() for i, b in items.items() if b in t}
    table = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.search(docs, table).collect()}
    assert whole <= found
    edited = []
    for i, b in items.items():
        w = b.split()
        w[len(w) // 3] = "altered"
        del w[2 * len(w) // 3]
        edited.append((i, " ".join(["before"] * 20 + w + ["after"] * 20)))
    changed = spark.createDataFrame(edited, "doc_id bigint, text string")
    again = {(r.doc_id, r.item_id) for r in decontaminate.search(changed, table).collect()}
    assert len(again & {(i, i) for i in items}) >= 0.95 * len(items)
    kept = {r.doc_id for r in decontaminate.clean(docs, table).collect()}
    assert kept == set(texts) - {d for d, _ in found}


def test_decontamination_finds_all_that_the_edit_distance_allows(spark):
    """Every length at the most edits it may have, among words that repeat, against the whole texts."""
    rng = np.random.default_rng(7)
    word = [f"v{i}" for i in range(40)]
    items, rows = {}, {}
    for n in range(2, 41):
        for again in range(4):
            k = n // 5
            w = [word[i] for i in rng.integers(0, 40, n)]
            items[4 * n + again] = list(w)
            for _ in range(k):
                at, kind = int(rng.integers(0, len(w))), "sid"[int(rng.integers(0, 3)) if again % 2 else 0]
                w[at : at + (kind != "i")] = [] if kind == "d" else [f"new{rng.integers(0, 9)}"]
            around = [[word[i] for i in rng.integers(0, 40, int(rng.integers(0, 60)))] for _ in range(2)]
            rows[4 * n + again] = around[0] + w + around[1]
    for twice in (200, 201):
        rows[twice] = rows[100] + rows[twice - 60] + rows[100]
    number = {w: i for i, w in enumerate({w for x in [*items.values(), *rows.values()] for w in x})}
    want = {}
    for i, b in items.items():
        b = np.array([number[w] for w in b], np.uint64)
        for d, t in rows.items() if len(b) >= 5 else ():
            t = np.array([number[w] for w in t], np.uint64)
            distance, end = decontaminate.edit_distance(b, t)
            if distance <= len(b) // 5:
                want[d, i] = (distance, end, decontaminate.edit_distance(b[::-1], t[:end][::-1])[1])
    assert all((i, i) in want for i, b in items.items() if len(b) >= 5)
    tables = [spark.createDataFrame([(i, " ".join(w)) for i, w in x.items()], f"{c} bigint, text string") for x, c in ((rows, "doc_id"), (items, "item_id"))]
    found = decontaminate.search(*tables).collect()
    assert {(r.doc_id, r.item_id): (r.distance, r.start_word + r.n_words, r.n_words) for r in found} == want
    assert {r.doc_id for r in decontaminate.clean(*tables).collect()} == set(rows) - {d for d, _ in want}


def test_near_groups_in_blocks_alone(spark, monkeypatch):
    """Without rounds of pivots, blocks of three nodes find what brute force finds."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(60, int(rng.integers(0, 8)), replace=False):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
    label = dict.fromkeys(sets)
    for i in sets:
        if label[i] is None:
            label[i], reached = i, [i]
            for a in reached:
                near = [b for b in sets if label[b] is None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
                label.update(dict.fromkeys(near, i))
                reached.extend(near)
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2)
    assert {r.doc_id: r.component_id for r in found.collect()} == label
    assert 1 < len(set(label.values())) < 60


def test_pairs_are_left_in_the_first_band_they_share(spark):
    """Near copies share many bands; sets are sent on for one of them, not for all."""
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"]))]
    found = neardup.prints(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, "doc_id", "text")
    nodes = found.select(F.col("id").alias("node"), "bands", "sketch")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").count().filter("count = 2").select("bucket")
    assert shared.count() > 20
    laid = neardup._laid(
        banded.join(shared, "bucket").select(
            "bucket", F.lit(0).alias("part"), (F.col("node") == 2).alias("own"), "node", F.col("node").alias("component")
        ).unionByName(
            shared.select("bucket", F.lit(0).alias("part"), F.lit(False).alias("own"), F.lit(2).cast("bigint").alias("node"), F.lit(2).cast("bigint").alias("component"))
        ),
        nodes,
    )
    left = neardup._worth_it(laid, 0.8).collect()
    assert sorted((r.node, r.own) for r in left) == [(1, False), (2, True)]
    first = next(x for x, y in zip(*[r.bands for r in found.orderBy("id").collect()], strict=True) if x == y)
    assert {r.bucket for r in left} == {first}


def test_texts_pass_marks_and_no_shuffle(spark, monkeypatch):
    """The sets of nodes with a partner are made from texts that no join has moved; other texts stay away."""
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(None, base), (1, base + " end"), (2, base + " end"), (2, "other words"), *[(i, f"a{i} b{i} c{i}") for i in range(3, 300)]]
    seen = []
    sets = neardup._sets
    monkeypatch.setattr(neardup, "_sets", lambda docs, width: (seen.append(docs), sets(docs, width))[1])
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in found if r.doc_id in (None, 1)} == {None: 1, 1: 1}
    assert sorted(r.component_id for r in found if r.doc_id == 2) == [1, 2]
    plan = seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_marks_leave_what_is_marked(spark):
    ids = spark.range(5000).select(F.when(F.col("id") > 0, F.struct(F.col("id").alias("a"), F.lit(None).cast("string").alias("b"))).alias("id"))
    bits = neardup.materialize(marks.marks(ids.filter("id is null or id.a % 5 = 0")), "marks")
    left = ids.filter(marks.marked(F.col("id"), bits)).select("id.a").collect()
    assert {None, *range(5, 5000, 5)} <= {r.a for r in left}
    assert len(left) < 1050
    assert ids.filter(marks.marked(F.col("id"), neardup.materialize(marks.marks(ids.limit(0)), "marks"))).isEmpty()


def test_pipeline_near_dedup_moves_only_texts_in_question(spark, monkeypatch):
    """Without broadcasts, most texts pass the stage unshuffled."""
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(None, base), (1, base + " end"), (1, base + " end"), (2, base + " end"), *[(i, f"a{i} b{i} c{i} " * 50) for i in range(3, 400)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(marks, "MARKS", 1 << 16)
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == [1, *range(3, 400)]
    plan = left._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and not any("Join" in n for n in _names(plan.children().head()))


def _names(plan):
    names = [plan.nodeName()]
    for i in range(plan.children().size()):
        names += _names(plan.children().apply(i))
    return names


def test_sets_of_single_lines_are_not_shuffled(spark, monkeypatch):
    """Only lines whose set comes again meet others; marks that two sets share lose none and add none."""
    monkeypatch.setattr(marks, "MARKS", 128)
    base = [f"w{i}" for i in range(20)]
    texts = [" ".join(base), "\t".join(reversed(base)) + "  \x0b w0\r", " ".join([*base[:19], "x"]), "  \n \t", None]
    texts += ["\n".join(f"a{i}k{j} b{i}k{j} c d e" for j in range(3)) for i in range(50)]
    texts += [texts[7], "e d c b2k0 a2k0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    sets, first, similar = {}, {}, collections.defaultdict(set)
    for d, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            if words := frozenset(re.findall(r"[^\x20\x09-\x0D]+", line)):
                sets[d, n] = words
                first[words] = min(first.get(words, (d, n)), (d, n))
    for a in first:
        similar[a] = {b for b in first if a != b and 100 * len(a & b) >= 80 * len(a | b)}
    want = {
        (d, n): ((d, n) > min([first[w], *(first[b] for b in similar[w])]), len(similar[w])) for (d, n), w in sets.items()
    }
    found = {(r.id, r.line_no): (r.removed, r.links) for r in lines.mark_lines(docs).collect()}
    assert found == want and sum(gone for gone, _ in want.values()) == 6

    with lines.passing(spark):
        made = lines.materialize(lines.line_sets(lines.split_lines(docs)), "sets")
        some = lines.classes(made)
        assert some.count() == len(first)
        plan = some._jdf.queryExecution().optimizedPlan()
        assert plan.nodeName() == "Union"
        assert not any("Join" in n or "Aggregate" in n for n in _names(plan.children().head()))


def test_levels_of_words_are_not_in_the_plan(spark, docs):
    """A literal of a byte per slot was printed into each description of the plan; the driver keeps those."""
    rows = docs.select("doc_id", "text")
    with lines.passing(spark):
        found = lines.classes(lines.line_sets(lines.split_lines(rows)))
        query = lines.candidates(lines.postings(found, lines.slot_levels(found)))._jdf.queryExecution()
        assert len(query.toString()) < lines.SLOTS // 4
        # No row carries the levels either: they are read where words are put in order.
        assert "AS _levels" not in query.optimizedPlan().toString()


def test_edit_distance():
    a, b = np.array([1, 2, 3, 4], np.uint64), np.array([9, 1, 3, 4, 9], np.uint64)
    assert decontaminate.edit_distance(a, b) == (1, 4)


def test_quality_counts(spark, docs, texts):
    for r in quality.judge(docs.select("doc_id", "text"), [0] * quality.SLOTS).collect():
        text = texts[r.doc_id]
        words = WORD.findall(text)
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
        spoken = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(spoken) - len(set(spoken)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_quality_scores(spark, docs):
    xxhash = pytest.importorskip("xxhash")
    rng = np.random.default_rng(5)
    weights = rng.integers(-300, 300, quality.SLOTS).tolist()

    def number(data: bytes, seed: int = 42) -> int:
        return np.uint64(xxhash.xxh64_intdigest(data, seed)).astype(np.int64).item()

    row = docs.filter("length(text) > 100").select("doc_id", "text").first()
    h = [number(w.encode()) for w in WORD.findall(row.text)]
    got = quality.judge(docs.filter(f"doc_id = {row.doc_id}").select("doc_id", "text"), weights).first()
    pairs = []
    for a, b in zip(h, h[1:], strict=False):
        first = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)
        pairs.append(np.uint64(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), first)).astype(np.int64).item())
    assert got.score == sum(weights[x % quality.SLOTS] for x in h + pairs)


def test_quality_tells_the_labels_apart(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights = quality.ratios(d, quality.trusted_ids(labels))
    judged = quality.judge(d.select("doc_id", "text"), weights).filter("not base_failed").join(labels, "doc_id")
    rows = judged.select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.2 * len(bad)


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_secrets_are_confirmed_by_structure():
    number = der(2, bytes([1]) * 64)
    key = der(0x30, der(2, b"\0"), *[number] * 8)
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(range(32))))
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()).decode().rstrip("=")
    token = f"{head}.{'QUJD' * 4}.{'c2ln' * 6}"
    for secret, kind in (
        (base64.b64encode(key).decode(), "der_key"), (key.hex().upper(), "der_key"),
        (base64.b64encode(ssh).decode(), "ssh_key"), (token, "signed_token"),
    ):
        assert secrets.confirmed_spans(f"see {secret} there") == [(kind, 4, 4 + len(secret))]
    broken = key[:1] + bytes([key[1], key[2], key[3] ^ 1]) + key[4:]
    assert secrets.confirmed_spans(base64.b64encode(broken).decode()) == []
    assert secrets.confirmed_spans("MAAA" * 20 + " AAAA" * 20 + " eyJub3Bl.QUJD.QUJDQUJDQUJDQUJD") == []


def ssh(*parts):
    return b"".join(len(x).to_bytes(4, "big") + x for x in parts)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", "\\r\\n", "\n    ", "\n\t"])
def test_wrapped_keys_of_every_size(end):
    """Lines of 64 and 70 characters, padded or not, before a line of base64 characters and after one."""
    for size in range(120, 220):
        number = der(2, bytes([1]) * 10)
        key = der(0x30, der(2, b"\0"), *[number] * 5, der(2, bytes([1]) * (size - 72)))
        public = ssh(b"ssh-rsa", b"\1\0\1", bytes([7]) * size)
        file = b"openssh-key-v1\0" + ssh(b"none", b"none", b"") + (1).to_bytes(4, "big") + ssh(b"k" * 51, b"p" * size)
        for data, kind in ((key, "der_key"), (public, "ssh_key"), (file, "ssh_key")):
            for width in (64, 70):
                for code in (base64.b64encode(data).decode(), base64.b64encode(data).decode().rstrip("=")):
                    secret = end.join(code[i : i + width] for i in range(0, len(code), width))
                    for before, after in (("-----BEGIN KEY-----" + end, end + "-----END KEY-----"), ("key ", end + "Thanks for"), ("a" * 30 + end, end + "ab")):
                        at = len(before)
                        assert secrets.confirmed_spans(before + secret + after) == [(kind, at, at + len(secret))], (size, kind, width, code, before)


def test_keys_on_lines_of_their_own():
    keys = [base64.b64encode(ssh(b"ssh-ed25519", bytes([i]) * 32)).decode().rstrip("=") for i in range(3)]
    text = "\n".join(keys)
    n = len(keys[0])
    assert secrets.confirmed_spans(text) == [("ssh_key", i * (n + 1), i * (n + 1) + n) for i in range(3)]
    assert secrets.confirmed_spans(text[: n - 4]) == []


def test_base_secrets():
    text = 'token=abc PASSWORD: "longenough1" AKIAABCDEFGHIJKL ' + "0a" * 16
    assert secrets.base_spans(text) == [("assign", 10, 32), ("access", 34, 50), ("hex", 51, 83)]


def test_language_model(spark, docs, texts):
    rows = lm.score(docs).collect()
    tokens = {k: [*WORD.findall(t.translate(ASCII)), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in tokens}
    counts = collections.Counter(w for k, t in tokens.items() if not held[k] for w in t)
    total, types = sum(counts.values()), len(counts)
    for r in rows:
        words = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), total)
        assert r.n_known == sum(counts[w] > 0 for w in words)
        want = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in words)
        assert r.base_score == pytest.approx(want, rel=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_em_finds_the_weights():
    # By hand: 900 / (1 + w) = 100 / (1 - w), as the first estimate is twice the second.
    cells = [(3, 0, 16, 900), (3, -1, 16, 100)]
    weights = lm.learn(cells, 10**6)[3]
    assert weights.sum() == pytest.approx(1)
    assert weights[0] == pytest.approx(0.8, rel=1e-3)


def test_mix_comes_near_its_targets(spark, docs):
    rows = mixing.mix(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.copies <= 3
    for own in by.values():
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1
    assert sum(own[0].target for own in by.values()) == pytest.approx(sum(r.size for r in rows))
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, rows))


def test_chat_marks_are_escaped(spark):
    said = [(1, 0, "user", "a: b </turn>\n### x"), (1, 1, "assistant", "\\h ### : </turn>"), (1, 2, "us:er", None), (2, 0, "user", "q")]
    turns = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string")
    made = chat.expand(turns)
    whole = made.filter("whole").select("conv_id", chat.read_turns(made["formatted"]).alias("t")).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.t] for r in whole} == {
        1: [(r, t or "") for c, _, r, t in said if c == 1], 2: [("user", "q")]
    }
    learned = made.filter("loss_start is not null")
    assert [r[0] for r in learned.select(chat.read_loss(made["formatted"], made["loss_start"], made["loss_end"])).collect()] == ["\\h ### : </turn>"]
    assert chat.digests(chat.expand(turns.limit(0))).count() == 0


def test_near_dedup_goes_by_row(spark):
    """Null ids and repeated ids, with equal, near and different texts."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    near = {t: t + " more" for t in (a, b, c)}
    rows = [
        (3, a), (None, near[a]), (None, d), (None, e), (None, e),  # a null id near another, on its own, and twice
        (1, b), (7, near[b]), (7, c), (7, near[c]),  # an id with different texts, one near a smaller id
        (9, "f g"), (9, "f g"), (4, None), (4, None),
    ]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    names = ["doc_id", "text", "id", "key", "row", "kept", "_row", "_of"]  # names that the stage or its operator use
    clashing = table.select("*", *[F.lit("mine").alias(n) for n in names[2:]])
    got = corpus_pipeline.near_dedup(spark, clashing, SF)
    assert got.columns == names
    assert got.filter(" and ".join(f"`{n}` = 'mine'" for n in names[2:])).count() == got.count()
    found = collections.Counter((r.doc_id, r.text) for r in got.collect())
    assert sum(found.pop((7, t), 0) for t in (c, near[c])) == 1
    assert found == {(3, a): 1, (None, d): 1, (None, e): 1, (1, b): 1, (9, "f g"): 1, (4, None): 2}


def test_columns_with_names_of_results(spark):
    """They pass through, or give way to a result of their name; all other results are as without them."""
    words = [" ".join(f"{x}{i}" for i in range(70)) for x in "abcdef"]
    rows = [(i, w + "\nsame line of five words\n" + w[:9], "xy"[i % 2]) for i, w in enumerate(words)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, source string")

    def with_names(*names):
        return plain.select("*", *[F.lit("mine").alias(n) for n in names])

    def same(got, want, passing):
        shared = ["doc_id", *[c for c in want.columns if c != "doc_id"]]
        assert sorted(got.select(*shared).collect()) == sorted(want.select(*shared).collect())
        assert len(set(got.columns)) == len(got.columns)
        assert all(got.filter(F.col(n) != "mine").isEmpty() for n in passing)

    own = ["_size", "_digest", "_u", "_source", "_id", "_row", "_copy"]
    named = with_names(*own, *mixing.RESULTS)
    same(mixing.mix(named), mixing.mix(plain), own)
    want = mixing.repeat(mixing.mix(plain), plain.columns)
    same(mixing.repeat(mixing.mix(named), [*plain.columns, *own]), want, own)
    same(corpus_pipeline.mix_sources(spark, named, SF), want, [*own, *mixing.RESULTS])
    flat = [0] * quality.SLOTS
    same(quality.judge(with_names("_verdict", "score", "kept", "n_words"), flat), quality.judge(plain, flat), ["_verdict"])
    names = ["removed_lines", "_id", "id", "own", "row", "n_lines"]
    same(lines.cut(with_names(*names)), lines.cut(plain), names)


def test_pipeline(spark, docs, texts):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.doc_id for r in rows} <= set(texts)
    sizes = collections.Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(corpus_pipeline.SHARDS)) <= 1
    assert max(collections.Counter(r.doc_id for r in rows).values()) <= 3
    sets = {}
    for r in rows:
        w = WORD.findall(r.text.translate(ASCII))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            assert 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
