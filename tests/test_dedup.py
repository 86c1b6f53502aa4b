"""Scores, groups and picks: hand-worked cases, brute force, skew and invariance."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators import clustering, components, dedup, sampling, tiles
from gleaner.plans import coresets
from gleaner.streaming import streams

SCHEMA = "id bigint, cluster_id int, embedding array<float>, centroid_dist double, clip_score double"


def rows(spark, vectors, dist=None, cluster=None, score=None):
    n = len(vectors)
    return spark.createDataFrame(
        [
            (
                i,
                int(cluster[i]) if cluster is not None else 0,
                [float(x) for x in vectors[i]],
                float(dist[i]) if dist is not None else float(n - i),
                float(score[i]) if score is not None else 0.0,
            )
            for i in range(n)
        ],
        SCHEMA,
    ).repartition(3)


def random_vectors(n, dim=8, groups=12, seed=0, spread=0.25):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    return (centres[r.integers(0, groups, n)] + spread * r.normal(size=(n, dim))).astype(np.float32)


def unit(v):
    w = v.astype(np.float64)
    return w / np.linalg.norm(w, axis=1, keepdims=True)


def brute_scores(vectors, order, cluster):
    u = unit(vectors)
    best = {}
    for j in range(len(u)):
        before = [
            i for i in range(len(u)) if cluster[i] == cluster[j] and (order[i], i) < (order[j], j)
        ]
        best[j] = round(max([0.0] + [float(u[i] @ u[j]) for i in before]), 6)
    return best


def scores(df, **kw):
    return {r["id"]: round(r["semdedup_score"], 6) for r in dedup.semdedup_score(df, **kw).collect()}


def test_small_cases(spark):
    assert scores(rows(spark, [[1, 0]])) == {0: 0}
    assert scores(rows(spark, [[1, 0], [0, 1]])) == {0: 0, 1: 0}
    assert scores(rows(spark, [[1, 0], [-1, 0]])) == {0: 0, 1: 0}
    assert scores(rows(spark, [[1, 0], [1, 0]])) == {0: 0, 1: 1}
    assert scores(rows(spark, [[1, 0], [3, 0]])) == {0: 0, 1: 1}


def test_zero_vectors_are_reported_and_dropped(spark):
    df = rows(spark, [[1, 0], [0, 0], [0, 1]])
    assert [r["id"] for r in clustering.zero_vectors(df).collect()] == [1]
    assert sorted(scores(df)) == [0, 2]


@pytest.mark.parametrize("block_rows", [7, 40, 8192])
def test_scores_match_brute_force(spark, block_rows):
    """One cluster holds two thirds of the rows; blocks of any size give the same scores."""
    v = random_vectors(240)
    cluster = [0 if i % 3 else i % 5 for i in range(240)]
    r = np.random.default_rng(1)
    dist = np.round(r.random(240), 1)  # many ties
    df = rows(spark, v, dist, cluster)
    assert scores(df, block_rows=block_rows) == brute_scores(v, [-d for d in dist], cluster)


def test_copies_that_fill_a_third_of_the_table(spark):
    v = random_vectors(150)
    v[::3] = v[0]
    cluster = [0] * 150
    df = rows(spark, v, cluster=cluster)
    assert scores(df, block_rows=20) == brute_scores(v, [-(150 - i) for i in range(150)], cluster)
    links = dedup.linking_edges(df, 0.9, block_rows=20)
    assert links.count() < 150 * 8  # fewer links than rows per tile, no clique


@pytest.mark.parametrize("part_rows", [4, 512])
@pytest.mark.parametrize("block_rows", [10, 8192])
def test_edges_of_copies_are_all_pairs(spark, monkeypatch, block_rows, part_rows):
    """Copies are paired with one another and with all rows that any of them is similar to; ids may
    repeat, and rows without one are in no pair."""
    monkeypatch.setattr(dedup, "PART_ROWS", part_rows)
    v = random_vectors(90, groups=6)
    v[::3] = v[0]
    v[1::10] = v[1]
    cluster = [i % 2 if i % 5 else 2 for i in range(90)]
    ids = [None if i == 7 else 12 if i in (24, 25) else i for i in range(90)]
    table = [(i, c, [float(x) for x in w]) for i, c, w in zip(ids, cluster, v, strict=True)]
    df = spark.createDataFrame(table, "id bigint, cluster_id int, embedding array<float>").repartition(3)
    u = unit(v)
    expected = sorted(
        (cluster[i], min(ids[i], ids[j]), max(ids[i], ids[j]), round(float(u[i] @ u[j]), 5))
        for i in range(90)
        for j in range(i + 1, 90)
        if i != 7 and j != 7 and cluster[i] == cluster[j] and u[i] @ u[j] > 0.9
    )
    edges = dedup.similarity_edges(df, 0.9, block_rows=block_rows).collect()
    assert sorted((r["cluster_id"], r["src"], r["dst"], round(r["sim"], 5)) for r in edges) == expected


def test_edges_on_shifted_copies_of_a_table_match_the_sql(spark, tmp_path):
    """The registered query on a table that holds every vector three times."""
    from catalog import similarity

    v = random_vectors(60, dim=64, groups=5)
    table = [(1000 * k + i, i % 3, [float(x) for x in v[i]]) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(table, "vec_id bigint, label int, embedding array<float>")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = con.execute(similarity.SQL["similarity_edges_in_blocks"]).fetchall()
    assert len(expected) > 9 * 60
    for name in ("similarity_edges_in_blocks", "similarity_edges"):
        found = similarity.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(tuple(r) for r in found) == sorted(expected)


def brute_groups(v, cluster, threshold):
    u = unit(v)
    label = list(range(len(u)))
    changed = True
    while changed:
        changed = False
        for i in range(len(u)):
            for j in range(len(u)):
                if cluster[i] == cluster[j] and i != j and u[i] @ u[j] > threshold and label[j] != label[i]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return dict(enumerate(label))


@pytest.mark.parametrize("block_rows", [9, 8192])
def test_groups_match_brute_force(spark, block_rows):
    v = random_vectors(120, spread=0.35)
    cluster = [0 if i % 3 else i % 5 for i in range(120)]
    df = rows(spark, v, cluster=cluster)
    links = dedup.linking_edges(df, 0.9, block_rows=block_rows)
    found = {r["id"]: r["component"] for r in components.connected_components(df, links).collect()}
    assert found == brute_groups(v, cluster, 0.9)


def test_long_chain(spark):
    """A chain is the slowest graph for the star rounds."""
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = components.connected_components(spark.range(n + 2), edges.repartition(4))
    assert found.filter("component = 0").count() == n
    assert found.filter("id >= 300 and component = id").count() == 2


def test_hub(spark):
    edges = spark.range(1, 2000).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    found = components.connected_components(spark.range(2000), edges)
    assert found.filter("component <> 0").isEmpty()


def test_score_filter_and_groups_differ_on_a_chain(spark):
    """Order A, C, B with edges A-B and C-B only."""
    a, b, c = math.radians(0), math.radians(20), math.radians(40)
    v = [[math.cos(t), math.sin(t)] for t in (a, b, c)]
    t = math.cos(math.radians(25))
    df = rows(spark, v, dist=[0.9, 0.1, 0.5])
    kept = {r["id"] for r in dedup.threshold_filter(dedup.semdedup_score(df), t).collect()}
    assert kept == {0, 2}
    groups = components.connected_components(df, dedup.linking_edges(df, t))
    assert [r["id"] for r in components.pick_per_component(df, groups, "far").collect()] == [0]


@pytest.mark.parametrize("dist, expected", [([0.1, 0.2, 0.3, 0.4], 2), ([0.1, 0.2, 0.3], 1), ([0.5], 0)])
def test_middle_is_the_upper_median(spark, dist, expected):
    df = rows(spark, [[1, 0]] * len(dist), dist)
    groups = spark.range(len(dist)).select("id", F.lit(0).cast("bigint").alias("component"))
    assert [r["id"] for r in components.pick_per_component(df, groups, "middle").collect()] == [expected]


def test_score_max_takes_the_best_row_not_a_position(spark):
    df = rows(spark, [[1, 0]] * 4, score=[0.1, 0.2, 0.9, 0.9])
    groups = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 1)], "id bigint, component bigint")
    found = {r["component"]: r["id"] for r in components.pick_per_component(df, groups, "score-max").collect()}
    assert found == {0: 0, 1: 2}


def test_every_dropped_row_has_an_earlier_neighbour(spark):
    v = random_vectors(150)
    df = rows(spark, v)
    found = scores(df)
    u = unit(v)
    for j, s in found.items():
        if s > 0.9:
            assert any(u[i] @ u[j] > 0.9 for i in range(j))


def test_coreset_grows_with_the_threshold(spark):
    df = rows(spark, random_vectors(150))
    sweep = dedup.threshold_sweep(dedup.semdedup_score(df), [0.0, 0.5, 0.8, 0.9, 0.95, 1.0])
    kept = [r["n_kept"] for r in sweep.orderBy("threshold").collect()]
    assert kept == sorted(kept) and kept[-1] == 150
    groups = [
        components.connected_components(df, dedup.linking_edges(df, t)).select("component").distinct().count()
        for t in (0.5, 0.8, 0.95)
    ]
    assert groups == sorted(groups)


def test_threshold_for_fraction(spark):
    df = spark.range(100).select("id", (F.col("id") / 100).alias("semdedup_score"))
    assert dedup.threshold_for_fraction(df, 0.5) == 0.49
    assert dedup.threshold_filter(df, 0.49).count() == 50


@pytest.mark.parametrize("block_rows", [10, 8192])
def test_arrivals_match_a_sequential_reader(spark, block_rows):
    v = random_vectors(150, spread=0.3)
    cluster = [0 if i % 3 else i % 4 for i in range(150)]
    u = unit(v)
    kept = []
    for i in range(150):
        if all(cluster[i] != cluster[k] or u[i] @ u[k] <= 0.9 for k in kept):
            kept.append(i)
    df = rows(spark, v, cluster=cluster)
    one = streams.keep_first_arrivals(df, None, 0.9, block_rows=block_rows)
    assert sorted(r["id"] for r in one.collect()) == kept
    first = streams.keep_first_arrivals(df.filter("id < 60"), None, 0.9, block_rows=block_rows)
    second = streams.keep_first_arrivals(df.filter("id >= 60"), first, 0.9, block_rows=block_rows)
    assert sorted(r["id"] for r in first.union(second).collect()) == kept
    everything = streams.keep_first_arrivals(df, None, 1.0, block_rows=block_rows)
    assert everything.count() == 150


def test_assignment_in_blocks_and_ties(spark):
    v = random_vectors(200)
    centres = random_vectors(9, seed=5).astype(np.float64)
    centres[7] = centres[2]
    table = spark.createDataFrame([(i * 10, c.tolist()) for i, c in enumerate(centres)], "cluster_id int, centroid array<double>")
    expected = [int(np.linalg.norm(centres - x, axis=1).argmin()) * 10 for x in v.astype(np.float64)]
    df = rows(spark, v).select("id", "embedding")
    for limit in (1 << 20, 2 * 8 * 8):
        found = clustering.assign_clusters(df, table, limit=limit).orderBy("id").collect()
        assert [r["cluster_id"] for r in found] == expected


@pytest.mark.parametrize("limit", [1 << 30, 40 * 16 * 8, 7 * 16 * 8, 16 * 8])
def test_assignment_equals_brute_force_for_every_block(spark, monkeypatch, limit):
    monkeypatch.setattr(clustering, "CHUNK_ROWS", 100)
    r = np.random.default_rng(3)
    around = r.normal(size=(12, 16)) * 3
    centres = (around[:, None] + 0.3 * r.normal(size=(12, 10, 16))).reshape(120, 16)
    centres[50], centres[99] = centres[3], centres[3] + 1e-13  # equal and equal after rounding
    centres[60] = 0
    points = np.concatenate([around[r.integers(12, size=300)] + 0.4 * r.normal(size=(300, 16)), centres[[3, 60]], [np.full(16, 1e4)]])
    points[301] = 1e-9
    table = spark.createDataFrame([(1000 - i, c.tolist()) for i, c in enumerate(centres)], "cluster_id int, centroid array<double>")
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, embedding array<double>")
    apart = np.round(np.sqrt(((points[:, None] - centres[None]) ** 2).sum(axis=2)), 9)
    found = clustering.assign_clusters(df, table, limit=limit).orderBy("id").collect()
    for r_, row in zip(found, apart, strict=True):
        assert r_["cluster_id"] == min((d, 1000 - i) for i, d in enumerate(row))[1]
        assert abs(r_["centroid_dist"] - row.min()) < 2e-9


def test_groups_out_of_reach_are_skipped(monkeypatch):
    r = np.random.default_rng(0)
    around = r.normal(size=(40, 32)) * 5
    centres = (around[:, None] + 0.1 * r.normal(size=(40, 40, 32))).reshape(-1, 32)
    table = pa.table({"cluster_id": np.arange(1600), "centroid": list(centres)})
    index = clustering._Index(clustering._Block(table))
    compared = []
    real = clustering._Nearest._compare
    monkeypatch.setattr(clustering._Nearest, "_compare", lambda s, at, i, g: (compared.append(len(at) * (i.bounds[g + 1] - i.bounds[g])), real(s, at, i, g)))
    points = centres[r.integers(1600, size=500)] + 0.05 * r.normal(size=(500, 32))
    found = clustering._Nearest(points)
    found.visit(index)
    assert (found.ids == ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(compared) < 0.2 * 500 * 1600


def test_kmeans_opens_only_the_files_it_draws(spark, tmp_path):
    v = random_vectors(120)
    for i in range(6):
        np.save(tmp_path / f"{i:04d}.npy", v[20 * i : 20 * i + 20].astype(np.float32))
    before = clustering.train_kmeans_on_files(spark, str(tmp_path), 3, 2, 2, 2, seed=1)
    before = {r["cluster_id"]: r["centroid"] for r in before.collect()}
    names = spark.createDataFrame([(f"{i:04d}.npy",) for i in range(6)], "file string")
    drawn = {r["file"] for e in (0, 1) for r in sampling.sample_files(names, "file", 2, 1, e).collect()}
    assert 2 <= len(drawn) <= 4
    for i in range(6):
        if f"{i:04d}.npy" not in drawn:
            (tmp_path / f"{i:04d}.npy").write_bytes(b"")
    after = clustering.train_kmeans_on_files(spark, str(tmp_path), 3, 2, 2, 2, seed=1)
    assert {r["cluster_id"]: r["centroid"] for r in after.collect()} == before


def test_means_in_many_partial_sums(spark, monkeypatch):
    monkeypatch.setattr(clustering, "PARTIAL_BYTES", 1000)
    v = random_vectors(300)
    groups = [None if i % 7 == 0 else f"g{i % 7}" for i in range(300)]
    df = spark.createDataFrame([(g, x.tolist()) for g, x in zip(groups, v, strict=True)], "g string, embedding array<float>")
    found = {r["g"]: r["centroid"] for r in clustering.mean_vectors(df, "g", "embedding").collect()}
    assert found.keys() == set(groups)
    for g, mean in found.items():
        assert np.allclose(mean, v[[i for i in range(300) if groups[i] == g]].astype(float).mean(axis=0))


def test_kmeans_resumes_and_keeps_empty_clusters(spark, tmp_path):
    df = rows(spark, random_vectors(100)).select("id", "embedding")
    start = clustering.initial_centroids(df, 3, "id")
    far = spark.createDataFrame([(3, [1e6] * 8)], "cluster_id int, centroid array<double>")
    path = str(tmp_path / "c")
    first = clustering.train_kmeans(df, 4, 1, 2, "id", start=start.union(far), path=path)
    assert first.filter("cluster_id = 3").first()["centroid"] == [1e6] * 8
    both = clustering.train_kmeans(df, 4, 2, 2, "id", path=path)
    whole = clustering.train_kmeans(df, 4, 2, 2, "id", start=start.union(far), path=str(tmp_path / "d"))
    a, b = ({r["cluster_id"]: r["centroid"] for r in d.collect()} for d in (both, whole))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_plans_keep_a_subset(spark):
    v = random_vectors(200, groups=5, spread=0.1)
    df = rows(spark, v, score=np.linspace(0, 1, 200)).drop("cluster_id", "centroid_dist")
    centres = clustering.initial_centroids(df, 4, "id")
    by_score = coresets.score_coreset(df, centres, 0.9)
    by_graph = coresets.graph_coreset(df, centres, 0.9, "middle", [("clip_score", 0.0, 0.5)])
    for kept in (by_score, by_graph):
        found = [r["id"] for r in kept.collect()]
        assert found and len(set(found)) == len(found) and set(found) < set(range(200))


def test_logits_in_blocks(spark):
    from gleaner.operators import evaluation

    v = random_vectors(60)
    df = rows(spark, v, cluster=[i % 6 for i in range(60)]).select("id", "embedding", F.col("cluster_id").alias("label"))
    prototypes = evaluation.class_prototypes(df, "label")
    whole = evaluation.zero_shot_logits(df, prototypes)
    parts = evaluation.zero_shot_logits(df, prototypes, limit=2 * 8 * 8)
    a, b = ({r["id"]: r["logits"] for r in d.collect()} for d in (whole, parts))
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i]) for i in a)
    assert all(len(x) == 6 for x in a.values())


@pytest.mark.parametrize("spread", [0.03, 0.3])
def test_bounds_leave_nothing_out(spark, monkeypatch, spread):
    """Links, edges and scores above the floor are the same however early strips are stopped."""
    monkeypatch.setattr(tiles, "MIN_DIMENSIONS", 1)
    v = random_vectors(240, spread=spread)
    cluster = [0 if i % 3 else i % 5 for i in range(240)]
    df = rows(spark, v, cluster=cluster)
    u = unit(v)
    near = [
        (i, j) for i in range(240) for j in range(i + 1, 240) if cluster[i] == cluster[j] and u[i] @ u[j] > 0.95
    ]
    edges = dedup.similarity_edges(df, 0.95, block_rows=10)
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == near
    whole = components.connected_components(df, dedup.linking_edges(df, 0.95))
    parts = components.connected_components(df, dedup.linking_edges(df, 0.95, block_rows=10))
    assert parts.exceptAll(whole).isEmpty() and parts.count() == 240
    order = [-(240 - i) for i in range(240)]
    expected = {i: max(s, 0.95) for i, s in brute_scores(v, order, cluster).items()}
    assert scores(df, block_rows=10, floor=0.95) == expected


@pytest.mark.parametrize("few", [0.0, 0.02, 1.0])
@pytest.mark.parametrize("diagonal", [True, False])
def test_strips_stop_early_without_loss(monkeypatch, few, diagonal):
    monkeypatch.setattr(tiles, "FEW", few)
    monkeypatch.setattr(tiles, "STRIP_ENTRIES", 4000)
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 96)) * np.arange(1, 97) ** -0.5
    v[200:] = v[r.integers(20, size=100)] + 0.02 * r.normal(size=(100, 96))
    v = v @ np.linalg.qr(r.normal(size=(96, 96)))[0]
    side = np.zeros(300, int) if diagonal else r.integers(2, size=300)
    right = [0] * 300 if diagonal else [1] * 300
    table = pa.table(
        {"_cluster": [0] * 300, "_left": [0] * 300, "_right": right, "_side": side, "_id": np.arange(300), "_order": r.normal(size=300), "_vector": list(v)}
    )
    u = unit(v)
    want = {
        (i, j)
        for i in range(300)
        for j in range(i + 1, 300)
        if u[i] @ u[j] > 0.9 and (diagonal or side[i] != side[j])
    }
    assert len(want) > 100
    found = tiles.pairs_above(0.9)(table)
    assert set(zip(found["src"].to_pylist(), found["dst"].to_pylist(), strict=True)) == want
    floored = {r["_id"]: r["_best"] for r in tiles.above_floor(0.9)(table).to_pylist()}
    whole = {r["_id"]: r["_best"] for r in tiles.earlier_maxima(table).to_pylist()}
    assert floored == {i: max(0.9, s) for i, s in whole.items()}
    forest = tiles.forest_above(0.9)(table)
    label = np.arange(300)
    for a, b in sorted(want):
        label[label == max(label[a], label[b])] = min(label[a], label[b])
    parts = {i: int(label[i]) for i in range(300) if label[i] != i}
    assert dict(zip(forest["dst"].to_pylist(), forest["src"].to_pylist(), strict=True)) == parts


def test_small_blocks_do_not_multiply_the_rows_sent(spark):
    """300 blocks of one row: a row travels once per bundle, and no pair is lost or seen twice."""
    df = rows(spark, random_vectors(300, groups=30))

    def count(table):
        both = table.column("_side").to_pylist().count(1)
        n = table.num_rows
        pairs = (n - both) * both if both else n * (n - 1) // 2
        diagonal = table.column("_left")[0] == table.column("_right")[0]
        return pa.table({"_sent": [n], "_pairs": [pairs if diagonal or both else 0]})

    sent = tiles.self_tiles(df, "cluster_id", "id", "embedding", None, count, "_sent bigint, _pairs bigint", 1)
    found = sent.agg(F.sum("_sent").alias("sent"), F.sum("_pairs").alias("pairs")).first()
    assert found["pairs"] == 300 * 299 // 2
    assert found["sent"] <= 300 * tiles.FACING


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("close", [1.0, 1e-6])
def test_maxima_in_pieces_equal_the_full_product(monkeypatch, diagonal, close):
    """Also where 32 bits cannot tell the similarities apart. No piece exceeds the strip."""
    monkeypatch.setattr(tiles, "PIECE_ROWS", 16)
    monkeypatch.setattr(tiles, "STRIP_ENTRIES", 160)
    r = np.random.default_rng(5)
    v = r.normal(size=(1, 12)) * (close < 1) + close * r.normal(size=(90, 12))
    order = r.integers(0, 20, 90).astype(float)
    side = np.zeros(90, int) if diagonal else (np.arange(90) % 2)
    seen = []
    raised = tiles._raise
    monkeypatch.setattr(tiles, "_raise", lambda best, sims, *rest: (seen.append(sims.size), raised(best, sims, *rest)))
    table = pa.table(
        {"_cluster": [0] * 90, "_left": [0] * 90, "_right": [0 if diagonal else 1] * 90, "_side": side,
         "_id": np.arange(90), "_order": order, "_vector": pa.array(v.tolist())}
    )
    out = tiles.earlier_maxima(table)
    found = dict(zip(out.column("_id").to_pylist(), out.column("_best").to_pylist(), strict=True))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for i in range(90):
        before = [j for j in range(90) if (order[j], j) < (order[i], i) and (diagonal or side[i] != side[j])]
        assert found[i] == pytest.approx(max([0.0, *(u[before] @ u[i])]), abs=1.1e-9)
    assert seen and max(seen) <= 160


def test_a_vector_without_direction_hides_no_maximum():
    """Not those of the rows that share a piece with it."""
    v = np.array([[1.0, 0.0], [np.nan, 1.0], [1.0, 0.1]])
    table = pa.table(
        {"_cluster": [0] * 3, "_left": [0] * 3, "_right": [0] * 3, "_side": [0] * 3, "_id": np.arange(3),
         "_order": np.zeros(3), "_vector": pa.array(v.tolist())}
    )
    best = tiles.earlier_maxima(table).column("_best").to_pylist()
    assert best == pytest.approx([0.0, 0.0, 1 / 1.01**0.5], abs=1.1e-9)


def test_linked_rows_are_not_compared_again(monkeypatch):
    """A forest over many like rows finishes few pairs in double."""
    r = np.random.default_rng(3)
    v = np.ones((400, 64)) + 0.05 * r.normal(size=(400, 64))
    table = pa.table(
        {"_cluster": [0] * 400, "_left": [0] * 400, "_right": [0] * 400, "_side": [0] * 400, "_id": np.arange(400),
         "_order": np.zeros(400), "_vector": pa.array(v.tolist())}
    )
    monkeypatch.setattr(tiles, "PIECE_ROWS", 40)
    done = []
    joined = tiles._joined
    monkeypatch.setattr(tiles, "_joined", lambda label, a, b: (done.append(len(a)), joined(label, a, b))[1])
    found = tiles.forest_above(0.9)(table)
    assert found["src"].to_pylist() == [0] * 399
    assert sum(done) < 400 * 399 / 4
