from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from redbuild.functions import vectors as V
from redbuild.operators import dedup as D
from redbuild.operators import cells as M
from redbuild.operators import density as Y
from redbuild.operators import neighbours as N


def cloud(n, seed, dims=6, groups=3):
    """Points with exact copies, chains of near copies and loners."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    for i in range(1, n):
        move = rng.random()
        if move < 0.2:
            base[i] = base[i - 1]
        elif move < 0.6:
            base[i] = base[i - 1] + rng.normal(scale=0.02, size=dims) * np.linalg.norm(base[i - 1])
    base = base / np.linalg.norm(base, axis=1)[:, None]
    return [(int(i % groups), int(i), [float(x) for x in v]) for i, v in enumerate(base)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, id long, vec array<double>")


def brute_components(rows, radius):
    label = {i: i for _, i, _ in rows}
    changed = True
    while changed:
        changed = False
        for g, i, v in rows:
            for h, j, w in rows:
                if g == h and np.linalg.norm(np.subtract(v, w)) <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def brute_keep(rows, above):
    kept = []
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        if not any(g == h and np.dot(v, w) > above for h, _, w in kept):
            kept.append((g, i, v))
    return {i for _, i, _ in kept}


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_components_and_greedy_keep_equal_brute_force(spark, block_rows):
    rows = cloud(60, 3)
    points = frame(spark, rows)
    got = {r["id"]: r["label"] for r in N.components(points, 0.1, block_rows).collect()}
    assert got == brute_components(rows, 0.1)
    assert len(set(got.values())) < 50
    kept = {r["id"] for r in N.greedy_keep(points, 0.85, block_rows).collect()}
    assert kept == brute_keep(rows, 0.85)
    assert len(kept) < 50


@pytest.mark.parametrize("broadcast_rows", [5, 1000])
def test_nearest_equals_brute_force(spark, broadcast_rows):
    stored = cloud(40, 5)
    queries = cloud(25, 6)
    got = {}
    found = N.nearest(
        frame(spark, queries), frame(spark, stored), 3, "l2", block_rows=7, broadcast_rows=broadcast_rows
    )
    for r in found.collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["stored_id"]
    for _, i, v in queries:
        want = sorted((round(float(np.sum(np.subtract(v, w) ** 2)), 9), j) for _, j, w in stored)[:3]
        assert [got[i][k] for k in (1, 2, 3)] == [j for _, j in want]


def test_threshold_drops_far_points(spark):
    rows = [(0, 1, [1.0, 0.0])]
    stored = [(0, 7, [0.0, 1.0]), (0, 8, [1.0, 0.05])]
    found = N.nearest(frame(spark, rows), frame(spark, stored), 1, "cosine", at_least=0.92).collect()
    assert [r["stored_id"] for r in found] == [8]
    assert N.nearest(frame(spark, rows), frame(spark, stored[:1]), 1, "cosine", at_least=0.92).collect() == []


def test_representatives_cover_copies_clusters_and_noise(spark):
    rows = [
        (0, 1, [1.0, 0.0, 0.0]), (0, 2, [1.0, 0.0, 0.0]), (0, 3, [0.999, 0.03, 0.0]),
        (0, 4, [0.0, 1.0, 0.0]), (0, 5, [0.0, 0.9, 0.4]), (0, 6, [0.0, 0.0, 1.0]), (1, 9, [0.0, 0.0, 1.0]),
    ]
    got = {(r["g"], r["id"]): r["kind"] for r in D.representatives(frame(spark, rows), block_rows=2).collect()}
    # 1, 2, 3 form a cluster whose mean lies nearest to the copies; 5 is near 4.
    assert got == {(0, 1): "cluster", (0, 4): "noise", (0, 6): "noise", (1, 9): "noise"}


def test_vector_functions(spark):
    row = spark.range(1).select(
        V.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"),
        V.squared_l2(F.array(F.lit(1.0)), F.array(F.lit(3.0))).alias("d"),
        V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"),
        V.hashed_words(F.lit("b a a")).alias("x"), V.hashed_words(F.lit("a b a")).alias("y"),
        V.hashed_words(F.lit("")).alias("z"),
    ).head()
    assert np.allclose(row["u"], [0.6, 0.8]) and row["d"] == 4 and abs(row["c"] - 0.70710678) < 1e-7
    assert row["x"] == row["y"] and abs(np.linalg.norm(row["x"]) - 1) < 1e-6 and not any(row["z"])


@pytest.mark.parametrize("broadcast_rows", [5, 100_000])
def test_copies_make_no_more_than_k_rows(spark, broadcast_rows):
    same = F.array(*[F.lit(1.0)] * 4)
    queries = spark.range(2_000).select("id", same.alias("vec"))
    stored = spark.range(20_000).select((20_000 - F.col("id")).alias("id"), same.alias("vec"))
    got = N.nearest(queries, stored, 3, "l2", broadcast_rows=broadcast_rows)
    assert got.count() == 6_000
    assert got.groupBy("stored_id").count().orderBy("stored_id").collect() == [(1, 2_000), (2, 2_000), (3, 2_000)]


def test_medoids_of_wide_vectors(spark, monkeypatch):
    points = frame(spark, cloud(80, 5))
    clustered = D.clusters(points).checkpoint()
    want = sorted(D.medoids(clustered).collect())
    monkeypatch.setattr(D, "WIDE", 2)
    assert sorted(D.medoids(clustered).collect()) == want and want
    with pytest.raises(ValueError):
        D.medoids(clustered.withColumn("vec", F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0))).otherwise(F.col("vec"))))


def clouds(n, centres, dims, seed, spread=0.05):
    """Points around a few centres; one centre holds a third of them, every tenth point is a copy."""
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(1).normal(size=(centres, dims))
    at = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, centres, n))
    points = middle[at] + rng.normal(scale=spread, size=(n, dims))
    points[9::10] = points[8::10][:len(points[9::10])]
    return points


def as_frame(spark, points, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(points)], "id long, vec array<double>")


@pytest.mark.parametrize("metric, at_least", [("l2", None), ("cosine", None), ("cosine", 0.9)])
def test_cells_find_what_a_full_search_finds(spark, metric, at_least):
    stored, queries = clouds(600, 12, 5, 2), clouds(90, 12, 5, 3)
    stored[5], stored[6], queries[4], queries[7] = 0.0, 0.0, 0.0, 40.0  # no direction; far from everything
    found = N.nearest(
        as_frame(spark, queries), as_frame(spark, stored, 1_000), 4, metric, at_least, block_rows=50, broadcast_rows=10
    )
    got = sorted((r["id"], r["rank"], r["stored_id"], r["value"]) for r in found.collect())
    whole = N.nearest(as_frame(spark, queries), as_frame(spark, stored, 1_000), 4, metric, at_least)
    assert got == sorted((r["id"], r["rank"], r["stored_id"], r["value"]) for r in whole.collect())
    assert len(got) == 360 if at_least is None else 0 < len(got) < 360


def test_cells_leave_out_most_pairs(spark):
    stored, queries = as_frame(spark, clouds(3_000, 40, 8, 2)), as_frame(spark, clouds(500, 40, 8, 3))
    space, dealt = M.deal(stored, "l2", 3_000, 64)
    visits = queries.select("id", F.explode(M.cells_within(space, F.lit(0.3))).alias("cell"))
    share = M.pair_share(visits, dealt, 500)
    # A third of both sides lies around one centre: a ninth of all pairs there alone, if nothing tells them apart.
    assert 0 < share < 0.2
    near = {(r["id"], r["cell"]) for r in visits.collect()}
    where = {r["id"]: r["cell"] for r in dealt.collect()}
    a, b = clouds(500, 40, 8, 3), clouds(3_000, 40, 8, 2)
    close = np.argwhere(((a[:, None] - b[None]) ** 2).sum(axis=2) <= 0.09)
    assert len(close) and all((i, where[j]) in near for i, j in close)


def test_groups_in_cells_equal_groups_whole(spark):
    rows = [(0, i, [float(x) for x in v]) for i, v in enumerate(clouds(300, 10, 4, 8, 0.03))]
    rows += [(1, 1_000 + i, [float(x) for x in v]) for i, v in enumerate(clouds(12, 3, 4, 9, 0.03))]
    rows += [(0, 2_000, [float("nan")] * 4), (0, 2_001, [float("inf")] * 4), (0, 2_002, [0.0] * 4), (0, 2_003, [0.0] * 4)]
    points = frame(spark, rows)
    for walk in (lambda n: N.components(points, 0.05, n), lambda n: N.greedy_keep(points, 0.99, n)):
        small, large = sorted(map(tuple, walk(40).collect())), sorted(map(tuple, walk(100_000).collect()))
        assert small == large and {2_000, 2_001} <= {r[1] for r in large}
    got = {r["id"]: r["label"] for r in N.components(points, 0.05, 40).collect()}
    assert got == brute_components(rows, 0.05) and len(set(got.values())) < 250


def test_no_cells_of_nothing(spark):
    none = frame(spark, [])
    assert N.components(none, 0.1).collect() == [] and N.greedy_keep(none, 0.85).collect() == []
    strange = spark.createDataFrame([(1, [float("nan")])], "id long, vec array<double>")
    assert N.nearest(strange, strange, 1, "l2", broadcast_rows=0).collect() == []


def folder_bytes(spark):
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_vectors_without_structure_are_not_copied_into_cells(spark):
    rng = np.random.default_rng(3)
    N.ensure_checkpoints(spark)
    stored, queries = rng.normal(size=(2_000, 32)), rng.normal(size=(3_000, 32))
    known, asked = as_frame(spark, stored).checkpoint(), as_frame(spark, queries, 10_000).checkpoint()
    before = folder_bytes(spark)
    got = {r["id"]: r["stored_id"] for r in N.nearest(asked, known, 1, "cosine", 0.1, broadcast_rows=0).collect()}
    cosines = (queries / np.linalg.norm(queries, axis=1)[:, None]) @ (stored / np.linalg.norm(stored, axis=1)[:, None]).T
    assert got == {10_000 + i: int(c.argmax()) for i, c in enumerate(cosines) if c.max() >= 0.1}
    assert folder_bytes(spark) - before < 6 * 5_000 * 32 * 8
    points = known.select(F.lit(0).alias("g"), "id", "vec")
    for walk in (lambda: N.greedy_keep(points, 0.5, 500), lambda: N.components(points, 4.5, 500), lambda: Y.spanning_forest(points.filter("id < 600"), 3.0, 200)):
        before = folder_bytes(spark)
        assert walk().count() > 500
        assert folder_bytes(spark) - before < 15 * 2_000 * 32 * 8


def test_clusters_compare_a_group_once(spark):
    from redbuild.operators import dedup

    points = spark.createDataFrame([(1, i, [1.0, 0.01 * i]) for i in range(5)], "g int, id int, vec array<double>")
    found = dedup.clusters(points)
    assert "InPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], r["label"], r["members"]) for r in found.collect()) == [(i, 0, 5) for i in range(5)]


def folders_with_vectors(spark, run):
    """Folders of Parquet with vectors, and checkpoints, that run() leaves in the checkpoint folder."""
    top = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = {p.name for p in top.iterdir()}
    run().count()
    new = [p for p in top.iterdir() if p.name not in before]
    return [p.name for p in new if p.name.startswith("rdd-") or any("vec" in pq.read_schema(f).names for f in p.rglob("*.parquet"))]


def test_vectors_of_large_groups_are_written_once(spark):
    points = frame(spark, cloud(60, 5))
    for run in (lambda: N.greedy_keep(points, 0.85, 4), lambda: N.components(points, 0.1, 4), lambda: Y.spanning_forest(points, block_rows=4)):
        left = folders_with_vectors(spark, run)
        assert len(left) == 1 and left[0].startswith("shelves-"), left


def test_queries_of_a_search_on_shelves_stay_where_they_are(spark):
    points = frame(spark, cloud(60, 6)).select("id", "vec")
    found = N.nearest(points, points, 2, "l2", block_rows=8, broadcast_rows=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan, plan
    whole = N.nearest(points, points, 2, "l2")
    assert sorted(found.select("id", "stored_id", "rank").collect()) == sorted(whole.select("id", "stored_id", "rank").collect())


def test_queries_with_equal_ids_are_one_query(spark, tmp_path):
    """Whatever tasks they are read in."""
    from redbuild.plans.registered import knn_votes

    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4)], int(i % 3)) for i in range(60)]
    votes = []
    for name, twice in (("once", rows), ("twice", [*rows, *rows])):
        spark.createDataFrame(twice, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        found = knn_votes(spark, f"{tmp_path}/{name}").groupBy("id").agg(F.sum("share").alias("s"), F.max("first_rank").alias("last")).collect()
        votes.append({r["id"]: (round(r["s"], 4), r["last"] <= 3) for r in found})
    assert votes[0] == votes[1] == {i: (1.0, True) for i in votes[0]}
