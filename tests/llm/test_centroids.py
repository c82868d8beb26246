"""Clusters against a plain loop over integers."""

import hashlib
import math

from pyspark.sql import functions as F

from conftest import SMALL
from millrun.llm import centroids, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, dims, k, rounds, salt="2", scale=256):
    """[(id, cluster, distance)], centroids of the rows (id, vector) that are clustered."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims
            and all(x is not None and math.isfinite(x) for x in v)]

    def place(row):
        i, v = row
        return (i is None, hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v)
    held = [v for _, v in sorted(kept, key=place)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(held))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            held[n] = [sum(xs) // len(vs) for xs in zip(*vs)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], held


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in
            spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want, held = plain(rows, 64, 40, 5)
    inertia = {}
    for _, c, d in want:
        inertia[c] = inertia.get(c, 0) + d
    got = queries.op13_centroids(spark, SMALL).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(want)
    for r in got:
        assert r["cluster_inertia"] == inertia[r["cluster"]]
        assert r["inertia"] == sum(inertia.values())
        assert r["centroid_sha256"] == hashlib.sha256(
            ",".join(map(str, held[r["cluster"]])).encode()).hexdigest()


def awkward():
    nan, inf = float("nan"), float("inf")
    return [(1, [0.5, -0.25], 0), (2, [0.5, -0.25], 1), (2, [0.5, -0.25], 1), (2, [-1.0, 3.0], 1),
            (3, None, 1), (4, [1.0], 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1),
            (7, [1.0, inf], 1), (8, [-inf, 1.0], None), (None, [2.0, 2.0], None),
            (None, None, None), (9, [], 2), (10, [1.0, 2.0, 3.0], 3), (11, [-0.001, 0.0], 3),
            (12, [100.0, -100.0], 3), (13, [99.0, -101.0], 3)]


def test_awkward_rows(spark):
    df = spark.createDataFrame(awkward(), SCHEMA).selectExpr(
        "*", "'x' as id", "'x' as v", "'x' as cluster", "'x' as distance", "'x' as vv")
    for k in (1, 3, 50):
        want, held = plain([r[:2] for r in awkward()], 2, k, 3)
        got, centres = centroids.cluster(df, dims=2, k=k, rounds=3)
        assert centres == held
        assert sorted(map(str, ((r["id"], r["cluster"], r["distance"]) for r in got.collect()))) \
            == sorted(map(str, want))
    report = centroids.cluster_report(df, dims=2, k=3, rounds=3)
    assert report.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                              "centroid_sha256"]
    assert report.count() == len(want) == 8


def test_empty_table_and_nothing_kept(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster_report(empty).count() == 0
    short = spark.createDataFrame([(1, [1.0], 0)], SCHEMA)
    assert centroids.cluster_report(short).count() == 0


def test_a_group_of_copies(spark):
    """A third of the rows are one vector; the partitioning doesn't change the result."""
    rows = [(i, [1.0, 1.0] if i % 3 == 0 else [i % 17 / 16, i % 5 / 4], 0) for i in range(300)]
    want, _ = plain([r[:2] for r in rows], 2, 6, 4)
    for parts in (1, 7):
        got, _ = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(parts),
                                   dims=2, k=6, rounds=4)
        assert sorted((r["id"], r["cluster"], r["distance"]) for r in got.collect()) == sorted(want)


def test_a_round_is_a_scan_with_a_partial_sum(spark):
    """Rows aren't shuffled in a round: only partial sums cross an exchange."""
    df = spark.createDataFrame([(i, [i / 9, 1.0], 0) for i in range(9)], SCHEMA)
    vectors = centroids.integer_vectors(df, "vec_id", "embedding", 2, 256)
    near = centroids.nearest(F.col("v"), F.col("vv"), [[1, 2], [3, 4]])
    plan = vectors.select(near["cluster"].alias("c"), "v").groupBy("c").agg(
        F.sum(F.get("v", 0)))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan and plan.count("Exchange") == 1
