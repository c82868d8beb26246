"""Clustering of integer vectors around centroids, in JVM expressions.

Vectors are scaled to integers. Every round holds the centroids as one literal array in the
plan: ``zip_with`` and ``aggregate`` give the squared distance of a vector to each of them,
``array_min`` over structs of distance and number picks the nearest (ties: the smaller
number), and a hash aggregate with one sum a component, in generated code, gives the sums
that move the centroids. Only the sums (centroids x components) reach the driver. No row is
shuffled in a round: it is a scan with a partial aggregate.

All arithmetic is on integers, so results don't depend on the partitioning.

Defined cases: rows whose vector is null, has another length, or holds a null or non-finite
component aren't clustered and aren't returned; rows with a null id are clustered but only
start a centroid after all others; repeated rows count each, and of equal ids the lesser
vector starts first; with fewer rows than centroids each row starts one; an empty table
gives an empty result; a component of 2**26 or more after scaling is an error (squared
distances would leave 64 bits); other columns have any name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrun.session import Scratch

LIMIT = 1 << 26
ROWS_A_TASK = 100_000


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int,
                    scale: int) -> DataFrame:
    """(id, v, vv): the rows with ``dims`` finite components, each times ``scale``, rounded
    down, and their product with themselves."""
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x)
                   | (F.abs(x.cast("double")) == float("inf")))

    def scaled(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < LIMIT, F.floor(y)).otherwise(
            F.raise_error(F.lit(f"a scaled component is {LIMIT} or more")).cast("bigint")) \
            .cast("bigint")

    kept = df.where(vector.isNotNull() & (F.size(vector) == dims) & ~bad).select(
        F.col(id_col).alias("id"), F.transform(vector, scaled).alias("v"))
    return kept.withColumn("vv", F.aggregate(
        F.transform("v", lambda x: x * x), F.lit(0).cast("bigint"), lambda s, x: s + x))


def start(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors whose ids have the least SHA-256 of ``salt:id``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    chosen = vectors.select(digest.alias("digest"), "v").orderBy(
        F.col("digest").asc_nulls_last(), "v").limit(k)
    return [list(r["v"]) for r in chosen.collect()]


def nearest(vector: Column, square: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; ``square``: the vector's own product.

    The squared distance is ``vv + cc - 2 vc``: the literal holds ``-2 c`` and ``cc``.
    """
    held = F.expr("array({})".format(", ".join(
        "struct({} as cluster, {}L as square, array({}) as twice)".format(
            number, sum(x * x for x in c), ", ".join(f"{-2 * x}L" for x in c))
        for number, c in enumerate(centroids))))

    def measured(c: Column) -> Column:
        products = F.zip_with(vector, c["twice"], lambda a, b: a * b)
        distance = F.aggregate(products, square + c["square"], lambda s, x: s + x)
        return F.struct(distance.alias("distance"), c["cluster"].alias("cluster"))

    return F.array_min(F.transform(held, measured))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid that has vectors, replaced by their mean, rounded down."""
    dims = len(centroids[0])
    sums = (vectors.select(nearest(F.col("v"), F.col("vv"), centroids)["cluster"].alias("cluster"), "v")
            .groupBy("cluster").agg(F.count(F.lit(1)).alias("n"),
                                    *[F.sum(F.get("v", i)).alias(f"s{i}") for i in range(dims)]))
    out = [list(c) for c in centroids]
    for r in sums.collect():  # one row a centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
            dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5,
            salt: str = "2") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every vector after ``rounds`` rounds, and the centroids."""
    scratch = Scratch(df.sparkSession, "centroids")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                df.count() // ROWS_A_TASK + 1)  # rounds cost CPU, not bytes: small files
    vectors = scratch.write(integer_vectors(df, id_col, vector_col, dims, scale)
                            .repartition(parts), "vectors")
    centroids = start(vectors, k, salt)
    if not centroids:
        return vectors.select("id", F.lit(0).alias("cluster"),
                              F.lit(0).cast("bigint").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    assigned = vectors.select("id", nearest(F.col("v"), F.col("vv"), centroids).alias("near")).select(
        "id", "near.cluster", "near.distance")
    return scratch.write(assigned, "assigned"), centroids


def cluster_report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                   **parameters) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector."""
    assigned, centroids = cluster(df, id_col, vector_col, **parameters)
    sums = {r["cluster"]: r["s"] for r in  # one row a centroid
            assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    per_cluster = F.array(*[F.lit(sums.get(c, 0)).cast("bigint")
                            for c in range(max(1, len(centroids)))])
    digests = F.array(*[F.lit(digest(c)) for c in centroids or [[]]])
    return assigned.select(
        F.col("id").alias(id_col), "cluster", "distance",
        F.get(per_cluster, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        F.get(digests, F.col("cluster")).alias("centroid_sha256"))
