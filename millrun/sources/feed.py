"""Change feed of a keyed table, made from two of its snapshots.

Rows of both snapshots meet by key in one aggregate (partial aggregates aren't needed: a
key has one row a side, and a key that repeats is an error), so the feed costs one exchange
of the two snapshots. Rows are compared as whole structs, null equal to null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrun.sources import catalog

# What happened to a row.
INSERT, BEFORE, AFTER, DELETE = "insert", "update_preimage", "update_postimage", "delete"
CHANGE_TYPE = "change_type"


def snapshot_changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``change_type`` and the columns of ``new``: what leads from ``old`` to ``new``.

    An update gives the row before and the row after. A null in a key is a key like any
    other. The query fails where a key repeats in a snapshot.
    """
    columns = new.columns
    row = F.struct(*columns)
    sides = (old.select(*columns).withColumn("is_new", F.lit(False))
             .unionByName(new.withColumn("is_new", F.lit(True))))
    met = sides.groupBy(*keys).agg(
        F.min(F.when(~F.col("is_new"), row)).alias("was"), F.count_if(~F.col("is_new")).alias("n0"),
        F.min(F.when(F.col("is_new"), row)).alias("now"), F.count_if("is_new").alias("n1"))
    kind = new.select(row.alias("r")).schema["r"].dataType
    once = F.when((F.col("n0") > 1) | (F.col("n1") > 1), F.raise_error(F.concat(
        F.lit("key repeats in a snapshot: "), F.concat_ws(", ", *[
            F.col(k).cast("string") for k in keys]))).cast(kind)).otherwise(F.col("now"))
    met = met.withColumn("now", once).where(~F.col("was").eqNullSafe(F.col("now")))

    def change(name: str, side: str):
        return F.struct(F.lit(name).alias(CHANGE_TYPE), F.col(side).alias("r"))

    events = (F.when(F.col("n0") == 0, F.array(change(INSERT, "now")))
              .when(F.col("n1") == 0, F.array(change(DELETE, "was")))
              .otherwise(F.array(change(BEFORE, "was"), change(AFTER, "now"))))
    return met.select(F.explode(events).alias("e")).select(f"e.{CHANGE_TYPE}", "e.r.*")


def table_changes(spark: SparkSession, table: str, before: DataFrame,
                  keys: Sequence[str]) -> DataFrame:
    """Changes of a catalog table since ``before``; its property ``change_feed`` must be set."""
    if catalog.table_properties(spark, table).get("change_feed") != "true":
        raise ValueError(f"{table} has no change feed: set its property change_feed to true")
    return snapshot_changes(before, spark.table(table), keys)


def as_refresh(changes: DataFrame, version: int) -> DataFrame:
    """The changes as rows for the replica refresh: newest state by key, ``deleted`` flagged."""
    return (changes.where(F.col(CHANGE_TYPE) != BEFORE)
            .withColumn("version", F.lit(version).cast("bigint"))
            .withColumn("deleted", F.col(CHANGE_TYPE) == DELETE).drop(CHANGE_TYPE))
