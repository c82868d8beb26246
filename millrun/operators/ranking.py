"""Dense 1-based ranks inside groups without putting a whole group in one task.

A window ``row_number() over (partition by g order by k)`` sends every row of
``g`` to one task; with a hot group that task holds a third of the table.
Here the rows are range-partitioned on (g, k) (Spark samples the bounds),
numbered inside each range, and shifted by the row count of the group's
earlier ranges (a table of groups x ranges).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrun.session import Scratch


BUCKET_ROWS = 500_000  # rows in a range, about: what one window holds


def _bucketed(df: DataFrame, buckets: int | None, scratch: Scratch,
              name: str) -> tuple[DataFrame, int]:
    """``df``, and how many ranges to cut it into (from its row count, written first)."""
    if buckets:
        return df, buckets
    stored = scratch.write(df, name)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored, max(least, stored.count() // BUCKET_ROWS + 1)


def positions(df: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """``df`` with each row's 1-based place along a unique ``order``."""
    return dense_rank(df.withColumn("_all", F.lit(1)), ["_all"], order, df.columns, out).drop(
        "_all", "rid")


def range_ids(df: DataFrame, order: Sequence[Column], buckets: int,
              keep: Sequence[str]) -> DataFrame:
    """``keep`` columns + ``rid``: increasing along ``order``; ``rid >> 33`` is the range."""
    return (df.repartitionByRange(buckets, *order)
              .sortWithinPartitions(*order)
              .select(*keep, F.monotonically_increasing_id().alias("rid")))


def dense_rank_from_ids(ided: DataFrame, group: Sequence[str], out: str = "rank") -> DataFrame:
    """Rank by ``rid`` inside ``group`` (rid from :func:`range_ids`, written first)."""
    g = list(group)
    b = ided.withColumn("_bucket", F.shiftright(F.col("rid"), 33))
    local = b.withColumn("_local", F.row_number().over(
        Window.partitionBy(*g, "_bucket").orderBy("rid")))
    totals = b.groupBy(*g, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = totals.select(*g, "_bucket", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*g).orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return (local.join(offsets, [*g, "_bucket"])
                 .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
                 .drop("_bucket", "_local", "_offset"))


def dense_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column],
               keep: Sequence[str], out: str = "rank", buckets: int | None = None,
               scratch: Scratch | None = None) -> DataFrame:
    """``row_number() over (partition by group order by order)`` computed skew-safely.

    ``order`` must make rows unique within a group (add a key as last tie-break).
    The numbered rows are written once so the range assignment is fixed.
    """
    scratch = scratch or Scratch(df.sparkSession, "rank")
    df, buckets = _bucketed(df, buckets, scratch, f"rows_{out}")
    full_order = [F.col(c).asc_nulls_last() for c in group] + list(order)
    ided = scratch.write(range_ids(df, full_order, buckets, list(dict.fromkeys([*group, *keep]))),
                         f"ids_{out}")
    return dense_rank_from_ids(ided, group, out)


def running_total(df: DataFrame, order: Sequence[Column], value: str, keep: Sequence[str],
                  out: str = "cum", buckets: int | None = None,
                  scratch: Scratch | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` along a global ``order`` (unique), skew-safe.

    Sum inside each range of the order plus the totals of all earlier ranges
    (one row per range).
    """
    scratch = scratch or Scratch(df.sparkSession, "cumsum")
    df, buckets = _bucketed(df, buckets, scratch, f"rows_{out}")
    ided = scratch.write(range_ids(df, list(order), buckets,
                                   list(dict.fromkeys([*keep, value]))), f"ids_{out}")
    b = ided.withColumn("_bucket", F.shiftright(F.col("rid"), 33))
    local = b.withColumn("_local", F.sum(value).over(
        Window.partitionBy("_bucket").orderBy("rid")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    totals = b.groupBy("_bucket").agg(F.sum(value).alias("_t"))
    offsets = totals.select("_bucket", F.coalesce(F.sum("_t").over(
        Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_offset"))
    return (local.join(offsets, "_bucket")
                 .withColumn(out, F.col("_local") + F.col("_offset"))
                 .drop("_bucket", "_local", "_offset", "rid"))
