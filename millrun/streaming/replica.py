"""Keyed table replica refreshed incrementally from a change feed.

Change rows (key columns, version columns, payload, optional delete flag)
land as files in a folder. A Structured Streaming query reads new files and,
per micro-batch, merges them into the replica: newest row per key wins
(an aggregate, so a hot key is combined map-side). A deleted key keeps its
delete row, hidden from readers, so an older row that comes late doesn't
bring it back. With ``trigger(availableNow=True)`` one call processes what
has arrived and stops, which is a triggered refresh.

The replica is a Parquet folder partitioned by a hash of the key. A batch merges
the partitions that its keys fall in and replaces just those by Spark's dynamic
partition overwrite, from a written copy of the merged rows, because what is
replaced is also read. Merging is idempotent, so a batch that is replayed gives
the same rows; a copy that was finished before a failure is used again. The
number of partitions follows the rows of the first refresh and is part of the
folder's names. Readers should run between refreshes.

``<root>/_checkpoint`` holds the stream's progress beside the data it is the
progress of, so any later session resumes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrun.sources.overrides import drop_table, path_exists

ROWS_A_PART = 2_000_000  # rows of the first refresh in a partition, about


def newest_per_key(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest version tuple, delete rows included."""
    payload = [c for c in df.columns if c not in keys and c not in version]
    best = F.max(F.struct(*version, *[F.col(c).alias(f"_p_{c}") for c in payload]))
    out = df.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, *[F.col(f"_b.{v}").alias(v) for v in version],
        *[F.col(f"_b._p_{c}").alias(c) for c in payload])
    return out.select(*df.columns)


def live(rows: DataFrame, delete_flag: str | None) -> DataFrame:
    """``rows`` without delete rows and their flag."""
    if not delete_flag:
        return rows
    return rows.filter(~F.coalesce(F.col(delete_flag), F.lit(False))).drop(delete_flag)


def merge(current: DataFrame | None, changes: DataFrame, keys: Sequence[str],
          version: Sequence[str]) -> DataFrame:
    """Rows after applying ``changes`` to ``current`` (upsert by key, newest wins).

    Both hold delete rows where the feed has them; :func:`live` hides them.
    """
    rows = changes if current is None else current.unionByName(changes.select(*current.columns))
    return newest_per_key(rows, keys, version)


def _stored(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame | None:
    """All rows with their partition (``parts``, ``part``), or None before the first refresh."""
    if not path_exists(spark, f"{root}/data"):
        return None
    placed = T.StructType([*schema.fields, T.StructField("parts", T.IntegerType()),
                           T.StructField("part", T.IntegerType())])
    return spark.read.schema(placed).parquet(f"{root}/data")


def read_replica(spark: SparkSession, root: str, schema: T.StructType,
                 delete_flag: str | None = None) -> DataFrame | None:
    """The replica's live rows, or None before the first refresh."""
    rows = _stored(spark, root, schema)
    return None if rows is None else live(rows.select(*schema.fieldNames()), delete_flag)


def _merge_batch(batch: DataFrame, batch_id: int, root: str, keys: Sequence[str],
                 version: Sequence[str], schema: T.StructType) -> None:
    spark = batch.sparkSession
    copy = f"{root}/_merged/batch={batch_id}"
    if not path_exists(spark, f"{copy}/_SUCCESS"):
        current = _stored(spark, root, schema)
        first = None if current is None else current.select("parts").first()
        parts = first["parts"] if first else batch.count() // ROWS_A_PART + 1
        placed = batch.select(*schema.fieldNames()).withColumn(
            "part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        if current is not None:
            touched = [r["part"] for r in placed.select("part").distinct().collect()]
            current = current.where(F.col("part").isin(touched)).drop("parts")
        merged = merge(current, placed, [*keys, "part"], version)
        merged.withColumn("parts", F.lit(parts)).write.mode("overwrite").parquet(copy)
    rows = spark.read.parquet(copy)
    (rows.repartition("part").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("parts", "part")
     .parquet(f"{root}/data"))
    drop_table(spark, f"{root}/_merged/batch={batch_id - 1}")


def refresh(spark: SparkSession, changes_dir: str, schema: T.StructType, replica_root: str,
            keys: Sequence[str], version: Sequence[str],
            max_files_per_trigger: int | None = None) -> int:
    """Process all change files that arrived since the last refresh; return batches run."""
    batches = []

    def apply(batch: DataFrame, batch_id: int) -> None:
        _merge_batch(batch, batch_id, replica_root, keys, version, schema)
        batches.append(batch_id)

    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (reader.parquet(changes_dir).writeStream
         .foreachBatch(apply)
         .option("checkpointLocation", f"{replica_root}/_checkpoint")
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return len(batches)
