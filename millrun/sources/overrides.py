"""Append-only log of manual assignment overrides (a Parquet table).

The log is partitioned by month. Rows arrive in batches under a request id; a batch that
is sent again adds nothing. Small files of a month are rewritten into few, from a written
copy and by Spark's dynamic partition overwrite, so that other months aren't touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrun import schemas
from millrun.operators.ranking import positions
from millrun.session import Scratch

OVERRIDE_COLUMNS = ["order_id", "machine_id", "assigned_by", "assigned_at", "notes"]

STORED = T.StructType([*schemas.ASSIGNMENT_OVERRIDES.fields,
                       T.StructField("request_id", T.StringType()),
                       T.StructField("month", T.StringType())])

# Column headers of the override history table.
DISPLAY_NAMES = {"order_id": "Order ID", "machine_id": "Machine ID",
                 "assigned_by": "Assigned By", "assigned_at": "Assigned At", "notes": "Notes"}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the path (works on any store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def create_table(spark: SparkSession, path: str, replace: bool = False) -> None:
    """Create an empty override table (drop first when ``replace``)."""
    if replace:
        drop_table(spark, path)
    if not path_exists(spark, path):
        spark.createDataFrame([], STORED).write.partitionBy("month").parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    if path_exists(spark, path):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def append_batch(spark: SparkSession, path: str, rows: DataFrame, request_id: str) -> None:
    """Append ``rows`` (order_id, machine_id, assigned_by, notes) stamped with the server time.

    Idempotent by ``request_id``: nothing is added where the log has that request.
    """
    if not _log(spark, path).where(F.col("request_id") == request_id).isEmpty():
        return
    stamped = rows.withColumn("assigned_at", F.current_timestamp()).withColumn(
        "request_id", F.lit(request_id)).withColumn("month", F.date_format("assigned_at", "yyyy-MM"))
    stamped.select(*STORED.fieldNames()).write.mode("append").partitionBy("month").parquet(path)


def add_override(spark: SparkSession, path: str, order_id: str, machine_id: str,
                 assigned_by: str, notes: str | None = None,
                 request_id: str | None = None) -> None:
    """Append one override stamped with the server time (S12)."""
    row = spark.createDataFrame([(order_id, machine_id, assigned_by, notes)],
                                "order_id string, machine_id string, assigned_by string, "
                                "notes string")
    append_batch(spark, path, row, request_id or uuid.uuid4().hex)


def compact(spark: SparkSession, path: str, max_files: int = 16,
            rows_a_file: int = 1_000_000) -> list[str]:
    """Rewrite the months that have more than ``max_files`` files; return those months.

    A month's rows are cut by time into files of about ``rows_a_file`` rows.
    """
    files = (_log(spark, path).select("month", F.input_file_name().alias("file"))
             .groupBy("month").agg(F.count_distinct("file").alias("files"),
                                   F.count(F.lit(1)).alias("rows")).collect())  # a row a month
    crowded = {r["month"]: r["rows"] // rows_a_file + 1 for r in files
               if r["files"] > max(max_files, 2 * (r["rows"] // rows_a_file + 1))}
    scratch = Scratch(spark, "compact")
    for month, cuts in crowded.items():
        copy = scratch.write(_log(spark, path).where(F.col("month") == month), month)
        (copy.repartitionByRange(cuts, "assigned_at", "order_id", "machine_id")
         .sortWithinPartitions("assigned_at").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))
        scratch.drop(month)
    return sorted(crowded)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    return _log(spark, path).select(*OVERRIDE_COLUMNS)


def newest_first() -> list:
    """Order of the override history; ties by order and machine id."""
    return [F.desc_nulls_last("assigned_at"), F.asc("order_id"), F.asc("machine_id")]


def history(overrides: DataFrame) -> DataFrame:
    """Override history, newest first (S13 / O4); ties by order and machine id."""
    return overrides.select(*OVERRIDE_COLUMNS).orderBy(*newest_first())


def history_positions(overrides: DataFrame) -> DataFrame:
    """The history with each row's place in it, sorted once, in ranges."""
    return positions(overrides.select(*OVERRIDE_COLUMNS), newest_first())


def display(overrides: DataFrame) -> DataFrame:
    """Rename to the display headers (P10)."""
    out = overrides.select(*OVERRIDE_COLUMNS)
    for c, label in DISPLAY_NAMES.items():
        out = out.withColumnRenamed(c, label)
    return out


def with_current_machine(requests: DataFrame, plan: DataFrame) -> DataFrame:
    """Each request with the machine the plan currently uses for its order (P6)."""
    cur = plan.select("order_id", F.col("machine_id").alias("current_machine"))
    return requests.select("order_id", F.col("machine_id").alias("requested_machine"),
                           *[c for c in requests.columns
                             if c not in ("order_id", "machine_id")]).join(cur, "order_id", "left")


def valid_requests(requests: DataFrame, plan: DataFrame) -> DataFrame:
    """Requests for planned orders naming a new, different machine (P8)."""
    j = with_current_machine(requests, plan)
    return j.filter(F.col("current_machine").isNotNull()
                    & F.col("requested_machine").isNotNull()
                    & (F.col("requested_machine") != F.col("current_machine")))
