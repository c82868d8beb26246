"""Catalog operations: schemas, typed commented tables, writes, literal inserts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrun.schemas import ddl


def create_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create a schema (S3), its tables under ``location`` or in the warehouse."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{where}")


def drop_schema(spark: SparkSession, name: str, cascade: bool = True) -> None:
    spark.sql(f"DROP SCHEMA IF EXISTS {name}{' CASCADE' if cascade else ''}")


def create_table(spark: SparkSession, name: str, schema: T.StructType,
                 fmt: str = "parquet") -> None:
    """``CREATE TABLE IF NOT EXISTS`` with typed, commented columns (S4)."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (\n  {ddl(schema)}\n) USING {fmt}")


def overwrite(df: DataFrame, name: str) -> None:
    """Replace a table's contents (S2)."""
    df.write.mode("overwrite").saveAsTable(name)


def insert_values(spark: SparkSession, name: str, rows: Iterable[tuple],
                  timestamp_column: str | None = None) -> None:
    """Insert literal rows; ``timestamp_column`` is filled with current_timestamp() (S5)."""
    schema = spark.table(name).schema
    cols = [f.name for f in schema.fields if f.name != timestamp_column]
    df = spark.createDataFrame(list(rows), T.StructType([schema[c] for c in cols]))
    if timestamp_column:
        from pyspark.sql import functions as F
        df = df.withColumn(timestamp_column, F.current_timestamp())
    df.select(*schema.fieldNames()).write.insertInto(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def set_properties(spark: SparkSession, name: str, props: Mapping[str, str]) -> None:
    """``ALTER TABLE ... SET TBLPROPERTIES`` (S15)."""
    kv = ", ".join(f"'{k}' = '{v}'" for k, v in props.items())
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({kv})")


def table_properties(spark: SparkSession, name: str) -> dict:
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").collect()
    return {r["key"]: r["value"] for r in rows}


def column_comments(spark: SparkSession, name: str) -> dict:
    return {f.name: f.metadata.get("comment") for f in spark.table(name).schema.fields}
