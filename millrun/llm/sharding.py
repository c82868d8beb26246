"""Shards by jump consistent hashing, with DataFrame functions only.

A row's shard depends on its key and the number of shards alone, so no table of a ring is
kept: the key seeds a linear congruential generator whose draws give the growing shard
counts at which the row moves, and its shard is the last of those jumps below the count.
When one shard is added, the rows whose next jump is the new shard go there (one in
``shards + 1``) and all others stay. Shards agree with other implementations of the
published algorithm for the same 64-bit key.

64-bit products that wrap around are made from 32- and 16-bit halves, which never overflow
a ``bigint``.

Defined cases: a null key counts as 0; a null text has no bytes and the checksum 0; rows
that repeat are rows of their own (they share a shard and take a slot each); an empty
table gives an empty result; other columns have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrun.operators import ranking
from millrun.session import Scratch

MULTIPLIER = 2862933555777941757  # fixed value of the published algorithm
_MASK = 0xFFFFFFFF
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & _MASK


def _advance(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next state, ``state * MULTIPLIER + 1`` modulo 2**64, as halves."""
    first = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(_LOW) + 1
    second = F.shiftright(low, 16) * F.lit(_LOW)
    total = first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(total, 32) + F.shiftright(second, 16)
    upper = high.bitwiseAND(F.lit(0xFFFF)) * F.lit(_LOW) + F.shiftleft(
        (F.shiftright(high, 16) * F.lit(_LOW)).bitwiseAND(F.lit(0xFFFF)), 16)
    return ((carry + low * F.lit(_HIGH) + upper).bitwiseAND(F.lit(_MASK)),
            total.bitwiseAND(F.lit(_MASK)))


def jump(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the shard among ``shards``, and among one more."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    high, low = _advance(F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_MASK)))
    zero = F.lit(0).cast("bigint")
    start = F.struct(high.alias("high"), low.alias("low"), zero.alias("at"),
                     zero.alias("shard"), zero.alias("grown"))

    def step(s: Column, _: Column) -> Column:
        h, w = _advance(s["high"], s["low"])
        draw = F.lit(float(1 << 31)) / (F.shiftright(s["high"], 1) + 1).cast("double")
        moved = F.struct(
            h.alias("high"), w.alias("low"),
            F.floor((s["at"] + 1).cast("double") * draw).cast("bigint").alias("at"),
            F.when(s["at"] < shards, s["at"]).otherwise(s["shard"]).alias("shard"),
            s["at"].alias("grown"))
        return F.when(s["at"] > shards, s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: F.struct(
        s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def shard_rows(df: DataFrame, shards: int, key_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row of ``df``.

    ``size`` is the UTF-8 bytes of the text and one; ``slot`` numbers a shard's rows from 0
    by key, then size and checksum. Texts aren't moved: only the short rows are ranked, in
    ranges, so a hot key or shard doesn't meet in one task.
    """
    scratch = Scratch(df.sparkSession, "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = scratch.write(df.select(
        F.col(key_col).alias("key"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), jump(F.col(key_col), shards).alias("to"),
        F.monotonically_increasing_id().alias("row")).select("*", "to.*").drop("to"), "rows")
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                 rows.count() // ranking.BUCKET_ROWS + 1)
    order = [F.col(c).asc_nulls_first() for c in ("key", "size", "text_crc32", "row")]
    placed = ranking.dense_rank(rows, ["shard"], order, ["key", "size", "text_crc32", "grown"],
                                "place", ranges, scratch)
    return placed.select(F.col("key").alias(key_col), "size", "text_crc32",
                         F.lit("key").alias("law"), "shard",
                         (F.col("place") - 1).alias("slot"), F.col("grown").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, shards: int, key_col: str = "doc_id",
                 rows_a_file: int = 500_000) -> None:
    """All rows of ``df`` as Parquet, a folder ``shard=k`` for each shard.

    A shard is cut into files of about ``rows_a_file`` rows, dealt evenly, so a shard of any
    size is written by many tasks.
    """
    spark = df.sparkSession
    files = df.count() // rows_a_file + shards
    with_shard = df.withColumn("shard", jump(F.col(key_col), shards)["shard"])
    (with_shard.withColumn("__deal", F.pmod(F.monotonically_increasing_id(),
                                            F.lit(files // shards + 1)))
     .repartition(max(files, int(spark.conf.get("spark.sql.shuffle.partitions"))),
                  "shard", "__deal").drop("__deal")
     .write.partitionBy("shard").option("maxRecordsPerFile", rows_a_file).parquet(path))


def moved_rows(df: DataFrame, shards: int, key_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that go to the new shard when one is added to ``shards``."""
    return df.where(jump(F.col(key_col), shards)["grown"] == shards)
