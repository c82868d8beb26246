"""Shards against the published loop, gapless slots, what moves when a shard is added."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from llm_cases import awkward_rows, clashing, docs
from millrun.llm import queries, sharding


def plain_jump(key, shards):
    """The published loop on 64-bit integers."""
    key %= 2**64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 8, 100])
def test_jump_is_the_published_loop(spark, shards):
    keys = [*range(-50, 400), 2**63 - 1, -2**63, 2**40 + 7, 2**62 + 1]
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint").select(
        "k", sharding.jump(F.col("k"), shards).alias("to")).select("k", "to.*").collect()
    for r in rows:
        assert r["shard"] == plain_jump(r["k"], shards)
        assert r["grown"] == plain_jump(r["k"], shards + 1)


def test_whole_table(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in
             spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op11_jump_shards(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 1, zlib.crc32(text), "key")
        assert r["shard"] == plain_jump(r["doc_id"], 8)
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_even_and_only_the_needed_rows_move(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "doc_id")
    counts = Counter(r["s"] for r in keys.select(
        sharding.jump(F.col("doc_id"), 8)["shard"].alias("s")).collect())
    assert set(counts) == set(range(8)) and max(counts.values()) < 1.06 * 5000
    assert abs(sharding.moved_rows(keys, 8).count() - 40_000 / 9) < 0.06 * 40_000 / 9


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = sharding.shard_rows(clashing(docs(spark, rows)), 3).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        assert r["shard"] == plain_jump(r["doc_id"] or 0, 3)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert sizes == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()))
                            for r in rows)
    assert sharding.shard_rows(docs(spark, []), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.jump(F.lit(1), 0)


def test_hot_key_is_ranked_in_ranges(spark):
    """A third of the rows share one key: slots stay gapless, ranges stay bounded."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
        F.lit("same").alias("text"))
    rows = sharding.shard_rows(df, 8).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 3000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_written_shards_and_growth(spark, tmp_path):
    df = docs(spark, [(i, f"text {i}", "en", "s", 6) for i in range(500)])
    sharding.write_shards(df, str(tmp_path / "shards"), 4, rows_a_file=50)
    back = spark.read.parquet(str(tmp_path / "shards"))
    rows = back.select("doc_id", "text", "shard").collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted(
        (i, f"text {i}") for i in range(500))
    assert all(r["shard"] == plain_jump(r["doc_id"], 4) for r in rows)
    assert len(list((tmp_path / "shards" / "shard=0").glob("*.parquet"))) > 1
    moved = {r["doc_id"] for r in sharding.moved_rows(back, 4).collect()}
    assert moved == {i for i in range(500) if plain_jump(i, 5) == 4}
