"""Catalog ops, override log, keyed replica refresh, ranking helpers."""

import datetime as dt
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrun import schemas
from millrun.operators import ranking
from millrun.sources import catalog, feed, overrides
from millrun.streaming import replica


def test_catalog_roundtrip(spark):
    catalog.create_schema(spark, "plant")
    catalog.create_table(spark, "plant.machine_status", schemas.MACHINE_STATUS)
    assert catalog.table_exists(spark, "plant.machine_status")
    assert catalog.column_comments(spark, "plant.machine_status")["status"].startswith("down")
    catalog.insert_values(spark, "plant.machine_status",
                          [("M1", "Mill 1", "down"), ("M2", "Mill 2", "up")],
                          timestamp_column="reported_at")
    rows = spark.table("plant.machine_status").collect()
    assert len(rows) == 2 and all(r.reported_at is not None for r in rows)
    catalog.set_properties(spark, "plant.machine_status", {"change_feed": "true"})
    assert catalog.table_properties(spark, "plant.machine_status")["change_feed"] == "true"
    df = spark.createDataFrame([("M3", "Mill 3", "up", dt.datetime(2025, 1, 1))],
                               schemas.MACHINE_STATUS)
    catalog.overwrite(df, "plant.machine_status")
    assert spark.table("plant.machine_status").count() == 1
    catalog.drop_schema(spark, "plant")
    assert not catalog.table_exists(spark, "plant.machine_status")


def test_overrides_log(spark, tmp_path):
    path = str(tmp_path / "overrides")
    overrides.create_table(spark, path)
    assert overrides.path_exists(spark, path)
    overrides.add_override(spark, path, "ORD-1", "M-0001", "alice", "rush")
    overrides.add_override(spark, path, "ORD-2", "M-0002", "bob", None)
    hist = overrides.history(overrides.read_overrides(spark, path)).collect()
    assert [r.order_id for r in hist] == ["ORD-2", "ORD-1"]
    shown = overrides.display(overrides.read_overrides(spark, path))
    assert shown.columns == ["Order ID", "Machine ID", "Assigned By", "Assigned At", "Notes"]
    overrides.create_table(spark, path, replace=True)
    assert overrides.read_overrides(spark, path).count() == 0


def _files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names
            if f.endswith(".parquet")]


def test_override_batches_are_idempotent_and_compacted(spark, tmp_path):
    path = str(tmp_path / "overrides")
    overrides.create_table(spark, path)
    for k in range(6):
        batch = spark.createDataFrame([(f"ORD-{k}-{i}", "M-0001", "alice", None) for i in range(3)],
                                      "order_id string, machine_id string, assigned_by string, "
                                      "notes string")
        overrides.append_batch(spark, path, batch, f"request-{k}")
        overrides.append_batch(spark, path, batch, f"request-{k}")  # sent again
    before = overrides.history(overrides.read_overrides(spark, path)).collect()
    assert len(before) == 18 and len(_files(path)) >= 6
    other = "month=2001-01"  # a month that isn't crowded
    spark.createDataFrame([("OLD", "M-0002", "bob", dt.datetime(2001, 1, 2), None, "r", "2001-01")],
                          overrides.STORED).write.mode("append").partitionBy("month").parquet(path)
    old_files = {f for f in _files(path) if other in f}
    done = overrides.compact(spark, path, max_files=4)
    assert len(done) == 1 and done != ["2001-01"]
    assert {f for f in _files(path) if other in f} == old_files
    assert len(_files(path)) == 1 + len(old_files)
    after = overrides.history(overrides.read_overrides(spark, path)).collect()
    assert after[:-1] == before and after[-1].order_id == "OLD"
    overrides.append_batch(spark, path, batch, "request-5")
    assert overrides.read_overrides(spark, path).count() == 19
    assert overrides.compact(spark, path, max_files=4) == []


def test_history_positions(spark):
    rows = [(f"O{i % 7}", f"M{i % 3}", "x", dt.datetime(2025, 1, 1 + i % 5), None)
            for i in range(40)]
    df = spark.createDataFrame(rows, schemas.ASSIGNMENT_OVERRIDES)
    got = sorted(overrides.history_positions(df).collect(), key=lambda r: r.position)
    assert [tuple(r)[:5] for r in got] == [tuple(r) for r in overrides.history(df).collect()]
    assert [r.position for r in got] == list(range(1, 41))


_FEED = "k bigint, ts timestamp, v double, deleted boolean"
_T = dt.datetime(2024, 1, 1)


def _land(spark, changes, name, *rows):
    """One file of change rows (key, hour, value, deleted)."""
    spark.createDataFrame([(k, _T.replace(hour=h), v, gone) for k, h, v, gone in rows],
                          _FEED).coalesce(1).write.parquet(f"{changes}/{name}")


def _refresh(spark, changes, root, **kw):
    schema = spark.createDataFrame([], _FEED).schema
    n = replica.refresh(spark, f"{changes}/*", schema, root, ["k"], ["ts"], **kw)
    return n, {r.k: r.v for r in replica.read_replica(spark, root, schema, "deleted").collect()}


def test_replica_goes_on_in_another_session(spark, tmp_path):
    """Three refreshes, each by a session of its own: all rows arrive."""
    changes, root = str(tmp_path / "changes"), str(tmp_path / "replica")
    schema = spark.createDataFrame([], _FEED).schema
    assert replica.read_replica(spark, root, schema) is None
    _land(spark, changes, "b1", (1, 0, 1.0, False), (2, 0, 2.0, False), (1, 1, 1.5, False))
    assert _refresh(spark, changes, root) == (1, {1: 1.5, 2: 2.0})
    _land(spark, changes, "b2", (2, 2, 2.5, False), (1, 3, None, True), (3, 0, 3.0, False))
    assert _refresh(spark.newSession(), changes, root) == (1, {2: 2.5, 3: 3.0})
    _land(spark, changes, "b3", (4, 0, 4.0, False))
    assert _refresh(spark.newSession(), changes, root) == (1, {2: 2.5, 3: 3.0, 4: 4.0})
    assert _refresh(spark, changes, root)[0] == 0


def test_replica_rewrites_only_touched_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replica, "ROWS_A_PART", 10)
    changes, root = str(tmp_path / "changes"), str(tmp_path / "replica")
    _land(spark, changes, "b1", *[(k, 0, float(k), False) for k in range(60)])
    _refresh(spark, changes, root)
    before = set(_files(f"{root}/data"))
    assert len(os.listdir(f"{root}/data/parts=7")) > 4
    _land(spark, changes, "b2", (4, 1, -4.0, False))
    assert _refresh(spark, changes, root)[1] == {k: -4.0 if k == 4 else float(k)
                                                 for k in range(60)}
    assert len(before - set(_files(f"{root}/data"))) == 1


def test_replica_keeps_deletes_against_late_rows(spark, tmp_path):
    changes, root = str(tmp_path / "changes"), str(tmp_path / "replica")
    _land(spark, changes, "b1", (1, 5, None, True), (2, 1, 2.0, False))
    assert _refresh(spark, changes, root) == (1, {2: 2.0})
    _land(spark, changes, "b2", (1, 3, 1.0, False))
    assert _refresh(spark, changes, root) == (1, {2: 2.0})
    _land(spark, changes, "b3", (1, 6, 1.5, False), (2, 7, None, True))
    assert _refresh(spark, changes, root) == (1, {1: 1.5})
    # all at once, and replayed from nothing, give the same
    assert _refresh(spark, changes, str(tmp_path / "again"))[1] == {1: 1.5}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    changes, root = str(tmp_path / "changes"), str(tmp_path / "replica")
    _land(spark, changes, "b1", (1, 0, 1.0, False))
    _refresh(spark, changes, root)
    _land(spark, changes, "b2", (1, 1, 2.0, False), (2, 1, 3.0, False))
    _refresh(spark, changes, root)
    (tmp_path / "replica" / "_checkpoint" / "commits" / "1").unlink()  # ended before its note
    (tmp_path / "replica" / "_checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    for f in _files(f"{root}/data"):  # and after old files went
        os.unlink(f)
    assert _refresh(spark, changes, root) == (1, {1: 2.0, 2: 3.0})


_STATE = "k bigint, name string, v double"


def test_snapshot_changes(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", None), (None, "n", 0.0),
                                 (5, "e", float("nan"))], _STATE)
    new = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.5), (3, None, None), (4, "d", 4.0),
                                 (None, "n", 0.5), (5, "e", float("nan"))], _STATE)
    got = sorted(map(str, (tuple(r) for r in feed.snapshot_changes(old, new, ["k"]).collect())))
    assert got == sorted(map(str, [
        ("update_preimage", 2, "b", 2.0), ("update_postimage", 2, "b", 2.5),
        ("update_preimage", 3, "c", None), ("update_postimage", 3, None, None),
        ("insert", 4, "d", 4.0),
        ("update_preimage", None, "n", 0.0), ("update_postimage", None, "n", 0.5)]))
    gone = feed.snapshot_changes(new, old, ["k"]).where("change_type = 'delete'").collect()
    assert [r.k for r in gone] == [4]
    assert feed.snapshot_changes(old, old, ["k"]).count() == 0
    twice = old.unionByName(old.where("k = 1"))
    with pytest.raises(Exception, match="key repeats in a snapshot: 1"):
        feed.snapshot_changes(twice, new, ["k"]).collect()


def test_changes_of_a_table_refresh_a_replica(spark, tmp_path):
    """The feed of a table with the property set brings a replica to its newer state."""
    catalog.create_schema(spark, "feeds")
    rows = [(k, f"n{k}", float(k)) for k in range(20)]
    old = spark.createDataFrame(rows, _STATE)
    catalog.overwrite(spark.createDataFrame(
        [(k, n, v + (k % 3 == 0)) for k, n, v in rows if k % 4] + [(50, "new", 5.0)], _STATE),
        "feeds.parts")
    with pytest.raises(ValueError, match="no change feed"):
        feed.table_changes(spark, "feeds.parts", old, ["k"])
    catalog.set_properties(spark, "feeds.parts", {"change_feed": "true"})
    changes = feed.as_refresh(feed.table_changes(spark, "feeds.parts", old, ["k"]), 2)
    start = feed.as_refresh(feed.snapshot_changes(old.limit(0), old, ["k"]), 1)
    landed, root = str(tmp_path / "changes"), str(tmp_path / "replica")
    for name, batch in (("b1", start), ("b2", changes)):
        batch.write.parquet(f"{landed}/{name}")
        replica.refresh(spark, f"{landed}/*", start.schema, root, ["k"], ["version"])
    got = replica.read_replica(spark, root, start.schema, "deleted").drop("version")
    want = spark.table("feeds.parts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    catalog.drop_schema(spark, "feeds")


def test_dense_rank_matches_window(spark):
    rows = [(g, i, (i * 7919) % 101) for g in ("a", "b", "b", "c") for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i int, v int").dropDuplicates(["g", "i"])
    got = ranking.dense_rank(df, ["g"], [F.col("v").desc(), F.col("i").asc()],
                             keep=["g", "i"], out="r", buckets=5)
    want = df.withColumn("r", F.row_number().over(
        Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("i").asc())))
    assert {(r.g, r.i, r.r) for r in got.collect()} == {(r.g, r.i, r.r) for r in want.collect()}


def test_running_total(spark):
    df = spark.createDataFrame([(f"p{i:03d}", i % 4 + 1) for i in range(100)],
                               "k string, w bigint")
    got = {r.k: r.cum for r in ranking.running_total(df, [F.col("k").asc()], "w", ["k"],
                                                     buckets=7).collect()}
    acc, want = 0, {}
    for i in range(100):
        acc += i % 4 + 1
        want[f"p{i:03d}"] = acc
    assert got == want
