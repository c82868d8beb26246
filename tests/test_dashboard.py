"""Dashboard flow: cached load, SQL text over views, re-plan with a machine down."""

from pyspark.sql import functions as F

from millrun.plans import dashboard
from conftest import SMALL


def test_load_recalculate(spark):
    loaded = dashboard.load_data(spark, SMALL, planning_days=2)
    assert loaded.candidates.storageLevel.useMemory
    base_rows = loaded.assigned_baseline.count()
    assert base_rows > 0
    assert set(loaded.assigned_baseline.columns) >= {"order_id", "customer_name", "quantity"}
    enriched, kpis, rep = dashboard.recalculate(loaded, ["M-0000", "M-0001"], planning_days=2)
    assert enriched.filter(F.col("machine_id").isin("M-0000", "M-0001")).count() == 0
    assert {r.scenario_id for r in kpis.collect()} == {"baseline", "recalculated"}
    assert rep.count() == 4
    loaded.release()


class _Fake:
    def __init__(self, n):
        self.n, self.released = n, False

    def release(self):
        self.released = True


def test_cache_lives_until_its_deadline(spark):
    """By an injected clock: one load a lifetime, a fresh one after it or when a source changed."""
    now, versions, loads = [0.0], ["a"], []

    def load(*_):
        loads.append(_Fake(len(loads)))
        return loads[-1]

    cache = dashboard.LoadCache(60, load, lambda *_: tuple(versions), lambda: now[0])
    first = cache.get(spark, "x")
    now[0] = 59.9
    assert cache.get(spark, "x") is first and len(loads) == 1
    assert cache.get(spark, "x", 7) is not first  # another horizon, another entry
    now[0] = 60.0
    second = cache.get(spark, "x")
    assert second is not first and first.released and not second.released
    versions[0] = "b"
    third = cache.get(spark, "x")
    assert third is not second and second.released
    cache.clear()
    assert all(x.released for x in loads)


def test_cache_of_the_tables(spark):
    now = [0.0]
    cache = dashboard.LoadCache(60, clock=lambda: now[0])
    first = cache.get(spark, SMALL, 2)
    assert cache.get(spark, SMALL, 2) is first and first.candidates.storageLevel.useMemory
    now[0] = 61.0
    second = cache.get(spark, SMALL, 2)
    assert second is not first and second.candidates.storageLevel.useMemory
    cache.clear()
    assert not second.candidates.storageLevel.useMemory


def test_sorted_by_score(spark):
    from millrun.plans import queries as Q
    rows = dashboard.sorted_by_score(Q._scored(spark, SMALL)).limit(50).collect()
    scores = [r.profit_score for r in rows]
    assert scores == sorted(scores, reverse=True)
