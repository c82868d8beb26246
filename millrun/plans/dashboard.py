"""Dashboard flow as DataFrames: cached load, SQL text over views, re-plan, report."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrun.functions import report
from millrun.operators import greedy, kpi, routes, scenario
from millrun.sources import fixtures as fx

SOURCES = ["nation", "part", "lineitem", "orders", "customer"]
PLAN_COLUMNS = ["order_id", "machine_id", "profit", "p_best", "processing_hours"]
# SQL text over the registered views (S8): the planned rows with their backlog columns.
ENRICHED_SQL = (f"SELECT {', '.join([*PLAN_COLUMNS, *scenario.ENRICH_COLUMNS])} "
                "FROM assigned_baseline LEFT JOIN orders_backlog USING (order_id)")


def best_first() -> list:
    """Display order of scored candidates."""
    return [F.desc_nulls_last("profit_score"), F.asc("order_id"), F.asc("machine_id")]


def sorted_by_score(scored: DataFrame) -> DataFrame:
    """Scored candidates, highest planning score first (O1, display order)."""
    return scored.orderBy(*best_first())


@dataclass
class Loaded:
    machines: DataFrame
    candidates: DataFrame
    backlog: DataFrame
    assigned_baseline: DataFrame
    kpis: DataFrame

    def release(self) -> None:
        for df in (self.machines, self.candidates, self.backlog, self.assigned_baseline):
            df.unpersist()


def load_data(spark: SparkSession, sf_dir: str, planning_days: int = 21) -> Loaded:
    """Load and persist the dashboard tables; they live until ``release``.

    Persisted DataFrames keep their lineage, so a lost executor's blocks are recomputed.
    """
    level = StorageLevel.MEMORY_AND_DISK
    machines = fx.machines(spark, sf_dir).persist(level)
    backlog = fx.backlog(spark, sf_dir).persist(level)
    cands = routes.scored_routes(routes.candidate_routes(backlog, machines)).persist(level)
    plan = greedy.greedy_assign_priority(cands, machines, planning_days).assigned
    register_views(machines, cands, backlog, plan)
    enriched = spark.sql(ENRICHED_SQL).persist(level)
    kpis = kpi.compute_kpis(plan, machines, planning_days)
    return Loaded(machines, cands, backlog, enriched, kpis)


def source_versions(spark: SparkSession, sf_dir: str) -> tuple:
    """Time of the last change and bytes of each table that the dashboard reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in SOURCES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(conf)
        out.append((name, fs.getFileStatus(path).getModificationTime(),
                    fs.getContentSummary(path).getLength()))
    return tuple(out)


class LoadCache:
    """Loaded dashboard tables with a lifetime (S10).

    An entry is keyed by folder, horizon and the versions of the sources, and serves until its
    deadline. The first use after it, or after a source changed, loads anew and releases the
    blocks of the entry it replaces.
    """

    def __init__(self, seconds: float = 60.0, load: Callable[..., Loaded] = load_data,
                 versions: Callable[..., tuple] = source_versions,
                 clock: Callable[[], float] = time.monotonic):
        self.seconds, self.load, self.versions, self.clock = seconds, load, versions, clock
        self._held: dict[tuple, tuple[float, tuple, Loaded]] = {}

    def get(self, spark: SparkSession, sf_dir: str, planning_days: int = 21) -> Loaded:
        key = (sf_dir, planning_days)
        versions = self.versions(spark, sf_dir)
        held = self._held.get(key)
        if held and self.clock() < held[0] and held[1] == versions:
            return held[2]
        if held:
            del self._held[key]
            held[2].release()
        loaded = self.load(spark, sf_dir, planning_days)
        self._held[key] = (self.clock() + self.seconds, versions, loaded)
        return loaded

    def clear(self) -> None:
        for _, _, loaded in self._held.values():
            loaded.release()
        self._held.clear()


def register_views(machines: DataFrame, cands: DataFrame, backlog: DataFrame,
                   plan: DataFrame) -> None:
    machines.createOrReplaceTempView("machines_catalog")
    cands.createOrReplaceTempView("candidate_routes_scored")
    backlog.createOrReplaceTempView("orders_backlog")
    plan.createOrReplaceTempView("assigned_baseline")


def recalculate(loaded: Loaded, down_machines: Sequence[str] | DataFrame | None,
                planning_days: int = 21) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Re-plan with machines down: (enriched plan, KPI rows, report) against the baseline."""
    res, kpis, _ = scenario.run_scenarios(loaded.candidates, loaded.machines, planning_days,
                                          {"recalculated": down_machines})
    plan = res.assigned.filter(F.col("scenario_id") == "recalculated").drop("scenario_id")
    enriched = scenario.enrich(plan, loaded.backlog)
    return enriched, kpis, report.with_display_text(
        report.kpi_report(kpis).filter(F.col("scenario_id") == "recalculated"))
