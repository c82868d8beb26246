"""Plan KPIs (profit, on-time proxy, OEE, utilisation, orders) and capacities.

Sums run over DECIMAL(38,9): exact, so a KPI does not depend on the order in
which partitions are added up. Ratios are computed from those exact sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUALITY = 0.98
DEC = "decimal(38,9)"
KPI_COLUMNS = ["expected_profit", "expected_ontime_deliveries", "factory_oee",
               "factory_capacity_utilization", "expected_orders_completed"]


def machine_capacity(machines: DataFrame, planning_days: int) -> DataFrame:
    """Per-machine capacity over the horizon (A6)."""
    return machines.select("machine_id", (F.col("daily_capacity_hours") * F.lit(planning_days))
                           .alias("capacity_hours"))


def plant_capacity(machines: DataFrame, planning_days: int) -> DataFrame:
    """sum(daily hours) x days over the whole catalog, down machines included (A5)."""
    return machines.agg((F.sum(F.col("daily_capacity_hours").cast(DEC)) * F.lit(planning_days))
                        .cast("double").alias("plant_capacity_hours"))


def compute_kpis(assigned: DataFrame, machines: DataFrame, planning_days: int = 21,
                 scenario_ids: Sequence[str] | None = None, quality: float = QUALITY) -> DataFrame:
    """One KPI row per scenario (D3); an empty plan gives zeros.

    Plan rows and catalog rows are stacked and aggregated once per scenario,
    so capacity needs no join. ``assigned`` may carry ``scenario_id``; then
    ``scenario_ids`` lists the scenarios to report (also those with no rows).
    """
    has_sid = "scenario_id" in assigned.columns
    if has_sid and not scenario_ids:
        raise ValueError("scenario_ids is required when the plan has scenario_id")
    ids = list(scenario_ids) if has_sid else ["_"]
    sid = F.col("scenario_id") if has_sid else F.lit("_")
    null_dec = F.lit(None).cast(DEC)
    plan_rows = assigned.select(
        sid.alias("scenario_id"), F.col("order_id"),
        F.col("profit").cast(DEC).alias("profit"), F.col("p_best").cast(DEC).alias("p_best"),
        F.col("processing_hours").cast(DEC).alias("hours"), null_dec.alias("daily"))
    cat_rows = machines.select(
        F.explode(F.array(*[F.lit(s) for s in ids])).alias("scenario_id"),
        F.lit(None).cast("string").alias("order_id"), null_dec.alias("profit"),
        null_dec.alias("p_best"), null_dec.alias("hours"),
        F.col("daily_capacity_hours").cast(DEC).alias("daily"))
    sums = plan_rows.unionByName(cat_rows).groupBy("scenario_id").agg(
        F.sum("profit").alias("s_profit"), F.sum("p_best").alias("s_pbest"),
        F.count("p_best").alias("n_pbest"), F.sum("hours").alias("s_hours"),
        F.countDistinct("order_id").alias("n_orders"), F.sum("daily").alias("s_daily"))
    used = F.coalesce(F.col("s_hours").cast("double"), F.lit(0.0))
    cap = (F.col("s_daily") * F.lit(planning_days)).cast("double")
    availability = F.when(cap > 0, F.least(used / cap, F.lit(1.0))).otherwise(F.lit(0.0))
    performance = F.when(F.col("n_pbest") > 0,
                         F.col("s_pbest").cast("double") / F.col("n_pbest")).otherwise(F.lit(0.0))
    out = sums.select(
        "scenario_id",
        F.coalesce(F.col("s_profit").cast("double"), F.lit(0.0)).alias("expected_profit"),
        F.coalesce(F.col("s_pbest").cast("double"), F.lit(0.0))
         .alias("expected_ontime_deliveries"),
        (availability * performance * F.lit(quality)).alias("factory_oee"),
        availability.alias("factory_capacity_utilization"),
        F.col("n_orders").cast("bigint").alias("expected_orders_completed"))
    return out if has_sid else out.drop("scenario_id")


def kpi_delta(kpis: DataFrame, baseline_id: str = "baseline") -> DataFrame:
    """Scenario minus baseline for every KPI (J5, D5); an equi-join on the baseline id."""
    base = kpis.filter(F.col("scenario_id") == baseline_id).select(
        F.col("scenario_id").alias("base_id"), *[F.col(c).alias(f"b_{c}") for c in KPI_COLUMNS])
    other = kpis.filter(F.col("scenario_id") != baseline_id).withColumn(
        "base_id", F.lit(baseline_id))
    j = other.join(base, "base_id")
    return j.select(
        "scenario_id",
        (F.col("expected_profit") - F.col("b_expected_profit")).alias("profit_delta"),
        (F.col("expected_ontime_deliveries") - F.col("b_expected_ontime_deliveries"))
        .alias("ontime_delta"),
        (F.col("factory_oee") - F.col("b_factory_oee")).alias("oee_delta"),
        (F.col("factory_capacity_utilization") - F.col("b_factory_capacity_utilization"))
        .alias("utilization_delta"),
        (F.col("expected_orders_completed") - F.col("b_expected_orders_completed"))
        .alias("orders_delta"))
