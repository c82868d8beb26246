"""What-if scenarios: re-plan with machines down, enrich plans, compare KPIs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.operators import greedy, kpi
from millrun.session import Scratch

ENRICH_COLUMNS = ["part_id", "category", "customer_name", "quantity"]
VIEW_COLUMNS = ["order_id", "machine_id", "part_id", "category", "customer_name", "quantity"]


def unique_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key`` and ``columns``, one row a key; the query fails where a key repeats.

    The check is part of the plan (an aggregate on the key that a join on it needs
    anyway), so nothing runs before the result is asked for.
    """
    row = F.struct(*columns)
    once = F.when(F.col("n") > 1, F.raise_error(F.concat(
        F.lit(f"duplicate {key}: "), F.col(key).cast("string"))).cast(
            df.select(row.alias("r")).schema["r"].dataType)).otherwise(F.col("r"))
    return (df.groupBy(key).agg(F.min(row).alias("r"), F.count(F.lit(1)).alias("n"))
            .select(key, once.alias("r")).select(key, "r.*"))


def enrich(plan: DataFrame, backlog: DataFrame, validate: bool = True) -> DataFrame:
    """plan LEFT JOIN backlog on order_id (J2 / J3), backlog key checked unique."""
    right = unique_rows(backlog, "order_id", ENRICH_COLUMNS) if validate else \
        backlog.select("order_id", *ENRICH_COLUMNS)
    return plan.join(right, "order_id", "left")


def assigned_view(enriched: DataFrame) -> DataFrame:
    """The six display columns of the assigned-orders table (P9)."""
    return enriched.select(*VIEW_COLUMNS)


def unassigned_orders(backlog: DataFrame, plan: DataFrame) -> DataFrame:
    """Backlog orders absent from the plan (D2), incl. orders no machine can make."""
    return backlog.join(plan.select("order_id"), "order_id", "left_anti")


def down_from_status(status: DataFrame) -> DataFrame:
    """Machines whose latest status report says down (newest report per machine wins)."""
    latest = status.groupBy("machine_id").agg(
        F.max(F.struct("reported_at", "event_id", "status")).alias("s"))
    return latest.filter(F.col("s.status") == "down").select("machine_id")


def run_scenarios(cands: DataFrame, machines: DataFrame, planning_days: int,
                  scenarios: Mapping[str, Sequence[str] | DataFrame | None],
                  baseline_id: str = greedy.BASELINE, **plan_kw):
    """Plan all scenarios in one go; return (plan result, KPI table, delta table)."""
    scenarios = dict(scenarios)
    scenarios.setdefault(baseline_id, None)
    res = greedy.plan_scenarios(cands, machines, planning_days, scenarios, **plan_kw)
    kpis = kpi.compute_kpis(res.assigned, machines, planning_days, list(scenarios))
    return res, kpis, kpi.kpi_delta(kpis, baseline_id)


def newest_override(overrides: DataFrame) -> DataFrame:
    """order_id, machine_id, assigned_at: the newest override of each order.

    Of overrides with equal times the greatest machine id counts.
    """
    latest = overrides.groupBy("order_id").agg(
        F.max(F.struct("assigned_at", "machine_id")).alias("o"))
    return latest.select("order_id", "o.machine_id", "o.assigned_at")


def apply_overrides(plan: DataFrame, overrides: DataFrame) -> DataFrame:
    """The newest override of an order replaces the planned machine, whatever its capacity."""
    latest = newest_override(overrides).select("order_id", F.col("machine_id").alias("o"))
    return (plan.join(latest, "order_id", "left")
                .withColumn("machine_id", F.coalesce(F.col("o"), F.col("machine_id")))
                .drop("o"))


@dataclass
class OverridePlan:
    assigned: DataFrame   # plan columns and whether an override pinned the order
    remaining: DataFrame  # machine_id, remaining_hours
    rejected: DataFrame   # order_id, machine_id of overrides that can't be kept


def plan_with_overrides(cands: DataFrame, machines: DataFrame, planning_days: int,
                        overrides: DataFrame,
                        down_machines: Sequence[str] | DataFrame | None = None,
                        buckets: int | None = None) -> OverridePlan:
    """Plan in which overridden orders take their machine's capacity first.

    The newest override of an order pins it to its machine. Pins are taken by their time
    (then order id), each if the order has a route there, the machine is up and what is left
    of it is enough; others are rejected, and their orders are planned like the rest, on the
    capacity that the pins leave. Both steps are runs of the planner: a pinned order is one
    with a single option.
    """
    spark = cands.sparkSession
    ids, down = greedy.scenario_frame(spark, {greedy.BASELINE: down_machines})
    scratch = Scratch(spark, "overrides")
    cap = greedy.held(greedy.capacity(machines, planning_days, ids, down))
    orders = scratch.write(greedy.numbered(greedy.as_orders(cands)), "orders")
    pins = scratch.write(newest_override(overrides).where(
        "order_id is not null and machine_id is not null"), "pins")
    wanted = pins.select("order_id", F.col("machine_id").alias("pin"), "assigned_at")
    single = F.filter("options", lambda o: o["machine_id"] == F.col("pin"))
    pinned = scratch.write(orders.join(wanted, "order_id").select(
        "row", "order_id", "assigned_at", F.slice(single, 1, 1).alias("options")), "pinned")
    by_time = [F.col("assigned_at").asc_nulls_last(), F.col("order_id").asc()]
    kept, _, _ = greedy.plan_capacities(pinned, greedy.usable_capacity(cap), ids,
                                        Scratch(spark, "pins"), buckets, by_time)
    kept = scratch.write(kept, "kept")
    left = greedy.held(greedy.remaining_capacity(cap, kept))
    rest = scratch.write(orders.join(kept.select("order_id"), "order_id", "left_anti"), "rest")
    planned, _, _ = greedy.plan_capacities(rest, greedy.usable_capacity(left), ids,
                                           Scratch(spark, "rest"), buckets)
    planned = scratch.write(planned, "planned")
    rows = (kept.withColumn("pinned", F.lit(True))
            .unionByName(planned.withColumn("pinned", F.lit(False))))
    res = greedy.as_result(rows, greedy.remaining_capacity(left, planned), 0, 0, "pinned")
    rejected = pins.join(kept.select("order_id"), "order_id", "left_anti").select(
        "order_id", "machine_id")
    return OverridePlan(res.assigned.drop("scenario_id"), res.remaining.drop("scenario_id"),
                        rejected)
