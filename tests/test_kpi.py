"""KPIs on hand-computed plans, the empty plan, deltas and the report."""

import pytest
from pyspark.sql import functions as F

from millrun.functions import report
from millrun.operators import kpi

PLAN = "order_id string, machine_id string, profit double, p_best double, processing_hours double"


def machines(spark):
    return spark.createDataFrame([("M1", 10.0), ("M2", 5.0)],
                                 "machine_id string, daily_capacity_hours double")


def test_kpis_hand_computed(spark):
    plan = spark.createDataFrame([("A", "M1", 100.0, 0.5, 30.0), ("B", "M2", 50.5, 0.7, 15.0),
                                  ("B", "M2", 1.0, 0.3, 15.0)], PLAN)
    r = kpi.compute_kpis(plan, machines(spark), planning_days=2).first()
    assert r.expected_profit == pytest.approx(151.5)
    assert r.expected_ontime_deliveries == pytest.approx(1.5)
    assert r.factory_capacity_utilization == 1.0          # 60 h used of 30 h -> capped
    assert r.factory_oee == pytest.approx(1.0 * 0.5 * 0.98)
    assert r.expected_orders_completed == 2


def test_empty_plan_is_zero(spark):
    plan = spark.createDataFrame([], PLAN)
    r = kpi.compute_kpis(plan, machines(spark), planning_days=21).first()
    assert (r.expected_profit, r.expected_ontime_deliveries, r.factory_oee,
            r.expected_orders_completed) == (0.0, 0.0, 0.0, 0)


def test_zero_capacity(spark):
    plan = spark.createDataFrame([("A", "M1", 1.0, 0.5, 1.0)], PLAN)
    r = kpi.compute_kpis(plan, machines(spark), planning_days=0).first()
    assert r.factory_capacity_utilization == 0.0 and r.factory_oee == 0.0


def test_delta_and_report(spark):
    rows = [("baseline", "A", "M1", 100.0, 0.5, 30.0), ("down", "A", "M1", 50.0, 0.25, 10.0)]
    plan = spark.createDataFrame(rows, "scenario_id string, " + PLAN)
    k = kpi.compute_kpis(plan, machines(spark), 2, ["baseline", "down"])
    d = kpi.kpi_delta(k).first()
    assert d.scenario_id == "down" and d.profit_delta == -50.0 and d.orders_delta == 0
    rep = report.with_display_text(report.kpi_report(k).filter(F.col("scenario_id") == "down"))
    got = {r.kpi: r for r in rep.collect()}
    assert got["Expected Profit ($)"].value_text == "50.00"
    assert got["Expected Profit ($)"].delta_text == "50.00"
    assert got["Expected Profit ($)"].direction == "down"
    assert got["Orders Completed"].direction == "none"
    assert got["Factory OEE (%)"].value_int == int(10 / 30 * 0.25 * 0.98 * 100)
    big = spark.createDataFrame([("baseline", "A", "M1", 1234567.891, 0.5, 1.0)],
                                "scenario_id string, " + PLAN)
    k2 = kpi.compute_kpis(big, machines(spark), 2, ["baseline"])
    t = report.with_display_text(report.kpi_report(k2)).collect()
    assert {r.kpi: r.value_text for r in t}["Expected Profit ($)"] == "1,234,567.89"


def test_capacities(spark):
    assert kpi.plant_capacity(machines(spark), 3).first()[0] == 45.0
    assert {r.machine_id: r.capacity_hours
            for r in kpi.machine_capacity(machines(spark), 3).collect()} == {"M1": 30.0,
                                                                            "M2": 15.0}
