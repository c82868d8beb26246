"""KPI report: scenario value, delta to baseline, display text and direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Card labels of the four KPIs, in display order.
KPI_LABELS = [
    ("expected_profit", "Expected Profit ($)"),
    ("expected_ontime_deliveries", "On-Time Deliveries"),
    ("factory_oee", "Factory OEE (%)"),
    ("expected_orders_completed", "Orders Completed"),
]


def kpi_report(kpis: DataFrame, baseline_id: str = "baseline",
               recalculated: bool = True) -> DataFrame:
    """Long table: one row per (scenario, KPI) with value, delta and truncations.

    ``value_int`` / ``delta_int`` are the whole numbers shown on the cards:
    truncated counts, OEE as truncated percent; profit keeps two decimals.
    ``direction`` is up / down / none, or null when no re-plan was made.
    """
    base = kpis.filter(F.col("scenario_id") == baseline_id).select(
        F.col("scenario_id").alias("base_id"),
        *[F.col(c).cast("double").alias(f"b_{c}") for c, _ in KPI_LABELS])
    scen = kpis.withColumn("base_id", F.lit(baseline_id)).join(base, "base_id")
    stacked = scen.select("scenario_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(label).alias("kpi"),
                 F.col(c).cast("double").alias("value"),
                 (F.col(c).cast("double") - F.col(f"b_{c}")).alias("delta"))
        for i, (c, label) in enumerate(KPI_LABELS)])).alias("k")).select("scenario_id", "k.*")
    pct = F.col("kpi") == "Factory OEE (%)"
    money = F.col("kpi") == "Expected Profit ($)"
    value_int = (F.when(money, F.lit(None))
                  .when(pct, (F.col("value") * 100).cast("bigint"))
                  .otherwise(F.col("value").cast("bigint")))
    delta_int = (F.when(money, F.lit(None))
                  .when(pct, F.abs((F.col("delta") * 100).cast("bigint")))
                  .otherwise(F.abs(F.col("delta").cast("bigint"))))
    direction = (F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down")
                  .otherwise("none"))
    return stacked.select(
        "scenario_id", "pos", "kpi", "value", "delta",
        value_int.cast("bigint").alias("value_int"), delta_int.cast("bigint").alias("delta_int"),
        (direction if recalculated else F.lit(None).cast("string")).alias("direction"))


def with_display_text(report: DataFrame) -> DataFrame:
    """Card text: ``1,234.56`` for money, ``1,234`` for counts, ``87`` for OEE percent."""
    money = F.col("kpi") == "Expected Profit ($)"
    pct = F.col("kpi") == "Factory OEE (%)"
    value_text = (F.when(money, F.format_number(F.col("value"), 2))
                   .when(pct, F.col("value_int").cast("string"))
                   .otherwise(F.format_number(F.col("value_int"), 0)))
    delta_text = (F.when(money, F.format_number(F.abs(F.col("delta")), 2))
                   .when(pct, F.col("delta_int").cast("string"))
                   .otherwise(F.format_number(F.col("delta_int"), 0)))
    return report.withColumn("value_text", value_text).withColumn("delta_text", delta_text)
