"""Synthetic order backlog: weighted part choice, customer pools, quantities, dates.

Every random draw is a keyed hash of (seed, purpose, order_id), so the result
does not depend on partitioning or on re-execution after a lost executor.
The draws follow the reference generator's distributions, not Python's
random sequence.

* part: weighted by category; cumulative weights over the parts catalog
  (a distributed running sum) and a binned range join from the draw
* customer: dealer pool for dealer categories, else all customers; uniform
  pick by dense index inside the pool
* quantity: 4-6 units for dealer categories, else 1-6
* promised date: start + 1..horizon days
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrun.operators.ranking import dense_rank, running_total
from millrun.session import Scratch

SEED = 42
START = dt.date(2025, 11, 1)
HORIZON_DAYS = 30
ID_OFFSET = 2000
WEIGHT_UNITS = 1_000_000
# The reference's category weights and dealer categories.
REFERENCE_WEIGHTS = {"metal": 1.0, "battery": 1.0, "electronics": 2.5, "assembly": 3.0}
REFERENCE_DEALER_CATEGORIES = ("battery", "electronics")


def draw(seed: int, purpose: str, key: Column, bits: int = 32) -> Column:
    """Uniform integer in [0, 2**bits) from md5 of ``seed|purpose|key`` (bits 32 or 60)."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("bigint")


def generate_backlog(ids: DataFrame, parts: DataFrame, customers: DataFrame,
                     category_weights: Mapping[str, float] = REFERENCE_WEIGHTS,
                     dealer_categories: Collection[str] = REFERENCE_DEALER_CATEGORIES,
                     seed: int = SEED, start: dt.date = START, horizon_days: int = HORIZON_DAYS,
                     id_offset: int = ID_OFFSET) -> DataFrame:
    """Backlog rows for each ``seq`` in ``ids``.

    ``parts``: part_id, category, default_price, material_cost, estimated_runtime_hours.
    ``customers``: customer_name, customer_key (tie-break), is_dealer.
    Category weights are used in millionths (integer arithmetic, at least one for a weight
    above zero); categories without a weight have 1.
    """
    spark = ids.sparkSession
    scratch = Scratch(spark, "gen")
    w = F.lit(WEIGHT_UNITS)
    for cat, weight in category_weights.items():
        units = max(1, round(weight * WEIGHT_UNITS)) if weight > 0 else 0
        w = F.when(F.col("category") == cat, F.lit(units)).otherwise(w)
    pw = parts.select("part_id", "category", "default_price", "material_cost",
                      "estimated_runtime_hours", w.cast("bigint").alias("w"))
    cum = running_total(pw, [F.col("part_id").asc()], "w",
                        keep=["part_id", "category", "default_price", "material_cost",
                              "estimated_runtime_hours"], out="hi", scratch=scratch)
    cum = cum.withColumn("lo", F.col("hi") - F.col("w"))
    stats = cum.agg(F.max("hi").alias("total"), F.count(F.lit(1)).alias("n")).first()
    total, n_parts = int(stats["total"] or 0), int(stats["n"])
    if total == 0:
        raise ValueError("no part with a weight")
    width = max(1, -(-total // n_parts))
    binned = cum.withColumn("bin", F.explode(F.sequence(
        F.call_function("div", F.col("lo"), F.lit(width)),
        F.call_function("div", F.col("hi") - 1, F.lit(width)))))

    orders = ids.select(F.concat(F.lit("ORD-"), (F.col("seq") + id_offset).cast("string"))
                        .alias("order_id"))
    orders = orders.withColumn(
        "target", F.pmod(draw(seed, "part", F.col("order_id"), 60), F.lit(total)))
    orders = orders.withColumn("bin", F.call_function("div", F.col("target"), F.lit(width)))
    chosen = (orders.join(binned, "bin")
                    .filter((F.col("target") >= F.col("lo")) & (F.col("target") < F.col("hi"))))

    dealer_cat = F.col("category").isin(list(dealer_categories))
    pools = (customers.select(F.lit("all").alias("pool"), "customer_name", "customer_key")
             .unionByName(customers.filter(F.col("is_dealer"))
                          .select(F.lit("dealer").alias("pool"), "customer_name",
                                  "customer_key")))
    indexed = dense_rank(pools, ["pool"], [F.col("customer_name").asc(),
                                           F.col("customer_key").asc()],
                         keep=["customer_name"], out="idx", scratch=scratch)
    sizes = {r["pool"]: r["n"] for r in
             pools.groupBy("pool").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_all, n_dealer = sizes.get("all", 0), sizes.get("dealer", 0)
    pool = F.when(dealer_cat & F.lit(n_dealer > 0), F.lit("dealer")).otherwise(F.lit("all"))
    size = F.when(pool == "dealer", F.lit(n_dealer)).otherwise(F.lit(max(n_all, 1)))
    chosen = (chosen.withColumn("pool", pool)
                    .withColumn("idx", F.pmod(draw(seed, "customer", F.col("order_id")), size) + 1))
    qty = F.when(dealer_cat, F.lit(4) + F.pmod(draw(seed, "quantity", F.col("order_id")),
                                                 F.lit(3)))
    qty = qty.otherwise(F.lit(1) + F.pmod(draw(seed, "quantity", F.col("order_id")), F.lit(6)))
    due = F.date_add(F.lit(start), (F.lit(1) + F.pmod(draw(seed, "due", F.col("order_id")),
                                                        F.lit(horizon_days))).cast("int"))
    out = chosen.join(indexed, ["pool", "idx"], "left")
    return out.select("order_id", "part_id", "category", "customer_name",
                      qty.cast("int").alias("quantity"), due.alias("promised_date"),
                      F.col("default_price").alias("sale_price"), "material_cost",
                      "estimated_runtime_hours")
