"""Candidate routes: orders x capable machines, route features and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrun.functions.fixedpoint import (MICRO, confidence_pct, keyed_u32,
                                          need_micro_hours, to_units)

SEED = 42

CANDIDATE_COLUMNS = [
    "order_id", "part_id", "part_category", "customer_name", "quantity", "promised_date",
    "sale_price", "material_cost", "estimated_runtime_hours", "machine_id", "machine_name",
    "capability", "daily_capacity_hours", "efficiency_factor", "is_operational",
    "processing_hours", "margin", "base_confidence",
]

MACHINE_COLUMNS = ["machine_id", "machine_name", "capability", "daily_capacity_hours",
                   "efficiency_factor", "is_operational"]

FEATURE_COLUMNS = [
    "part_category", "machine_id", "estimated_runtime_hours", "quantity", "margin",
    "processing_hours", "daily_capacity_hours", "efficiency_factor", "base_confidence",
]
CATEGORICAL_FEATURES = ["part_category", "machine_id"]
NUMERIC_FEATURES = [c for c in FEATURE_COLUMNS if c not in CATEGORICAL_FEATURES]
TARGET = "is_best"


def _integers(orders: DataFrame) -> DataFrame:
    """Orders with ``runtime_uh`` (micro-hours a unit) and ``margin_cents``."""
    return orders.select(
        "order_id", "part_id", F.col("category").alias("part_category"), "customer_name",
        "quantity", "promised_date", "sale_price", "material_cost", "estimated_runtime_hours",
        to_units(F.col("estimated_runtime_hours"), MICRO).alias("runtime_uh"),
        ((to_units(F.col("sale_price"), 100) - to_units(F.col("material_cost"), 100))
         * F.col("quantity").cast("bigint")).alias("margin_cents"))


def _machines(machines: DataFrame) -> DataFrame:
    return machines.select(*MACHINE_COLUMNS,
                           to_units(F.col("efficiency_factor"), 100).alias("eff_pct"))


def _need(eff_pct: Column) -> Column:
    return need_micro_hours(F.col("runtime_uh"), F.col("quantity"), eff_pct)


def _confidence(seed: int, machine_id: Column, eff_pct: Column) -> Column:
    return confidence_pct(keyed_u32(seed, F.col("order_id"), machine_id), eff_pct)


def _with_features(rows: DataFrame, seed: int) -> DataFrame:
    """Rows of orders and machines with the route's columns, in generated code."""
    rows = rows.withColumn("need_uh", _need(F.col("eff_pct"))).withColumn(
        "conf_pct", _confidence(seed, F.col("machine_id"), F.col("eff_pct")))
    return rows.withColumns({
        "processing_hours": F.col("need_uh").cast("double") / MICRO,
        "margin": F.col("margin_cents").cast("double") / 100,
        "base_confidence": F.col("conf_pct").cast("double") / 100})


def candidate_routes(orders: DataFrame, machines: DataFrame, seed: int = SEED,
                     keep_units: bool = True) -> DataFrame:
    """Expand each order to every machine whose capability equals its category.

    Besides the candidate columns the result keeps the integer forms ``need_uh``
    (micro-hours), ``margin_cents`` and ``conf_pct``. Spark broadcasts the catalog where it
    is small enough, and else splits a category that holds a large share of the orders.
    """
    cols = CANDIDATE_COLUMNS + (["need_uh", "margin_cents", "conf_pct"] if keep_units else [])
    o, m = _integers(orders), _machines(machines)
    rows = o.join(m, o["part_category"] == m["capability"])
    return _with_features(rows, seed).select(*cols)


def order_routes(orders: DataFrame, machines: DataFrame) -> DataFrame:
    """One row per order and category with ``machines``, an array of those that can make it.

    The machines of a capability are one array (as many rows as capabilities), so an order's
    candidates are ranked inside its row, on structs of what the rank needs: no exchange
    beyond the join.
    """
    capable = _machines(machines).groupBy("capability").agg(F.sort_array(F.collect_list(F.struct(
        *MACHINE_COLUMNS, "eff_pct"))).alias("machines"))
    o = _integers(orders)
    return o.join(capable, o["part_category"] == capable["capability"]).drop("capability")


def _score(machine: Column, seed: int) -> Column:
    """Score of a route in units of a cent x percent."""
    return F.col("margin_cents") * _confidence(seed, machine["machine_id"], machine["eff_pct"])


def label_orders(by_order: DataFrame, seed: int = SEED) -> DataFrame:
    """Labelled candidates of :func:`order_routes`: 1 for the top historical score of an order
    (ties: lowest machine_id)."""
    def slim(m):
        return F.struct(_score(m, seed).alias("score"), m["machine_id"].alias("machine_id"))

    best = F.array_min(F.transform(F.transform("machines", slim), lambda r: F.struct(
        r["score"].isNull().alias("no_score"), (-r["score"]).alias("down"),
        r["machine_id"].alias("machine_id"))))
    ranked = by_order.withColumn("best", best["machine_id"])
    rows = _with_features(
        ranked.select(*[c for c in ranked.columns if c != "machines"], F.inline("machines")), seed)
    return (rows.withColumn("profit_score", (F.col("margin_cents") * F.col("conf_pct"))
                            .cast("double") / 10000)
            .withColumn("is_best", F.col("machine_id").eqNullSafe(F.col("best")).cast("int"))
            .drop("best", "eff_pct", "runtime_uh"))


def route_preference(by_order: DataFrame, seed: int = SEED) -> DataFrame:
    """Preference rank of each route inside its order (O3)."""
    def slim(m):
        return F.struct(_score(m, seed).alias("score"), _need(m["eff_pct"]).alias("need"),
                        m["machine_id"].alias("machine_id"))

    keys = F.transform(F.transform("machines", slim), lambda r: F.struct(
        r["score"].isNull().alias("no_score"), (-r["score"]).alias("down"),
        r["need"].isNull().alias("no_need"), r["need"].alias("need"),
        r["machine_id"].alias("machine_id")))
    ranked = F.posexplode(F.sort_array(keys))
    return by_order.select("order_id", ranked.alias("at", "r")).select(
        "order_id", "r.machine_id", (F.col("at") + 1).cast("bigint").alias("pref_rank"))


def priority_keys(by_order: DataFrame, seed: int = SEED) -> DataFrame:
    """Priority keys of each order (A1): best score, due date and least need of its routes."""
    return by_order.select(
        "part_category", "order_id",
        F.array_max(F.transform("machines", lambda m: _score(m, seed))).alias("best_units"),
        F.col("promised_date").alias("k_due"),
        F.array_min(F.transform("machines", lambda m: _need(m["eff_pct"]))).alias("k_need")
    ).withColumn("k_score", F.col("best_units").cast("double") / 10000).drop("best_units")


def order_options(by_order: DataFrame, seed: int = SEED) -> DataFrame:
    """Orders as the planner takes them, scored by base confidence: priority keys and options.

    Everything stays in the order's row (one row an order: the backlog's key).
    """
    def drawn(m):
        return F.struct(m["machine_id"].alias("machine_id"), _need(m["eff_pct"]).alias("need_u"),
                        _confidence(seed, m["machine_id"], m["eff_pct"]).alias("conf"))

    def option(d):
        score = (F.col("margin_cents") * d["conf"]).cast("double") / 10000
        conf = d["conf"].cast("double") / 100
        return F.struct(
            score.isNull().alias("no_score"),
            F.coalesce(-score, F.lit(0.0)).alias("down_score"), d["need_u"].alias("need_u"),
            d["machine_id"].alias("machine_id"),
            (F.col("margin_cents").cast("double") / 100).alias("margin"), conf.alias("p_best"),
            (d["need_u"].cast("double") / MICRO).alias("processing_hours"),
            score.alias("profit_score"), conf.alias("base_confidence"))

    rows = by_order.where(F.col("order_id").isNotNull()).withColumn(
        "all", F.transform(F.transform("machines", drawn), option))
    return rows.select(
        "order_id", F.array_max("all.profit_score").alias("k_score"),
        F.col("promised_date").alias("k_due"), F.array_min("all.need_u").alias("k_need"),
        F.sort_array(F.filter("all", lambda o: o["machine_id"].isNotNull() & (o["need_u"] >= 0)))
        .alias("options"))


def route_priority(by_order: DataFrame, seed: int = SEED) -> DataFrame:
    """The priority keys as a report."""
    return priority_keys(by_order, seed).select(
        "part_category", "order_id", F.col("k_score").alias("max_profit_score"),
        F.col("k_due").alias("min_due"),
        (F.col("k_need").cast("double") / MICRO).alias("min_hours"))


def labeled_output(labeled: DataFrame) -> DataFrame:
    """The historical_routes_labeled projection."""
    return labeled.select(*CANDIDATE_COLUMNS, "profit_score", "is_best")


def feature_matrix(cands: DataFrame) -> DataFrame:
    """Model input: nine features plus the two passthrough columns."""
    return cands.select(*FEATURE_COLUMNS, "order_id", "promised_date")


def training_rows(labeled: DataFrame) -> DataFrame:
    """Features + label with every row holding a null or NaN among them dropped."""
    return labeled.select(*FEATURE_COLUMNS, TARGET).dropna(how="any")


def training_shape(rows: DataFrame) -> DataFrame:
    """(rows, columns) of the training set as a one-row table."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(rows.columns)).cast("bigint"))


def input_example(rows: DataFrame, n: int = 5, keys=("order_id", "machine_id")) -> DataFrame:
    """First ``n`` rows by key, stored with a model as its input example (a top-n is the feature)."""
    return rows.orderBy(*keys).limit(n)


def scored_routes(cands: DataFrame, p_best: str | None = None) -> DataFrame:
    """Planning score = p_best x margin. Without a model p_best := base_confidence."""
    if p_best is None:
        s = (cands.withColumn("p_best", F.col("base_confidence"))
                  .withColumn("profit_score",
                              (F.col("margin_cents") * F.col("conf_pct")).cast("double") / 10000))
    else:
        s = (cands.withColumn("p_best", F.col(p_best).cast("double"))
                  .withColumn("profit_score", F.col("p_best") * F.col("margin")))
    return s
