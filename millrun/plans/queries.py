"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the whole test tables (through the fixture views) so its
work grows with them; parameters (horizon, down machines, seeds) are fixed
per query and mirrored in the SQL twins in ``oracle_sql.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrun import schemas
from millrun.operators import ranking, routes
from millrun.session import Scratch
from millrun.sources import catalog
from millrun.sources import feed as feed_of
from millrun.sources import fixtures as fx

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

PLANNING_DAYS = 28
SCENARIO_DOWN = ["M-0003", "M-0010"]
RETIRED = ["M-0004", "M-0011", "M-0018"]


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _cands(spark, d):
    return routes.candidate_routes(fx.backlog(spark, d), fx.machines(spark, d))


def _by_order(spark, d):
    return routes.order_routes(fx.backlog(spark, d), fx.machines(spark, d))


def _labeled(spark, d):
    return routes.label_orders(_by_order(spark, d))


# ---- scans and projections -------------------------------------------------

@query("scan_machines")
def scan_machines(spark, d):
    return fx.machines(spark, d)


@query("catalog_table")
def catalog_table(spark, d):
    """Machines through a typed, commented table: created, overwritten, added to by values."""
    scratch = Scratch(spark, "catalog")
    schema = f"plant_{uuid.uuid4().hex[:12]}"
    name = f"{schema}.machines"
    catalog.create_schema(spark, schema, scratch.path("tables"))
    catalog.create_table(spark, name, schemas.MACHINES)
    catalog.overwrite(fx.machines(spark, d), name)
    catalog.insert_values(spark, name, [("M-9999", "SPARE", "LARGE", 8.0, 1.0, False)])
    catalog.set_properties(spark, name, {"change_feed": "true"})
    changes = feed_of.table_changes(spark, name, fx.machines(spark, d), ["machine_id"])
    rows = spark.table(name).join(changes.select("machine_id", feed_of.CHANGE_TYPE), "machine_id",
                                  "left")
    rows = scratch.write(rows, "rows")
    catalog.drop_schema(spark, schema)
    return rows


@query("backlog_projection")
def backlog_projection(spark, d):
    return fx.backlog(spark, d).select("order_id", "part_id", "category", "customer_name",
                                       "quantity")


# ---- candidate routes, features, labels -------------------------------------

@query("candidate_routes")
def candidate_routes(spark, d):
    return _cands(spark, d).select(*routes.CANDIDATE_COLUMNS)


@query("route_features")
def route_features(spark, d):
    c = _cands(spark, d)
    return c.select("order_id", "machine_id", "processing_hours", "margin", "base_confidence",
                    "need_uh", "margin_cents", "conf_pct")


@query("labeled_routes")
def labeled_routes(spark, d):
    return routes.labeled_output(_labeled(spark, d))


@query("feature_matrix")
def feature_matrix(spark, d):
    return routes.feature_matrix(_cands(spark, d))


@query("training_rows")
def training_rows(spark, d):
    return routes.training_rows(_labeled(spark, d))


@query("training_shape")
def training_shape(spark, d):
    return routes.training_shape(routes.training_rows(_labeled(spark, d)))


@query("input_example")
def input_example(spark, d):
    rows = _labeled(spark, d).select(*routes.FEATURE_COLUMNS, routes.TARGET,
                                                        "order_id")
    return routes.input_example(rows).drop("order_id")


@query("scored_routes")
def scored_routes(spark, d):
    s = routes.scored_routes(_cands(spark, d))
    return s.select("order_id", "machine_id", "part_category", "promised_date",
                    "processing_hours", "margin", "p_best", "profit_score")


# ---- planner ---------------------------------------------------------------------

from millrun.functions import report as rpt  # noqa: E402
from millrun.operators import greedy, kpi, scenario  # noqa: E402


def _scored(spark, d):
    return routes.scored_routes(_cands(spark, d))


def _scenarios(spark, d):
    """Fixed what-if set: two named machines down, and the latest reported status."""
    return {greedy.BASELINE: None, "two_down": SCENARIO_DOWN,
            "status": scenario.down_from_status(fx.machine_status(spark, d))}


def _options(spark, d):
    return routes.order_options(_by_order(spark, d))


def _plan(spark, d, days=PLANNING_DAYS, down=None, **kw):
    return greedy.greedy_assign_priority(_options(spark, d), fx.machines(spark, d), days, down,
                                         **kw)


@query("order_priority")
def order_priority(spark, d):
    return routes.route_priority(_by_order(spark, d))


@query("order_rank")
def order_rank(spark, d):
    keys = routes.priority_keys(_by_order(spark, d)).withColumnRenamed("part_category",
                                                                       "component")
    return greedy.order_ranks(keys).withColumnRenamed("component", "part_category")


@query("candidate_preference")
def candidate_preference(spark, d):
    return routes.route_preference(_by_order(spark, d))


@query("candidates_machine_down")
def candidates_machine_down(spark, d):
    down = spark.createDataFrame([(m,) for m in SCENARIO_DOWN], "machine_id string")
    return (_scored(spark, d).join(F.broadcast(down), "machine_id", "left_anti")
            .select("order_id", "machine_id", "processing_hours", "profit_score"))


@query("candidates_unknown_machine")
def candidates_unknown_machine(spark, d):
    """Capacity lookup with default 0: a machine outside the catalog has no hours."""
    cap = kpi.machine_capacity(fx.machines(spark, d), PLANNING_DAYS)
    c = _scored(spark, d).join(cap, "machine_id", "left")
    hours = F.coalesce(F.col("capacity_hours"), F.lit(0.0))
    return c.select("order_id", "machine_id", hours.alias("capacity_hours"),
                    (hours >= F.col("processing_hours")).alias("fits_empty_machine"))


@query("candidates_retired_machines")
def candidates_retired_machines(spark, d):
    """Candidates against a catalog that lacks some of their machines: those have no hours."""
    kept = fx.machines(spark, d).filter(~F.col("machine_id").isin(*RETIRED))
    cap = kpi.machine_capacity(kept, PLANNING_DAYS)
    c = _scored(spark, d).join(cap, "machine_id", "left")
    hours = F.coalesce(F.col("capacity_hours"), F.lit(0.0))
    return c.select("order_id", "machine_id", hours.alias("capacity_hours"),
                    (hours >= F.col("processing_hours")).alias("fits_empty_machine"))


@query("greedy_plan_spanning")
def greedy_plan_spanning(spark, d):
    """Every fifth machine has a second capability, so orders and machines span categories."""
    machines = fx.machines(spark, d)
    second = fx.second_capabilities(spark, d)
    cands = routes.scored_routes(routes.candidate_routes(
        fx.backlog(spark, d), machines.unionByName(second)))
    return greedy.greedy_assign_priority(cands, machines, PLANNING_DAYS).assigned


@query("greedy_plan")
def greedy_plan(spark, d):
    return _plan(spark, d).assigned


@query("greedy_plan_rounds")
def greedy_plan_rounds(spark, d):
    """The same plan cut into many small priority buckets, so with many more rounds."""
    return _plan(spark, d, buckets=400).assigned


@query("remaining_capacity")
def remaining_capacity(spark, d):
    return _plan(spark, d).remaining


@query("unassigned_orders")
def unassigned_orders(spark, d):
    plan = _plan(spark, d).assigned
    return scenario.unassigned_orders(fx.backlog(spark, d), plan).select(
        "order_id", "category", "quantity")


@query("machine_capacity")
def machine_capacity(spark, d):
    return kpi.machine_capacity(fx.machines(spark, d), PLANNING_DAYS)


@query("plant_capacity")
def plant_capacity(spark, d):
    return kpi.plant_capacity(fx.machines(spark, d), PLANNING_DAYS)


@query("kpi_baseline")
def kpi_baseline(spark, d):
    return kpi.compute_kpis(_plan(spark, d).assigned, fx.machines(spark, d), PLANNING_DAYS)


@query("kpi_empty_plan")
def kpi_empty_plan(spark, d):
    """A zero-day horizon leaves no capacity, so the plan is empty and KPIs are zeros."""
    return kpi.compute_kpis(_plan(spark, d, days=0).assigned, fx.machines(spark, d), 0)


@query("scenario_plan")
def scenario_plan(spark, d):
    res = greedy.plan_scenarios(_options(spark, d), fx.machines(spark, d), PLANNING_DAYS,
                                _scenarios(spark, d))
    return res.assigned


@query("kpi_scenarios")
def kpi_scenarios(spark, d):
    _, kpis, _ = scenario.run_scenarios(_options(spark, d), fx.machines(spark, d), PLANNING_DAYS,
                                        _scenarios(spark, d))
    return kpis


@query("kpi_delta")
def kpi_delta(spark, d):
    _, _, delta = scenario.run_scenarios(_options(spark, d), fx.machines(spark, d),
                                         PLANNING_DAYS, _scenarios(spark, d))
    return delta


@query("kpi_report")
def kpi_report(spark, d):
    _, kpis, _ = scenario.run_scenarios(_options(spark, d), fx.machines(spark, d), PLANNING_DAYS,
                                        _scenarios(spark, d))
    return rpt.kpi_report(kpis).filter(F.col("scenario_id") != greedy.BASELINE)


@query("assigned_enriched")
def assigned_enriched(spark, d):
    plan = _plan(spark, d).assigned
    return scenario.enrich(plan.select("order_id", "machine_id", "profit", "p_best",
                                       "processing_hours"), fx.backlog(spark, d))


@query("scenario_enriched")
def scenario_enriched(spark, d):
    plan = _plan(spark, d, down=SCENARIO_DOWN).assigned
    return scenario.enrich(plan, fx.backlog(spark, d))


@query("assigned_orders_view")
def assigned_orders_view(spark, d):
    plan = _plan(spark, d).assigned
    return scenario.assigned_view(scenario.enrich(plan, fx.backlog(spark, d)))


@query("assigned_order_ids")
def assigned_order_ids(spark, d):
    return _plan(spark, d).assigned.select("order_id").distinct()


# ---- route model ------------------------------------------------------------------

from millrun.operators import model as mdl  # noqa: E402

def _training_rows(spark, d):
    return _labeled(spark, d).select(*routes.FEATURE_COLUMNS, routes.TARGET, "order_id").dropna(how="any")


@query("split_counts")
def split_counts(spark, d):
    split = mdl.stratified_split(_training_rows(spark, d))
    return split.groupBy(routes.TARGET, "is_test").agg(F.count(F.lit(1)).alias("n"))


def _trained(spark, d):
    return mdl.train(_training_rows(spark, d))


@query("route_model_scores")
def route_model_scores(spark, d):
    trained = _trained(spark, d)
    scored = mdl.score(trained, _cands(spark, d))
    return scored.select("order_id", "machine_id", "p_best", "profit_score")


@query("model_accuracy")
def model_accuracy(spark, d):
    t = _trained(spark, d)
    return spark.createDataFrame([(t.test_accuracy, t.params["numTrees"])],
                                 "test_accuracy double, num_trees int")


@query("split_rows")
def split_rows(spark, d):
    """Which rows the split holds out."""
    return mdl.stratified_split(_training_rows(spark, d)).select("order_id", "machine_id",
                                                                 "is_test")


@query("model_checks")
def model_checks(spark, d):
    """Scores of all candidates: how many, how many wrong, and whether the model beats a guess."""
    trained = _trained(spark, d)
    scored = mdl.score(trained, _cands(spark, d))
    wrong = F.abs(F.col("profit_score") - F.col("p_best") * F.col("margin")) > 1e-9
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(~F.col("p_best").between(0, 1) | F.col("p_best").isNull(), 1))
        .alias("n_out_of_range"),
        F.count(F.when(wrong, 1)).alias("n_wrong_scores")).withColumn(
        "beats_majority", F.lit(trained.test_accuracy >= trained.majority_share))


@query("model_plan_checks")
def model_plan_checks(spark, d):
    """The plan on the model's scores: every count is a broken promise of the planner."""
    machines = fx.machines(spark, d)
    scored = Scratch(spark, "scored").write(
        mdl.score(_trained(spark, d), _cands(spark, d)).select(
            "order_id", "machine_id", "promised_date", "profit_score", *[
                c for c in greedy.PAYLOAD if c != "profit_score"]), "scored")
    res = greedy.greedy_assign_priority(scored, machines, PLANNING_DAYS)
    keys = ["order_id", "machine_id"]
    left = res.remaining.withColumnRenamed("remaining_hours", "left_hours")
    open_orders = scored.join(res.assigned.select("order_id"), "order_id", "left_anti")

    broken = {
        "n_twice": res.assigned.groupBy("order_id").count().filter("count > 1"),
        "n_overfull": left.filter("left_hours < 0"),
        "n_not_candidates": res.assigned.join(scored, keys, "left_anti"),
        "n_left_though_fitting": open_orders.join(left, "machine_id").filter(
            "processing_hours <= left_hours"),
    }
    rows = None
    for name, df in broken.items():
        part = df.select(*[F.lit(int(n == name)).cast("bigint").alias(n) for n in broken])
        rows = part if rows is None else rows.unionByName(part)
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in broken])


@query("registry_checks")
def registry_checks(spark, d):
    """A small forest registered twice, its alias moved on and back, loaded and scored."""
    scratch = Scratch(spark, "registry")
    root = scratch.path("models")
    trained = mdl.train(_training_rows(spark, d), num_trees=5, max_depth=5)
    first = mdl.register(spark, root, "routes", trained)
    mdl.set_alias(spark, root, "routes", "champion",
                  mdl.register(spark, root, "routes", trained, "challenger"))
    mdl.set_alias(spark, root, "routes", "champion", first)
    loaded = mdl.load(spark, root, "routes")
    once = mdl.score(trained, _cands(spark, d)).select(
        "order_id", *routes.FEATURE_COLUMNS, F.col("p_best").alias("once"))
    scores = mdl.score(loaded, once).select("order_id", "machine_id", "once",
                                            F.col("p_best").alias("again"))
    return mdl.compare_scores(scores).withColumns({
            "n_inputs": F.lit(len(loaded.signature.inputs)),
            "n_example": F.lit(loaded.example.count()),
            "is_first": F.lit(mdl.resolve_alias(spark, root, "routes").endswith(f"v={first}")),
            "n_alias_rows": F.lit(mdl.read_aliases(spark, root).count())})


@query("latest_version")
def latest_version(spark, d):
    """Versions as text per name (event_type, user_id); the latest is the integer maximum."""
    reg = fx.read(spark, d, "events").select(
        F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("version"),
        F.concat(F.lit("events/"), F.col("event_id").cast("string")).alias("path"))
    return mdl.latest_versions(reg).select("name", "version")


@query("alias_targets")
def alias_targets(spark, d):
    """Events as a log of aliases: the version each alias of each name points to."""
    log = fx.read(spark, d, "events").select(
        F.col("event_type").alias("name"),
        F.concat(F.lit("alias-"), (F.col("event_id") % 3).cast("string")).alias("alias"),
        F.col("user_id").cast("string").alias("version"), F.col("ts").alias("set_at"),
        F.col("event_id").alias("entry"))
    return mdl.alias_targets(log)


# ---- overrides and replica refresh ------------------------------------------------

from millrun.sources import overrides as ov  # noqa: E402
from millrun.streaming import replica  # noqa: E402

SYNC_CUTOFF = "2024-01-15 00:00:00"


@query("override_history")
def override_history(spark, d):
    """Overrides with their place in the list, newest first."""
    return ov.history_positions(fx.override_requests(spark, d))


@query("override_log")
def override_log(spark, d):
    """All requests through the log in three batches, each sent twice, then compacted."""
    scratch = Scratch(spark, "override_log")
    path = scratch.path("log")
    ov.create_table(spark, path)
    requests = fx.override_requests(spark, d)
    for k in range(3):
        batch = requests.where(F.col("event_id") % 3 == k)
        for _ in range(2):
            ov.append_batch(spark, path, batch, f"batch-{k}")
    ov.compact(spark, path, max_files=1)
    return ov.read_overrides(spark, path).select(
        "order_id", "machine_id", "assigned_by", "notes",
        F.col("assigned_at").isNotNull().alias("stamped"))


@query("override_display")
def override_display(spark, d):
    return ov.display(fx.override_requests(spark, d))


def _requests(spark, d):
    return fx.override_requests(spark, d).select("order_id", "machine_id", "event_id")


@query("current_machine")
def current_machine(spark, d):
    return ov.with_current_machine(_requests(spark, d), _plan(spark, d).assigned)


@query("valid_overrides")
def valid_overrides(spark, d):
    return ov.valid_requests(_requests(spark, d), _plan(spark, d).assigned)


@query("overrides_applied")
def overrides_applied(spark, d):
    """Plan with the latest valid override per order replacing the planned machine."""
    plan = _plan(spark, d).assigned
    valid = ov.valid_requests(fx.override_requests(spark, d).select(
        "order_id", "machine_id", "assigned_at"), plan).select(
        "order_id", F.col("requested_machine").alias("machine_id"), "assigned_at")
    return scenario.apply_overrides(plan.select("order_id", "machine_id"), valid)


def _with_overrides(spark, d):
    return scenario.plan_with_overrides(_options(spark, d), fx.machines(spark, d), PLANNING_DAYS,
                                        fx.override_requests(spark, d), SCENARIO_DOWN)


@query("plan_with_overrides")
def plan_with_overrides(spark, d):
    """Overrides take their capacity first, with two machines down; the rest is planned after."""
    return _with_overrides(spark, d).assigned


@query("overrides_remaining")
def overrides_remaining(spark, d):
    return _with_overrides(spark, d).remaining


@query("overrides_rejected")
def overrides_rejected(spark, d):
    """Newest override of an order whose machine can't make it, is down or is full by then."""
    return _with_overrides(spark, d).rejected


@query("overrides_kpi")
def overrides_kpi(spark, d):
    return kpi.compute_kpis(_with_overrides(spark, d).assigned, fx.machines(spark, d),
                            PLANNING_DAYS)


@query("synced_upsert")
def synced_upsert(spark, d):
    """Replica keyed by user_id: snapshot before the cutoff, then the later changes merged."""
    feed = fx.change_feed(spark, d)
    cutoff = F.lit(SYNC_CUTOFF).cast("timestamp_ntz")
    base = replica.merge(None, feed.filter(F.col("ts") < cutoff), ["user_id"], ["ts", "event_id"])
    return replica.merge(base, feed.filter(F.col("ts") >= cutoff), ["user_id"],
                         ["ts", "event_id"])


@query("replica_refreshed")
def replica_refreshed(spark, d):
    """The feed with deletes, landed and refreshed as a stream in three parts with late rows."""
    scratch = Scratch(spark, "feed")
    feed = fx.change_feed(spark, d).withColumn("deleted", F.col("event_type") == "error")
    third = F.pmod(F.col("event_id") * 7, F.lit(3))
    for k in (2, 0, 1):
        feed.filter(third == k).write.parquet(scratch.path(f"changes/b{k}"))
        replica.refresh(spark, scratch.path("changes/*"), feed.schema, scratch.path("replica"),
                        ["user_id"], ["ts", "event_id"])
    return replica.read_replica(spark, scratch.path("replica"), feed.schema, "deleted")


def _snapshots(spark, d):
    """State by user before the cutoff, and at the end without users whose last event is an error."""
    feed = fx.change_feed(spark, d)
    early = feed.filter(F.col("ts") < F.lit(SYNC_CUTOFF).cast("timestamp_ntz"))
    old = replica.merge(None, early, ["user_id"], ["ts", "event_id"])
    new = replica.merge(None, feed, ["user_id"], ["ts", "event_id"])
    return old, new.filter(F.col("event_type") != "error")


@query("snapshot_changes")
def snapshot_changes(spark, d):
    """What leads from the earlier state to the later one."""
    return feed_of.snapshot_changes(*_snapshots(spark, d), ["user_id"])


@query("changes_refreshed")
def changes_refreshed(spark, d):
    """The earlier state as a replica, refreshed from the change feed of the two states."""
    scratch = Scratch(spark, "snapshots")
    old, new = _snapshots(spark, d)
    old = scratch.write(old, "old")
    changes = feed_of.as_refresh(feed_of.snapshot_changes(old, new, ["user_id"]), 2)
    start = feed_of.as_refresh(feed_of.snapshot_changes(old.limit(0), old, ["user_id"]), 1)
    for name, rows in (("b1", start), ("b2", changes)):
        rows.write.parquet(scratch.path(f"changes/{name}"))
        replica.refresh(spark, scratch.path("changes/*"), start.schema, scratch.path("replica"),
                        ["user_id"], ["version"])
    return replica.read_replica(spark, scratch.path("replica"), start.schema,
                                "deleted").drop("version")


@query("down_from_status")
def down_from_status(spark, d):
    return scenario.down_from_status(fx.machine_status(spark, d))


# ---- synthetic backlog --------------------------------------------------------------

from millrun.sources import generate as gen  # noqa: E402

GEN_WEIGHTS = {"MEDIUM": 2.5, "PROMO": 3.0}
GEN_DEALER_CATEGORIES = ("LARGE", "MEDIUM")
GEN_DEALER_SEGMENTS = ("AUTOMOBILE", "MACHINERY")


@query("generated_backlog")
def generated_backlog(spark, d):
    """One synthetic order per row of ``orders`` (its key is the sequence number)."""
    ids = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("seq"))
    cust = fx.read(spark, d, "customer").select(
        F.col("c_name").alias("customer_name"), F.col("c_custkey").alias("customer_key"),
        F.col("c_mktsegment").isin(list(GEN_DEALER_SEGMENTS)).alias("is_dealer"))
    return gen.generate_backlog(ids, fx.parts(spark, d), cust, GEN_WEIGHTS,
                                GEN_DEALER_CATEGORIES)


# ---- dashboard flow -------------------------------------------------------------------

from millrun.plans import dashboard  # noqa: E402


@query("assigned_enriched_sql")
def assigned_enriched_sql(spark, d):
    """The enrichment join as SQL text over registered views (S8)."""
    m = fx.machines(spark, d)
    backlog = fx.backlog(spark, d)
    cands = routes.scored_routes(routes.candidate_routes(backlog, m))
    plan = greedy.greedy_assign_priority(cands, m, PLANNING_DAYS).assigned
    dashboard.register_views(m, cands, backlog, plan)
    return spark.sql(dashboard.ENRICHED_SQL)


@query("cached_load")
def cached_load(spark, d):
    """The dashboard's plan from its cache, the second time it is asked for."""
    cache = dashboard.LoadCache()
    cache.get(spark, d, PLANNING_DAYS)
    rows = Scratch(spark, "dashboard").write(
        cache.get(spark, d, PLANNING_DAYS).assigned_baseline, "rows")
    cache.clear()
    return rows


@query("dashboard_recalculated")
def dashboard_recalculated(spark, d):
    """The plan after two machines were marked as down in the dashboard."""
    cache = dashboard.LoadCache()
    enriched, _, _ = dashboard.recalculate(cache.get(spark, d, PLANNING_DAYS), SCENARIO_DOWN,
                                           PLANNING_DAYS)
    rows = Scratch(spark, "dashboard").write(enriched, "rows")
    cache.clear()
    return rows


@query("scored_routes_sorted")
def scored_routes_sorted(spark, d):
    """Scored candidates in display order (highest planning score first)."""
    return ranking.positions(_scored(spark, d).select("order_id", "machine_id", "profit_score"),
                             dashboard.best_first())
