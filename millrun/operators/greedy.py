"""Exact greedy assignment of orders to machines under capacity, on Spark.

Semantics (the sequential planner this reproduces):

* orders are taken by priority: highest max(profit_score) over the order's
  candidates, then earliest promised date, then least processing hours, then
  order_id; priorities use *all* candidates, down machines included;
* each order takes its first candidate by preference (profit_score desc,
  processing hours asc, machine_id asc, then the least other values) whose
  machine is up and still has at least the order's need; otherwise it stays
  unassigned. An order gets one machine, whatever its categories;
* capacity per machine is daily hours x planning days; a machine outside the
  catalog, a null, NaN or negative need or a null order id is never assignable.

Orders and machines only meet inside a *component* of the graph of orders and
machines, so components are planned independently. They are derived from the
candidates: machines that share an order are in one component.

A component's orders are cut into priority *buckets* of about ``BUCKET_ROWS``
orders, and all buckets are planned at once, each from a guess of the capacities
it starts with (what is left when all earlier orders get their first option). Options
that don't fit a bucket's start never fit in it: they only count for its bounds, and
orders without any other don't go to the planning task. Planning a bucket gives what it takes from every machine, and the
*bounds* of the starting capacities that give the very same answer: a machine must
hold at least what was taken from it, and less than what the least refused order
would have needed. Running sums of what earlier buckets take (one row a bucket and
machine) give every bucket the capacities it starts with; buckets whose bounds
don't hold them are planned again from there. When all bounds hold, the plan is the
sequential one: the first bucket's start is known, and each bucket that holds makes
the next one's start exact.

Answers change where a machine runs out, so the number of rounds follows the
machines that do, not the number of orders. A hot component is spread over as many
tasks as it has buckets. The driver holds the capacities of the machine catalog;
guesses, sums and bounds are tables.

Scenarios share work in two ways. In a component where a scenario has the capacities
of the baseline it has the baseline's plan. In the others it starts from the
baseline's answers: buckets before the first order that had a down machine, and all
others whose bounds hold, aren't planned again.

Needs and capacities are integer micro-hours, so sums equal the sequential
subtraction exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrun import schemas
from millrun.functions.fixedpoint import MICRO, to_units
from millrun.session import Scratch, trace as _trace

PAYLOAD = ["margin", "p_best", "processing_hours", "profit_score", "base_confidence"]
BASELINE = "baseline"
BUCKET_ROWS = 100_000    # orders in a priority bucket, about: what one task plans
RANK_ROWS = 500_000      # orders in a range that is ranked, about
NEVER = -(1 << 60)       # capacity of a machine that is down or unknown
_ABSENT = 1 << 62        # need of an option that isn't there
_BITS = 33               # a priority's bucket is its bits above these


@dataclass
class PlanResult:
    assigned: DataFrame   # scenario_id, order_id, machine_id, profit, p_best, processing_hours, ...
    remaining: DataFrame  # scenario_id, machine_id, remaining_hours
    rounds: int
    planned_buckets: int  # buckets planned in all rounds, each time counted


def _no_nan(c):
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def scenario_frame(spark: SparkSession, scenarios) -> tuple[list[str], DataFrame]:
    """(scenario ids, DataFrame(scenario_id, machine_id) of down machines)."""
    schema = T.StructType([T.StructField("scenario_id", T.StringType()),
                           T.StructField("machine_id", T.StringType())])
    ids, frames, literal_rows = [], [], []
    for sid, down in scenarios.items():
        ids.append(sid)
        if down is None:
            continue
        if isinstance(down, DataFrame):
            frames.append(down.select(F.lit(sid).alias("scenario_id"),
                                      F.col("machine_id").cast("string")))
        else:
            literal_rows.extend((sid, str(m)) for m in down)
    df = spark.createDataFrame(literal_rows, schema)
    for f in frames:
        df = df.unionByName(f)
    return ids, df.dropna().distinct()


def priority_order() -> list[Column]:
    """Sort order of O2 in a component: score desc, due asc, need asc (nulls last), order_id."""
    return [F.col("k_score").desc_nulls_last(), F.col("k_due").asc_nulls_last(),
            F.col("k_need").asc_nulls_last(), F.col("order_id").asc()]


def rank_orders(keys: DataFrame, buckets: int, *keep: str,
                order_by: Sequence[Column] | None = None) -> DataFrame:
    """Global priority id: range-partition on the priority order, number rows in order.

    ``prio`` increases with priority inside a component; ``prio >> 33`` is the
    range bucket (the partition index), used to split running sums.
    """
    order = [F.col("component").asc_nulls_last(), *(order_by or priority_order())]
    return (keys.repartitionByRange(buckets, *order)
                .sortWithinPartitions(*order)
                .select("component", "order_id",
                        F.monotonically_increasing_id().alias("prio"), *keep))


def capacity(machines: DataFrame, planning_days: int, ids: list[str],
              down: DataFrame) -> DataFrame:
    """(scenario_id, machine_id, cap_u): catalog capacity; down machines 0, even if unknown."""
    cat = (machines.select(F.col("machine_id").cast("string").alias("machine_id"),
                           (to_units(F.col("daily_capacity_hours"), MICRO)
                            * F.lit(planning_days)).alias("cap_u"))
                   .groupBy("machine_id").agg(F.max("cap_u").alias("cap_u")))
    cat = cat.withColumn("scenario_id", F.explode(F.array(*[F.lit(s) for s in ids])))
    downs = down.withColumn("is_down", F.lit(True))
    both = cat.join(downs, ["scenario_id", "machine_id"], "full_outer")
    return both.select("scenario_id", "machine_id",
                       F.when(F.col("is_down"), F.lit(0)).otherwise(F.col("cap_u"))
                        .cast("bigint").alias("cap_u"),
                       F.coalesce(F.col("is_down"), F.lit(False)).alias("is_down"))


def order_options(cands: DataFrame) -> DataFrame:
    """One row per order: priority keys over all its candidates, and the usable ones in order.

    Usable are candidates with a machine and a need. Candidates that are still arrays in the
    order's row don't need the exchange of this step: see ``routes.order_options``.
    """
    rows = cands.filter(F.col("order_id").isNotNull()).select(
        "order_id", F.col("machine_id").cast("string").alias("machine_id"), "promised_date",
        _no_nan(F.col("profit_score")).alias("score"),
        to_units(F.col("processing_hours"), MICRO).alias("need_u"),
        *[F.col(c).cast("double").alias(c) for c in PAYLOAD])
    option = F.struct(F.col("score").isNull().alias("no_score"),
                      F.coalesce(-F.col("score"), F.lit(0.0)).alias("down_score"),
                      "need_u", "machine_id", *PAYLOAD)
    usable = F.col("machine_id").isNotNull() & (F.col("need_u") >= 0)
    return rows.groupBy("order_id").agg(
        F.max("score").alias("k_score"), F.min("promised_date").alias("k_due"),
        F.min("need_u").alias("k_need"),
        F.sort_array(F.collect_list(F.when(usable, option))).alias("options"))


def _machine_groups(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Machines linked by ``pairs``, as sorted groups named by their first machine."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    groups: dict[str, list[str]] = {}
    for m in sorted(parent):
        groups.setdefault(find(m), []).append(m)
    return groups


def _local(spark: SparkSession, rows: list[tuple], columns: dict[str, pa.DataType]) -> DataFrame:
    """Rows of the machine catalog's size as a table that is part of the plan."""
    arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(columns.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))


def numbered(orders: DataFrame) -> DataFrame:
    """``orders`` with a number for each row, to be written before it is used."""
    return orders.withColumn("row", F.monotonically_increasing_id())


def _state(orders: DataFrame, groups: dict[str, list[str]], buckets: int,
           order_by: Sequence[Column] | None) -> DataFrame:
    """component, bucket, prio, row and cand (place of the machine in its group, need, place of
    the option). The options themselves stay where they are.

    A bucket is one or more neighbouring ranges of the sort, so that the sort is as parallel
    as the session's shuffles however few buckets there are.
    """
    spark = orders.sparkSession
    of = _local(spark, [(m, name) for name, members in groups.items() for m in members],
                {"first": pa.string(), "component": pa.string()})
    places = _local(spark, list(groups.items()),
                    {"component": pa.string(), "members": pa.list_(pa.string())})
    keyed = orders.withColumns({
        "first": F.col("options")[0]["machine_id"], "ids": F.col("options.machine_id"),
        "needs": F.col("options.need_u")}).drop("options").join(of, "first").drop("first")
    pieces = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    ranked = rank_orders(keyed, buckets * pieces, "ids", "needs", "row", order_by=order_by)
    cand = F.transform("ids", lambda x, i: F.struct(
        (F.array_position("members", x) - 1).cast("int").alias("m"),
        F.col("needs")[i].alias("need"), i.alias("at")))
    return ranked.join(places, "component").select(
        "component", F.expr(f"shiftright(prio, {_BITS}) div {pieces}").alias("bucket"), "prio",
        "row", cand.alias("cand"))


# ---- one bucket, inside a task ------------------------------------------------------------

def walk(machine: np.ndarray, need: np.ndarray, start: np.ndarray):
    """Plan one bucket: (place of each order's pick or -1, taken, low, high) by machine.

    ``machine`` and ``need`` have a row per order and its options in order of preference.
    Any starting capacities from ``low`` to below ``high`` give the same picks. Orders are
    taken in runs: all pick from what is left where the run begins, needs are added up by
    machine, and the run ends before the first order that doesn't fit any more.
    """
    n, width = machine.shape
    left, used = start.copy(), np.zeros_like(start)
    low = np.full(len(start), 2 * NEVER)
    high = np.full(len(start), _ABSENT)
    picks = np.full(n, -1, np.int64)
    at, span = 0, 1024
    while at < n:
        length = min(span, n - at)
        m, want = machine[at:at + length], need[at:at + length]
        fits = want <= left[m]
        pick = np.where(fits.any(1), fits.argmax(1), -1)
        rows = np.flatnonzero(pick >= 0)
        rows = rows[np.argsort(m[rows, pick[rows]], kind="stable")]  # by machine, then in order
        mine, needs = m[rows, pick[rows]], want[rows, pick[rows]]
        sums = np.concatenate(([0], np.cumsum(needs)))
        run = sums[1:] - sums[np.searchsorted(mine, mine)]
        over = rows[run > left[mine]]
        stop = int(over.min()) if len(over) else length
        kept = rows < stop
        rows, mine, needs, run = rows[kept], mine[kept], needs[kept], run[kept]
        picks[at + rows] = pick[rows]
        np.maximum.at(low, mine, used[mine] + run)
        # refused: the options before the pick, or all of them
        ends = np.where(pick < 0, width, pick)[:stop]
        r, c = np.nonzero((np.arange(width) < ends[:, None]) & (want[:stop] < _ABSENT))
        theirs = m[r, c]
        sums = np.concatenate(([0], np.cumsum(needs)))
        key = mine * length + rows
        before = (sums[np.searchsorted(key, theirs * length + r)]
                  - sums[np.searchsorted(key, theirs * length)])
        np.minimum.at(high, theirs, used[theirs] + before + want[r, c])
        taken = np.zeros_like(start)
        np.add.at(taken, mine, needs)
        used += taken
        left -= taken
        at += stop
        span = 2 * span if stop == length else max(256, stop)
    return picks, used, low, high


def _options(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Machines and needs of every order's options, filled up to the longest list."""
    lists = table.column("cand").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    there = np.arange(int(sizes.max(initial=1))) < sizes[:, None]
    machine = np.zeros(there.shape, np.int64)
    need = np.full(there.shape, _ABSENT)
    flat = lists.flatten()
    machine[there] = flat.field("m").to_numpy(zero_copy_only=False)
    need[there] = flat.field("need").to_numpy(zero_copy_only=False)
    return machine, need


_ANSWER = "variant int, component string, bucket bigint, m int, taken bigint, low bigint, high bigint"
_PICK = "variant int, component string, row bigint, at int"


def _answers(orders: pa.Table, asked: pa.Table) -> pa.Table:
    """What a bucket takes and its bounds, for each of the asked starts."""
    machine, need = _options(orders.sort_by("prio"))
    parts = []
    for r in asked.to_pylist():
        _, taken, low, high = walk(machine, need, np.array(r["starts"], np.int64))
        k = len(taken)
        parts.append(pa.table({
            "variant": pa.array([r["variant"]] * k, pa.int32()),
            "component": pa.array([r["component"]] * k, pa.string()),
            "bucket": pa.array([r["bucket"]] * k, pa.int64()),
            "m": pa.array(np.arange(k), pa.int32()), "taken": pa.array(taken, pa.int64()),
            "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())}))
    return pa.concat_tables(parts)


def _chosen(orders: pa.Table, asked: pa.Table) -> pa.Table:
    """The picks of a bucket's orders, for each of the asked starts."""
    orders = orders.sort_by("prio")
    machine, need = _options(orders)
    lists = orders.column("cand").combine_chunks()
    first = np.concatenate(([0], np.cumsum(
        lists.value_lengths().to_numpy(zero_copy_only=False))))[:-1]
    places = lists.flatten().field("at")
    parts = []
    for r in asked.to_pylist():
        picks = walk(machine, need, np.array(r["starts"], np.int64))[0]
        got = np.flatnonzero(picks >= 0)
        parts.append(pa.table({
            "variant": pa.array([r["variant"]] * len(got), pa.int32()),
            "component": pa.array([r["component"]] * len(got), pa.string()),
            "row": orders.column("row").take(pa.array(got)),
            "at": places.take(pa.array(first[got] + picks[got])).cast(pa.int32())}))
    return pa.concat_tables(parts)


def _with_most(state: DataFrame, asked: DataFrame) -> DataFrame:
    """Orders of the buckets asked for, with the most that their machines may start with."""
    most = (asked.select("component", "bucket", F.posexplode("starts").alias("m", "start"))
            .groupBy("component", "bucket", "m").agg(F.max("start").alias("start"))
            .groupBy("component", "bucket").agg(
                F.sort_array(F.collect_list(F.struct("m", "start")))["start"].alias("most")))
    return state.select("component", "bucket", "prio", "row", "cand").join(
        most, ["component", "bucket"])


def _too_long(state: DataFrame, asked: DataFrame) -> DataFrame:
    """component, bucket, m, least: the least need of a bucket's options that can't fit."""
    options = _with_most(state, asked).select("component", "bucket", "most", F.inline("cand"))
    return options.where(F.col("need") > F.col("most")[F.col("m")]).groupBy(
        "component", "bucket", "m").agg(F.min("need").alias("least"))


def _in_buckets(state: DataFrame, asked: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(orders of a bucket, what is asked of it)`` for every bucket that is asked for and
    has orders with options that may fit."""
    orders = _with_most(state, asked).withColumn("cand", F.filter(
        "cand", lambda c: c["need"] <= F.col("most")[c["m"]])).where("size(cand) > 0").drop("most")

    def called(rows: pa.Table, starts: pa.Table) -> pa.Table:
        if not rows.num_rows or not starts.num_rows:
            return none
        return fn(rows, starts)

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    none = pa.schema([(c.split()[0], kinds[c.split()[1]])
                      for c in schema.split(", ")]).empty_table()
    asked = asked.select(F.col("component").alias("of"), F.col("bucket").alias("at_bucket"),
                         "variant", "component", "bucket", "starts")
    return orders.groupBy("component", "bucket").cogroup(
        asked.groupBy("of", "at_bucket")).applyInArrow(called, schema)


# ---- rounds -------------------------------------------------------------------------------

def _starts(answers: DataFrame, problems: DataFrame) -> DataFrame:
    """variant, component, bucket, starts (by machine) and whether the answer holds for them."""
    earlier = Window.partitionBy("variant", "component", "m").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    start = F.col("cap") - F.coalesce(F.sum("taken").over(earlier), F.lit(0))
    rows = (answers.join(problems, ["variant", "component", "m"]).withColumn("start", start)
            .withColumn("holds", (F.col("start") >= F.col("low"))
                        & (F.col("start") < F.col("high")))
            # more taken than there is: a guess of nothing left
            .withColumn("start", F.when(F.col("start") < NEVER // 2, F.col("start"))
                        .otherwise(F.greatest("start", F.lit(0)))))
    return rows.groupBy("variant", "component", "bucket").agg(
        F.sort_array(F.collect_list(F.struct("m", "start")))["start"].alias("starts"),
        F.bool_and("holds").alias("holds"))


class _Rounds:
    """Plans buckets of ``state`` until every answer holds for the start it really has."""

    def __init__(self, state: DataFrame, scratch: Scratch):
        self.state, self.scratch = state, scratch
        self.rounds = self.planned = self.checks = 0

    def _answer(self, asked: DataFrame, n: int) -> DataFrame:
        self.rounds += 1
        self.planned += n
        planned = _in_buckets(self.state, asked, _answers, _ANSWER)
        known = asked.select("variant", "component", "bucket",
                             F.posexplode("starts").alias("m", "start")).drop("start")
        return known.join(planned, ["variant", "component", "bucket", "m"], "left").join(
            _too_long(self.state, asked), ["component", "bucket", "m"], "left").select(
                "variant", "component", "bucket", "m",
                F.coalesce("taken", F.lit(0)).alias("taken"),
                F.coalesce("low", F.lit(2 * NEVER)).alias("low"),
                F.least(F.coalesce("high", F.lit(_ABSENT)),
                        F.coalesce("least", F.lit(_ABSENT))).alias("high"))

    def first(self, problems: DataFrame) -> DataFrame:
        """Answers of all buckets, from what first options leave of the capacities.

        Where they would take more than a component has, nothing is left.
        """
        wants = self.state.select("component", "bucket", F.col("cand")[0].alias("c")).groupBy(
            "component", "bucket", F.col("c.m").alias("m")).agg(F.sum("c.need").alias("want"))
        wants = self.scratch.write(wants, "wants")
        places = wants.select("component", "bucket").distinct().join(problems, "component")
        usable = F.greatest("cap", F.lit(0))
        earlier = Window.partitionBy("variant", "component", "m").orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, -1)
        whole = Window.partitionBy("variant", "component", "bucket")
        guess = (places.join(wants, ["component", "bucket", "m"], "left")
                 .withColumn("before", F.coalesce(F.sum("want").over(earlier), F.lit(0)))
                 .withColumn("short", F.sum("before").over(whole) > F.sum(usable).over(whole))
                 .withColumn("start", F.when(F.col("cap") < 0, F.col("cap"))
                             .when(F.col("short"), F.lit(0))
                             .otherwise(F.greatest(F.col("cap") - F.col("before"), F.lit(0)))))
        asked = self.scratch.write(guess.groupBy("variant", "component", "bucket").agg(
            F.sort_array(F.collect_list(F.struct("m", "start")))["start"].alias("starts")),
            "asked_0")
        return self.scratch.write(self._answer(asked, asked.count()), "answers_0")

    def settle(self, answers: DataFrame, problems: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The answers that hold, and all buckets' starts."""
        key = ["variant", "component", "bucket"]
        while True:
            self.checks += 1
            starts = self.scratch.write(_starts(answers, problems), f"starts_{self.checks}")
            asked = starts.where("not holds")
            n = asked.count()
            _trace(f"round {self.rounds}: {n} buckets to plan again")
            if not n:
                return answers, starts
            answers = self.scratch.write(
                answers.join(asked.select(*key), key, "left_anti").unionByName(
                    self._answer(asked, n)), f"answers_{self.checks}")


def plan_capacities(orders: DataFrame, cap: DataFrame, ids: Sequence[str], scratch: Scratch,
                    buckets: int | None = None, order_by: Sequence[Column] | None = None,
                    base: str | None = None) -> tuple[DataFrame, int, int]:
    """Plan ``orders`` (written) for every scenario's capacities.

    ``orders`` has a row for each order: ``row`` (see :func:`numbered`), order_id, ``options`` and
    the columns of ``order_by`` (default: the keys of :func:`order_options`); ``cap`` has scenario_id, machine_id, cap_u
    (null, or no row: unusable).
    Returns (scenario_id, order_id, machine_id, need_u, payload), rounds, planned buckets.
    """
    spark = orders.sparkSession
    ids = list(ids)
    base = base or (BASELINE if BASELINE in ids else ids[0])
    orders = orders.filter("size(options) > 0")
    # at most machines x machines rows, and machines x scenarios
    links = (orders.select(F.col("options")[0]["machine_id"].alias("a"),
                           F.posexplode("options.machine_id").alias("at", "b"))
             .groupBy("a", "b").agg(F.count_if(F.col("at") == 0).alias("n")).collect())
    groups = _machine_groups([(r["a"], r["b"]) for r in links])
    caps = {(r["scenario_id"], r["machine_id"]): r["cap_u"] for r in cap.collect()}
    variants: dict[tuple, int] = {}  # (component, capacities) that differ
    problems, plans = [], []
    for sid in [base, *(s for s in ids if s != base)]:
        for component, members in groups.items():
            vector = tuple(NEVER if caps.get((sid, m)) is None else caps[sid, m] for m in members)
            if (component, vector) not in variants:
                variants[component, vector] = len(variants)
                problems += [(len(variants) - 1, component, i, c, sid == base)
                             for i, c in enumerate(vector)]
            plans.append((sid, component, variants[component, vector]))
    known = _local(spark, problems, {"variant": pa.int32(), "component": pa.string(),
                                     "m": pa.int32(), "cap": pa.int64(), "is_base": pa.bool_()})
    of_base = known.where("is_base").drop("is_base")
    others = known.where("not is_base").drop("is_base")
    buckets = buckets or sum(r["n"] for r in links) // BUCKET_ROWS + 1
    state = scratch.write(_state(orders, groups, buckets, order_by), "state")
    rounds = _Rounds(state, scratch)
    answers, starts = rounds.settle(rounds.first(of_base), of_base)
    if not all(p[4] for p in problems):
        theirs = others.select("variant", "component").distinct()
        taken_over = scratch.write(answers.drop("variant").join(theirs, "component"), "taken_over")
        _, more = rounds.settle(taken_over, others)
        starts = starts.unionByName(more)
    picks = scratch.write(_in_buckets(state, starts, _chosen, _PICK), "picks")
    of = _local(spark, plans, {"scenario_id": pa.string(), "component": pa.string(),
                               "variant": pa.int32()})
    rows = orders.select("row", "order_id", "options").join(picks, "row")
    taken = rows.withColumn("o", F.col("options")[F.col("at")]).join(of, ["component", "variant"])
    assigned = taken.select("scenario_id", F.col("order_id").cast("string").alias("order_id"),
                            *[F.col("o")[c].alias(c) for c in ("machine_id", "need_u", *PAYLOAD)])
    return assigned, rounds.rounds, rounds.planned


def remaining_capacity(cap: DataFrame, assigned: DataFrame) -> DataFrame:
    """scenario_id, machine_id, cap_u less what ``assigned`` takes."""
    used = assigned.groupBy("scenario_id", "machine_id").agg(F.sum("need_u").alias("used_u"))
    return cap.join(used, ["scenario_id", "machine_id"], "left").withColumn(
        "cap_u", F.col("cap_u") - F.coalesce(F.col("used_u"), F.lit(0))).drop("used_u")


def as_result(assigned: DataFrame, left: DataFrame, rounds: int, planned: int,
              *more: str) -> PlanResult:
    hours = left.select("scenario_id", "machine_id",
                        (F.col("cap_u").cast("double") / MICRO).alias("remaining_hours"))
    return PlanResult(
        schemas.conform(assigned.withColumn("profit", F.col("margin")), schemas.ASSIGNED_PLAN,
                        "scenario_id", *more),
        schemas.conform(hours, schemas.REMAINING_CAPACITY, "scenario_id"), rounds, planned)


def usable_capacity(cap: DataFrame) -> DataFrame:
    """``cap`` with null where a machine is down, so that nothing ever fits."""
    return cap.select("scenario_id", "machine_id",
                      F.when(~F.col("is_down"), F.col("cap_u")).alias("cap_u"))


def as_orders(cands: DataFrame) -> DataFrame:
    return cands if "options" in cands.columns else order_options(cands)


def held(cap: DataFrame) -> DataFrame:
    """Capacities (machines x scenarios) read once and made part of the plans that use them."""
    kinds = {"scenario_id": pa.string(), "machine_id": pa.string(), "cap_u": pa.int64(),
             "is_down": pa.bool_()}
    return _local(cap.sparkSession, [tuple(r) for r in cap.select(*kinds).collect()], kinds)


def plan_scenarios(cands: DataFrame, machines: DataFrame, planning_days: int = 21,
                   scenarios: Mapping[str, Sequence[str] | DataFrame | None] | None = None,
                   buckets: int | None = None) -> PlanResult:
    """Plan every scenario (set of down machines) in one set of jobs.

    ``cands`` needs order_id, machine_id, promised_date, processing_hours, margin, p_best,
    profit_score and base_confidence; or it has a row for each order with its ``options`` in
    order and priority keys, as :func:`order_options` and ``routes.order_options`` make them.
    """
    spark = cands.sparkSession
    ids, down = scenario_frame(spark, dict(scenarios or {BASELINE: None}))
    scratch = Scratch(spark, "plan")
    cap = held(capacity(machines, planning_days, ids, down))
    orders = scratch.write(numbered(as_orders(cands)), "orders")
    assigned, rounds, planned = plan_capacities(orders, usable_capacity(cap), ids, scratch,
                                                buckets)
    assigned = scratch.write(assigned, "assigned")
    scratch.drop("orders")
    scratch.drop("state")
    return as_result(assigned, remaining_capacity(cap, assigned), rounds, planned)


def greedy_assign_priority(cands: DataFrame, machines: DataFrame, planning_days: int = 21,
                           down_machines: Sequence[str] | DataFrame | None = None,
                           **kw) -> PlanResult:
    """One plan (D1). Result columns drop ``scenario_id``."""
    res = plan_scenarios(cands, machines, planning_days, {BASELINE: down_machines}, **kw)
    return PlanResult(res.assigned.drop("scenario_id"), res.remaining.drop("scenario_id"),
                      res.rounds, res.planned_buckets)


# ---- ranks exposed as tables ------------------------------------------------------------

def dense_order_rank(ranked: DataFrame) -> DataFrame:
    """1-based priority rank per component (O2) from the range-sorted ``prio``.

    Row number inside each (component, range bucket) plus the order count of
    the component's earlier buckets: no window ever spans a whole component.
    """
    b = ranked.withColumn("bucket", F.shiftright(F.col("prio"), 33))
    local = b.withColumn("local_rank", F.row_number().over(
        Window.partitionBy("component", "bucket").orderBy("prio")))
    totals = b.groupBy("component", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = totals.select("component", "bucket", F.coalesce(F.sum("n").over(
        Window.partitionBy("component").orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return (local.join(offsets, ["component", "bucket"])
                 .select("component", "order_id",
                         (F.col("local_rank") + F.col("offset")).cast("bigint")
                         .alias("priority_rank")))


def order_ranks(keys: DataFrame, buckets: int | None = None) -> DataFrame:
    """Priority rank of every order (O2) from ``keys``: component, order_id, k_score, k_due,
    k_need."""
    spark = keys.sparkSession
    scratch = Scratch(spark, "rank")
    keys = scratch.write(keys, "keys")
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                             keys.count() // RANK_ROWS + 1)
    ranked = scratch.write(rank_orders(keys, buckets), "ranked")
    return dense_order_rank(ranked)
