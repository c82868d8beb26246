"""Greedy planner: equal to a plain sequential loop; invariants hold."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from millrun.operators import greedy, scenario
from seq_planner import sequential_plan

CAND_SCHEMA = ("order_id string, machine_id string, part_category string, promised_date date, "
               "processing_hours double, margin double, p_best double, profit_score double, "
               "base_confidence double")
MACH_SCHEMA = "machine_id string, daily_capacity_hours double"


def random_instance(rng, n_orders, n_comp=2, machines_per_comp=3, score_levels=5,
                    null_rate=0.05):
    machines, cands = [], []
    for c in range(n_comp):
        for j in range(machines_per_comp):
            machines.append((f"M{c}{j}", float(rng.choice([0.5, 1.0, 1.5, 2.0, 4.0]))))
    for i in range(n_orders):
        comp = rng.randrange(n_comp)
        oid = f"O{i:04d}"
        due = dt.date(2025, 11, 1) + dt.timedelta(days=rng.randrange(5))
        margin = float(rng.choice([10.0, 20.0, 30.0]))
        for j in range(machines_per_comp):
            if rng.random() < 0.2:
                continue
            hours = None if rng.random() < null_rate else float(rng.choice([0, 1, 2, 3, 5, 8]))
            p = rng.randrange(score_levels) / score_levels
            score = None if rng.random() < null_rate else p * margin
            cands.append((oid, f"M{comp}{j}", f"C{comp}", due, hours, margin, p, score, p))
    return cands, machines


def plan_dict(res):
    return {r.order_id: r.machine_id for r in res.assigned.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_sequential(spark, seed):
    rng = random.Random(seed)
    cands, machines = random_instance(rng, 60)
    c = spark.createDataFrame(cands, CAND_SCHEMA)
    m = spark.createDataFrame(machines, MACH_SCHEMA)
    cp = pd.DataFrame(cands, columns=[f.split()[0] for f in CAND_SCHEMA.split(", ")])
    mp = pd.DataFrame(machines, columns=["machine_id", "daily_capacity_hours"])
    for down, buckets in [((), 20), (("M01",), 3), (("M00", "M10"), 7)]:
        expected, caps = sequential_plan(cp, mp, 3, down)
        res = greedy.greedy_assign_priority(c, m, 3, list(down), buckets=buckets)
        assert plan_dict(res) == expected, (buckets, down)
        rem = {r.machine_id: r.remaining_hours for r in res.remaining.collect()}
        assert rem == {k: v / 1e6 for k, v in caps.items()}


def test_one_component_and_scenarios(spark):
    rng = random.Random(7)
    cands, machines = random_instance(rng, 40, n_comp=1, machines_per_comp=4)
    c = spark.createDataFrame(cands, CAND_SCHEMA)
    m = spark.createDataFrame(machines, MACH_SCHEMA)
    cp = pd.DataFrame(cands, columns=[f.split()[0] for f in CAND_SCHEMA.split(", ")])
    mp = pd.DataFrame(machines, columns=["machine_id", "daily_capacity_hours"])
    res = greedy.plan_scenarios(c, m, 2, {"baseline": None, "down": ["M00"]},
                                buckets=2)
    rows = res.assigned.collect()
    for sid, down in (("baseline", ()), ("down", ("M00",))):
        expected, _ = sequential_plan(cp, mp, 2, down, component=None)
        got = {r.order_id: r.machine_id for r in rows if r.scenario_id == sid}
        assert got == expected


def test_edge_cases(spark):
    cands = [
        # unknown machine only -> unassigned; zero need on a known machine -> assigned
        ("A", "MX", "C", dt.date(2025, 1, 1), 1.0, 5.0, 0.5, 2.5, 0.5),
        ("B", "M1", "C", dt.date(2025, 1, 1), 0.0, 5.0, 0.5, 2.5, 0.5),
        # bigger than any machine -> unassigned
        ("C", "M1", "C", dt.date(2025, 1, 2), 100.0, 9.0, 0.9, 8.1, 0.9),
        # fills M1 exactly (capacity 2 x 3 days = 6)
        ("D", "M1", "C", dt.date(2025, 1, 3), 6.0, 1.0, 0.1, 0.1, 0.1),
        # NaN need never fits
        ("E", "M1", "C", dt.date(2025, 1, 3), float("nan"), 1.0, 0.1, 0.05, 0.1),
        (None, "M1", "C", dt.date(2025, 1, 3), 1.0, 1.0, 0.1, 0.05, 0.1),
    ]
    c = spark.createDataFrame(cands, CAND_SCHEMA)
    m = spark.createDataFrame([("M1", 2.0)], MACH_SCHEMA)
    res = greedy.greedy_assign_priority(c, m, 3, None)
    assert plan_dict(res) == {"B": "M1", "D": "M1"}
    assert {r.machine_id: r.remaining_hours for r in res.remaining.collect()} == {"M1": 0.0}


def test_empty_and_all_down(spark):
    c = spark.createDataFrame([], CAND_SCHEMA)
    m = spark.createDataFrame([("M1", 2.0)], MACH_SCHEMA)
    res = greedy.greedy_assign_priority(c, m, 3)
    assert res.assigned.count() == 0
    c = spark.createDataFrame([("A", "M1", "C", dt.date(2025, 1, 1), 1.0, 5.0, 0.5, 2.5, 0.5)],
                              CAND_SCHEMA)
    res = greedy.greedy_assign_priority(c, m, 3, ["M1", "M9"])
    assert res.assigned.count() == 0
    assert {r.machine_id: r.remaining_hours for r in res.remaining.collect()} == {
        "M1": 0.0, "M9": 0.0}


def _frames(spark, cands, machines):
    return (spark.createDataFrame(cands, CAND_SCHEMA), spark.createDataFrame(machines, MACH_SCHEMA),
            pd.DataFrame(cands, columns=[f.split()[0] for f in CAND_SCHEMA.split(", ")]),
            pd.DataFrame(machines, columns=["machine_id", "daily_capacity_hours"]))


@pytest.mark.parametrize("seed", [5, 6])
def test_one_component_in_many_buckets(spark, seed):
    """Each bucket has a few orders, so nearly all start from a guess."""
    rng = random.Random(seed)
    cands, machines = random_instance(rng, 120, n_comp=1, machines_per_comp=5)
    c, m, cp, mp = _frames(spark, cands, [(i, 4 * h) for i, h in machines])
    expected, caps = sequential_plan(cp, mp, 3)
    res = greedy.greedy_assign_priority(c, m, 3, buckets=30)
    assert plan_dict(res) == expected
    rem = {r.machine_id: r.remaining_hours for r in res.remaining.collect()}
    assert rem == {k: v / 1e6 for k, v in caps.items()}


def test_rounds_follow_the_machines_that_run_out(spark):
    """Eight times the orders and buckets, capacities to match: no more rounds to speak of."""
    rounds = []
    for times in (1, 8):
        cands = [(f"O{i:05d}", f"M{j}", "C", dt.date(2025, 1, 1), 1.0, 10.0, 0.5,
                  float(100 - j) if (i + j) % 3 else float(90 - j), 0.5)
                 for i in range(60 * times) for j in range(4)]
        machines = [(f"M{j}", 6.0 * times) for j in range(4)]
        c, m, cp, mp = _frames(spark, cands, machines)
        res = greedy.greedy_assign_priority(c, m, 2, buckets=6 * times)
        assert plan_dict(res) == sequential_plan(cp, mp, 2)[0]
        rounds.append(res.rounds)
    assert max(rounds) <= 6 and rounds[1] <= rounds[0] + 2


def test_scenarios_plan_only_what_the_down_machines_change(spark):
    """Untouched components and buckets before the first pick of a down machine are shared."""
    cands, machines = [], [(f"M{c}{j}", 30.0) for c in range(3) for j in range(3)]
    for c in range(3):
        for i in range(80):
            # the last quarter prefers M{c}2, the others never have it as an option
            options = [2, 0] if i >= 60 else [0, 1]
            cands += [(f"O{c}{i:03d}", f"M{c}{j}", f"C{c}", dt.date(2025, 1, 1), 1.0, 1.0, 0.5,
                       1000.0 - i - 0.1 * k, 0.5) for k, j in enumerate(options)]
    c, m, cp, mp = _frames(spark, cands, machines)
    alone = greedy.plan_scenarios(c, m, 2, {"baseline": None}, buckets=24)
    both = greedy.plan_scenarios(c, m, 2, {"baseline": None, "down": ["M12"], "same": ["MX"]},
                                 buckets=24)
    more = both.planned_buckets - alone.planned_buckets
    assert 0 < more <= 6  # a quarter of one component's eight buckets, some of them twice
    rows = both.assigned.collect()
    for sid, down in (("baseline", ()), ("down", ("M12",)), ("same", ())):
        assert {r.order_id: r.machine_id for r in rows if r.scenario_id == sid} \
            == sequential_plan(cp, mp, 2, down)[0]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_walk_and_its_bounds(seed):
    """A bucket's picks are the plain loop's, and hold for all capacities within the bounds."""
    rng = np.random.default_rng(seed)
    n, machines = 400, 4
    lists = [[(int(m), int(rng.integers(0, 9))) for m in rng.permutation(machines)[
        :rng.integers(0, machines + 1)]] for _ in range(n)]
    machine = np.zeros((n, machines), np.int64)
    need = np.full((n, machines), greedy._ABSENT)
    for i, options in enumerate(lists):
        for k, (m, w) in enumerate(options):
            machine[i, k], need[i, k] = m, w

    def loop(start):
        left, picks = list(start), []
        for options in lists:
            place = next((k for k, (m, w) in enumerate(options) if w <= left[m]), -1)
            picks.append(place)
            if place >= 0:
                left[options[place][0]] -= options[place][1]
        return picks

    start = np.array([greedy.NEVER, 0, 150, 10**6], np.int64)[rng.permutation(4)]
    start[start == 150] += rng.integers(0, 60)
    picks, taken, low, high = greedy.walk(machine, need, start)
    assert picks.tolist() == loop(start)
    assert ((start >= low) & (start < high)).all()
    for m in range(machines):
        inside = {int(x) for x in (low[m], high[m] - 1, low[m] + 1) if low[m] <= x < high[m]}
        for x in inside:
            moved = start.copy()
            moved[m] = x
            assert loop(moved) == picks.tolist()
        for x in (low[m] - 1, high[m]):
            if 0 <= x < 10**7:
                moved = start.copy()
                moved[m] = x
                assert loop(moved) != picks.tolist()


def test_negative_needs_are_never_assigned(spark):
    rows = [_row("A", "M1", "C1", hours=-1.0), _row("B", "M1", "C1", hours=2.0)]
    c, m, _, _ = _frames(spark, rows, [("M1", 2.0)])
    assert plan_dict(greedy.greedy_assign_priority(c, m, 1)) == {"B": "M1"}


def _pinned_loop(cands, machines, days, overrides, down):
    """Pins in order of time, then the sequential planner on what they leave."""
    caps = {m: 0 if m in down else round(h * 1e6) * days for m, h in machines}
    newest = {}
    for order, machine, at in sorted(overrides, key=lambda o: (o[2], o[1])):
        newest[order] = (at, machine)
    needs = {(r[0], r[1]): round(r[4] * 1e6) for r in cands if r[4] is not None}
    pins = {}
    for order, (at, machine) in sorted(newest.items(), key=lambda o: (o[1][0], o[0])):
        need = needs.get((order, machine))
        if need is not None and machine in caps and machine not in down and caps[machine] >= need:
            caps[machine] -= need
            pins[order] = machine
    rest = pd.DataFrame([r for r in cands if r[0] not in pins],
                        columns=[f.split()[0] for f in CAND_SCHEMA.split(", ")])
    left = pd.DataFrame([(m, u / days / 1e6) for m, u in caps.items()],
                        columns=["machine_id", "daily_capacity_hours"])
    plan, remaining = sequential_plan(rest, left, days, down)
    return pins, plan, {m: (0 if m in down else u / 1e6) for m, u in remaining.items()}, \
        {o: m for o, (_, m) in newest.items() if o not in pins}


@pytest.mark.parametrize("seed", [1, 2])
def test_overrides_take_capacity_first(spark, seed):
    rng = random.Random(seed)
    cands, machines = random_instance(rng, 60)
    overrides = [(f"O{rng.randrange(70):04d}", f"M{rng.randrange(2)}{rng.randrange(4)}",
                  dt.datetime(2025, 1, 1 + rng.randrange(3))) for _ in range(50)]
    down = ("M01",)
    pins, plan, remaining, rejected = _pinned_loop(cands, machines, 2, overrides, down)
    c, m, _, _ = _frames(spark, cands, machines)
    res = scenario.plan_with_overrides(c, m, 2, spark.createDataFrame(
        overrides, "order_id string, machine_id string, assigned_at timestamp"), list(down),
        buckets=4)
    rows = res.assigned.collect()
    assert {r.order_id: r.machine_id for r in rows if r.pinned} == pins and pins
    assert {r.order_id: r.machine_id for r in rows if not r.pinned} == plan
    assert {r.machine_id: r.remaining_hours for r in res.remaining.collect()} == remaining
    assert {r.order_id: r.machine_id for r in res.rejected.collect()} == rejected and rejected


def test_no_overrides_is_the_plain_plan(spark):
    cands, machines = random_instance(random.Random(3), 40)
    c, m, cp, mp = _frames(spark, cands, machines)
    none = spark.createDataFrame([], "order_id string, machine_id string, assigned_at timestamp")
    res = scenario.plan_with_overrides(c, m, 2, none)
    assert plan_dict(res) == sequential_plan(cp, mp, 2)[0]
    assert res.rejected.count() == 0


def _row(order, machine, category, hours=1.0, score=2.5, margin=5.0):
    return (order, machine, category, dt.date(2025, 1, 1), hours, margin, 0.5, score, 0.5)


def test_orders_and_machines_span_categories(spark):
    """One machine per order, one capacity per machine, whatever the categories say."""
    rows = [_row("A", "M1", "C1"), _row("A", "M2", "C2", score=9.0),
            _row("B", "M1", "C2", score=8.0), _row("B", "M2", "C1", score=8.0),
            _row("D", "M1", "C1", score=7.0), _row("E", "M3", "C3"), _row("F", "M3", None),
            _row("G", "M1", None, score=6.0)]
    c = spark.createDataFrame(rows, CAND_SCHEMA)
    machines = [("M1", 2.0), ("M2", 1.0), ("M3", 1.0)]
    m = spark.createDataFrame(machines, MACH_SCHEMA)
    expected, _ = sequential_plan(
        pd.DataFrame(rows, columns=[f.split()[0] for f in CAND_SCHEMA.split(", ")]),
        pd.DataFrame(machines, columns=["machine_id", "daily_capacity_hours"]), 1,
        component=None)
    res = greedy.greedy_assign_priority(c, m, 1)
    assert plan_dict(res) == expected
    assert res.assigned.count() == len(expected)


def test_random_instances_across_categories(spark):
    rng = random.Random(11)
    cands, machines = random_instance(rng, 50, n_comp=4, machines_per_comp=2)
    cands = [(o, f"M{rng.randrange(4)}{mid[2]}" if rng.random() < 0.1 else mid,
              None if rng.random() < 0.2 else comp, *rest) for o, mid, comp, *rest in cands]
    c = spark.createDataFrame(cands, CAND_SCHEMA)
    m = spark.createDataFrame(machines, MACH_SCHEMA)
    expected, _ = sequential_plan(
        pd.DataFrame(cands, columns=[f.split()[0] for f in CAND_SCHEMA.split(", ")]),
        pd.DataFrame(machines, columns=["machine_id", "daily_capacity_hours"]), 3,
        component=None)
    assert plan_dict(greedy.greedy_assign_priority(c, m, 3, buckets=6)) == expected


def test_duplicate_candidates_take_the_least_values(spark):
    rows = [_row("A", "M1", "C1", margin=7.0), _row("A", "M1", "C1", margin=5.0),
            _row("A", "M1", "C1", margin=6.0)]
    m = spark.createDataFrame([("M1", 2.0)], MACH_SCHEMA)
    for order in (rows, rows[::-1]):
        res = greedy.greedy_assign_priority(spark.createDataFrame(order, CAND_SCHEMA), m, 1)
        assert [(r.order_id, r.profit) for r in res.assigned.collect()] == [("A", 5.0)]


def test_duplicate_backlog_key_rejected(spark):
    plan = spark.createDataFrame([("A", "M1")], "order_id string, machine_id string")
    backlog = spark.createDataFrame(
        [("A", "P", "C", "x", 1), ("A", "P", "C", "y", 2)],
        "order_id string, part_id string, category string, customer_name string, quantity int")
    with pytest.raises(Exception, match="duplicate order_id: A"):
        scenario.enrich(plan, backlog).collect()


def test_invariants_on_fixture(spark):
    from millrun.plans import queries as Q
    from conftest import SMALL
    res = Q._plan(spark, SMALL, days=2)
    plan = res.assigned.toPandas()
    assert plan["order_id"].is_unique
    m = Q.fx.machines(spark, SMALL).toPandas().set_index("machine_id")
    used = plan.groupby("machine_id")["processing_hours"].sum()
    for mid, u in used.items():
        assert u <= m.loc[mid, "daily_capacity_hours"] * 2 + 1e-9
    cands = Q._scored(spark, SMALL).toPandas()
    merged = plan.merge(cands, on=["order_id", "machine_id"])
    assert len(merged) == len(plan)
    assert (merged["part_category"] == merged["capability"]).all()
    # an unassigned order fits nowhere in the final remaining capacity
    rem = {r.machine_id: r.remaining_hours for r in res.remaining.collect()}
    open_orders = cands[~cands["order_id"].isin(plan["order_id"])]
    assert (open_orders["processing_hours"] > open_orders["machine_id"].map(rem)).all()


def test_only_rows_that_may_fit_are_sent_to_the_planning_tasks(spark, tmp_path):
    """Options that don't fit a bucket's start count for its bounds only, and carry no payload."""
    o = "struct<m:int,need:bigint,at:int>"
    state = spark.createDataFrame(
        [("c", 0, i, 10 + i, [(0, 5 + i, 0), (1, 9, 1)]) for i in range(4)],
        f"component string, bucket bigint, prio bigint, row bigint, cand array<{o}>")
    asked = spark.createDataFrame([(0, "c", 0, [6, 2]), (1, "c", 0, [5, 1])],
                                  "variant int, component string, bucket bigint, "
                                  "starts array<bigint>")
    least = {r.m: r.least for r in greedy._too_long(state, asked).collect()}
    assert least == {0: 7, 1: 9}
    picks = greedy._in_buckets(state, asked, greedy._chosen, greedy._PICK).collect()
    assert sorted((r.variant, r.row, r["at"]) for r in picks) == [(0, 10, 0), (1, 10, 0)]
    none = spark.createDataFrame([(0, "c", 0, [1, 1])], asked.schema)
    assert greedy._in_buckets(state, none, greedy._chosen, greedy._PICK).count() == 0
