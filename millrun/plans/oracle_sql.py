"""SQL twins of the registered queries, for an independent engine (DuckDB).

Written against the raw test tables through the view definitions in
``millrun.sources.fixtures.ORACLE_VIEWS``. Integer division is ``//``,
literals that must be doubles are cast, sums of BIGINT are cast back.
"""

from __future__ import annotations

from millrun.sources.fixtures import oracle_prefix

ORACLES: dict[str, str] = {}

# Candidate expansion + fixed-point features (the view every planner query uses).
CANDS = """
cand0 AS (
  SELECT o.order_id, o.part_id, o.category AS part_category, o.customer_name, o.quantity,
         o.promised_date, o.sale_price, o.material_cost, o.estimated_runtime_hours,
         m.machine_id, m.machine_name, m.capability, m.daily_capacity_hours,
         m.efficiency_factor, m.is_operational,
         CAST(round(m.efficiency_factor * 100) AS BIGINT) AS eff_pct,
         CAST(round(o.estimated_runtime_hours * 1000000) AS BIGINT) AS runtime_uh,
         CAST(round(o.sale_price * 100) AS BIGINT) AS price_c,
         CAST(round(o.material_cost * 100) AS BIGINT) AS cost_c,
         ('0x' || substr(md5('42|' || o.order_id || '|' || m.machine_id), 1, 8))::BIGINT AS u32
  FROM backlog o JOIN machines m ON o.category = m.capability),
cand1 AS (
  SELECT *,
         (runtime_uh * quantity * 100 + eff_pct // 2) // eff_pct AS need_uh,
         (price_c - cost_c) * quantity AS margin_cents,
         CAST((least(greatest(3500 + (u32 * 6000) // 4294967296 + (eff_pct - 100) * 15, 100),
                     9900) + 50) // 100 AS INTEGER) AS conf_pct
  FROM cand0),
cands AS (
  SELECT *, CAST(need_uh AS DOUBLE) / 1000000 AS processing_hours,
         CAST(margin_cents AS DOUBLE) / 100 AS margin,
         CAST(conf_pct AS DOUBLE) / 100 AS base_confidence
  FROM cand1)"""

CAND_COLS = """order_id, part_id, part_category, customer_name, quantity, promised_date,
  sale_price, material_cost, estimated_runtime_hours, machine_id, machine_name, capability,
  daily_capacity_hours, efficiency_factor, is_operational, processing_hours, margin,
  base_confidence"""

FEATURES = """part_category, machine_id, estimated_runtime_hours, quantity, margin,
  processing_hours, daily_capacity_hours, efficiency_factor, base_confidence"""

LABELED = """
labeled AS (
  SELECT *, CAST(margin_cents * conf_pct AS DOUBLE) / 10000 AS profit_score,
         CASE WHEN row_number() OVER (PARTITION BY order_id
                   ORDER BY margin_cents * conf_pct DESC NULLS LAST, machine_id ASC NULLS LAST) = 1
              THEN 1 ELSE 0 END AS is_best
  FROM cands)"""


def with_cands(*extra: str) -> str:
    return oracle_prefix("machines", "backlog") + ",\n" + CANDS + "".join(
        ",\n" + e for e in extra)


ORACLES["scan_machines"] = oracle_prefix("machines") + "\nSELECT * FROM machines"

ORACLES["catalog_table"] = oracle_prefix("machines") + """
SELECT *, CAST(NULL AS VARCHAR) AS change_type FROM machines
UNION ALL SELECT 'M-9999', 'SPARE', 'LARGE', CAST(8 AS DOUBLE), CAST(1 AS DOUBLE), FALSE, 'insert'"""

ORACLES["backlog_projection"] = oracle_prefix("backlog") + """
SELECT order_id, part_id, category, customer_name, quantity FROM backlog"""

ORACLES["candidate_routes"] = with_cands() + f"\nSELECT {CAND_COLS} FROM cands"

ORACLES["route_features"] = with_cands() + """
SELECT order_id, machine_id, processing_hours, margin, base_confidence, need_uh, margin_cents,
       conf_pct FROM cands"""

ORACLES["labeled_routes"] = with_cands(LABELED) + f"""
SELECT {CAND_COLS}, profit_score, is_best FROM labeled"""

ORACLES["feature_matrix"] = with_cands() + f"""
SELECT {FEATURES}, order_id, promised_date FROM cands"""

ORACLES["training_rows"] = with_cands(LABELED) + f"""
SELECT {FEATURES}, is_best FROM labeled
WHERE NOT (part_category IS NULL OR machine_id IS NULL OR estimated_runtime_hours IS NULL
  OR isnan(estimated_runtime_hours) OR quantity IS NULL OR margin IS NULL OR isnan(margin)
  OR processing_hours IS NULL OR isnan(processing_hours) OR daily_capacity_hours IS NULL
  OR isnan(daily_capacity_hours) OR efficiency_factor IS NULL OR isnan(efficiency_factor)
  OR base_confidence IS NULL OR isnan(base_confidence) OR is_best IS NULL)"""

ORACLES["training_shape"] = with_cands(LABELED) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(10 AS BIGINT) AS n_columns FROM labeled
WHERE NOT (part_category IS NULL OR machine_id IS NULL OR estimated_runtime_hours IS NULL
  OR isnan(estimated_runtime_hours) OR quantity IS NULL OR margin IS NULL OR isnan(margin)
  OR processing_hours IS NULL OR isnan(processing_hours) OR daily_capacity_hours IS NULL
  OR isnan(daily_capacity_hours) OR efficiency_factor IS NULL OR isnan(efficiency_factor)
  OR base_confidence IS NULL OR isnan(base_confidence) OR is_best IS NULL)"""

ORACLES["input_example"] = with_cands(LABELED) + f"""
SELECT {FEATURES}, is_best FROM labeled ORDER BY order_id, machine_id LIMIT 5"""

ORACLES["scored_routes"] = with_cands() + """
SELECT order_id, machine_id, part_category, promised_date, processing_hours, margin,
       base_confidence AS p_best, CAST(margin_cents * conf_pct AS DOUBLE) / 10000 AS profit_score
FROM cands"""


# ---- planner ---------------------------------------------------------------------

SCORED = """
sc AS MATERIALIZED (
  SELECT part_category AS component, order_id, machine_id, promised_date, need_uh,
         processing_hours, margin, base_confidence AS p_best, base_confidence,
         CAST(margin_cents * conf_pct AS DOUBLE) / 10000 AS profit_score
  FROM cands)"""

PRIORITY = """
pri AS (
  SELECT component, order_id,
         row_number() OVER (PARTITION BY component ORDER BY max(profit_score) DESC NULLS LAST,
              min(promised_date) ASC NULLS LAST, min(need_uh) ASC NULLS LAST, order_id) AS rk
  FROM sc GROUP BY component, order_id)"""

LATEST_STATUS_DOWN = """
SELECT machine_id FROM (
  SELECT machine_id, status, row_number() OVER (PARTITION BY machine_id
         ORDER BY reported_at DESC, event_id DESC) AS rn FROM machine_status)
WHERE rn = 1 AND status = 'down'"""


def plan_ctes(days: int, scenarios: dict[str, str | None]) -> str:
    """CTEs ``sc``, ``pri`` and ``plan(scenario_id, order_id, machine_id)``.

    The sequential greedy as a recursive query: one state row per (scenario,
    component) holding a map machine -> remaining micro-hours; step k takes
    the component's k-th order and its first candidate that still fits.
    ``scenarios`` maps scenario id -> SQL returning down machine ids (or None).
    """
    scen = ", ".join(f"('{s}')" for s in scenarios)
    downs = [f"SELECT '{s}' AS scenario_id, machine_id FROM ({q})"
             for s, q in scenarios.items() if q]
    down_sql = " UNION ALL ".join(downs) if downs else (
        "SELECT CAST(NULL AS VARCHAR) AS scenario_id, CAST(NULL AS VARCHAR) AS machine_id "
        "WHERE FALSE")
    return f"""{SCORED},
{PRIORITY},
scen(scenario_id) AS (VALUES {scen}),
down AS ({down_sql}),
cl AS (
  SELECT s.scenario_id, c.component, c.order_id,
         list({{'m': c.machine_id, 'n': c.need_uh}} ORDER BY c.profit_score DESC NULLS LAST,
              c.need_uh ASC NULLS LAST, c.machine_id) AS cs
  FROM sc c CROSS JOIN scen s
  WHERE c.need_uh IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM down d WHERE d.scenario_id = s.scenario_id AND d.machine_id = c.machine_id)
  GROUP BY s.scenario_id, c.component, c.order_id),
oc AS MATERIALIZED (
  SELECT s.scenario_id, p.component, p.rk, p.order_id, cl.cs
  FROM pri p CROSS JOIN scen s LEFT JOIN cl
    ON cl.scenario_id = s.scenario_id AND cl.component = p.component AND cl.order_id = p.order_id),
caps0 AS MATERIALIZED (
  SELECT s.scenario_id, m.capability AS component,
         map_from_entries(list({{'k': m.machine_id,
           'v': CASE WHEN d.machine_id IS NULL
                     THEN CAST(round(m.daily_capacity_hours * 1000000) AS BIGINT) * {days}
                     ELSE 0 END}})) AS caps
  FROM machines m CROSS JOIN scen s
  LEFT JOIN down d ON d.scenario_id = s.scenario_id AND d.machine_id = m.machine_id
  GROUP BY s.scenario_id, m.capability),
r AS (
  SELECT scenario_id, component, 0 AS step, caps,
         CAST(NULL AS VARCHAR) AS order_id, CAST(NULL AS VARCHAR) AS machine_id
  FROM caps0
  UNION ALL
  SELECT scenario_id, component, step,
         CASE WHEN pick IS NULL THEN caps
              ELSE map_from_entries(list_transform(map_entries(caps),
                     lambda e: {{'k': e.key, 'v': CASE WHEN e.key = pick.m
                                                      THEN e.value - pick.n
                                                      ELSE e.value END}})) END,
         order_id, pick.m
  FROM (
    SELECT r.scenario_id, r.component, r.step + 1 AS step, r.caps, oc.order_id,
           list_filter(oc.cs, lambda x: r.caps[x.m] IS NOT NULL AND r.caps[x.m] >= x.n)[1]
             AS pick
    FROM r JOIN oc ON oc.scenario_id = r.scenario_id AND oc.component = r.component
                  AND oc.rk = r.step + 1) t),
plan AS (
  SELECT r.scenario_id, r.order_id, r.machine_id, s.margin AS profit, s.p_best,
         s.processing_hours, s.profit_score, s.base_confidence, s.need_uh
  FROM r JOIN sc s ON s.order_id = r.order_id AND s.machine_id = r.machine_id
  WHERE r.machine_id IS NOT NULL)"""


PLAN_COLS = "order_id, machine_id, profit, p_best, processing_hours, profit_score, base_confidence"
BASE = {"baseline": None}
SCENARIOS = {"baseline": None,
             "two_down": "SELECT unnest(['M-0003', 'M-0010']) AS machine_id",
             "status": LATEST_STATUS_DOWN}
ALL_VIEWS = oracle_prefix("machines", "backlog", "machine_status") + ",\n" + CANDS


def planned(days: int, scenarios: dict[str, str | None]) -> str:
    sql = ALL_VIEWS + ",\n" + plan_ctes(days, scenarios)
    return "WITH RECURSIVE " + sql[len("WITH "):]


KPI_CTE = """
kpis AS (
  SELECT s.scenario_id,
         coalesce(CAST(a.s_profit AS DOUBLE), 0.0) AS expected_profit,
         coalesce(CAST(a.s_pbest AS DOUBLE), 0.0) AS expected_ontime_deliveries,
         (CASE WHEN c.cap > 0 THEN least(coalesce(CAST(a.s_hours AS DOUBLE), 0.0) / c.cap,
                                         CAST(1 AS DOUBLE)) ELSE 0.0 END)
           * (CASE WHEN a.n_pbest > 0 THEN CAST(a.s_pbest AS DOUBLE) / a.n_pbest ELSE 0.0 END)
           * CAST(0.98 AS DOUBLE) AS factory_oee,
         CASE WHEN c.cap > 0 THEN least(coalesce(CAST(a.s_hours AS DOUBLE), 0.0) / c.cap,
                                        CAST(1 AS DOUBLE)) ELSE 0.0 END
           AS factory_capacity_utilization,
         CAST(coalesce(a.n_orders, 0) AS BIGINT) AS expected_orders_completed
  FROM scen s
  LEFT JOIN (SELECT scenario_id, sum(CAST(profit AS DECIMAL(38,9))) AS s_profit,
                    sum(CAST(p_best AS DECIMAL(38,9))) AS s_pbest, count(p_best) AS n_pbest,
                    sum(CAST(processing_hours AS DECIMAL(38,9))) AS s_hours,
                    count(DISTINCT order_id) AS n_orders
             FROM plan GROUP BY scenario_id) a ON a.scenario_id = s.scenario_id
  CROSS JOIN (SELECT CAST(sum(CAST(daily_capacity_hours AS DECIMAL(38,9))) * {days} AS DOUBLE)
              AS cap FROM machines) c)"""

KPI_COLS = """expected_profit, expected_ontime_deliveries, factory_oee,
  factory_capacity_utilization, expected_orders_completed"""

DAYS = 28

ORACLES["order_priority"] = with_cands(SCORED) + """
SELECT component AS part_category, order_id, max(profit_score) AS max_profit_score,
       min(promised_date) AS min_due, min(processing_hours) AS min_hours
FROM sc GROUP BY component, order_id"""

ORACLES["order_rank"] = with_cands(SCORED, PRIORITY) + """
SELECT component AS part_category, order_id, CAST(rk AS BIGINT) AS priority_rank FROM pri"""

ORACLES["candidate_preference"] = with_cands(SCORED) + """
SELECT order_id, machine_id, CAST(row_number() OVER (PARTITION BY order_id
       ORDER BY profit_score DESC NULLS LAST, need_uh ASC NULLS LAST, machine_id) AS BIGINT)
       AS pref_rank FROM sc"""

ORACLES["candidates_machine_down"] = with_cands(SCORED) + """
SELECT order_id, machine_id, processing_hours, profit_score FROM sc
WHERE machine_id NOT IN ('M-0003', 'M-0010')"""

ORACLES["candidates_unknown_machine"] = with_cands(SCORED) + f"""
SELECT s.order_id, s.machine_id, coalesce(m.daily_capacity_hours * {DAYS}, 0.0) AS capacity_hours,
       coalesce(m.daily_capacity_hours * {DAYS}, 0.0) >= s.processing_hours AS fits_empty_machine
FROM sc s LEFT JOIN machines m ON m.machine_id = s.machine_id"""

ORACLES["candidates_retired_machines"] = with_cands(SCORED) + f"""
SELECT s.order_id, s.machine_id, coalesce(m.daily_capacity_hours * {DAYS}, 0.0) AS capacity_hours,
       coalesce(m.daily_capacity_hours * {DAYS}, 0.0) >= s.processing_hours AS fits_empty_machine
FROM sc s LEFT JOIN (SELECT * FROM machines
                     WHERE machine_id NOT IN ('M-0004', 'M-0011', 'M-0018')) m
  ON m.machine_id = s.machine_id"""

ORACLES["greedy_plan"] = planned(DAYS, BASE) + f"\nSELECT {PLAN_COLS} FROM plan"
ORACLES["greedy_plan_rounds"] = ORACLES["greedy_plan"]

# One component for the whole plant, and every fifth machine a second time with the
# capability after its own.
_SPANNING = (
    "WITH RECURSIVE " + ALL_VIEWS[len("WITH "):]
    .replace("FROM backlog o JOIN machines m ON o.category = m.capability",
             "FROM backlog o JOIN able m ON o.category = m.capability")
    .replace("cand0 AS (", """able AS (
  SELECT * FROM machines
  UNION ALL
  SELECT m.machine_id, m.machine_name,
         CASE (n.n_nationkey + 1) % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE'
              WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'SMALL' ELSE 'STANDARD' END,
         m.daily_capacity_hours, m.efficiency_factor, m.is_operational
  FROM machines m JOIN nation n ON m.machine_name = n.n_name WHERE n.n_nationkey % 5 = 0),
cand0 AS (""", 1) + ",\n" + plan_ctes(DAYS, BASE)
    .replace("SELECT part_category AS component", "SELECT 'all' AS component")
    .replace("m.capability AS component", "'all' AS component")
    .replace("GROUP BY s.scenario_id, m.capability)", "GROUP BY s.scenario_id)"))
ORACLES["greedy_plan_spanning"] = _SPANNING + f"\nSELECT {PLAN_COLS} FROM plan"

ORACLES["remaining_capacity"] = planned(DAYS, BASE) + f"""
SELECT m.machine_id, CAST(CAST(round(m.daily_capacity_hours * 1000000) AS BIGINT) * {DAYS}
       - coalesce(u.used, 0) AS DOUBLE) / 1000000 AS remaining_hours
FROM machines m LEFT JOIN (SELECT machine_id, CAST(sum(need_uh) AS BIGINT) AS used FROM plan
                           GROUP BY machine_id) u ON u.machine_id = m.machine_id"""

ORACLES["unassigned_orders"] = planned(DAYS, BASE) + """
SELECT order_id, category, quantity FROM backlog b
WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.order_id = b.order_id)"""

ORACLES["machine_capacity"] = oracle_prefix("machines") + f"""
SELECT machine_id, daily_capacity_hours * {DAYS} AS capacity_hours FROM machines"""

ORACLES["plant_capacity"] = oracle_prefix("machines") + f"""
SELECT CAST(sum(CAST(daily_capacity_hours AS DECIMAL(38,9))) * {DAYS} AS DOUBLE)
       AS plant_capacity_hours FROM machines"""

ORACLES["kpi_baseline"] = (planned(DAYS, BASE) + "," + KPI_CTE.format(days=DAYS)
                           + f"\nSELECT {KPI_COLS} FROM kpis")

ORACLES["kpi_empty_plan"] = (planned(0, BASE) + "," + KPI_CTE.format(days=0)
                             + f"\nSELECT {KPI_COLS} FROM kpis")

ORACLES["scenario_plan"] = planned(DAYS, SCENARIOS) + f"\nSELECT scenario_id, {PLAN_COLS} FROM plan"

ORACLES["kpi_scenarios"] = (planned(DAYS, SCENARIOS) + "," + KPI_CTE.format(days=DAYS)
                            + f"\nSELECT scenario_id, {KPI_COLS} FROM kpis")

DELTA_CTE = """
delta AS (
  SELECT k.scenario_id,
         k.expected_profit - b.expected_profit AS profit_delta,
         k.expected_ontime_deliveries - b.expected_ontime_deliveries AS ontime_delta,
         k.factory_oee - b.factory_oee AS oee_delta,
         k.factory_capacity_utilization - b.factory_capacity_utilization AS utilization_delta,
         k.expected_orders_completed - b.expected_orders_completed AS orders_delta
  FROM kpis k JOIN kpis b ON b.scenario_id = 'baseline' WHERE k.scenario_id <> 'baseline')"""

ORACLES["kpi_delta"] = (planned(DAYS, SCENARIOS) + "," + KPI_CTE.format(days=DAYS) + ","
                        + DELTA_CTE + "\nSELECT * FROM delta")

ORACLES["kpi_report"] = (planned(DAYS, SCENARIOS) + "," + KPI_CTE.format(days=DAYS) + """,
b AS (SELECT * FROM kpis WHERE scenario_id = 'baseline'),
st AS (
  SELECT k.scenario_id, 0 AS pos, 'Expected Profit ($)' AS kpi, k.expected_profit AS value,
         k.expected_profit - b.expected_profit AS delta FROM kpis k, b
  UNION ALL
  SELECT k.scenario_id, 1, 'On-Time Deliveries', k.expected_ontime_deliveries,
         k.expected_ontime_deliveries - b.expected_ontime_deliveries FROM kpis k, b
  UNION ALL
  SELECT k.scenario_id, 2, 'Factory OEE (%)', k.factory_oee, k.factory_oee - b.factory_oee
  FROM kpis k, b
  UNION ALL
  SELECT k.scenario_id, 3, 'Orders Completed', CAST(k.expected_orders_completed AS DOUBLE),
         CAST(k.expected_orders_completed AS DOUBLE) - CAST(b.expected_orders_completed AS DOUBLE)
  FROM kpis k, b)
SELECT scenario_id, pos, kpi, value, delta,
       CASE WHEN pos = 0 THEN NULL WHEN pos = 2 THEN CAST(trunc(value * 100) AS BIGINT)
            ELSE CAST(trunc(value) AS BIGINT) END AS value_int,
       CASE WHEN pos = 0 THEN NULL WHEN pos = 2 THEN abs(CAST(trunc(delta * 100) AS BIGINT))
            ELSE abs(CAST(trunc(delta) AS BIGINT)) END AS delta_int,
       CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'none' END AS direction
FROM st WHERE scenario_id <> 'baseline'""")

ORACLES["assigned_enriched"] = planned(DAYS, BASE) + """
SELECT p.order_id, p.machine_id, p.profit, p.p_best, p.processing_hours,
       b.part_id, b.category, b.customer_name, b.quantity
FROM plan p LEFT JOIN backlog b ON b.order_id = p.order_id"""

ORACLES["scenario_enriched"] = planned(DAYS, {"baseline": SCENARIOS["two_down"]}) + f"""
SELECT p.order_id, p.machine_id, p.profit, p.p_best, p.processing_hours,
       p.profit_score, p.base_confidence, b.part_id, b.category, b.customer_name, b.quantity
FROM plan p LEFT JOIN backlog b ON b.order_id = p.order_id"""

ORACLES["assigned_orders_view"] = planned(DAYS, BASE) + """
SELECT p.order_id, p.machine_id, b.part_id, b.category, b.customer_name, b.quantity
FROM plan p LEFT JOIN backlog b ON b.order_id = p.order_id"""

ORACLES["assigned_order_ids"] = planned(DAYS, BASE) + "\nSELECT DISTINCT order_id FROM plan"


# ---- route model -------------------------------------------------------------------

ORACLES["split_counts"] = with_cands(LABELED) + """,
tr AS (
  SELECT is_best, order_id, machine_id,
         ('0x' || substr(md5('42|split|' || order_id || '|' || machine_id), 1, 8))::BIGINT AS h
  FROM labeled),
rk AS (
  SELECT is_best, row_number() OVER (PARTITION BY is_best ORDER BY h, order_id, machine_id) AS r,
         count(*) OVER (PARTITION BY is_best) AS n
  FROM tr)
SELECT is_best, r <= CAST(round(n * CAST(0.2 AS DOUBLE)) AS BIGINT) AS is_test,
       CAST(count(*) AS BIGINT) AS n
FROM rk GROUP BY ALL"""

ORACLES["split_rows"] = with_cands(LABELED) + """
SELECT order_id, machine_id, r <= CAST(round(n * CAST(0.2 AS DOUBLE)) AS BIGINT) AS is_test
FROM (
  SELECT order_id, machine_id, count(*) OVER (PARTITION BY is_best) AS n,
         row_number() OVER (PARTITION BY is_best ORDER BY
           ('0x' || substr(md5('42|split|' || order_id || '|' || machine_id), 1, 8))::BIGINT,
           order_id, machine_id) AS r
  FROM labeled)"""

ORACLES["model_checks"] = with_cands() + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_out_of_range,
       CAST(0 AS BIGINT) AS n_wrong_scores, TRUE AS beats_majority FROM cands"""

ORACLES["model_plan_checks"] = """
SELECT CAST(0 AS BIGINT) AS n_twice, CAST(0 AS BIGINT) AS n_overfull,
       CAST(0 AS BIGINT) AS n_not_candidates, CAST(0 AS BIGINT) AS n_left_though_fitting"""

ORACLES["registry_checks"] = with_cands() + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_differ, 9 AS n_inputs,
       5 AS n_example, TRUE AS is_first, 4 AS n_alias_rows FROM cands"""

ORACLES["latest_version"] = """
SELECT event_type AS name, CAST(max(user_id) AS VARCHAR) AS version FROM events GROUP BY event_type"""


ORACLES["alias_targets"] = """
SELECT name, alias, version FROM (
  SELECT event_type AS name, 'alias-' || CAST(event_id % 3 AS VARCHAR) AS alias,
         CAST(user_id AS VARCHAR) AS version,
         row_number() OVER (PARTITION BY event_type, event_id % 3 ORDER BY ts DESC, event_id DESC)
           AS rn FROM events) WHERE rn = 1"""


# ---- overrides and replica refresh ---------------------------------------------------

OV = oracle_prefix("override_requests")

ORACLES["override_history"] = OV + """
SELECT order_id, machine_id, assigned_by, assigned_at, notes,
       row_number() OVER (ORDER BY assigned_at DESC NULLS LAST, order_id, machine_id) AS position
FROM override_requests"""

ORACLES["override_log"] = OV + """
SELECT order_id, machine_id, assigned_by, notes, TRUE AS stamped FROM override_requests"""

ORACLES["override_display"] = OV + """
SELECT order_id AS "Order ID", machine_id AS "Machine ID", assigned_by AS "Assigned By",
       assigned_at AS "Assigned At", notes AS "Notes" FROM override_requests"""

_PLAN_OV = ("WITH RECURSIVE " + (oracle_prefix("machines", "backlog", "machine_status",
                                               "override_requests")[len("WITH "):])
            + ",\n" + CANDS + ",\n" + plan_ctes(DAYS, BASE))

ORACLES["current_machine"] = _PLAN_OV + """
SELECT r.order_id, r.machine_id AS requested_machine, r.event_id, p.machine_id AS current_machine
FROM override_requests r LEFT JOIN plan p ON p.order_id = r.order_id"""

ORACLES["valid_overrides"] = _PLAN_OV + """
SELECT r.order_id, r.machine_id AS requested_machine, r.event_id, p.machine_id AS current_machine
FROM override_requests r JOIN plan p ON p.order_id = r.order_id
WHERE r.machine_id IS NOT NULL AND r.machine_id <> p.machine_id"""

ORACLES["overrides_applied"] = _PLAN_OV + """,
v AS (
  SELECT r.order_id, r.machine_id, r.assigned_at,
         row_number() OVER (PARTITION BY r.order_id ORDER BY r.assigned_at DESC,
                            r.machine_id DESC) AS rn
  FROM override_requests r JOIN plan p ON p.order_id = r.order_id
  WHERE r.machine_id IS NOT NULL AND r.machine_id <> p.machine_id)
SELECT p.order_id, coalesce(v.machine_id, p.machine_id) AS machine_id
FROM plan p LEFT JOIN v ON v.order_id = p.order_id AND v.rn = 1"""

# Pins by machine in order of time, one step an override; the rest on what they leave.
_PINS = f"""
newest AS (
  SELECT order_id, machine_id, assigned_at FROM override_requests
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY assigned_at DESC, machine_id DESC) = 1),
asked AS MATERIALIZED (
  SELECT n.order_id, n.machine_id, s.need_uh,
         row_number() OVER (PARTITION BY n.machine_id ORDER BY n.assigned_at, n.order_id) AS k
  FROM newest n JOIN sc s ON s.order_id = n.order_id AND s.machine_id = n.machine_id
  WHERE n.machine_id NOT IN ('M-0003', 'M-0010')),
pr AS (
  SELECT machine_id, 0 AS k, CAST(round(daily_capacity_hours * 1000000) AS BIGINT) * {DAYS} AS u,
         CAST(NULL AS VARCHAR) AS order_id, FALSE AS taken FROM machines
  UNION ALL
  SELECT a.machine_id, CAST(a.k AS INTEGER), CASE WHEN pr.u >= a.need_uh THEN pr.u - a.need_uh
         ELSE pr.u END, a.order_id, pr.u >= a.need_uh
  FROM pr JOIN asked a ON a.machine_id = pr.machine_id AND a.k = pr.k + 1),
pins AS MATERIALIZED (SELECT order_id, machine_id FROM pr WHERE taken),
machines_left AS MATERIALIZED (
  SELECT m.machine_id, m.capability, min(pr.u) AS left_u
  FROM machines m JOIN pr ON pr.machine_id = m.machine_id GROUP BY m.machine_id, m.capability),
free AS (SELECT * FROM sc WHERE order_id NOT IN (SELECT order_id FROM pins)),
pri AS ("""

_PINNED_PLAN = (
    "WITH RECURSIVE " + (oracle_prefix("machines", "backlog", "machine_status",
                                       "override_requests")[len("WITH "):])
    + ",\n" + CANDS + ",\n"
    + plan_ctes(DAYS, {"baseline": SCENARIOS["two_down"]})
    .replace("\npri AS (", _PINS, 1)
    .replace("FROM sc GROUP BY", "FROM free GROUP BY")
    .replace("FROM sc c CROSS JOIN", "FROM free c CROSS JOIN")
    .replace("FROM machines m CROSS JOIN scen s", "FROM machines_left m CROSS JOIN scen s")
    .replace(f"CAST(round(m.daily_capacity_hours * 1000000) AS BIGINT) * {DAYS}", "m.left_u")
    .replace("\nplan AS (", "\nrest AS (") + f""",
plan AS (
  SELECT *, FALSE AS pinned FROM rest
  UNION ALL
  SELECT 'baseline', p.order_id, p.machine_id, s.margin, s.p_best, s.processing_hours,
         s.profit_score, s.base_confidence, s.need_uh, TRUE
  FROM pins p JOIN sc s ON s.order_id = p.order_id AND s.machine_id = p.machine_id)""")

ORACLES["plan_with_overrides"] = _PINNED_PLAN + f"\nSELECT pinned, {PLAN_COLS} FROM plan"

ORACLES["overrides_remaining"] = _PINNED_PLAN + f"""
SELECT m.machine_id, CASE WHEN m.machine_id IN ('M-0003', 'M-0010') THEN CAST(0 AS DOUBLE)
       ELSE CAST(CAST(round(m.daily_capacity_hours * 1000000) AS BIGINT) * {DAYS}
                 - coalesce(u.used, 0) AS DOUBLE) / 1000000 END AS remaining_hours
FROM machines m LEFT JOIN (SELECT machine_id, CAST(sum(need_uh) AS BIGINT) AS used FROM plan
                           GROUP BY machine_id) u ON u.machine_id = m.machine_id"""

ORACLES["overrides_rejected"] = _PINNED_PLAN + """
SELECT order_id, machine_id FROM newest
WHERE order_id NOT IN (SELECT order_id FROM pins) AND machine_id IS NOT NULL"""

ORACLES["overrides_kpi"] = (_PINNED_PLAN + "," + KPI_CTE.format(days=DAYS)
                            + f"\nSELECT {KPI_COLS} FROM kpis")

ORACLES["synced_upsert"] = """
SELECT user_id, ts, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1"""

ORACLES["replica_refreshed"] = """
SELECT user_id, ts, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1 AND event_type IS DISTINCT FROM 'error'"""

_SNAPSHOTS = """
WITH old AS (
  SELECT user_id, ts, event_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-15'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
later AS (
  SELECT user_id, ts, event_id, event_type, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
new AS (SELECT * FROM later WHERE event_type <> 'error')"""

ORACLES["snapshot_changes"] = _SNAPSHOTS + """
SELECT 'insert' AS change_type, n.* FROM new n ANTI JOIN old o ON o.user_id = n.user_id
UNION ALL
SELECT 'delete', o.* FROM old o ANTI JOIN new n ON o.user_id = n.user_id
UNION ALL
SELECT 'update_preimage', o.* FROM old o JOIN new n ON o.user_id = n.user_id
WHERE o.event_id <> n.event_id
UNION ALL
SELECT 'update_postimage', n.* FROM old o JOIN new n ON o.user_id = n.user_id
WHERE o.event_id <> n.event_id"""

ORACLES["changes_refreshed"] = _SNAPSHOTS + "\nSELECT * FROM new"

ORACLES["down_from_status"] = oracle_prefix("machine_status") + "," + """
d AS (""" + LATEST_STATUS_DOWN + ")\nSELECT machine_id FROM d"


# ---- synthetic backlog -------------------------------------------------------------

ORACLES["generated_backlog"] = oracle_prefix("parts") + """,
pw AS (SELECT *, CAST(CASE category WHEN 'MEDIUM' THEN 2500000 WHEN 'PROMO' THEN 3000000
                           ELSE 1000000 END
                     AS BIGINT) AS w FROM parts),
cum AS (SELECT *, sum(w) OVER (ORDER BY part_id ROWS UNBOUNDED PRECEDING) AS hi FROM pw),
tot AS (SELECT CAST(max(hi) AS BIGINT) AS total FROM cum),
o AS (SELECT 'ORD-' || CAST(o_orderkey + 2000 AS VARCHAR) AS order_id FROM orders),
o2 AS (
  SELECT order_id,
         ('0x' || substr(md5('42|part|' || order_id), 1, 15))::BIGINT % total AS target,
         ('0x' || substr(md5('42|customer|' || order_id), 1, 8))::BIGINT AS h_cust,
         ('0x' || substr(md5('42|quantity|' || order_id), 1, 8))::BIGINT AS h_qty,
         ('0x' || substr(md5('42|due|' || order_id), 1, 8))::BIGINT AS h_due
  FROM o, tot),
custs AS (
  SELECT 'all' AS pool, c_name, row_number() OVER (ORDER BY c_name, c_custkey) AS idx
  FROM customer
  UNION ALL
  SELECT 'dealer', c_name, row_number() OVER (ORDER BY c_name, c_custkey)
  FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'MACHINERY')),
sizes AS (SELECT pool, count(*) AS n FROM custs GROUP BY pool),
chosen AS (
  SELECT o2.*, p.part_id, p.category, p.default_price, p.material_cost,
         p.estimated_runtime_hours,
         CASE WHEN p.category IN ('LARGE', 'MEDIUM') THEN 'dealer' ELSE 'all' END AS pool
  FROM o2 JOIN (SELECT *, hi - w AS lo FROM cum) p ON o2.target >= p.lo AND o2.target < p.hi)
SELECT ch.order_id, ch.part_id, ch.category, c.c_name AS customer_name,
       CAST(CASE WHEN ch.category IN ('LARGE', 'MEDIUM') THEN 4 + h_qty % 3
                 ELSE 1 + h_qty % 6 END AS INTEGER) AS quantity,
       CAST(DATE '2025-11-01' + CAST(1 + h_due % 30 AS INTEGER) AS DATE) AS promised_date,
       ch.default_price AS sale_price, ch.material_cost, ch.estimated_runtime_hours
FROM chosen ch JOIN sizes s ON s.pool = ch.pool
LEFT JOIN custs c ON c.pool = ch.pool AND c.idx = 1 + ch.h_cust % s.n"""


# ---- dashboard flow ---------------------------------------------------------------

ORACLES["assigned_enriched_sql"] = ORACLES["assigned_enriched"]

ORACLES["cached_load"] = ORACLES["assigned_enriched"]

ORACLES["dashboard_recalculated"] = ORACLES["scenario_enriched"]

ORACLES["scored_routes_sorted"] = with_cands() + """
SELECT order_id, machine_id, profit_score,
       row_number() OVER (ORDER BY profit_score DESC NULLS LAST, order_id, machine_id) AS position
FROM (SELECT order_id, machine_id, CAST(margin_cents * conf_pct AS DOUBLE) / 10000 AS profit_score
      FROM cands)"""
