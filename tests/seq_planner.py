"""Plain sequential greedy planner (test oracle), written from the stated semantics."""

from __future__ import annotations

import math

import pandas as pd


def _units(x, scale):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return int(round(x * scale))


def sequential_plan(cands: pd.DataFrame, machines: pd.DataFrame, planning_days: int,
                    down=(), component="part_category"):
    """Return (dict order_id -> machine_id, dict machine_id -> remaining micro-hours)."""
    down = set(down)
    caps = {}
    for _, m in machines.iterrows():
        caps[m["machine_id"]] = _units(m["daily_capacity_hours"], 1_000_000) * planning_days
    for m in down:
        caps[m] = 0
    rows = []
    for r in cands.itertuples(index=False):
        if r.order_id is None:
            continue
        score = r.profit_score
        if score is not None and isinstance(score, float) and math.isnan(score):
            score = None
        comp = getattr(r, component) if component else "all"
        rows.append((comp, r.order_id, r.machine_id, score, r.promised_date,
                     _units(r.processing_hours, 1_000_000)))
    by_order = {}
    for row in rows:
        by_order.setdefault((row[0], row[1]), []).append(row)

    def okey(item):
        (comp, oid), rs = item
        scores = [x[3] for x in rs if x[3] is not None]
        dues = [x[4] for x in rs if x[4] is not None]
        needs = [x[5] for x in rs if x[5] is not None]
        s = max(scores) if scores else None
        d = min(dues) if dues else None
        n = min(needs) if needs else None
        return (comp, s is None, -(s or 0), d is None, d or pd.Timestamp(0).date(),
                n is None, n or 0, oid)

    plan = {}
    for (comp, oid), rs in sorted(by_order.items(), key=okey):
        prefs = sorted(rs, key=lambda x: (x[3] is None, -(x[3] or 0), x[5] is None, x[5] or 0,
                                          x[2]))
        for _, _, mid, _, _, need in prefs:
            if mid in down or need is None:
                continue
            if mid in caps and caps[mid] >= need:
                caps[mid] -= need
                plan[oid] = mid
                break
    return plan, caps
