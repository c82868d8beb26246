"""Integer (fixed-point) forms of the route formulas.

Money is held in cents, hours in micro-hours, efficiency and confidence in
percent. Sums of integers do not depend on the order rows are added in, so
running totals, capacity subtraction and KPIs are the same on every engine
and every partitioning. Doubles only appear at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000
TWO_POW_32 = 4_294_967_296


def to_units(c: Column, scale: int) -> Column:
    """Round a double to an integer number of 1/scale units (null/NaN -> null)."""
    c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return F.round(c * scale).cast("bigint")


def keyed_u32(seed: int, *keys: Column) -> Column:
    """Uniform 32-bit integer from md5 of ``seed|k1|k2...``: same on any partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def need_micro_hours(runtime_uh: Column, quantity: Column, eff_pct: Column) -> Column:
    """runtime x quantity / efficiency, rounded half up to micro-hours."""
    eff = eff_pct.cast("bigint")
    num = runtime_uh * quantity.cast("bigint") * 100 + F.call_function("div", eff, F.lit(2))
    return F.when(eff > 0, F.call_function("div", num, F.when(eff > 0, eff)))


def confidence_pct(u32: Column, eff_pct: Column) -> Column:
    """round(clamp(0.35 + 0.6 u + 0.15 (eff - 1), 0.01, 0.99), 2) in integer basis points."""
    bp = F.lit(3500) + F.floor(u32 * 6000 / TWO_POW_32).cast("bigint") + (eff_pct - 100) * 15
    bp = F.least(F.greatest(bp, F.lit(100)), F.lit(9900))
    return F.floor((bp + 50) / 100).cast("int")
