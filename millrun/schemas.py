"""Declared schemas of every domain table (with column comments)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _f(name: str, dtype: T.DataType, comment: str) -> T.StructField:
    return T.StructField(name, dtype, True, metadata={"comment": comment})


S, D, I, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()

MACHINES = T.StructType([
    _f("machine_id", S, "key"),
    _f("machine_name", S, "label for people"),
    _f("capability", S, "the one category it makes"),
    _f("daily_capacity_hours", D, "hours a day it can be planned for"),
    _f("efficiency_factor", D, "divides an order's runtime; 1 is nominal"),
    _f("is_operational", B, "false while out of service"),
])

PARTS = T.StructType([
    _f("part_id", S, "key"),
    _f("part_name", S, "label for people"),
    _f("category", S, "matched with machine capabilities"),
    _f("material_cost", D, "spent on one unit"),
    _f("default_price", D, "earned by one unit"),
    _f("estimated_runtime_hours", D, "one unit on a nominal machine"),
])

ORDERS_BACKLOG = T.StructType([
    _f("order_id", S, "key, one row each"),
    _f("part_id", S, "what is made"),
    _f("category", S, "of the part"),
    _f("customer_name", S, "who gets it"),
    _f("quantity", I, "how many"),
    _f("promised_date", T.DateType(), "due day"),
    _f("sale_price", D, "earned by one unit"),
    _f("material_cost", D, "spent on one unit"),
    _f("estimated_runtime_hours", D, "one unit on a nominal machine"),
])

CANDIDATE_ROUTES = T.StructType([
    _f("order_id", S, "with machine_id the key"),
    _f("part_id", S, "what is made"),
    _f("part_category", S, "equals capability"),
    _f("customer_name", S, "who gets it"),
    _f("quantity", I, "how many"),
    _f("promised_date", T.DateType(), "due day"),
    _f("sale_price", D, "earned by one unit"),
    _f("material_cost", D, "spent on one unit"),
    _f("estimated_runtime_hours", D, "one unit on a nominal machine"),
    _f("machine_id", S, "a machine that can make the order"),
    _f("machine_name", S, "label for people"),
    _f("capability", S, "equals part_category"),
    _f("daily_capacity_hours", D, "hours a day it can be planned for"),
    _f("efficiency_factor", D, "divides the runtime"),
    _f("is_operational", B, "false while out of service"),
    _f("processing_hours", D, "runtime x quantity / efficiency"),
    _f("margin", D, "(sale_price - material_cost) x quantity"),
    _f("base_confidence", D, "0.01 to 0.99, drawn by order and machine"),
])

HISTORICAL_ROUTES_LABELED = T.StructType(list(CANDIDATE_ROUTES.fields) + [
    _f("profit_score", D, "margin x base_confidence"),
    _f("is_best", I, "1 on the order's row with the top profit_score"),
])

MACHINE_STATUS = T.StructType([
    _f("machine_id", S, "whose report"),
    _f("machine_name", S, "label for people"),
    _f("status", S, "down, or anything else"),
    _f("reported_at", T.TimestampType(), "newest report counts"),
])

ASSIGNED_PLAN = T.StructType([
    _f("order_id", S, "planned once"),
    _f("machine_id", S, "where it is made"),
    _f("profit", D, "its margin"),
    _f("p_best", D, "score that it was planned by"),
    _f("processing_hours", D, "taken from the machine's capacity"),
    _f("profit_score", D, "p_best x margin"),
    _f("base_confidence", D, "as in the candidates"),
])

REMAINING_CAPACITY = T.StructType([
    _f("machine_id", S, "key"),
    _f("remaining_hours", D, "not planned; 0 for a machine that is down"),
])

ASSIGNMENT_OVERRIDES = T.StructType([
    _f("order_id", S, "which order moves"),
    _f("machine_id", S, "where to"),
    _f("assigned_by", S, "who asked"),
    _f("assigned_at", T.TimestampType(), "when it was saved"),
    _f("notes", S, "why"),
])

MODEL_REGISTRY = T.StructType([
    _f("name", S, "Registered model name"),
    _f("version", S, "Version number as text"),
    _f("path", S, "Folder of the saved PipelineModel"),
    _f("test_accuracy", D, "Held-out accuracy at registration"),
    _f("params", S, "Training parameters as JSON"),
    _f("registered_at", T.TimestampType(), "Registration time"),
])


MODEL_ALIASES = T.StructType([
    _f("name", S, "Registered model name"),
    _f("alias", S, "Alias such as champion"),
    _f("version", S, "Version it points to from then on"),
    _f("set_at", T.TimestampType(), "Newest row of an alias counts"),
    _f("entry", T.LongType(), "Place in the log, orders equal times"),
])


def conform(df: DataFrame, schema: T.StructType, *before: str) -> DataFrame:
    """``df`` as the declared columns (types and comments), after the columns ``before``."""
    return df.select(*before, *[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata)
                                for f in schema.fields])


def ddl(schema: T.StructType) -> str:
    """``CREATE TABLE`` column list with comments for a StructType."""
    cols = []
    for f in schema.fields:
        comment = f.metadata.get("comment", "").replace("'", "\\'")
        cols.append(f"{f.name} {f.dataType.simpleString().upper()} COMMENT '{comment}'")
    return ",\n  ".join(cols)
