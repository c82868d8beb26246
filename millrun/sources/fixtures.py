"""Domain tables as views over the driver's TPC-H-like test tables.

The test data has no machines or backlog, so each domain table is a view:

* machines  <- ``nation`` (25 rows at every scale factor: a fixed plant)
* parts     <- ``part``
* backlog   <- first line of each order in ``lineitem`` + ``orders`` + ``part`` + ``customer``
* override requests, machine status, change feed <- ``events``

The same definitions exist as SQL text (``ORACLE_VIEWS``) so that an
independent engine can recompute every query from the raw Parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrun import schemas
from millrun.schemas import conform

# The six part types of the test tables, in the order machine
# capability is assigned by n_nationkey % 6.
CAPABILITIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _padded(prefix: str, key: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), width, "0"))


def machine_id_of(key: Column) -> Column:
    return _padded("M-", key, 4)


def order_id_of(key: Column) -> Column:
    return _padded("ORD-", key, 9)


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    caps = F.array(*[F.lit(c) for c in CAPABILITIES])
    return conform(read(spark, sf_dir, "nation").select(
        machine_id_of(k).alias("machine_id"),
        F.col("n_name").alias("machine_name"),
        F.element_at(caps, (F.pmod(k, F.lit(6)) + 1).cast("int")).alias("capability"),
        ((F.lit(20) + F.pmod(k, F.lit(9))).cast("double") / 2).alias("daily_capacity_hours"),
        ((F.lit(85) + F.pmod(k, F.lit(4)) * 5).cast("double") / 100).alias("efficiency_factor"),
        F.lit(True).alias("is_operational"),
    ), schemas.MACHINES)


def second_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth machine again, with the capability after its own."""
    k = F.col("n_nationkey")
    caps = F.array(*[F.lit(c) for c in CAPABILITIES])
    keys = read(spark, sf_dir, "nation").filter(F.pmod(k, F.lit(5)) == 0).select(
        machine_id_of(k).alias("machine_id"),
        F.element_at(caps, (F.pmod(k + 1, F.lit(6)) + 1).cast("int")).alias("second"))
    own = machines(spark, sf_dir)
    return own.join(keys, "machine_id").withColumn("capability", F.col("second")).select(
        *own.columns)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(_keyed_parts(spark, sf_dir), schemas.PARTS)


def _keyed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price_cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        _padded("P-", F.col("p_partkey"), 9).alias("part_id"),
        F.col("p_name").alias("part_name"),
        F.col("p_type").alias("category"),
        (F.expr("CAST(ROUND(p_retailprice * 100) AS BIGINT) * 60 DIV 100")
         .cast("double") / 100).alias("material_cost"),
        (price_cents.cast("double") / 100).alias("default_price"),
        (F.col("p_size").cast("double") / 1000).alias("estimated_runtime_hours"),
    )


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line per order: an aggregate (map-side combined), not a window."""
    li = read(spark, sf_dir, "lineitem")
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                           "l_quantity", "l_shipdate")).alias("f")
    return (li.groupBy("l_orderkey").agg(first)
            .select("l_orderkey", "f.l_partkey", "f.l_quantity", "f.l_shipdate"))


def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = first_lines(spark, sf_dir)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    p = _keyed_parts(spark, sf_dir)
    rows = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(p, lines.l_partkey == p.p_partkey)
        .join(cust, F.col("o_custkey") == cust.c_custkey)
        .select(
            order_id_of(F.col("o_orderkey")).alias("order_id"),
            "part_id",
            "category",
            F.col("c_name").alias("customer_name"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_shipdate").cast("date").alias("promised_date"),
            F.col("default_price").alias("sale_price"),
            "material_cost",
            "estimated_runtime_hours",
        )
    )
    return conform(rows, schemas.ORDERS_BACKLOG)


def override_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual override requests: each purchase event asks to move one order."""
    ev = read(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return ev.select(
        order_id_of(F.col("event_id")).alias("order_id"),
        machine_id_of(F.pmod(F.col("user_id"), F.lit(25))).alias("machine_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("assigned_by"),
        F.col("ts").alias("assigned_at"),
        F.col("props").alias("notes"),
        F.col("event_id"),
    )


def machine_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status reports: an ``error`` event reports its machine down, others up."""
    ev = read(spark, sf_dir, "events")
    return ev.select(
        machine_id_of(F.pmod(F.col("user_id"), F.lit(25))).alias("machine_id"),
        F.when(F.col("event_type") == "error", "down").otherwise("up").alias("status"),
        F.col("ts").alias("reported_at"),
        F.col("event_id"),
    )


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed change rows for the replica refresh: key user_id, version (ts, event_id)."""
    return read(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", "event_type", "value")


# SQL twins of the views above, for the independent oracle.
ORACLE_VIEWS = {
    "machines": """
SELECT 'M-' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS machine_id,
       n_name AS machine_name,
       CASE n_nationkey % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'MEDIUM'
            WHEN 3 THEN 'PROMO' WHEN 4 THEN 'SMALL' ELSE 'STANDARD' END AS capability,
       CAST(20 + n_nationkey % 9 AS DOUBLE) / 2 AS daily_capacity_hours,
       CAST(85 + (n_nationkey % 4) * 5 AS DOUBLE) / 100 AS efficiency_factor,
       TRUE AS is_operational
FROM nation""",
    "parts": """
SELECT 'P-' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS part_id,
       p_partkey,
       p_name AS part_name,
       p_type AS category,
       CAST(CAST(round(p_retailprice * 100) AS BIGINT) * 60 // 100 AS DOUBLE) / 100 AS material_cost,
       CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS DOUBLE) / 100 AS default_price,
       CAST(p_size AS DOUBLE) / 1000 AS estimated_runtime_hours
FROM part""",
    "first_lines": """
SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
         l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS rn
  FROM lineitem) WHERE rn = 1""",
    "backlog": """
SELECT 'ORD-' || lpad(CAST(o.o_orderkey AS VARCHAR), 9, '0') AS order_id,
       p.part_id, p.category, c.c_name AS customer_name,
       CAST(l.l_quantity AS INTEGER) AS quantity,
       CAST(l.l_shipdate AS DATE) AS promised_date,
       p.default_price AS sale_price, p.material_cost, p.estimated_runtime_hours
FROM first_lines l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN parts p ON l.l_partkey = p.p_partkey
JOIN customer c ON o.o_custkey = c.c_custkey""",
    "override_requests": """
SELECT 'ORD-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS order_id,
       'M-' || lpad(CAST(user_id % 25 AS VARCHAR), 4, '0') AS machine_id,
       'user-' || CAST(user_id AS VARCHAR) AS assigned_by,
       ts AS assigned_at, props AS notes, event_id
FROM events WHERE event_type = 'purchase'""",
    "machine_status": """
SELECT 'M-' || lpad(CAST(user_id % 25 AS VARCHAR), 4, '0') AS machine_id,
       CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END AS status,
       ts AS reported_at, event_id
FROM events""",
}


def oracle_prefix(*names: str) -> str:
    """``WITH`` clause defining the named views (and the ones they depend on)."""
    order = ["machines", "parts", "first_lines", "backlog", "override_requests", "machine_status"]
    deps = {"backlog": {"parts", "first_lines"}}
    need: set[str] = set()
    stack = list(names)
    while stack:
        n = stack.pop()
        if n not in need:
            need.add(n)
            stack.extend(deps.get(n, ()))
    parts_sql = [f"{n} AS ({ORACLE_VIEWS[n]})" for n in order if n in need]
    return "WITH " + ",\n".join(parts_sql)
