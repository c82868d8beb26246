"""Synthetic backlog: weighted category shares, customer pools, quantity and date ranges."""

import datetime as dt
import math

from pyspark.sql import functions as F

from millrun.sources import fixtures as fx
from millrun.sources import generate as gen

D = "/root/testdata/sf0.01"


def test_distributions(spark):
    n = 20000
    parts = fx.parts(spark, D)
    cust = fx.read(spark, D, "customer").select(
        F.col("c_name").alias("customer_name"), F.col("c_custkey").alias("customer_key"),
        F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY").alias("is_dealer"))
    weights = {"MEDIUM": 2.5, "PROMO": 3.0}
    dealer_cats = ("LARGE", "MEDIUM")
    out = gen.generate_backlog(spark.range(n).withColumnRenamed("id", "seq"), parts, cust,
                               weights, dealer_cats).cache()
    assert out.count() == n
    assert out.select("order_id").distinct().count() == n
    assert out.filter(F.col("order_id") == "ORD-2000").count() == 1

    # category shares follow (parts per category x weight) within 4 sigma
    pc = {r.category: r.n for r in parts.groupBy("category").agg(F.count("*").alias("n"))
          .collect()}
    w = {c: pc[c] * weights.get(c, 1.0) for c in pc}
    total = sum(w.values())
    got = {r.category: r.n for r in out.groupBy("category").agg(F.count("*").alias("n"))
           .collect()}
    for c, wc in w.items():
        p = wc / total
        assert abs(got.get(c, 0) - n * p) <= 4 * math.sqrt(n * p * (1 - p)), c

    # dealer categories get dealer customers and 4-6 units; others 1-6 units
    dealers = {r.customer_name for r in cust.filter("is_dealer").collect()}
    rows = out.select("category", "customer_name", "quantity", "promised_date").collect()
    for r in rows:
        if r.category in dealer_cats:
            assert r.customer_name in dealers and 4 <= r.quantity <= 6
        else:
            assert 1 <= r.quantity <= 6
        assert dt.date(2025, 11, 2) <= r.promised_date <= dt.date(2025, 12, 1)
    assert {r.quantity for r in rows if r.category not in dealer_cats} == set(range(1, 7))

    # attributes copied from the chosen part
    j = out.join(parts.select("part_id", F.col("default_price").alias("p")), "part_id")
    assert j.filter(F.col("p") != F.col("sale_price")).count() == 0
    out.unpersist()
