"""Flagship: one output per order line is parsed, its ref resolved to a part, and the orders' plans are checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrubric.functions import outputs as op
from sparkrubric.operators import checks as ck
from sparkrubric.operators import entities as en
from sparkrubric.operators import scoring as sc
from workload.base import spread, table

CHECKS = {
    "check_budget_limit": {"max_budget": 5000},
    "check_max_activities_per_day": {"max_per_day": 1},
    "check_type_diversity": {"min_types": 3},
}

SQL = """
WITH first AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1),
it AS (SELECT l_orderkey AS o, l_linenumber AS day, f.p_type, f.p_retailprice::DECIMAL(18,2) AS cost
       FROM lineitem JOIN part p ON l_partkey = p.p_partkey JOIN first ON first.p_name = p.p_name
       JOIN part f ON f.p_partkey = k),
c AS (SELECT o, coalesce(sum(cost), 0) <= 5000 AS b, count(DISTINCT p_type) >= 3 AS t FROM it GROUP BY o),
d AS (SELECT o, max(n) <= 1 AS a FROM (SELECT o, day, count(*) AS n FROM it GROUP BY 1, 2) GROUP BY o)
SELECT o_orderpriority, round(avg(coalesce(b, true)::INT), 6) AS check_budget_limit,
       round(avg(coalesce(a, true)::INT), 6) AS check_max_activities_per_day,
       round(avg(coalesce(t, false)::INT), 6) AS check_type_diversity, count(*) AS orders
FROM orders LEFT JOIN c ON c.o = o_orderkey LEFT JOIN d ON d.o = o_orderkey GROUP BY 1
"""


def checked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"))
    plan = F.concat(
        F.lit('{"day'), F.col("l_linenumber").cast("string"), F.lit('": ["'), F.upper("p_name"), F.lit('"]}')
    )
    outputs = lines.join(
        part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey"
    ).select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("Planul zilei:\n"), plan).alias("output"))
    items = op.plan_items(sc.parse_run(outputs), ["o_orderkey"])
    keys = en.entity_keys(part, [], "p_partkey", "p_partkey", F.array("p_name"))
    attributes = part.select(
        F.col("p_partkey").cast("string").alias("entity_id"),
        F.col("p_type").alias("type"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("cost_lei"),
    )
    resolved = en.resolve_by_join(items, keys, []).join(attributes, "entity_id", "left")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    rows = resolved.unionByName(orders.select("o_orderkey"), allowMissingColumns=True)
    checked = ck.run_literal_checks(rows, ["o_orderkey"], CHECKS).join(orders, "o_orderkey")
    share = lambda name: F.round(F.avg(F.col(name).cast("int")), 6).alias(name)
    return checked.groupBy("o_orderpriority").agg(*[share(n) for n in CHECKS], F.count(F.lit(1)).alias("orders"))
