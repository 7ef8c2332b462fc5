"""The flagship query: joins, grouping, HAVING, ordering and top-k in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import Tables
from .registry import register

FLAGSHIP_SQL = """
SELECT n_name, r_name, count(DISTINCT o_orderkey) AS n_orders,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY n_name, r_name
HAVING count(DISTINCT o_orderkey) > 10
ORDER BY revenue DESC, n_name
LIMIT 5"""


@register("flagship_nation_revenue_top5", sql=FLAGSHIP_SQL)
def nation_revenue_top(spark, d):
    t = Tables(spark, d)
    # Pre-aggregate lineitem to one row per order before the join: the
    # largest table crosses the shuffle once, already reduced.
    per_order = (t.lineitem.groupBy("l_orderkey")
                 .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev")))
    j = (t.orders.select("o_orderkey", "o_custkey")
         .join(per_order, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
         .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    g = (j.groupBy("n_name", "r_name")
         .agg(F.count_distinct("o_orderkey").alias("n_orders"), F.sum("rev").alias("_rev"))
         .where(F.col("n_orders") > 10))
    return (g.select("n_name", "r_name", "n_orders", F.round("_rev", 2).alias("revenue"))
            .orderBy(F.desc("revenue"), "n_name").limit(5))
