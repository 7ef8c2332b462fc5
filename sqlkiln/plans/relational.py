"""Q1-Q45: the relational surface the gold-query corpus exercises, written as
DataFrame code over the driver's star schema, each with its DuckDB oracle.

Conventions for parity (SURVEY 7.4): every computed column is aliased,
double aggregates are rounded to 2 digits on both sides, LIMIT always has a
unique tie-breaker, SQLite semantics (case-blind LIKE, truncating integer
division, bare GROUP BY columns) are reproduced explicitly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relational import int_div, not_in, numbered, semi_join, sqlite_like, union_distinct, except_distinct
from ..sources.tables import Tables
from .registry import register

R2 = lambda c: F.round(c, 2)


@register("q1_project", sql="SELECT c_custkey, c_name, c_acctbal FROM customer")
def q1_project(spark, d):
    return Tables(spark, d).customer.select("c_custkey", "c_name", "c_acctbal")


@register("q2_project_all", sql="SELECT * FROM orders")
def q2_project_all(spark, d):
    return Tables(spark, d).orders.select("*")


@register("q3_distinct", sql="SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def q3_distinct(spark, d):
    return Tables(spark, d).customer.select("c_mktsegment", "c_nationkey").distinct()


@register("q4_eq", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def q4_eq(spark, d):
    return Tables(spark, d).orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@register("q5_ne", sql="SELECT p_partkey, p_brand FROM part WHERE p_brand != 'Brand#13'")
def q5_ne(spark, d):
    return Tables(spark, d).part.where(F.col("p_brand") != "Brand#13").select("p_partkey", "p_brand")


@register("q6_compare", sql="""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity >= 30 AND l_extendedprice < 20000 AND l_tax > 0.02 AND l_linenumber <= 3""")
def q6_compare(spark, d):
    li = Tables(spark, d).lineitem
    return (li.where((F.col("l_quantity") >= 30) & (F.col("l_extendedprice") < 20000)
                     & (F.col("l_tax") > 0.02) & (F.col("l_linenumber") <= 3))
            .select("l_orderkey", "l_linenumber", "l_quantity"))


@register("q7_between", sql="""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000""")
def q7_between(spark, d):
    o = Tables(spark, d).orders
    return o.where(F.col("o_totalprice").between(100000, 150000)).select("o_orderkey", "o_totalprice")


@register("q8_like", sql="SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def q8_like(spark, d):
    p = Tables(spark, d).part
    return p.where(sqlite_like(F.col("p_name"), "%RED%")).select("p_partkey", "p_name")


@register("q9_in_subquery", sql="""
SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def q9_in_subquery(spark, d):
    t = Tables(spark, d)
    sub = t.orders.where(F.col("o_totalprice") > 400000)
    return semi_join(t.customer, sub, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@register("q10_not_in_subquery", sql="""
SELECT p_partkey, p_name FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)""")
def q10_not_in_subquery(spark, d):
    t = Tables(spark, d)
    sub = t.lineitem.where(F.col("l_quantity") > 40)
    return not_in(t.part, sub, "p_partkey", "l_partkey").select("p_partkey", "p_name")


@register("q11_is_null", sql="""
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey
 AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' WHERE o_orderkey IS NULL""")
def q11_is_null(spark, d):
    # IS NULL over the padded side of an outer join: customers without an
    # urgent finished order (the driver tables hold no NULLs of their own).
    t = Tables(spark, d)
    o = t.orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))
    j = t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.where(F.col("o_orderkey").isNull()).select("c_custkey", "o_orderkey")


@register("q12_exists", sql="""
SELECT c_custkey, c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT'
              AND o.o_totalprice > 300000)""")
def q12_exists(spark, d):
    t = Tables(spark, d)
    o = t.orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000))
    return t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@register("q13_and_or", sql="""
SELECT c_custkey, c_mktsegment, c_acctbal FROM customer
WHERE (c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY') AND c_acctbal > 5000 OR c_nationkey = 3""")
def q13_and_or(spark, d):
    c = Tables(spark, d).customer
    cond = (((F.col("c_mktsegment") == "BUILDING") | (F.col("c_mktsegment") == "MACHINERY"))
            & (F.col("c_acctbal") > 5000)) | (F.col("c_nationkey") == 3)
    return c.where(cond).select("c_custkey", "c_mktsegment", "c_acctbal")


@register("q14_not", sql="""
SELECT p_partkey, p_name, p_size FROM part
WHERE NOT (p_size BETWEEN 10 AND 40) AND p_name NOT ILIKE '%bolt%'""")
def q14_not(spark, d):
    p = Tables(spark, d).part
    return (p.where(~F.col("p_size").between(10, 40) & ~sqlite_like(F.col("p_name"), "%bolt%"))
            .select("p_partkey", "p_name", "p_size"))


@register("q15_arithmetic", sql="""
SELECT l_orderkey, l_linenumber,
       l_extendedprice * (1 - l_discount) AS net_price,
       CAST(l_linenumber * 7 // 2 AS BIGINT) AS half_units,
       l_extendedprice - l_quantity AS diff
FROM lineitem""")
def q15_arithmetic(spark, d):
    li = Tables(spark, d).lineitem
    return li.select("l_orderkey", "l_linenumber",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
                     int_div(F.col("l_linenumber") * 7, F.lit(2)).alias("half_units"),
                     (F.col("l_extendedprice") - F.col("l_quantity")).alias("diff"))


@register("q16_count_all", sql="SELECT count(*) AS n FROM lineitem")
def q16_count_all(spark, d):
    return Tables(spark, d).lineitem.agg(F.count(F.lit(1)).alias("n"))


@register("q17_count_col", sql="""
SELECT o_orderstatus, count(o_orderpriority) AS n FROM orders GROUP BY o_orderstatus""")
def q17_count_col(spark, d):
    return Tables(spark, d).orders.groupBy("o_orderstatus").agg(F.count("o_orderpriority").alias("n"))


@register("q18_count_distinct", sql="""
SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_supps
FROM lineitem GROUP BY l_returnflag""")
def q18_count_distinct(spark, d):
    return (Tables(spark, d).lineitem.groupBy("l_returnflag")
            .agg(F.count_distinct("l_partkey").alias("n_parts"),
                 F.count_distinct("l_suppkey").alias("n_supps")))


@register("q19_sum", sql="SELECT round(sum(l_quantity), 2) AS sum_qty FROM lineitem")
def q19_sum(spark, d):
    return Tables(spark, d).lineitem.agg(R2(F.sum("l_quantity")).alias("sum_qty"))


@register("q20_avg", sql="""
SELECT c_mktsegment, round(avg(c_acctbal), 2) AS avg_bal FROM customer GROUP BY c_mktsegment""")
def q20_avg(spark, d):
    return Tables(spark, d).customer.groupBy("c_mktsegment").agg(R2(F.avg("c_acctbal")).alias("avg_bal"))


@register("q21_min", sql="SELECT o_orderpriority, min(o_orderdate) AS first_date FROM orders GROUP BY o_orderpriority")
def q21_min(spark, d):
    return Tables(spark, d).orders.groupBy("o_orderpriority").agg(F.min("o_orderdate").alias("first_date"))


@register("q22_max", sql="SELECT max(p_retailprice) AS max_price, max(p_name) AS max_name FROM part")
def q22_max(spark, d):
    return Tables(spark, d).part.agg(F.max("p_retailprice").alias("max_price"), F.max("p_name").alias("max_name"))


@register("q23_group_by", sql="""
SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey""")
def q23_group_by(spark, d):
    return (Tables(spark, d).orders.groupBy("o_custkey")
            .agg(F.count(F.lit(1)).alias("n_orders"), R2(F.sum("o_totalprice")).alias("total")))


@register("q24_group_by_multi", sql="""
SELECT l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty,
       count(*) AS count_order
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q24_group_by_multi(spark, d):
    li = Tables(spark, d).lineitem
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        R2(F.sum("l_quantity")).alias("sum_qty"),
        R2(F.sum("l_extendedprice")).alias("sum_base_price"),
        R2(F.sum(disc)).alias("sum_disc_price"),
        R2(F.sum(disc * (1 + F.col("l_tax")))).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.count(F.lit(1)).alias("count_order"))


@register("q25_having", sql="""
SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) > 12""")
def q25_having(spark, d):
    o = Tables(spark, d).orders
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders")).where(F.col("n_orders") > 12)


@register("q26_having_compound", sql="""
SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey
HAVING count(*) BETWEEN 3 AND 5 OR sum(o_totalprice) > 4000000""")
def q26_having_compound(spark, d):
    o = Tables(spark, d).orders
    g = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("_total"))
    return (g.where(F.col("n_orders").between(3, 5) | (F.col("_total") > 4000000))
            .select("o_custkey", "n_orders", R2(F.col("_total")).alias("total")))


@register("q27_order_by", sql="""
SELECT s_suppkey, s_name, s_acctbal, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS position FROM supplier""")
def q27_order_by(spark, d):
    return numbered(Tables(spark, d).supplier.select("s_suppkey", "s_name", "s_acctbal"), "s_acctbal", "s_suppkey")


@register("q28_order_by_multi", sql="""
SELECT c_nationkey, c_acctbal, c_custkey,
       row_number() OVER (ORDER BY c_nationkey DESC, c_acctbal DESC, c_custkey) AS position FROM customer""")
def q28_order_by_multi(spark, d):
    c = Tables(spark, d).customer
    return numbered(c.select("c_nationkey", "c_acctbal", "c_custkey"), F.desc("c_nationkey"), F.desc("c_acctbal"), "c_custkey")


@register("q29_order_by_expr", sql="""
SELECT p_partkey, p_retailprice, p_size, row_number() OVER (ORDER BY p_retailprice / p_size DESC, p_partkey) AS position FROM part""")
def q29_order_by_expr(spark, d):
    p = Tables(spark, d).part
    return numbered(p.select("p_partkey", "p_retailprice", "p_size"), (F.col("p_retailprice") / F.col("p_size")).desc(), "p_partkey")


@register("q30_order_by_agg", sql="""
SELECT c_mktsegment, n, row_number() OVER (ORDER BY n DESC, c_mktsegment) AS position
FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment)""")
def q30_order_by_agg(spark, d):
    c = Tables(spark, d).customer
    return numbered(c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), F.desc("n"), "c_mktsegment")


@register("q31_limit_one", sql="""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1""")
def q31_limit_one(spark, d):
    o = Tables(spark, d).orders
    return o.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1)


@register("q32_top_k", sql="""
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10""")
def q32_top_k(spark, d):
    li = Tables(spark, d).lineitem
    return (li.select("l_orderkey", "l_linenumber", "l_extendedprice")
            .orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(10))


@register("q33_inner_join", sql="""
SELECT l_orderkey, l_linenumber, o_custkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def q33_inner_join(spark, d):
    t = Tables(spark, d)
    return (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select("l_orderkey", "l_linenumber", "o_custkey", "o_orderdate"))


@register("q34_multi_join", sql="""
SELECT r_name, n_name, count(DISTINCT c_custkey) AS n_customers,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY r_name, n_name""")
def q34_multi_join(spark, d):
    t = Tables(spark, d)
    j = (t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"))
         .join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(t.orders, F.col("o_custkey") == F.col("c_custkey"))
         .join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")))
    return j.groupBy("r_name", "n_name").agg(
        F.count_distinct("c_custkey").alias("n_customers"),
        R2(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"))


@register("q35_self_join", sql="""
SELECT a.l_orderkey AS l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b,
       b.l_quantity - a.l_quantity AS qty_change
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""")
def q35_self_join(spark, d):
    # Each line paired with the next line of the same order: one partner per
    # row, so the self join stays linear (no all-pairs within an order).
    li = Tables(spark, d).lineitem
    a = li.select(F.col("l_orderkey"), F.col("l_linenumber").alias("line_a"), F.col("l_quantity").alias("qa"))
    b = li.select(F.col("l_orderkey").alias("bk"), (F.col("l_linenumber") - 1).alias("prev_line"),
                  F.col("l_linenumber").alias("line_b"), F.col("l_quantity").alias("qb"))
    j = a.join(b, (F.col("l_orderkey") == F.col("bk")) & (F.col("line_a") == F.col("prev_line")))
    return j.select("l_orderkey", "line_a", "line_b", (F.col("qb") - F.col("qa")).alias("qty_change"))


@register("q36_multi_cond_join", sql="""
SELECT o_orderkey, l_linenumber, o_orderstatus, l_linestatus
FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus != o_orderstatus""")
def q36_multi_cond_join(spark, d):
    t = Tables(spark, d)
    cond = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linestatus") != F.col("o_orderstatus"))
    return t.orders.join(t.lineitem, cond).select("o_orderkey", "l_linenumber", "o_orderstatus", "l_linestatus")


@register("q37_derived_table", sql="""
SELECT n_orders, count(*) AS n_customers FROM
  (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) t
GROUP BY n_orders""")
def q37_derived_table(spark, d):
    per_cust = Tables(spark, d).orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return per_cust.groupBy("n_orders").agg(F.count(F.lit(1)).alias("n_customers"))


@register("q38_scalar_subquery", sql="""
SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)""")
def q38_scalar_subquery(spark, d):
    p = Tables(spark, d).part
    avg_price = p.select(F.avg("p_retailprice")).scalar()   # scalar subquery, no join
    return p.where(F.col("p_retailprice") > avg_price).select("p_partkey", "p_retailprice")


@register("q39_scalar_top1", sql="""
SELECT c_custkey, c_name FROM customer WHERE c_custkey =
  (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1)""")
def q39_scalar_top1(spark, d):
    t = Tables(spark, d)
    top = (t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), "o_custkey").limit(1).select("o_custkey"))
    return t.customer.where(F.col("c_custkey") == top.scalar()).select("c_custkey", "c_name")


@register("q40_nested_two", sql="""
SELECT p_partkey, p_name FROM part WHERE p_partkey IN
  (SELECT l_partkey FROM lineitem WHERE l_orderkey IN
     (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000))""")
def q40_nested_two(spark, d):
    t = Tables(spark, d)
    o = t.orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 450000))
    li = semi_join(t.lineitem, o, "l_orderkey", "o_orderkey")
    return semi_join(t.part, li, "p_partkey", "l_partkey").select("p_partkey", "p_name")


@register("q41_union", sql="""
SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9900
UNION SELECT s_nationkey AS nationkey FROM supplier WHERE s_acctbal < 0""")
def q41_union(spark, d):
    t = Tables(spark, d)
    a = t.customer.where(F.col("c_acctbal") > 9900).select(F.col("c_nationkey").alias("nationkey"))
    b = t.supplier.where(F.col("s_acctbal") < 0).select(F.col("s_nationkey").alias("nationkey"))
    return union_distinct(a, b)


@register("q42_intersect", sql="""
SELECT o_custkey AS custkey FROM orders WHERE o_orderpriority = '1-URGENT'
INTERSECT SELECT o_custkey AS custkey FROM orders WHERE o_orderpriority = '5-LOW'""")
def q42_intersect(spark, d):
    o = Tables(spark, d).orders
    a = o.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("custkey"))
    b = o.where(F.col("o_orderpriority") == "5-LOW").select(F.col("o_custkey").alias("custkey"))
    return a.intersect(b)


@register("q43_except", sql="""
SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F'""")
def q43_except(spark, d):
    t = Tables(spark, d)
    a = t.customer.select(F.col("c_custkey").alias("custkey"))
    b = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("custkey"))
    return except_distinct(a, b)


@register("q44_setop_over_agg", sql="""
SELECT o_custkey AS custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 18
UNION SELECT c_custkey AS custkey FROM customer WHERE c_acctbal < -900""")
def q44_setop_over_agg(spark, d):
    t = Tables(spark, d)
    a = (t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
         .where(F.col("n") >= 18).select(F.col("o_custkey").alias("custkey")))
    b = t.customer.where(F.col("c_acctbal") < -900).select(F.col("c_custkey").alias("custkey"))
    return union_distinct(a, b)


@register("q45_bare_group_column", sql="""
SELECT c_nationkey, min(c_name) AS c_name, round(max(c_acctbal), 2) AS max_bal
FROM customer GROUP BY c_nationkey""")
def q45_bare_group_column(spark, d):
    # SQLite accepts `SELECT c_nationkey, c_name ... GROUP BY c_nationkey`;
    # Spark rejects the bare column, so it is made deterministic with min().
    c = Tables(spark, d).customer
    return c.groupBy("c_nationkey").agg(F.min("c_name").alias("c_name"), R2(F.max("c_acctbal")).alias("max_bal"))
