"""Relational building blocks whose semantics differ from a plain Spark call.

The query corpus the engine serves was written for SQLite; the helpers here
give Spark the same answers where the two disagree, without leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def sqlite_like(col: Column, pattern: str) -> Column:
    """SQLite ``LIKE`` ignores ASCII case; Spark's ``like`` does not."""
    return col.ilike(pattern)


def int_div(a: Column, b: Column) -> Column:
    """SQLite integer ``/`` truncates toward zero; Spark ``/`` returns double.

    NULL on division by zero, as in SQLite.
    """
    return F.when(b != 0, (a.cast("bigint") / b.cast("bigint")).cast("bigint"))


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``x IN (subquery)``: right side reduced to distinct keys first.

    The distinct is a partial (map-side) aggregate, so at scale only one row
    per key and map task crosses the shuffle; AQE may then broadcast it.
    """
    keys = right.select(F.col(right_key).alias("__k")).where(F.col("__k").isNotNull()).distinct()
    return left.join(keys, left[left_key] == keys["__k"], "left_semi")


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``x NOT IN (subquery)`` with SQL's three-valued logic, shuffle-friendly.

    Spark's null-aware anti join needs the subquery side broadcast and falls
    back to a nested loop when it is not. Here the rule is split up:

    * a NULL inside the subquery makes every comparison unknown -> no rows;
    * a NULL outer key survives only when the subquery is empty;
    * otherwise a plain anti join on the key (hash-partitioned, or
      broadcast by AQE when the distinct keys turn out small).

    The two conditions are scalar subqueries (one value each, evaluated
    once), so no join is needed for them.
    """
    sub_keys = right.select(F.col(right_key).alias("__k")).distinct()   # map-side partial distinct
    has_null = sub_keys.select(F.count(F.when(F.col("__k").isNull(), 1)) > 0).scalar()
    non_empty = sub_keys.select(F.count(F.lit(1)) > 0).scalar()
    lk = left[left_key]
    not_null = (left.where(lk.isNotNull())
                .join(sub_keys.where(F.col("__k").isNotNull()), F.col(left_key) == F.col("__k"), "left_anti"))
    null_outer = left.where(lk.isNull() & ~non_empty)
    return not_null.unionByName(null_outer).where(~has_null)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """SQL ``EXCEPT`` (set semantics), not ``exceptAll``."""
    return a.subtract(b)


def numbered(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``df`` with each row's place (from 1) in ``ORDER BY order``, as a column.

    The order becomes part of the result, so it survives a write or a join. Rows
    are sorted by ranges and numbered inside their partition; the partitions'
    starts are a running sum of their sizes, one row a partition. No window runs
    over all rows in one task. Rows that tie in ``order`` are numbered in any order.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))      # Spark's place inside the partition
    ordered = cut_lineage(df.orderBy(*order).select("*", F.spark_partition_id().alias("__part"), at.alias("__at")), "ordered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ordered.groupBy("__part").agg(F.count("*").alias("__n"))
              .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    return (ordered.join(F.broadcast(starts), "__part")
            .select(*[ordered[c] for c in df.columns], (F.col("__start") + F.col("__at") + 1).alias(name)))
