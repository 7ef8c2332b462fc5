"""Index-encoded benchmark schemas (C8): one document per database with
parallel arrays of table names, ``[table_index, column_name]`` pairs, column
types, primary-key column indices and foreign-key index pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENCODED_SCHEMA = ("db_id string, table_names array<string>, table_names_original array<string>, "
                  "column_names array<array<string>>, column_names_original array<array<string>>, "
                  "column_types array<string>, primary_keys array<int>, foreign_keys array<array<int>>")


def encode_schema(tables: DataFrame, cols: DataFrame, fks: DataFrame) -> DataFrame:
    """Flat catalog -> encoded documents (the layout benchmark files ship in).

    Column 0 is the ``[-1, "*"]`` wildcard, as in the published format.
    """
    t = tables.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("table_pos", "table_name"))).alias("ts"))
    c = cols.groupBy("db_id").agg(
        F.array_sort(F.collect_list(F.struct("table_pos", "pos", "table_name", "name", "type", "pk"))).alias("cs"))
    f = fks.groupBy("db_id").agg(F.collect_list(F.struct("from_table", "from_column", "to_table", "to_column")).alias("fs"))
    doc = t.join(c, "db_id").join(f, "db_id", "left")
    tn = F.transform("ts", lambda x: x["table_name"])
    keys = F.transform("cs", lambda x: F.concat_ws(".", x["table_name"], x["name"]))
    col_pairs = F.transform("cs", lambda x: F.array((F.array_position(tn, x["table_name"]) - 1).cast("string"), x["name"]))
    star = F.array(F.array(F.lit("-1"), F.lit("*")))
    pks = F.filter(F.transform("cs", lambda x, i: F.when(x["pk"], i + 1).otherwise(F.lit(-1))), lambda i: i >= 0)
    fk_idx = F.transform(F.coalesce("fs", F.array()), lambda x: F.array(
        F.array_position(keys, F.concat_ws(".", x["from_table"], x["from_column"])).cast("int"),
        F.array_position(keys, F.concat_ws(".", x["to_table"], x["to_column"])).cast("int")))
    return (doc.withColumn("keys", keys)
            .select("db_id",
                    F.transform(tn, lambda n: F.lower(F.regexp_replace(n, "_", " "))).alias("table_names"),
                    tn.alias("table_names_original"),
                    F.concat(star, F.transform(col_pairs, lambda p: F.array(p[0], F.lower(F.regexp_replace(p[1], "_", " "))))).alias("column_names"),
                    F.concat(star, col_pairs).alias("column_names_original"),
                    F.concat(F.array(F.lit("text")), F.transform("cs", lambda x: x["type"])).alias("column_types"),
                    pks.cast("array<int>").alias("primary_keys"),
                    fk_idx.alias("foreign_keys")))


def decode_schema(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Encoded documents -> (columns, foreign keys), flat and joinable.

    ``*_original`` names are preferred, the cleaned names are the fallback;
    the wildcard column (table index -1) is dropped; pk comes from the index
    list; FK pairs with an end outside the column list are dropped.
    """
    tabs = docs.select("db_id", F.posexplode(F.arrays_zip(
        F.col("table_names_original").alias("orig"), F.col("table_names").alias("clean"))).alias("ti", "t"))
    tabs = tabs.select("db_id", "ti", F.coalesce("t.orig", "t.clean").alias("table_name"))
    cols = docs.select("db_id", "primary_keys", F.posexplode(F.arrays_zip(
        F.col("column_names_original").alias("orig"), F.col("column_names").alias("clean"),
        F.col("column_types").alias("type"))).alias("ci", "c"))
    cols = cols.select("db_id", "ci", F.coalesce(F.col("c.orig")[0], F.col("c.clean")[0]).cast("int").alias("ti"),
                       F.coalesce(F.col("c.orig")[1], F.col("c.clean")[1]).alias("column_name"),
                       F.col("c.type").alias("data_type"),
                       F.array_contains("primary_keys", F.col("ci")).alias("pk")).where(F.col("ti") >= 0)
    flat = cols.join(tabs, ["db_id", "ti"]).select("db_id", "ci", "table_name", "column_name", "data_type", "pk")
    fk = docs.select("db_id", F.explode("foreign_keys").alias("p")).select(
        "db_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    ends = flat.select("db_id", "ci", "table_name", "column_name")
    fks = (fk.join(ends.toDF("db_id", "a", "from_table", "from_column"), ["db_id", "a"])
           .join(ends.toDF("db_id", "b", "to_table", "to_column"), ["db_id", "b"])
           .select("db_id", "from_table", "from_column", "to_table", "to_column"))
    return flat.drop("ci"), fks
