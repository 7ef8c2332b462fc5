"""Catalog, key and schema-graph jobs.

Inputs are information_schema-shaped DataFrames keyed by ``db_id``:

* tables       (db_id, table_schema, table_name, table_pos, table_type)
* columns      (db_id, table_name, ordinal_position, column_name, data_type)
* constraints  (db_id, constraint_name, constraint_type, table_name, unique_constraint_name)
* key_columns  (db_id, constraint_name, table_name, column_name, key_pos)

A lake catalog of many databases is just more rows; every job is a join or
an aggregate keyed by ``db_id`` and never gathers a database on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import by_shuffle
from .components import connected_components

# Fixed value: table-name prefixes of Oracle demo/system tables ignored by default.
DEFAULT_IGNORED_PREFIXES = ["MVIEW$_", "APEX$_", "DEMO_"]


def table_inventory(tables: DataFrame) -> DataFrame:
    """Base tables only (views excluded)."""
    return (tables.where(F.col("table_type") == "BASE TABLE")
            .select("db_id", "table_schema", "table_name", "table_pos"))


# Fixed value: what each engine's catalog shows to a connection, as (dbms, schema, include,
# views, precedence). Schema "*" is any, "=" the connection's own schema, owner or database.
DEFAULT_SCOPE = [("sqlite", "*", True, False, 0), ("postgresql", "=", True, False, 0), ("mysql", "=", True, True, 0),
                 ("mssql", "*", True, False, 0), ("oracle", "=", True, False, 0)]
SCOPE_SCHEMA = "dbms string, schema string, include boolean, views boolean, precedence int"


def scoped_inventory(tables: DataFrame, databases: DataFrame, rules: DataFrame) -> DataFrame:
    """C1 by rules of which schemas and owners count: the tables that a connection sees.

    ``databases`` has ``(db_id, dbms, own_schema)``, ``rules`` the columns of
    ``SCOPE_SCHEMA``. Of the rules that match a table's engine and schema the
    highest precedence decides; on a tie a named schema goes before "=", that
    before "*", and leaving out before taking in. Without a matching rule, or with
    a null schema that only a name or "=" could match, a table is out. Views count
    where the rule says so. A database's rules travel with its row as one short
    array, so tables are neither multiplied by rules nor grouped.
    """
    exact = F.when(F.col("schema") == "*", 0).when(F.col("schema") == "=", 1).otherwise(2)
    rank = F.struct((-F.col("precedence")).alias("p"), (-exact).alias("e"), "include", "views", "schema")
    by_dbms = rules.groupBy("dbms").agg(F.array_sort(F.collect_list(rank)).alias("__rules"))
    dbs = databases.join(by_dbms, "dbms").select("db_id", "dbms", "own_schema", "__rules")
    seen = tables.join(dbs, "db_id")

    def matches(r: Column) -> Column:
        return F.coalesce((r["schema"] == "*") | ((r["schema"] == "=") & (F.col("table_schema") == F.col("own_schema")))
                          | (r["schema"] == F.col("table_schema")), F.lit(False))

    rule = F.get(F.filter("__rules", matches), F.lit(0))
    kind = F.col("table_type")
    return (seen.withColumn("__rule", rule)
            .where(F.col("__rule.include") & ((kind == "BASE TABLE") | (F.col("__rule.views") & (kind == "VIEW"))))
            .select("db_id", "dbms", "table_schema", "table_name", "table_pos", "table_type"))


def prefix_filter(tables: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """Drop tables whose name starts with an ignored prefix.

    ``None`` -> the default list; a user list is upper-cased; an empty list
    keeps everything. The list is a handful of literals, so the test is an
    OR of ``startswith`` in codegen rather than a join.
    """
    ps = DEFAULT_IGNORED_PREFIXES if prefixes is None else [p.upper() for p in prefixes]
    if not ps:
        return tables
    hit = reduce(lambda a, b: a | b, [F.col("table_name").startswith(p) for p in ps])
    return tables.where(~hit)


def column_inventory(columns: DataFrame, tables: DataFrame, constraints: DataFrame,
                     key_columns: DataFrame) -> DataFrame:
    """Columns of inventoried tables with a pk flag from the PK constraint."""
    pk = (key_columns.join(by_shuffle(constraints.where(F.col("constraint_type") == "PRIMARY KEY")
                                      .select("db_id", "constraint_name")), ["db_id", "constraint_name"], "left_semi")
          .groupBy("db_id", "table_name").agg(F.collect_set("column_name").alias("_pk")))
    # A table's key travels with its row, so that columns are dealt once.
    t = tables.select("db_id", "table_name", "table_pos").join(by_shuffle(pk), ["db_id", "table_name"], "left")
    return (columns.join(by_shuffle(t), ["db_id", "table_name"])
            .select("db_id", "table_name", "table_pos", F.col("ordinal_position").alias("pos"),
                    F.col("column_name").alias("name"), F.col("data_type").alias("type"),
                    F.coalesce(F.array_contains("_pk", F.col("column_name")), F.lit(False)).alias("pk")))


def fk_inventory(constraints: DataFrame, key_columns: DataFrame) -> DataFrame:
    """FK column pairs, the referencing and referenced key paired by key position.

    Joining without the position (as some catalog queries do) turns a
    composite key of n columns into n x n pairs.
    """
    fks = constraints.where(F.col("constraint_type") == "FOREIGN KEY").select(
        "db_id", "constraint_name", "unique_constraint_name")
    src = key_columns.join(by_shuffle(fks), ["db_id", "constraint_name"]).select(
        "db_id", "unique_constraint_name", "key_pos",
        F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"))
    dst = key_columns.select("db_id", F.col("constraint_name").alias("unique_constraint_name"), "key_pos",
                             F.col("table_name").alias("to_table"), F.col("column_name").alias("to_column"))
    return (src.join(by_shuffle(dst), ["db_id", "unique_constraint_name", "key_pos"])
            .select("db_id", "from_table", "from_column", "to_table", "to_column",
                    (F.col("key_pos") - 1).alias("key_pos")))


def _col_text(x: Column) -> Column:
    return F.concat(x["name"], F.lit(":"), x["type"], F.when(x["pk"], F.lit(" pk")).otherwise(F.lit("")))


def schema_document(cols: DataFrame, fks: DataFrame, tables: DataFrame) -> DataFrame:
    """C4: one nested row per table: ordered columns and the table's FKs.

    Rows are per table (bounded by its column count), so no database is
    ever gathered into one value here.
    """
    c = cols.groupBy("db_id", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", "type", "pk"))).alias("cols"))
    f = fks.groupBy("db_id", F.col("from_table").alias("table_name")).agg(
        F.array_sort(F.collect_list(F.concat_ws("", "from_column", F.lit("->"), "to_table",
                                                F.lit("."), "to_column"))).alias("fk_list"))
    t = tables.select("db_id", "table_name", "table_schema")
    return (t.join(c, ["db_id", "table_name"]).join(f, ["db_id", "table_name"], "left")
            .select("db_id", "table_name", "table_schema", F.size("cols").alias("n_columns"),
                    F.array_join(F.transform("cols", _col_text), ", ").alias("columns"),
                    F.coalesce(F.array_join("fk_list", ", "), F.lit("")).alias("foreign_keys")))


def normalize_identifier(name: Column, dialect: Column) -> Column:
    """Quoted -> unquoted with case kept; else Postgres lower, Oracle upper."""
    first, last = F.substring(name, 1, 1), F.substring(name, -1, 1)
    quoted = (((first == '"') & (last == '"')) | ((first == "`") & (last == "`"))
              | ((first == "[") & (last == "]")))
    inner = F.substring(name, F.lit(2), F.length(name) - 2)
    d = F.lower(dialect)
    return (F.when(F.coalesce(name, F.lit("")) == "", name)
            .when(quoted, inner)
            .when(d.isin("postgresql", "postgres"), F.lower(name))
            .when(d == "oracle", F.upper(name))
            .otherwise(name))


def bytes_to_text(b: Column) -> Column:
    """Bytes -> UTF-8 text, invalid sequences replaced by U+FFFD."""
    return F.make_valid_utf8(b.cast("string"))


def composite_pk(cols: DataFrame) -> DataFrame:
    """Ordered PK column list per table and whether it has several columns."""
    pk = cols.where(F.col("pk")).groupBy("db_id", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("_pk"))
    return pk.select("db_id", "table_name",
                     F.array_join(F.transform("_pk", lambda x: x["name"]), ",").alias("pk_columns"),
                     F.size("_pk").alias("n_pk"), (F.size("_pk") > 1).alias("composite_pk"))


def graph_nodes(cols: DataFrame, tables: DataFrame) -> DataFrame:
    """``table:<t>`` and ``column:<t>.<c>`` nodes with their attributes."""
    pk = composite_pk(cols)
    t = (tables.select("db_id", "table_name").join(pk, ["db_id", "table_name"], "left")
         .select("db_id", F.concat(F.lit("table:"), "table_name").alias("node_id"), F.lit("table").alias("kind"),
                 "table_name", F.lit(None).cast("string").alias("column_name"),
                 F.lit(None).cast("string").alias("data_type"), F.lit(None).cast("boolean").alias("pk"),
                 F.coalesce("pk_columns", F.lit("")).alias("pk_columns"),
                 F.coalesce("composite_pk", F.lit(False)).alias("composite_pk")))
    c = cols.select("db_id", F.concat(F.lit("column:"), "table_name", F.lit("."), "name").alias("node_id"),
                    F.lit("column").alias("kind"), "table_name", F.col("name").alias("column_name"),
                    F.col("type").alias("data_type"), "pk", F.lit(None).cast("string").alias("pk_columns"),
                    F.lit(None).cast("boolean").alias("composite_pk"))
    return t.unionByName(c)


def graph_edges(nodes: DataFrame, fks: DataFrame) -> DataFrame:
    """C11: HAS_COLUMN edges, and FK edges whose two end columns exist."""
    col_nodes = nodes.where(F.col("kind") == "column")
    has = col_nodes.select("db_id", F.concat(F.lit("table:"), "table_name").alias("src"),
                           F.col("node_id").alias("dst"), F.lit("HAS_COLUMN").alias("rel"),
                           "table_name", F.lit(None).cast("string").alias("dst_table"))
    ids = col_nodes.select("db_id", "node_id")
    fk = fks.select("db_id", F.concat(F.lit("column:"), "from_table", F.lit("."), "from_column").alias("src"),
                    F.concat(F.lit("column:"), "to_table", F.lit("."), "to_column").alias("dst"),
                    F.lit("FK").alias("rel"), F.col("from_table").alias("table_name"),
                    F.col("to_table").alias("dst_table"))
    fk = (fk.join(ids.withColumnRenamed("node_id", "src"), ["db_id", "src"], "left_semi")
          .join(ids.withColumnRenamed("node_id", "dst"), ["db_id", "dst"], "left_semi"))
    return has.unionByName(fk.select(*has.columns)).distinct()


def fk_neighbours(edges: DataFrame) -> DataFrame:
    """Tables one FK hop away in either direction (a self FK gives the table itself)."""
    fk = edges.where(F.col("rel") == "FK")
    a = fk.select("db_id", "table_name", F.col("dst_table").alias("neighbour"))
    b = fk.select("db_id", F.col("dst_table").alias("table_name"), F.col("table_name").alias("neighbour"))
    return a.unionByName(b).distinct()


def existing_fks(fks: DataFrame, cols: DataFrame) -> DataFrame:
    """FKs whose two end columns exist in the column inventory (the FK-edge
    rule of C11), by two semi-joins -- for jobs that need only FK edges."""
    c = cols.select("db_id", "table_name", F.col("name").alias("column_name")).distinct()
    f = fks.join(by_shuffle(c.toDF("db_id", "from_table", "from_column")), ["db_id", "from_table", "from_column"], "left_semi")
    return f.join(by_shuffle(c.toDF("db_id", "to_table", "to_column")), ["db_id", "to_table", "to_column"], "left_semi")


def fk_table_neighbours(fks: DataFrame, cols: DataFrame) -> DataFrame:
    """C12 straight from the FK inventory: same result as ``fk_neighbours``
    over ``graph_edges``, without building nodes for every column."""
    f = existing_fks(fks, cols)
    a = f.select("db_id", F.col("from_table").alias("table_name"), F.col("to_table").alias("neighbour"))
    b = f.select("db_id", F.col("to_table").alias("table_name"), F.col("from_table").alias("neighbour"))
    return a.unionByName(b).distinct()


def fk_canonical_map(fks: DataFrame, cols: DataFrame) -> DataFrame:
    """Column equivalence through FKs; representative = first column of the set
    by table position, then column position, in its database.

    Only FKs whose two end columns exist take part (the same rule as the FK
    edges of C11), found with two equi-joins against the column inventory. A
    vertex is ``(db_id, table_pos, pos)``, so databases never mix. True connected
    components (the original merges greedily and can leave two sets that a later
    edge bridges).
    """
    idx = cols.select("db_id", "table_name", F.col("name").alias("column_name"), F.struct("db_id", "table_pos", "pos").alias("vertex"))
    a = idx.toDF("db_id", "from_table", "from_column", "a")
    b = idx.toDF("db_id", "to_table", "to_column", "b")
    pairs = (fks.join(by_shuffle(a), ["db_id", "from_table", "from_column"])
             .join(by_shuffle(b), ["db_id", "to_table", "to_column"]).select("a", "b"))
    comp = connected_components(pairs, "a", "b", large=True)
    rep = idx.select(F.col("vertex").alias("component"), F.col("table_name").alias("rep_table"), F.col("column_name").alias("rep_column"))
    return comp.join(by_shuffle(idx), "vertex").join(by_shuffle(rep), "component").select("db_id", "table_name", "column_name", "rep_table", "rep_column")


def table_schema_default(tables: DataFrame, dialect: str, user: str | None = None) -> DataFrame:
    """C14: table -> schema, missing schema replaced by the dialect's default."""
    default = {"mssql": "dbo", "sqlserver": "dbo", "postgres": "public", "postgresql": "public",
               "oracle": (user or "").upper() or None}.get(dialect.lower())
    return tables.select("db_id", "table_name", F.coalesce("table_schema", F.lit(default)).alias("table_schema"))
