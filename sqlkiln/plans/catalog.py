"""C1-C16 over the data-derived lake catalog and the star-schema data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import cleanup as cu
from ..operators import profiling as prof
from ..sources import lake
from ..sources.tables import TABLES, Tables
from . import fixtures as fx
from .registry import register

D_T = f"t AS ({fx.TABLES_SQL})"
D_C = f"c AS ({fx.COLUMNS_SQL})"
D_K = f"k AS ({fx.CONSTRAINTS_SQL})"
D_KC = f"kc AS ({fx.KEY_COLUMNS_SQL})"
D_INV = "inv AS (SELECT db_id, table_schema, table_name, table_pos FROM t WHERE table_type = 'BASE TABLE')"
D_COLS = """pkc AS (SELECT DISTINCT kc.db_id, kc.table_name, kc.column_name FROM kc
                 JOIN k ON k.db_id = kc.db_id AND k.constraint_name = kc.constraint_name
                 WHERE k.constraint_type = 'PRIMARY KEY'),
cols AS (SELECT c.db_id, c.table_name, inv.table_pos, c.ordinal_position AS pos, c.column_name AS name,
                c.data_type AS type, pkc.column_name IS NOT NULL AS pk
         FROM c JOIN inv ON inv.db_id = c.db_id AND inv.table_name = c.table_name
         LEFT JOIN pkc ON pkc.db_id = c.db_id AND pkc.table_name = c.table_name AND pkc.column_name = c.column_name)"""
D_FKS = """fks AS (SELECT s.db_id, s.table_name AS from_table, s.column_name AS from_column,
                d.table_name AS to_table, d.column_name AS to_column, s.key_pos - 1 AS key_pos
         FROM kc s JOIN k ON k.db_id = s.db_id AND k.constraint_name = s.constraint_name AND k.constraint_type = 'FOREIGN KEY'
         JOIN kc d ON d.db_id = s.db_id AND d.constraint_name = k.unique_constraint_name AND d.key_pos = s.key_pos)"""
D_NODES = """pkt AS (SELECT db_id, table_name, string_agg(name, ',' ORDER BY pos, name) AS pk_columns, count(*) AS n_pk
        FROM cols WHERE pk GROUP BY ALL),
nodes AS (SELECT db_id, 'table:' || table_name AS node_id, 'table' AS kind, table_name FROM inv
          UNION ALL SELECT db_id, 'column:' || table_name || '.' || name, 'column', table_name FROM cols)"""
D_EDGES = """edges AS (SELECT DISTINCT * FROM (
    SELECT db_id, 'table:' || table_name AS src, 'column:' || table_name || '.' || name AS dst, 'HAS_COLUMN' AS rel,
           table_name, CAST(NULL AS VARCHAR) AS dst_table FROM cols
    UNION ALL
    SELECT db_id, 'column:' || from_table || '.' || from_column, 'column:' || to_table || '.' || to_column, 'FK',
           from_table, to_table FROM fks f
    WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.db_id = f.db_id AND n.node_id = 'column:' || from_table || '.' || from_column)
      AND EXISTS (SELECT 1 FROM nodes n WHERE n.db_id = f.db_id AND n.node_id = 'column:' || to_table || '.' || to_column)))"""


def with_(*ctes):
    return "WITH " + ",\n".join(ctes) + "\n"


def _inv(spark, d):
    return fx.written(spark, d, "inventory", lambda: cat.table_inventory(fx.lake_tables(spark, d)))


def _cols(spark, d):
    return fx.written(spark, d, "columns", lambda: cat.column_inventory(
        fx.lake_columns(spark, d), _inv(spark, d), fx.lake_constraints(spark, d), fx.lake_key_columns(spark, d)))


def _fks(spark, d):
    return fx.written(spark, d, "fks", lambda: cat.fk_inventory(fx.lake_constraints(spark, d), fx.lake_key_columns(spark, d)))


def _lake(spark, d):
    """Catalog inventories (C1, C2, C3), each written once per run into the shared folder.

    Dozens of jobs read the column and FK inventories; each job reads the files
    instead of re-joining the raw catalog rows. Missing files make the next
    caller rebuild them.
    """
    return fx.lake_tables(spark, d), _inv(spark, d), _cols(spark, d), _fks(spark, d)


@register("c1_table_inventory", sql=with_(D_T, D_INV) + "SELECT * FROM inv")
def c1_table_inventory(spark, d):
    return cat.table_inventory(fx.lake_tables(spark, d))


# Beside the engines' own rules: SQL Server's sales schema is left out, Postgres' dbo taken in.
EXTRA_SCOPE = [("mssql", "sales", False, False, 10), ("postgresql", "dbo", True, False, 0)]


@register("c1_scoped_inventory", sql=with_(D_T, f"db AS ({fx.DATABASES_SQL})") + """
SELECT t.db_id, dbms, table_schema, table_name, table_pos, table_type FROM t JOIN db ON db.db_id = t.db_id
WHERE CASE dbms WHEN 'sqlite' THEN table_type = 'BASE TABLE'
                WHEN 'postgresql' THEN table_type = 'BASE TABLE' AND table_schema IN (own_schema, 'dbo')
                WHEN 'mysql' THEN table_schema = own_schema
                WHEN 'mssql' THEN table_type = 'BASE TABLE' AND table_schema <> 'sales'
                ELSE table_type = 'BASE TABLE' AND table_schema = own_schema END""")
def c1_scoped_inventory(spark, d):
    rules = spark.createDataFrame(cat.DEFAULT_SCOPE + EXTRA_SCOPE, cat.SCOPE_SCHEMA)
    return cat.scoped_inventory(fx.lake_tables(spark, d), fx.lake_databases(spark, d), rules)


@register("c2_column_inventory", sql=with_(D_T, D_C, D_K, D_KC, D_INV, D_COLS) + "SELECT * FROM cols")
def c2_column_inventory(spark, d):
    return _cols(spark, d)


# The given tables' own files. DuckDB takes names and types from the views over them and counts rows.
_VIEWS = "(" + ", ".join(f"'{t}'" for t in TABLES) + ")"
D_FILES = """WITH col AS (SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name,
    replace(replace(replace(replace(replace(lower(data_type), 'float[]', 'array<float>'), 'varchar', 'string'), 'integer', 'int'),
      'timestamp', 'timestamp_ntz'), 'timestamp_ntz with time zone', 'timestamp') AS data_type
  FROM information_schema.columns WHERE table_name IN """ + _VIEWS + "),\nsize AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES) + "),\nfull_cells AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, * FROM (UNPIVOT (SELECT count(COLUMNS(*)) AS '\\0' FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE n_values)"
    for t in TABLES) + ")"


@register("c1_lake_tables", sql=D_FILES + """
SELECT table_name, 0 AS n_unreadable, any_value(n_rows) AS n_rows, count(*) AS n_columns FROM col JOIN size USING (table_name) GROUP BY table_name""")
def c1_lake_tables(spark, d):
    return lake.lake_tables(lake.parquet_footers(spark, d)).where(F.col("table_name").isin(*TABLES)).select("table_name", "n_unreadable", "n_rows", "n_columns")


@register("c2_lake_columns", sql=D_FILES + """
SELECT table_name, position, column_name, data_type, CASE WHEN data_type NOT LIKE 'array%' THEN n_values END AS n_values,
       CASE WHEN data_type NOT LIKE 'array%' THEN n_rows - n_values END AS n_nulls
FROM col JOIN size USING (table_name) JOIN full_cells USING (table_name, column_name)""")
def c2_lake_columns(spark, d):
    cols = lake.lake_columns(lake.parquet_footers(spark, d)).where(F.col("table_name").isin(*TABLES))
    return cols.select("table_name", "position", "column_name", "data_type", "n_values", "n_nulls")


@register("c3_fk_inventory", sql=with_(D_T, D_C, D_K, D_KC, D_FKS)
          + "SELECT db_id, from_table, from_column, to_table, to_column, CAST(key_pos AS INTEGER) AS key_pos FROM fks")
def c3_fk_inventory(spark, d):
    return _fks(spark, d)


@register("c4_schema_document", sql=with_(D_T, D_C, D_K, D_KC, D_INV, D_COLS, D_FKS) + """
, cc AS (SELECT db_id, table_name, count(*) AS n_columns,
                string_agg(name || ':' || type || CASE WHEN pk THEN ' pk' ELSE '' END, ', ' ORDER BY pos, name, type, pk) AS columns
         FROM cols GROUP BY ALL),
ff AS (SELECT db_id, from_table AS table_name,
              string_agg(from_column || '->' || to_table || '.' || to_column, ', '
                         ORDER BY from_column || '->' || to_table || '.' || to_column) AS foreign_keys
       FROM fks GROUP BY ALL)
SELECT inv.db_id, inv.table_name, inv.table_schema, CAST(cc.n_columns AS INTEGER) AS n_columns, cc.columns,
       coalesce(ff.foreign_keys, '') AS foreign_keys
FROM inv JOIN cc USING (db_id, table_name) LEFT JOIN ff USING (db_id, table_name)""")
def c4_schema_document(spark, d):
    _, inv, cols, fks = _lake(spark, d)
    return cat.schema_document(cols, fks, inv)


_PREFIX_COND = " AND ".join(f"NOT starts_with(table_name, '{p}')" for p in cat.DEFAULT_IGNORED_PREFIXES)


@register("c5_prefix_filter", sql=with_(D_T, D_INV) + f"SELECT * FROM inv WHERE {_PREFIX_COND}")
def c5_prefix_filter(spark, d):
    return cat.prefix_filter(cat.table_inventory(fx.lake_tables(spark, d)))


D_CORPUS_TOKENS = (f"ct AS (SELECT query_id, dialect, unnest(regexp_extract_all(raw_output, "
                   f"'(?i)\\b(?:FROM|JOIN)\\s+([^\\s,;()]+)', 1)) AS name FROM ({fx.corpus_sql()}))")


@register("c6_normalize_identifier", sql=with_(D_CORPUS_TOKENS) + """
SELECT DISTINCT dialect, name, CASE
  WHEN coalesce(name, '') = '' THEN name
  WHEN (left(name, 1) = '"' AND right(name, 1) = '"') OR (left(name, 1) = '`' AND right(name, 1) = '`')
       OR (left(name, 1) = '[' AND right(name, 1) = ']') THEN substr(name, 2, length(name) - 2)
  WHEN lower(dialect) IN ('postgresql', 'postgres') THEN lower(name)
  WHEN lower(dialect) = 'oracle' THEN upper(name) ELSE name END AS normalized
FROM ct""")
def c6_normalize_identifier(spark, d):
    c = fx.corpus(spark, d)
    toks = c.select("dialect", F.explode(F.regexp_extract_all(
        "raw_output", F.lit(r"(?i)\b(?:FROM|JOIN)\s+([^\s,;()]+)"), 1)).alias("name"))
    return toks.select("dialect", "name", cat.normalize_identifier(F.col("name"), F.col("dialect"))
                       .alias("normalized")).distinct()


@register("c7_bytes_to_text", sql="SELECT doc_id, text || chr(65533) AS text, length(text) + 1 AS n_chars FROM documents")
def c7_bytes_to_text(spark, d):
    # Document text as bytes with a stray invalid byte appended: decoding
    # keeps every valid character and replaces the bad byte.
    docs = Tables(spark, d).documents
    raw = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))
    return docs.select("doc_id", cat.bytes_to_text(raw).alias("text"),
                       F.length(cat.bytes_to_text(raw)).alias("n_chars"))


@register("c8_unpivot_schema", sql=with_(D_T, D_C, D_K, D_KC, D_INV, D_COLS)
          + "SELECT db_id, table_name, name AS column_name, type AS data_type, pk FROM cols")
def c8_unpivot_schema(spark, d):
    from ..operators.benchmark_schema import decode_schema, encode_schema
    _, inv, cols, fks = _lake(spark, d)
    return decode_schema(encode_schema(inv, cols, fks))[0]


@register("c8_unpivot_schema_fks", sql=with_(D_T, D_C, D_K, D_KC, D_INV, D_COLS, D_FKS) + """
SELECT f.db_id, from_table, from_column, to_table, to_column FROM fks f
WHERE EXISTS (SELECT 1 FROM cols c WHERE c.db_id = f.db_id AND c.table_name = f.from_table AND c.name = f.from_column)
  AND EXISTS (SELECT 1 FROM cols c WHERE c.db_id = f.db_id AND c.table_name = f.to_table AND c.name = f.to_column)""")
def c8_unpivot_schema_fks(spark, d):
    from ..operators.benchmark_schema import decode_schema, encode_schema
    _, inv, cols, fks = _lake(spark, d)
    return decode_schema(encode_schema(inv, cols, fks))[1]


@register("c9_composite_pk", sql=with_(D_T, D_C, D_K, D_KC, D_INV, D_COLS, D_NODES)
          + "SELECT db_id, table_name, pk_columns, CAST(n_pk AS INTEGER) AS n_pk, n_pk > 1 AS composite_pk FROM pkt")
def c9_composite_pk(spark, d):
    return cat.composite_pk(_cols(spark, d))


@register("c10_graph_nodes", sql=with_(D_T, D_C, D_K, D_KC, D_INV, D_COLS, D_NODES) + """
SELECT inv.db_id, 'table:' || inv.table_name AS node_id, 'table' AS kind, inv.table_name,
       CAST(NULL AS VARCHAR) AS column_name, CAST(NULL AS VARCHAR) AS data_type, CAST(NULL AS BOOLEAN) AS pk,
       coalesce(pkt.pk_columns, '') AS pk_columns, coalesce(pkt.n_pk > 1, false) AS composite_pk
FROM inv LEFT JOIN pkt USING (db_id, table_name)
UNION ALL
SELECT db_id, 'column:' || table_name || '.' || name, 'column', table_name, name, type, pk, NULL, NULL FROM cols""")
def c10_graph_nodes(spark, d):
    _, inv, cols, _ = _lake(spark, d)
    return cat.graph_nodes(cols, inv)


@register("c11_graph_edges", sql=with_(D_T, D_C, D_K, D_KC, D_INV, D_COLS, D_FKS, D_NODES, D_EDGES)
          + "SELECT * FROM edges")
def c11_graph_edges(spark, d):
    _, inv, cols, fks = _lake(spark, d)
    return cat.graph_edges(cat.graph_nodes(cols, inv), fks)


@register("c12_fk_neighbours", sql=with_(D_T, D_C, D_K, D_KC, D_INV, D_COLS, D_FKS, D_NODES, D_EDGES) + """
SELECT DISTINCT * FROM (SELECT db_id, table_name, dst_table AS neighbour FROM edges WHERE rel = 'FK'
                        UNION ALL SELECT db_id, dst_table, table_name FROM edges WHERE rel = 'FK')""")
def c12_fk_neighbours(spark, d):
    _, inv, cols, fks = _lake(spark, d)
    return cat.fk_neighbours(cat.graph_edges(cat.graph_nodes(cols, inv), fks))


D_COMPONENTS = """, idx AS (SELECT db_id, table_name, name AS column_name, {'p': table_pos, 'c': pos} AS v FROM cols),
pe AS (SELECT e.db_id, i1.v AS a, i2.v AS b FROM edges e
       JOIN idx i1 ON i1.db_id = e.db_id AND i1.table_name = e.table_name
            AND i1.column_name = regexp_extract(e.src, '^column:[^.]*\\.(.*)$', 1)
       JOIN idx i2 ON i2.db_id = e.db_id AND i2.table_name = e.dst_table
            AND i2.column_name = regexp_extract(e.dst, '^column:[^.]*\\.(.*)$', 1)
       WHERE e.rel = 'FK'),
und AS (SELECT db_id, a, b FROM pe UNION SELECT db_id, b, a FROM pe UNION SELECT db_id, a, a FROM pe UNION SELECT db_id, b, b FROM pe),
reach(db_id, a, b) AS (SELECT db_id, a, b FROM und UNION SELECT r.db_id, r.a, u.b FROM reach r JOIN und u ON u.db_id = r.db_id AND u.a = r.b),
lab AS (SELECT db_id, a AS v, min(b) AS label FROM reach GROUP BY db_id, a),
canon AS (SELECT i.db_id, i.table_name, i.column_name, r.table_name AS rep_table, r.column_name AS rep_column
  FROM lab l JOIN idx i ON i.db_id = l.db_id AND i.v = l.v JOIN idx r ON r.db_id = l.db_id AND r.v = l.label)"""
D_CANON = with_(D_T, D_C, D_K, D_KC, D_INV, D_COLS, D_FKS, D_NODES, D_EDGES).replace("WITH ", "WITH RECURSIVE ", 1) + D_COMPONENTS


@register("c13_fk_canonical_map", sql=D_CANON + "\nSELECT * FROM canon")
def c13_fk_canonical_map(spark, d):
    _, inv, cols, fks = _lake(spark, d)
    return cat.fk_canonical_map(fks, cols)


@register("c14_table_schema_map", sql=with_(D_T) + """
SELECT db_id, kind, key, max(table_schema) AS table_schema FROM (
  SELECT db_id, table_schema, 'mssql' AS kind, table_name AS key FROM t
  UNION ALL SELECT db_id, table_schema, 'postgres', lower(table_name) FROM t
  UNION ALL SELECT db_id, table_schema, 'oracle', upper(table_name) FROM t) GROUP BY ALL""")
def c14_table_schema_map(spark, d):
    return cu.table_schema_map(fx.lake_tables(spark, d))


@register("c14_table_schema_default", sql=with_(D_T) + """
SELECT db_id, table_name, 'mssql' AS dialect, coalesce(nullif(table_schema, 'dbo'), 'dbo') AS table_schema FROM t
UNION ALL SELECT db_id, table_name, 'postgres', coalesce(nullif(table_schema, 'dbo'), 'public') FROM t
UNION ALL SELECT db_id, table_name, 'oracle', coalesce(nullif(table_schema, 'dbo'), 'APP') FROM t
UNION ALL SELECT db_id, table_name, 'sqlite', nullif(table_schema, 'dbo') FROM t""")
def c14_table_schema_default(spark, d):
    # tables without a schema: those that the fixture puts in dbo
    t = fx.lake_tables(spark, d).withColumn("table_schema", F.nullif("table_schema", F.lit("dbo")))
    parts = [cat.table_schema_default(t, k, "app").withColumn("dialect", F.lit(k)) for k in ("mssql", "postgres", "oracle", "sqlite")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# All tables profiled for keys; column lists are the driver's
# published table layouts (fixed values).
PROFILED = {
    "region": [("r_regionkey", "integer"), ("r_name", "string")],
    "nation": [("n_nationkey", "integer"), ("n_name", "string"), ("n_regionkey", "integer")],
    "customer": [("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"),
                 ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "integer"), ("s_name", "string"), ("s_nationkey", "integer")],
    "part": [("p_partkey", "integer"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "integer")],
    "orders": [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"),
               ("o_orderdate", "datetime"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"),
                 ("l_linenumber", "integer"), ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "datetime")],
    "events": [("event_id", "integer"), ("ts", "datetime"), ("user_id", "integer"), ("event_type", "string"), ("props", "string")],
    "documents": [("doc_id", "integer"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "integer")],
    "embeddings": [("vec_id", "integer"), ("label", "integer")],
    "pages": [("page_id", "integer"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "integer"), ("text", "string")],
    "labels": [("doc_id", "integer"), ("quality", "integer"), ("toxic", "integer")],
    "conversations": [("conv_id", "integer"), ("turn", "integer"), ("role", "string"), ("text", "string")],
}


def _profiled_tables(spark, d):
    t = Tables(spark, d)
    return {name: getattr(t, name) for name in PROFILED}


def _duck_key_profile() -> str:
    parts = []
    for tname, cols in PROFILED.items():
        names = [c for c, _ in cols]
        single = " UNION ALL ".join(
            f"SELECT '{tname}' AS table_name, '{c}' AS key_columns, 1 AS n_columns, count(*) AS n_rows, "
            f"count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS ok FROM {tname}" for c in names)
        parts.append(f"s_{tname} AS ({single})")
        pairs = []
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                pairs.append(
                    f"SELECT '{tname}', '{a},{b}', 2, count(*), count({a}) = count(*) AND count({b}) = count(*) "
                    f"AND count(DISTINCT ({a}, {b})) = count(*) AND '{a}' NOT IN (SELECT key_columns FROM s_{tname} WHERE ok) "
                    f"AND '{b}' NOT IN (SELECT key_columns FROM s_{tname} WHERE ok) FROM {tname}")
        parts.append(f"p_{tname} AS ({' UNION ALL '.join(pairs)})")
    body = " UNION ALL ".join(f"SELECT * FROM s_{t} UNION ALL SELECT * FROM p_{t}" for t in PROFILED)
    return ("WITH " + ",\n".join(parts) + f"\nSELECT table_name, key_columns, CAST(n_columns AS INTEGER) AS n_columns, "
            f"n_rows FROM ({body}) WHERE ok")


KEY_PROFILE_SQL = _duck_key_profile()


@register("c15_key_profile", sql=KEY_PROFILE_SQL)
def c15_key_profile(spark, d):
    return prof.key_profile(spark, _profiled_tables(spark, d))


def _duck_inclusion() -> str:
    vals = " UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS table_name, '{c}' AS column_name, '{fam}' AS family, CAST({c} AS VARCHAR) AS value "
        f"FROM {t} WHERE {c} IS NOT NULL" for t, cols in PROFILED.items() for c, fam in cols)
    return (f"WITH kp AS ({KEY_PROFILE_SQL}), vals AS ({vals}),\n"
            "ref AS (SELECT v.table_name AS ref_table, v.column_name AS ref_column, family, value FROM vals v "
            "JOIN kp ON kp.n_columns = 1 AND kp.table_name = v.table_name AND kp.key_columns = v.column_name),\n"
            "nv AS (SELECT table_name, column_name, any_value(family) AS family, count(*) AS n_values FROM vals GROUP BY ALL),\n"
            "hits AS (SELECT v.table_name AS dep_table, v.column_name AS dep_column, ref_table, ref_column, "
            "count(*) AS n_covered FROM vals v JOIN ref USING (family, value) "
            "WHERE v.table_name <> ref_table OR v.column_name <> ref_column GROUP BY ALL)\n"
            "SELECT nv.table_name AS dep_table, nv.column_name AS dep_column, r.ref_table, r.ref_column, n_values, coalesce(n_covered, 0) AS n_covered, "
            "round(coalesce(n_covered, 0) / n_values, 4) AS coverage FROM nv "
            "JOIN (SELECT DISTINCT ref_table, ref_column, family FROM ref) r USING (family) "
            "LEFT JOIN hits h ON h.dep_table = nv.table_name AND h.dep_column = nv.column_name AND h.ref_table = r.ref_table AND h.ref_column = r.ref_column "
            "WHERE nv.table_name <> r.ref_table OR nv.column_name <> r.ref_column")


@register("c16_inclusion_dependency", sql=_duck_inclusion())
def c16_inclusion_dependency(spark, d):
    tables = _profiled_tables(spark, d)
    keys = prof.key_profile(spark, tables)
    return prof.inclusion_dependencies(tables, keys)
