"""Inputs derived from the driver tables for the text, catalog and log jobs.

No driver table holds SQL text, a catalog or a query log, so they are built
from ``orders``, ``lineitem`` and ``events`` with SQL that Spark and DuckDB
both run unchanged: the two sides start from identical rows and their size
grows with the data (one database per customer, one table per order, one
column per line item, one model output per order, one log entry per event).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import by_shuffle, cut_lineage, still_written
from ..sources.tables import table


def _lit(s: str) -> str:
    """SQL string literal valid in Spark and DuckDB (quotes and newlines via chr)."""
    parts = []
    buf = ""
    for ch in s:
        if ch in ("'", "\n", "\\"):
            if buf:
                parts.append("'" + buf + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf:
        parts.append("'" + buf + "'")
    return " || ".join(parts) if parts else "''"


def _template(t: str, fields: dict[str, str]) -> str:
    """Turn ``'... {key} ...'`` into a concat of literals and cast columns."""
    out, rest = [], t
    while rest:
        i = rest.find("{")
        if i < 0:
            out.append(_lit(rest))
            break
        if i:
            out.append(_lit(rest[:i]))
        j = rest.index("}", i)
        out.append(fields[rest[i + 1:j]])
        rest = rest[j + 1:]
    return "(" + " || ".join(out) + ")"


# Model outputs: reasoning + "SQL:" + statement, in the shapes generated text
# takes (fenced blocks, schema echoes, cut-off statements, DDL, quoting).
OUTPUT_TEMPLATES = [
    "Use SQLite syntax to count rows. SQL: SELECT count(*) FROM t_{key} WHERE active=0 AND n >= 1 LIMIT 5;",
    "The mysql database needs a join on `id`. SQL: SELECT `t_{key}`.`id`, \"c_name\" FROM t_{key} "
    "JOIN T_{key} ON t_{key}.id = T_{key}.id WHERE flag = 1 AND score >= 1;",
    "Reasoning for postgres: pick distinct names.\nSQL:SELECT DISTINCT name FROM t_{key} WHERE x IN "
    "(SELECT x FROM t_{cust}) LIMIT 3;\nSchema: t_{key}(id)",
    "I think the answer is\n```sql\nSELECT id FROM t_{key} -- first table\n-- a comment line\n"
    "WHERE ok = TRUE;\n```\nDone with Oracle.",
    "Oracle DDL follows. SQL: CREATE TABLE t_{key} (id INTEGER PRIMARY KEY AUTOINCREMENT, ts DATETIME "
    "DEFAULT CURRENT_TIMESTAMP(3), ok BOOLEAN DEFAULT TRUE, at TIMESTAMP DEFAULT NOW());",
    "mssql or sqlserver? First try SELECT a FROM t_{cust}; then DELETE FROM t_{key} WHERE id = {cust}; "
    "SQL: SELECT name FROM region",
    "Status check. SQL: SELECT * FROM [t_{key}] WHERE note = \"hello\" AND d = 'it''s' LIMIT 20;"
    "<|endoftext|><SCHEMA> t_{key}(id) </SCHEMA>",
    "Count by priority {prio}. SQL: SELECT status, count(*) FROM t_{key}, t_{cust} WHERE a.x = b.y GROUP BY",
    "Update the PostgreSQL row. SQL : UPDATE t_{key} SET status = '{status}' WHERE id = {key};",
    "Nested limit. SQL: SELECT a FROM (SELECT a FROM t_{key} LIMIT 2) s JOIN \"T_{key}\" ON s.a = 1 "
    "LEFT JOIN t_{key} u ON u.id=s.a LIMIT 7 ;",
]

DIALECT_CYCLE = ["sqlite", "postgres", "mysql", "mssql", "oracle", "postgresql", "sqlserver", "MySQL", "db2"]


def corpus_sql() -> str:
    f = {"key": "CAST(o_orderkey AS STRING)", "cust": "CAST(o_custkey AS STRING)",
         "status": "o_orderstatus", "prio": "o_orderpriority"}
    k = "CAST(floor(o_orderkey / 7) AS BIGINT) % " + str(len(OUTPUT_TEMPLATES))
    cases = " ".join(f"WHEN {i} THEN {_template(t, f)}" for i, t in enumerate(OUTPUT_TEMPLATES))
    dial = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DIALECT_CYCLE))
    return f"""
SELECT o_orderkey AS query_id,
       'db_' || CAST(o_custkey AS STRING) AS db_id,
       CASE o_orderkey % {len(DIALECT_CYCLE)} {dial} END AS dialect,
       CASE {k} {cases} END AS raw_output
FROM orders"""


# Error messages as drivers report them, one per logged event.
ERROR_TEMPLATES = [
    "SSL SYSCALL error: EOF detected",
    "ERROR: current transaction is aborted, commands ignored until end of transaction block",
    "no such table: t_{u}",
    "no such column c{k}_nme",
    "Unknown column 'prce{k}' in 'field list'",
    "column  parent_di does not exist",
    "MySQL server has gone away",
    "near \"FROM\": syntax error",
    "relation \"t_{u}\" does not exist",
    "Lost connection to MySQL server during query",
]


def error_log_sql(json_k: str = "get_json_object(props, '$.k')") -> str:
    f = {"u": "CAST(user_id AS STRING)", "k": json_k}
    cases = " ".join(f"WHEN {i} THEN {_template(t, f)}" for i, t in enumerate(ERROR_TEMPLATES))
    return f"""
SELECT event_id, ts, user_id, 'db_' || CAST(user_id AS STRING) AS db_id,
       CASE event_id % {len(ERROR_TEMPLATES)} {cases} END AS message
FROM events"""


# Lake catalog: information_schema-like rows.
TABLES_SQL = """
SELECT 'db_' || CAST(o_custkey AS STRING) AS db_id,
       CASE o_orderstatus WHEN 'F' THEN 'sales' WHEN 'O' THEN 'public' ELSE 'dbo' END AS table_schema,
       CASE o_orderkey % 50 WHEN 0 THEN 'DEMO_' WHEN 1 THEN 'MVIEW$_' WHEN 2 THEN 'APEX$_' ELSE '' END
         || 't_' || CAST(o_orderkey AS STRING) AS table_name,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS table_pos,
       o_orderkey AS order_key,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type
FROM orders"""

# The engine of every database, and the schema (or owner) of its connection.
DATABASES_SQL = """
SELECT 'db_' || CAST(c_custkey AS STRING) AS db_id,
       CASE c_custkey % 5 WHEN 0 THEN 'sqlite' WHEN 1 THEN 'postgresql' WHEN 2 THEN 'mysql' WHEN 3 THEN 'mssql' ELSE 'oracle' END AS dbms,
       CASE WHEN c_custkey % 5 = 1 THEN 'public' WHEN c_custkey % 2 = 0 THEN 'sales' ELSE 'dbo' END AS own_schema
FROM customer"""

COLUMN_WORDS = ["name", "price", "qty", "status", "note", "code"]

COLUMNS_SQL = f"""
SELECT t.db_id, t.table_name,
       CAST(l_linenumber - 1 AS INT) AS ordinal_position,
       CASE WHEN l_linenumber = 1 THEN 'id' WHEN l_linenumber = 2 THEN 'parent_id'
            ELSE CASE l_partkey % {len(COLUMN_WORDS)} {" ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(COLUMN_WORDS))} END
                 || '_' || CAST(l_linenumber AS STRING) END AS column_name,
       CASE WHEN l_linenumber <= 2 THEN 'INTEGER' WHEN l_linestatus = 'O' THEN 'TEXT' ELSE 'REAL' END AS data_type,
       (l_linenumber = 1 OR (l_linenumber = 2 AND l_returnflag = 'A')) AS is_pk
FROM lineitem JOIN ({TABLES_SQL}) t ON t.order_key = l_orderkey"""

# Key constraints, information_schema style: a primary key per table and a
# foreign key from every table's parent_id to the key of its database's
# first table (a self reference for the first table itself). Key columns
# carry their position, so composite keys pair by position.
CONSTRAINTS_SQL = f"""
WITH t AS ({TABLES_SQL}), c AS ({COLUMNS_SQL}),
firsts AS (SELECT db_id, min(table_pos) AS first_pos FROM t GROUP BY db_id),
first_names AS (SELECT t.db_id, t.table_name AS first_table FROM t JOIN firsts f
                ON f.db_id = t.db_id AND f.first_pos = t.table_pos)
SELECT db_id, 'pk_' || table_name AS constraint_name, 'PRIMARY KEY' AS constraint_type, table_name,
       CAST(NULL AS STRING) AS unique_constraint_name
FROM t
UNION ALL
SELECT c.db_id, 'fk_' || c.table_name, 'FOREIGN KEY', c.table_name, 'pk_' || fn.first_table
FROM c JOIN first_names fn ON fn.db_id = c.db_id WHERE c.column_name = 'parent_id'"""

KEY_COLUMNS_SQL = f"""
WITH c AS ({COLUMNS_SQL})
SELECT db_id, 'pk_' || table_name AS constraint_name, table_name, column_name,
       CAST(ordinal_position + 1 AS INT) AS key_pos
FROM c WHERE is_pk
UNION ALL
SELECT db_id, 'fk_' || table_name, table_name, column_name, CAST(1 AS INT) FROM c WHERE column_name = 'parent_id'"""


_MEMO: dict = {}


def _views(spark: SparkSession, named: dict[str, DataFrame]) -> None:
    """Views for fixture SQL, whose joins meet by shuffles: some columns of a large file
    look small enough to broadcast."""
    for name, df in named.items():
        by_shuffle(df).createOrReplaceTempView(name)


def spark_sql(spark: SparkSession, sf_dir: str, sql: str, tables=("orders", "lineitem", "events")) -> DataFrame:
    """Run fixture SQL once per session and directory, persisted.

    Fixtures are reused by many operators in one plan (the catalog feeds
    columns, keys, graph and prompts); persisting them (memory, spilling to
    disk) keeps one computation per run instead of one per reference.
    """
    key = (spark.sparkContext.applicationId, sf_dir, sql)
    df = _MEMO.get(key)
    if df is None or not df.is_cached:
        _views(spark, {t: table(spark, sf_dir, t) for t in tables})
        df = spark.sql(sql).persist()
        _MEMO[key] = df
    return df


def corpus(spark, sf_dir) -> DataFrame:
    return spark_sql(spark, sf_dir, corpus_sql(), ("orders",))


def error_log(spark, sf_dir) -> DataFrame:
    return spark_sql(spark, sf_dir, error_log_sql(), ("events",))


def written(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """``make()`` written once per session and directory; made again if its files are gone."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    df = _MEMO.get(key)
    if df is None or not still_written(df):
        df = _MEMO[key] = cut_lineage(make(), name)
    return df


def written_sql(spark: SparkSession, sf_dir: str, name: str, sql: str, tables) -> DataFrame:
    """Fixture SQL whose rows are long texts, written once: persisted, they would fill the
    executors' memory and drive out what queries need."""
    def make() -> DataFrame:
        _views(spark, {t: table(spark, sf_dir, t) for t in tables})
        return spark.sql(sql)
    return written(spark, sf_dir, name, make)


def lake_tables(spark, sf_dir) -> DataFrame:
    return written_sql(spark, sf_dir, "lake-tables", TABLES_SQL, ("orders",))


def _over_lake(spark, sf_dir, sql: str, tables=("lineitem",)) -> DataFrame:
    """``sql`` with the lake's table and column rows read as written, not derived again."""
    _views(spark, {t: table(spark, sf_dir, t) for t in tables})
    if COLUMNS_SQL in sql and sql != COLUMNS_SQL:
        _views(spark, {"sqlkiln_lake_c": lake_columns(spark, sf_dir)})
        sql = sql.replace(f"({COLUMNS_SQL})", "(SELECT * FROM sqlkiln_lake_c)")
    _views(spark, {"sqlkiln_lake_t": lake_tables(spark, sf_dir)})
    return spark.sql(sql.replace(f"({TABLES_SQL})", "(SELECT * FROM sqlkiln_lake_t)"))


def lake_columns(spark, sf_dir) -> DataFrame:
    return written(spark, sf_dir, "lake-columns", lambda: _over_lake(spark, sf_dir, COLUMNS_SQL))


def lake_constraints(spark, sf_dir) -> DataFrame:
    return _over_lake(spark, sf_dir, CONSTRAINTS_SQL)


def lake_key_columns(spark, sf_dir) -> DataFrame:
    return _over_lake(spark, sf_dir, KEY_COLUMNS_SQL)


def duck(sql: str) -> str:
    """Spark-flavoured fixture SQL -> DuckDB spelling."""
    return (sql.replace("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"))


# Query log (history entries): session = user, failed = error event,
# success = purchase, never run = anything else.
QUERY_LOG_SQL = """
SELECT event_id, user_id, ts, 'question ' || CAST(event_id AS STRING) AS question,
       CAST(get_json_object(props, '$.k') AS INT) > 50 AS edited,
       event_type = 'signup' AS user_written,
       CASE event_type WHEN 'error' THEN false WHEN 'purchase' THEN true END AS execution_status
FROM events"""


def query_log(spark, sf_dir) -> DataFrame:
    return spark_sql(spark, sf_dir, QUERY_LOG_SQL, ("events",))


def lake_databases(spark, sf_dir) -> DataFrame:
    return spark_sql(spark, sf_dir, DATABASES_SQL, ("customer",))
