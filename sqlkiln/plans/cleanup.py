"""P1-P21 over the model-output corpus, error log and query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqltext as st
from ..operators import cleanup as cu
from . import duck_text as dt
from . import fixtures as fx
from .registry import register

# --------------------------------------------------------------------------
# Oracle building blocks (DuckDB)
# --------------------------------------------------------------------------
D_CORPUS = f"c AS ({fx.corpus_sql()})"
D_SPLIT = (f"s AS (SELECT *, {dt.cot_text('raw_output')} AS cot_text, {dt.sql_part('raw_output')} AS sql_part, "
           f"{dt.sql_text('raw_output')} AS sql_text FROM c)")
D_BEST = (f"b AS (SELECT *, {dt.extract_sql('sql_text', 'cot_text')} AS best_sql, "
          f"{dt.extract_sql('sql_text', 'cot_text', True)} AS best_sql_compat FROM s)")
D_ADAPT = (f"a AS (SELECT *, CASE WHEN best_sql <> '' THEN {dt.transform_sql('best_sql', 'dialect')} ELSE '' END AS adapted, "
           f"{dt.canonical_dialect('dialect')} AS kind FROM b)")
D_MAP = f"""tm AS ({fx.TABLES_SQL}),
m AS (SELECT db_id, kind, key, max(table_schema) AS table_schema FROM (
        SELECT db_id, table_schema, 'mssql' AS kind, table_name AS key FROM tm
        UNION ALL SELECT db_id, table_schema, 'postgres', lower(table_name) FROM tm
        UNION ALL SELECT db_id, table_schema, 'oracle', upper(table_name) FROM tm) GROUP BY ALL)"""
D_QUALIFY = f"""tk AS (SELECT DISTINCT query_id, db_id, kind, tok,
        CASE kind WHEN 'postgres' THEN lower(base) WHEN 'oracle' THEN upper(base) ELSE base END AS key
      FROM (SELECT *, regexp_replace(regexp_replace(tok, '^\\[(.*)\\]$', '\\1'), '^"(.*)"$', '\\1') AS base
            FROM (SELECT query_id, db_id, kind, unnest(regexp_extract_all(adapted, {dt.q(st.RE_QUALIFY)}, 2)) AS tok
                  FROM a WHERE kind IN ('mssql', 'postgres', 'oracle')))
      WHERE NOT contains(base, '.') AND NOT starts_with(base, '(')),
h AS (SELECT query_id, list(DISTINCT {{'tok': tok, 'table_schema': m.table_schema}}) AS rewrites
      FROM tk JOIN m USING (db_id, kind, key)
      WHERE lower(m.table_schema) <> lower(CASE tk.kind WHEN 'mssql' THEN 'dbo' WHEN 'postgres' THEN 'public'
                                                 ELSE '' END)
      GROUP BY query_id),
qd AS (SELECT a.*, coalesce(list_reduce(h.rewrites, lambda acc, r: regexp_replace(acc,
          '\\b((?i:FROM|JOIN))\\s+\\Q' || r.tok || '\\E([\\s,;]|$)', '\\1 ' || r.table_schema || '.' || r.tok || '\\2', 'g'),
          a.adapted), a.adapted) AS qualified
       FROM a LEFT JOIN h USING (query_id))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------
def _split(spark, d):
    c = fx.corpus(spark, d)
    cot, sql = st.split_output(F.col("raw_output"))
    has = F.col("raw_output").rlike(r"(?i)\bSQL\s*:")
    part = F.when(has, st.strip(F.regexp_extract("raw_output", st.RE_SQL_SPLIT, 2))).otherwise(F.lit(""))
    return c.select("*", cot.alias("cot_text"), part.alias("sql_part"), sql.alias("sql_text"))


def _best(spark, d):
    s = _split(spark, d)
    return s.select("*", st.extract_sql(F.col("sql_text"), F.col("cot_text")).alias("best_sql"),
                    st.extract_sql(F.col("sql_text"), F.col("cot_text"), compat=True).alias("best_sql_compat"))


def _cleaned(spark, d):
    return cu.clean_outputs(fx.corpus(spark, d))


def _qualified(spark, d):
    smap = cu.table_schema_map(fx.lake_tables(spark, d))
    return cu.qualify_tables(_cleaned(spark, d), smap)


@register("p1_split_output", sql=with_(D_CORPUS, D_SPLIT) + "SELECT query_id, cot_text, sql_part FROM s")
def p1_split_output(spark, d):
    return _split(spark, d).select("query_id", "cot_text", "sql_part")


@register("p2_cut_schema_echo", sql=with_(D_CORPUS, D_SPLIT) + "SELECT query_id, sql_text FROM s")
def p2_cut_schema_echo(spark, d):
    return _split(spark, d).select("query_id", "sql_text")


@register("p3_extract_sql", sql=with_(D_CORPUS, D_SPLIT, D_BEST) + "SELECT query_id, best_sql, best_sql_compat FROM b")
def p3_extract_sql(spark, d):
    return _best(spark, d).select("query_id", "best_sql", "best_sql_compat")


@register("p4_fix_dbms_names", sql=with_(D_CORPUS, D_SPLIT)
          + f"SELECT query_id, dialect, {dt.fix_dbms_names('cot_text', 'dialect')} AS cot_fixed FROM s")
def p4_fix_dbms_names(spark, d):
    s = _split(spark, d)
    return s.select("query_id", "dialect", st.fix_dbms_names(F.col("cot_text"), F.col("dialect")).alias("cot_fixed"))


@register("p5_looks_incomplete", sql=with_(D_CORPUS, D_SPLIT, D_BEST)
          + f"SELECT query_id, {dt.looks_incomplete('best_sql')} AS incomplete, "
            f"{dt.looks_incomplete('best_sql', True)} AS incomplete_compat FROM b")
def p5_looks_incomplete(spark, d):
    b = _best(spark, d)
    return b.select("query_id", st.looks_incomplete(F.col("best_sql")).alias("incomplete"),
                    st.looks_incomplete(F.col("best_sql"), compat=True).alias("incomplete_compat"))


@register("p6_classify_statement", sql=with_(D_CORPUS, D_SPLIT, D_BEST)
          + f"SELECT {dt.verb('best_sql')} AS verb, count(*) AS n FROM b GROUP BY 1")
def p6_classify_statement(spark, d):
    b = _best(spark, d)
    return b.groupBy(st.statement_verb(F.col("best_sql")).alias("verb")).agg(F.count(F.lit(1)).alias("n"))


@register("p7_to_postgres", sql=with_(D_CORPUS, D_SPLIT, D_BEST)
          + f"SELECT query_id, {dt.to_postgres('best_sql')} AS pg_sql, {dt.to_postgres('best_sql', True)} AS pg_sql_compat FROM b")
def p7_to_postgres(spark, d):
    b = _best(spark, d)
    return b.select("query_id", st.to_postgres(F.col("best_sql")).alias("pg_sql"),
                    st.to_postgres(F.col("best_sql"), compat=True).alias("pg_sql_compat"))


@register("p7_to_postgres_typed", sql=with_(D_CORPUS, D_SPLIT, D_BEST) + """
, p AS (SELECT query_id, regexp_replace(regexp_replace(regexp_replace(best_sql, '^\\s+|\\s+$', '', 'g'), '`([^`]+)`', '"\\1"', 'g'), '\\bAUTOINCREMENT\\b', 'SERIAL', 'gi') AS s FROM b)
SELECT query_id, regexp_replace(regexp_replace(s, '\\b(active|flag)("?)\\s*=\\s*1\\b', '\\1\\2 = TRUE', 'gi'), '\\b(active|flag)("?)\\s*=\\s*0\\b', '\\1\\2 = FALSE', 'gi') AS pg_sql FROM p""")
def p7_to_postgres_typed(spark, d):
    return _best(spark, d).select("query_id", st.to_postgres(F.col("best_sql"), bool_columns=["active", "flag"]).alias("pg_sql"))


@register("p8_to_mysql", sql=with_(D_CORPUS, D_SPLIT, D_BEST) + f"SELECT query_id, {dt.to_mysql('best_sql')} AS mysql_sql FROM b")
def p8_to_mysql(spark, d):
    return _best(spark, d).select("query_id", st.to_mysql(F.col("best_sql")).alias("mysql_sql"))


@register("p9_to_mssql", sql=with_(D_CORPUS, D_SPLIT, D_BEST) + f"SELECT query_id, {dt.to_mssql('best_sql')} AS mssql_sql FROM b")
def p9_to_mssql(spark, d):
    return _best(spark, d).select("query_id", st.to_mssql(F.col("best_sql")).alias("mssql_sql"))


@register("p10_to_oracle", sql=with_(D_CORPUS, D_SPLIT, D_BEST)
          + f"SELECT query_id, {dt.to_oracle('best_sql')} AS ora_sql, {dt.to_oracle('best_sql', True)} AS ora_sql_compat FROM b")
def p10_to_oracle(spark, d):
    b = _best(spark, d)
    return b.select("query_id", st.to_oracle(F.col("best_sql")).alias("ora_sql"),
                    st.to_oracle(F.col("best_sql"), compat=True).alias("ora_sql_compat"))


@register("p11_transform_dispatch", sql=with_(D_CORPUS, D_SPLIT, D_BEST, D_ADAPT) + "SELECT query_id, dialect, adapted FROM a")
def p11_transform_dispatch(spark, d):
    return _cleaned(spark, d).select("query_id", "dialect", "adapted")


def _duck_portability():
    sel = " UNION ALL ".join(
        f"SELECT coalesce(kind, 'other') AS dialect, '{r}' AS rule, len(regexp_extract_all(best_sql, {dt.q(p)})) AS n FROM a"
        for r, p in cu.PORTABILITY_RULES.items())
    return (with_(D_CORPUS, D_SPLIT, D_BEST, D_ADAPT)
            + f"SELECT dialect, rule, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_queries, "
              f"CAST(sum(n) AS BIGINT) AS n_hits FROM ({sel}) GROUP BY dialect, rule")


@register("p12_portability_report", sql=_duck_portability())
def p12_portability_report(spark, d):
    return cu.portability_report(_cleaned(spark, d))


@register("p13_qualify_tables", sql=with_(D_CORPUS, D_SPLIT, D_BEST, D_ADAPT, D_MAP, D_QUALIFY)
          + "SELECT query_id, qualified FROM qd")
def p13_qualify_tables(spark, d):
    return _qualified(spark, d).select("query_id", "qualified")


@register("p14_adapted_flag", sql=with_(D_CORPUS, D_SPLIT, D_BEST, D_ADAPT, D_MAP, D_QUALIFY)
          + f"SELECT 'SQLite -> ' || {dt.display_name('dialect')} AS adaptation, best_sql <> qualified AS changed, "
            f"count(*) AS n FROM qd WHERE best_sql <> '' GROUP BY 1, 2")
def p14_adapted_flag(spark, d):
    return cu.adapted_report(_qualified(spark, d))


@register("p15_strip_semicolon", sql=with_(D_CORPUS, D_SPLIT, D_BEST, D_ADAPT, D_MAP, D_QUALIFY)
          + "SELECT query_id, CASE WHEN kind = 'oracle' THEN regexp_replace(" + dt.rstrip("qualified")
          + ", ';+$', '') ELSE qualified END AS exec_sql FROM qd")
def p15_strip_semicolon(spark, d):
    q = _qualified(spark, d)
    ora = st.canonical_dialect(F.col("dialect")) == "oracle"
    return q.select("query_id", F.when(ora, st.strip_trailing_semicolon(F.col("qualified")))
                    .otherwise(F.col("qualified")).alias("exec_sql"))


D_ERR = f"e AS ({fx.duck(fx.error_log_sql())})"


@register("p16_classify_error", sql=with_(D_ERR) + f"SELECT event_id, {dt.classify_error('message')} AS category FROM e")
def p16_classify_error(spark, d):
    return fx.error_log(spark, d).select("event_id", st.classify_error(F.col("message")).alias("category"))


@register("p17_missing_column", sql=with_(D_ERR) + f"SELECT event_id, {dt.missing_column('message')} AS token FROM e")
def p17_missing_column(spark, d):
    return fx.error_log(spark, d).select("event_id", st.missing_column(F.col("message")).alias("token"))


@register("p18_suggest_terms", sql=with_(D_ERR, f"tm AS ({fx.TABLES_SQL})", f"cm AS ({fx.COLUMNS_SQL})") + f"""
, mi AS (SELECT event_id, db_id, {dt.missing_column('message')} AS token FROM e),
names AS (SELECT db_id, table_name AS name FROM tm UNION ALL SELECT db_id, table_name || '.' || column_name FROM cm),
sc AS (SELECT event_id, token, name,
              round(1 - levenshtein(lower(token), lower(name)) / greatest(length(token), length(name)), 4) AS score
       FROM mi JOIN names USING (db_id) WHERE token IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, name) AS rank FROM sc)
SELECT event_id, token, CAST(rank AS INTEGER) AS rank, name, score FROM rk WHERE rank <= 5""")
def p18_suggest_terms(spark, d):
    errs = fx.error_log(spark, d)
    misses = (errs.select("event_id", "db_id", st.missing_column(F.col("message")).alias("token"))
              .where(F.col("token").isNotNull()))
    names = cu.catalog_names(fx.lake_tables(spark, d), fx.lake_columns(spark, d))
    return cu.suggest_terms(misses, names)


D_LOG = f"lg AS ({fx.duck(fx.QUERY_LOG_SQL)})"


@register("p19_history_last_n", sql=with_(D_LOG) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rd FROM lg)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS n, event_id, ts, question
FROM r WHERE rd <= 10""")
def p19_history_last_n(spark, d):
    return cu.history_last_n(fx.query_log(spark, d)).select("user_id", "n", "event_id", "ts", "question")


@register("p20_history_labels", sql=with_(D_LOG) + """
SELECT event_id, CASE WHEN user_written THEN ' (user-written)' ELSE '' END
  || CASE WHEN edited THEN ' (edited)' ELSE '' END
  || CASE WHEN execution_status THEN ' (success)' WHEN NOT execution_status THEN ' (failed)' ELSE '' END AS label
FROM lg""")
def p20_history_labels(spark, d):
    return cu.history_labels(fx.query_log(spark, d)).select("event_id", "label")


@register("p20_history_success_rate", sql=with_(D_LOG) + """
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_entries,
       count(*) FILTER (WHERE execution_status) AS n_success,
       count(*) FILTER (WHERE NOT execution_status) AS n_failed,
       round(count(*) FILTER (WHERE execution_status) / nullif(count(execution_status), 0), 4) AS success_rate
FROM lg GROUP BY 1, 2""")
def p20_history_success_rate(spark, d):
    lg = fx.query_log(spark, d)
    ok = F.col("execution_status")
    return (lg.groupBy("user_id", F.to_date("ts").alias("day"))
            .agg(F.count(F.lit(1)).alias("n_entries"),
                 F.count(F.when(ok, 1)).alias("n_success"),
                 F.count(F.when(~ok, 1)).alias("n_failed"),
                 F.round(F.count(F.when(ok, 1)) / F.nullif(F.count(ok), F.lit(0)), 4).alias("success_rate")))


@register("p21_clean_corpus", sql=with_(D_CORPUS, D_SPLIT, D_BEST, D_ADAPT, D_MAP, D_QUALIFY) + f"""
SELECT query_id, db_id, dialect, {dt.fix_dbms_names('cot_text', 'dialect')} AS cot_fixed, best_sql,
       {dt.looks_incomplete('best_sql')} AS incomplete, {dt.verb('best_sql')} AS verb, adapted, qualified,
       best_sql <> qualified AS changed
FROM qd""")
def p21_clean_corpus(spark, d):
    q = _qualified(spark, d)
    return q.select("query_id", "db_id", "dialect", "cot_fixed", "best_sql", "incomplete", "verb",
                    "adapted", "qualified", (F.col("best_sql") != F.col("qualified")).alias("changed"))
