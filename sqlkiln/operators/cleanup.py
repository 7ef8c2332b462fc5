"""DataFrame-level clean-up jobs over a corpus of generated SQL (P12-P14,
P18-P21). Row-local rules live in ``sqlkiln.functions.sqltext``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sqltext as st
from ..session import cut_lineage

# P12 rules: constructs the dialect rules leave untouched.
PORTABILITY_RULES = {
    # LIMIT that is not the statement's tail, or with OFFSET: TOP/FETCH rewrite misses it.
    "limit_not_at_end": r"(?i)\bLIMIT\s+\d+\s*(,|\bOFFSET\b|\)|\s+\w)",
    # "word" compared as a literal in SQLite becomes an identifier under mysql/mssql.
    "quoted_literal": r"(?i)(=|<>|!=|\bIN\s*\(|\bLIKE)\s*\"[A-Za-z0-9_]+\"",
    # FROM a, b: qualification only reaches the first table.
    "comma_from": r"(?i)\bFROM\s+[^\s,;()]+(\s+[A-Za-z_]\w*)?\s*,",
}


def clean_outputs(corpus: DataFrame, compat: bool = False) -> DataFrame:
    """One row in, one row out, all native expressions."""
    cot, sql = st.split_output(F.col("raw_output"))
    df = corpus.withColumn("cot_text", cot).withColumn("sql_text", sql)
    best = st.extract_sql(F.col("sql_text"), F.col("cot_text"), compat)
    return (df.withColumn("best_sql", best)
            .withColumn("cot_fixed", st.fix_dbms_names(F.col("cot_text"), F.col("dialect")))
            .withColumn("incomplete", st.looks_incomplete(F.col("best_sql"), compat))
            .withColumn("verb", st.statement_verb(F.col("best_sql")))
            .withColumn("adapted", F.when(F.col("best_sql") != "",
                                          st.transform_sql(F.col("best_sql"), F.col("dialect"), compat))
                        .otherwise(F.lit(""))))


def portability_report(df: DataFrame, sql_col: str = "best_sql") -> DataFrame:
    """Per (dialect, rule) number of queries hit and total hits."""
    hits = F.array(*[F.struct(F.lit(r).alias("rule"), F.regexp_count(F.col(sql_col), F.lit(p)).alias("n"))
                     for r, p in PORTABILITY_RULES.items()])
    long = df.select(st.canonical_dialect(F.col("dialect")).alias("dialect_key"), F.inline(hits))
    return (long.groupBy(F.coalesce("dialect_key", F.lit("other")).alias("dialect"), "rule")
            .agg(F.sum((F.col("n") > 0).cast("long")).alias("n_queries"),
                 F.sum(F.col("n").cast("long")).alias("n_hits")))


def table_schema_map(tables: DataFrame) -> DataFrame:
    """C14 in the form P13 joins on: one row per (db, lookup kind, key).

    SQL Server looks names up as written, Postgres lower-cased, Oracle
    upper-cased; the three spellings are laid out so the lookup is an
    equi-join and never a per-row scan of the map.
    """
    kinds = F.array(F.struct(F.lit("mssql").alias("kind"), F.col("table_name").alias("key")),
                    F.struct(F.lit("postgres").alias("kind"), F.lower("table_name").alias("key")),
                    F.struct(F.lit("oracle").alias("kind"), F.upper("table_name").alias("key")))
    return (tables.select("db_id", "table_schema", F.inline(kinds))
            .groupBy("db_id", "kind", "key").agg(F.max("table_schema").alias("table_schema")))


def qualify_tables(df: DataFrame, schema_map: DataFrame, sql_col: str = "adapted",
                   key: str = "query_id", oracle_default: str = "") -> DataFrame:
    """Prefix unqualified tables after FROM/JOIN with their schema.

    Tokens are exploded (bounded by the statement length), looked up with an
    equi-join on (db_id, kind, key), gathered into one small map per
    statement and applied in a single pass over the text (JVM-side).
    ``oracle_default`` is the connected user's schema; without one every Oracle
    table is qualified. Returns ``df`` with column ``qualified``.
    """
    # The statements feed both the token lookup and the final join: materialise
    # them once instead of running the whole clean-up chain twice.
    df = cut_lineage(df)
    kind = st.canonical_dialect(F.col("dialect"))
    toks = (df.select(key, "db_id", kind.alias("kind"),
                      F.explode(F.regexp_extract_all(F.col(sql_col), F.lit(st.RE_QUALIFY), 2)).alias("tok"))
            .where(F.col("kind").isin("mssql", "postgres", "oracle")))
    base = F.regexp_replace(F.regexp_replace(F.col("tok"), r"^\[(.*)\]$", "$1"), r'^"(.*)"$', "$1")
    toks = (toks.withColumn("base", base)
            .where(~F.col("base").contains(".") & ~F.col("base").startswith("("))
            .withColumn("key", F.when(F.col("kind") == "postgres", F.lower("base"))
                        .when(F.col("kind") == "oracle", F.upper("base")).otherwise(F.col("base")))
            .distinct())
    default = (F.when(F.col("kind") == "mssql", F.lit("dbo"))
               .when(F.col("kind") == "postgres", F.lit("public")).otherwise(F.lit(oracle_default)))
    hits = (toks.join(schema_map, ["db_id", "kind", "key"])
            .where(F.lower("table_schema") != F.lower(default))
            .groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("tok", "table_schema"))).alias("rewrites")))
    out = df.join(hits, key, "left")
    return out.withColumn("qualified", _apply_rewrites(F.col(sql_col), F.col("rewrites"))).drop("rewrites")


def _apply_rewrites(sql, rewrites):
    """Rewrite ``FROM|JOIN <tok>`` to ``<clause> <schema>.<tok>`` for tokens in
    the per-statement map. The text is split in front of every FROM/JOIN, so
    each piece starts with at most one candidate; all patterns are literals
    (compiled once), none is built per row."""
    head = r"(?is)^((?:FROM|JOIN))\s+([^\s,;]+)"

    def piece(seg):
        parts = F.array(F.regexp_extract(seg, head, 1), F.regexp_extract(seg, head, 2),
                        F.regexp_replace(seg, head, ""))

        def rebuild(p):
            schema = F.element_at(rewrites, p[1])
            return F.when((p[1] != "") & schema.isNotNull(),
                          F.concat(p[0], F.lit(" "), schema, F.lit("."), p[1], p[2])).otherwise(seg)
        return st.let(parts, rebuild)

    segs = F.split(sql, r"(?i)(?=\b(?:FROM|JOIN)\s)")
    return F.when(rewrites.isNull(), sql).otherwise(F.array_join(F.transform(segs, piece), ""))


def adapted_report(df: DataFrame) -> DataFrame:
    """How many statements the rewrite changed, as "SQLite -> target"."""
    target = st.dbms_display_name(F.col("dialect"))
    return (df.where(F.col("best_sql") != "")
            .select(F.concat(F.lit("SQLite -> "), target).alias("adaptation"),
                    (F.col("best_sql") != F.col("qualified")).alias("changed"))
            .groupBy("adaptation", "changed").agg(F.count(F.lit(1)).alias("n")))


def catalog_names(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """All ``table`` and ``table.column`` names per database."""
    t = tables.select("db_id", F.col("table_name").alias("name"))
    c = columns.select("db_id", F.concat_ws(".", "table_name", "column_name").alias("name"))
    return t.unionByName(c)


def suggest_terms(misses: DataFrame, names: DataFrame, k: int = 5) -> DataFrame:
    """The k catalog names closest to each unknown token of its database.

    Score = 1 - levenshtein / longer length (case-blind); ties by name. The
    candidate set is the token's own database, joined on ``db_id``; top-k
    per token uses a window whose ``row_number() <= k`` filter Spark turns
    into a map-side group limit.
    """
    # Every unknown token is scored once per database, however often it occurs.
    j = misses.select("db_id", "token").distinct().join(names, "db_id")
    a, b = F.lower("token"), F.lower("name")
    score = F.round(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)), 4)
    w = Window.partitionBy("db_id", "token").orderBy(F.desc("score"), "name")
    best = j.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return misses.join(best, ["db_id", "token"]).select("event_id", "token", "rank", "name", "score")


def history_last_n(log: DataFrame, n: int = 10, session: str = "user_id", ts: str = "ts",
                   tie: str = "event_id") -> DataFrame:
    """Last n entries per session, renumbered 1..n oldest first."""
    w_desc = Window.partitionBy(session).orderBy(F.desc(ts), F.desc(tie))
    w_asc = Window.partitionBy(session).orderBy(ts, tie)
    last = log.withColumn("_rd", F.row_number().over(w_desc)).where(F.col("_rd") <= n)
    return last.withColumn("n", F.row_number().over(w_asc)).drop("_rd")


def history_labels(log: DataFrame) -> DataFrame:
    """P20: label text per entry: user-written, edited, success / failed."""
    lab = F.concat(
        F.when(F.col("user_written"), F.lit(" (user-written)")).otherwise(F.lit("")),
        F.when(F.col("edited"), F.lit(" (edited)")).otherwise(F.lit("")),
        F.when(F.col("execution_status"), F.lit(" (success)"))
        .when(~F.col("execution_status"), F.lit(" (failed)")).otherwise(F.lit("")))
    return log.withColumn("label", lab)
