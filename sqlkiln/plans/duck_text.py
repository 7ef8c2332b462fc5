"""DuckDB spellings of the text rules, used only to build oracle SQL.

The rules are written anew for DuckDB, but their patterns and word lists are the
fixed values of ``functions.sqltext``, so a wrong pattern would be wrong on both
sides; ``tests/test_sqltext.py`` holds the rules against rows worked out by hand. RE2 replacement syntax
(``\\1``), the ``'g'`` flag and DuckDB lambdas differ from Java/Spark.
"""

from __future__ import annotations

from ..functions import sqltext as st


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x): return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
def rstrip(x): return f"regexp_replace({x}, '\\s+$', '')"
def count_sub(x, s): return f"CAST((length({x}) - length(replace({x}, {q(s)}, ''))) / {len(s)} AS INTEGER)"


def has_sql(raw): return f"regexp_matches({raw}, '(?i)\\bSQL\\s*:')"


def cot_text(raw):
    return f"CASE WHEN {has_sql(raw)} THEN {strip(f'regexp_extract({raw}, {q(st.RE_SQL_SPLIT)}, 1)')} ELSE {strip(raw)} END"


def sql_part(raw):
    return strip(f"regexp_extract({raw}, {q(st.RE_SQL_SPLIT)}, 2)")


def sql_text(raw):
    cut = strip(f"regexp_replace({sql_part(raw)}, {q(st.RE_SCHEMA_ECHO)}, '')")
    return f"CASE WHEN {has_sql(raw)} THEN {cut} ELSE '' END"


def extract_sql(sql, cot, compat=False):
    cand = strip(sql)
    low = f"lower({cand})"
    needs = f"({cand} = '' OR NOT ends_with({cand}, ';') OR {count_sub(low, 'select')} > 1 OR ends_with({low}, 'group by'))"
    fenced = f"regexp_extract({cot}, {q(st.RE_FENCED_SQL)}, 1)"
    stmts = f"regexp_extract_all({cot}, {q(st.RE_LAST_STATEMENT)}, 1)"
    last = f"CASE WHEN len({stmts}) > 0 THEN {stmts}[-1] END"
    found = f"CASE WHEN {fenced} <> '' THEN {strip(fenced)} ELSE {last} END"
    fallback = f"coalesce({found}, {q('') if compat else cand})"
    chosen = f"CASE WHEN {needs} THEN {fallback} ELSE {cand} END"
    no_eot = f"replace({chosen}, '<|endoftext|>', '')"
    lines = f"string_split_regex({no_eot}, '\\r\\n|\\r|\\n')"
    kept = f"list_filter({lines}, lambda l: NOT starts_with(regexp_replace(l, '^\\s+', ''), '--'))"
    return strip(f"replace(array_to_string({kept}, chr(10)), '```', '')")


def display_name(d):
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in st.DBMS_DISPLAY_NAMES.items())
    return f"CASE lower({d}) {cases} ELSE upper(substr({d}, 1, 1)) || lower(substr({d}, 2)) END"


def fix_dbms_names(cot, d):
    return f"regexp_replace({cot}, {q(st.RE_DBMS_NAME)}, {display_name(d)}, 'g')"


def looks_incomplete(sql, compat=False):
    s = strip(sql)
    tail = "upper(" + rstrip(f"regexp_replace({s}, ';\\s*$', '')") + ")"
    words = "|".join(st.INCOMPLETE_TAIL_WORDS)
    kw = f"regexp_matches({tail}, '({words})$')" if compat else f"regexp_matches({tail}, '\\b({words})$')"
    return (f"(coalesce({s}, '') = '' OR {count_sub(s, '(')} > {count_sub(s, ')')} "
            f"OR {count_sub(s, "'")} % 2 = 1 OR {count_sub(s, '"')} % 2 = 1 OR {kw} "
            f"OR ends_with({tail}, ','))")


def verb(sql):
    v = f"upper(regexp_extract({sql}, {q(st.RE_DDL_DML)}, 1))"
    return f"CASE WHEN {v} <> '' THEN {v} END"


def rx(x, p, r, g=True):
    return f"regexp_replace({x}, {q(p)}, {q(r)}{', ' + q('g') if g else ''})"


def to_postgres(sql, compat=False):
    out = strip(sql)
    out = rx(out, r"`([^`]+)`", r'"\1"')
    out = rx(out, r"(?i)\bAUTOINCREMENT\b", "SERIAL")
    if compat:
        out = rx(out, r"=\s*1\b", "= TRUE")
        out = rx(out, r"=\s*0\b", "= FALSE")
    else:
        out = rx(out, r"(^|[^<>!])=\s*1\b", r"\1= TRUE")
        out = rx(out, r"(^|[^<>!])=\s*0\b", r"\1= FALSE")
    return out


def to_mysql(sql):
    out = strip(sql)
    out = rx(out, r'"([A-Za-z0-9_]+)"', r"`\1`")
    out = rx(out, r"(?i)\bAUTOINCREMENT\b", "AUTO_INCREMENT")
    out = rx(out, r"(?i)CURRENT_TIMESTAMP\s*\([^\)]*\)", "CURRENT_TIMESTAMP()")
    return out


def _limit(out):
    has = f"regexp_matches({out}, {q(st.RE_LIMIT_TAIL)})"
    n = f"regexp_extract({out}, {q(st.RE_LIMIT_TAIL)}, 1)"
    semi = f"regexp_extract({out}, {q(st.RE_LIMIT_TAIL)}, 2)"
    body = f"regexp_replace({out}, {q(st.RE_LIMIT_TAIL)}, '')"
    return has, n, semi, body


def to_mssql(sql):
    out = strip(sql)
    out = rx(out, r"`([^`]+)`", r"[\1]")
    out = rx(out, r'"([A-Za-z0-9_]+)"', r"[\1]")
    out = rx(out, r"(?i)\bTRUE\b", "1")
    out = rx(out, r"(?i)\bFALSE\b", "0")
    out = rx(out, r"(?i)\bDATETIME\b", "DATETIME2")
    out = rx(out, r"(?i)\bTIMESTAMP\b", "DATETIME2")
    out = rx(out, r"(?i)\bINTEGER\s+PRIMARY\s+KEY\b", "INT PRIMARY KEY")
    out = rx(out, r"(?i)\b(AUTOINCREMENT|AUTO_INCREMENT|SERIAL)\b", "IDENTITY(1,1)")
    has, n, semi, body = _limit(out)
    distinct = f"regexp_replace({body}, '(?is)^(.*?)SELECT\\s+DISTINCT', '\\1SELECT DISTINCT TOP ' || {n})"
    plain = f"regexp_replace({body}, '(?is)^(.*?)SELECT', '\\1SELECT TOP ' || {n})"
    topped = (f"CASE WHEN regexp_matches({body}, '(?i)\\bTOP\\s+\\d+') THEN {body} "
              f"WHEN regexp_matches({body}, '(?i)SELECT\\s+DISTINCT') THEN {distinct} ELSE {plain} END")
    out = f"CASE WHEN {has} THEN {rstrip(topped)} || {semi} ELSE {out} END"
    return strip(rx(out, r"\s+;", ";"))


def to_oracle(sql, compat=False):
    out = strip(sql)
    out = rx(out, r"`([^`]+)`", r'"\1"')
    out = rx(out, r"\[([^\]]+)\]", r'"\1"')
    out = rx(out, r"(?i)\b(AUTOINCREMENT|AUTO_INCREMENT|SERIAL|IDENTITY\(1,1\))\b", "GENERATED BY DEFAULT AS IDENTITY")
    out = rx(out, r"(?i)\bTRUE\b", "1")
    out = rx(out, r"(?i)\bFALSE\b", "0")
    out = rx(out, r"(?i)\bNOW\(\)\b" if compat else r"(?i)\bNOW\(\)", "SYSDATE")
    has, n, semi, body = _limit(out)
    out = f"CASE WHEN {has} THEN {rstrip(body)} || ' FETCH FIRST ' || {n} || ' ROWS ONLY' || {semi} ELSE {out} END"
    return strip(rx(out, r"\s+;", ";"))


def canonical_dialect(d):
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in st.DIALECT_ALIASES.items())
    return f"CASE lower({d}) {cases} END"


def transform_sql(sql, d, compat=False):
    k = canonical_dialect(d)
    base0 = rstrip(sql)
    semi = f"CASE WHEN ends_with({base0}, ';') THEN ';' ELSE '' END"
    base = f"regexp_replace({base0}, ';$', '')"
    out = (f"CASE {k} WHEN 'postgres' THEN {to_postgres(base, compat)} WHEN 'mysql' THEN {to_mysql(base)} "
           f"WHEN 'mssql' THEN {to_mssql(base)} WHEN 'oracle' THEN {to_oracle(base, compat)} END")
    return f"CASE WHEN {k} IS NULL OR {k} = 'sqlite' THEN {strip(sql)} ELSE {rstrip(out)} || {semi} END"


def classify_error(msg):
    low = f"lower({msg})"
    def any_of(ps): return "(" + " OR ".join(f"contains({low}, {q(p)})" for p in ps) + ")"
    return (f"CASE WHEN {any_of(st.CONNECTION_LOST_PATTERNS)} THEN 'connection_lost' "
            f"WHEN {any_of(st.ABORTED_TRANSACTION_PATTERNS)} THEN 'aborted_transaction' "
            f"WHEN {any_of(st.MISSING_TABLE_PATTERNS)} THEN 'missing_table' ELSE 'other' END")


def missing_column(msg):
    v = f"regexp_extract({msg}, {q(st.RE_MISSING_COLUMN)}, 1)"
    return f"CASE WHEN {v} <> '' THEN {v} END"
