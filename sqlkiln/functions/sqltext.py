"""Column expressions over SQL text and model output.

Every function maps Spark Columns to a Column built from JVM-side string and
regex functions, so a corpus of any size is cleaned inside whole-stage
codegen with no Python worker. Patterns use only constructs that Java regex
and RE2 read alike (groups, lazy quantifiers, ``\\b``), which keeps the
DuckDB oracle in ``sqlkiln.plans.cleanup`` line-for-line comparable.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour (stated as text).
# ---------------------------------------------------------------------------
# Display name per DBMS key, used to rewrite DBMS mentions in reasoning text.
DBMS_DISPLAY_NAMES = {
    "sqlite": "SQLite",
    "postgres": "PostgreSQL",
    "postgresql": "PostgreSQL",
    "mysql": "MySQL",
    "mssql": "MSSQL",
    "sqlserver": "MSSQL",
    "oracle": "Oracle",
}
# Words that, at the end of a statement, mark it as cut off.
INCOMPLETE_TAIL_WORDS = ["SELECT", "FROM", "WHERE", "JOIN", "ON", "AND", "OR", "GROUP",
                         "ORDER", "VALUES", "SET", "INSERT", "UPDATE", "DELETE"]
# Leading verbs of statements that change data or schema.
DDL_DML_VERBS = ["DROP", "CREATE", "ALTER", "TRUNCATE", "RENAME", "INSERT", "UPDATE", "DELETE"]
# Error-message fragments meaning the connection is gone, then aborted
# transaction, then missing table (checked in this order, lower-cased text).
CONNECTION_LOST_PATTERNS = [
    "connection already closed",
    "connection is closed",
    "closed unexpectedly",
    "server closed the connection unexpectedly",
    "connection not open",
    "server closed the connection",
    "ssl connection has been closed",
    "ssl syscall error: eof detected",
    "server has gone away",
    "lost connection",
    "not connected",
    "broken pipe",
    "pipe closed",
    "cannot operate on a closed database",
]
ABORTED_TRANSACTION_PATTERNS = ["current transaction is aborted", "infailedsqltransaction"]
MISSING_TABLE_PATTERNS = ["no such table", "does not exist", "undefined table"]
# Dialect aliases accepted by the dispatcher.
DIALECT_ALIASES = {"postgres": "postgres", "postgresql": "postgres", "mysql": "mysql",
                   "mssql": "mssql", "sqlserver": "mssql", "oracle": "oracle", "sqlite": "sqlite"}
# Default schema that needs no qualification, per dialect.
DEFAULT_SCHEMA = {"mssql": "dbo", "postgres": "public"}

# Regex sources shared with the oracle.
RE_SQL_SPLIT = r"(?is)^(.*?)\bSQL\s*:\s*(.*)$"
RE_SCHEMA_ECHO = r"(?is)(Schema:|<SCHEMA>).*$"
RE_FENCED_SQL = r"(?is)```sql\s*(.+?)```"
RE_LAST_STATEMENT = r"(?is)((?:SELECT|INSERT|UPDATE|DELETE).*?;)"
RE_DBMS_NAME = r"(?i)\b(sqlite|postgresql|postgres|mysql|mssql|sqlserver|oracle)\b"
RE_LIMIT_TAIL = r"(?i)\bLIMIT\s+(\d+)\s*(;?)\s*$"
RE_DDL_DML = r"(?i)^\s*(DROP|CREATE|ALTER|TRUNCATE|RENAME|INSERT|UPDATE|DELETE)\b"
RE_QUALIFY = r"(?i)\b(FROM|JOIN)\s+([^\s,;]+)"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Column functions that use an input several times would otherwise copy
    the whole input expression into every use; long rule chains then blow
    past the 64 KB generated-method limit and fall back to interpretation.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (Spark ``trim`` only drops spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def count_sub(c: Column, s: str) -> Column:
    """Occurrences of a literal substring."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))) / len(s)).cast("int")


# -- P1 / P2 -----------------------------------------------------------------
def split_output(raw: Column) -> tuple[Column, Column]:
    """P1+P2: (reasoning, sql) from generated text.

    Split at the first ``SQL:`` (any case); the SQL part is cut at the first
    ``Schema:``/``<SCHEMA>`` echo. No marker -> all reasoning, empty SQL.
    """
    has = raw.rlike(r"(?i)\bSQL\s*:")
    cot = F.when(has, strip(F.regexp_extract(raw, RE_SQL_SPLIT, 1))).otherwise(strip(raw))
    sql = F.when(has, cut_schema_echo(strip(F.regexp_extract(raw, RE_SQL_SPLIT, 2)))).otherwise(F.lit(""))
    return cot, sql


def cut_schema_echo(c: Column) -> Column:
    return strip(F.regexp_replace(c, RE_SCHEMA_ECHO, ""))


# -- P3 ----------------------------------------------------------------------
def sql_needs_fallback(sql: Column) -> Column:
    def rule(cand):
        low = F.lower(cand)
        return ((cand == "") | ~cand.endswith(";") | (count_sub(low, "select") > 1)
                | low.endswith("group by"))
    return let(strip(sql), rule)


def extract_sql(sql: Column, cot: Column, compat: bool = False) -> Column:
    """Pick the SQL statement from the SQL part or, failing that, the reasoning.

    Fallback order: fenced sql block, else the last ``SELECT|INSERT|UPDATE|
    DELETE ... ;`` in the reasoning. With ``compat`` a failed fallback gives
    an empty string (original behaviour, which drops valid nested queries);
    by default the SQL part is kept. Then ``<|endoftext|>``, ``--`` comment
    lines and code fences are removed.
    """
    def pick(cand):
        fenced_last = F.array(F.regexp_extract(cot, RE_FENCED_SQL, 1),
                              F.try_element_at(F.regexp_extract_all(cot, F.lit(RE_LAST_STATEMENT), 1), F.lit(-1)))

        def fallback(fl):
            found = F.when(fl[0] != "", strip(fl[0])).otherwise(fl[1])
            return F.coalesce(found, F.lit("") if compat else cand)
        return F.when(sql_needs_fallback(cand), let(fenced_last, fallback)).otherwise(cand)

    chosen = let(strip(sql), pick)
    no_eot = F.replace(chosen, F.lit("<|endoftext|>"), F.lit(""))
    lines = F.split(no_eot, r"\r\n|\r|\n")
    kept = F.filter(lines, lambda l: ~F.regexp_replace(l, r"^\s+", "").startswith("--"))
    return strip(F.replace(F.array_join(kept, "\n"), F.lit("```"), F.lit("")))


# -- P4 ----------------------------------------------------------------------
def dbms_display_name(dialect: Column) -> Column:
    lut = F.create_map(*[F.lit(x) for kv in DBMS_DISPLAY_NAMES.items() for x in kv])
    low = F.lower(dialect)
    cap = F.concat(F.upper(F.substring(dialect, 1, 1)), F.lower(F.substring(dialect, 2, 1 << 30)))
    return F.coalesce(F.element_at(lut, low), cap)


def fix_dbms_names(cot: Column, dialect: Column) -> Column:
    """Every DBMS name in the reasoning becomes the active DBMS's display name."""
    return F.regexp_replace(cot, F.lit(RE_DBMS_NAME), dbms_display_name(dialect))


# -- P5 ----------------------------------------------------------------------
def looks_incomplete(sql: Column, compat: bool = False) -> Column:
    """P5: heuristic "statement was cut off".

    Blank; more ``(`` than ``)``; odd number of ``'`` or ``"``; ends with a
    clause keyword or a comma. The original tests the keyword with a plain
    suffix check, so ``... FROM region`` counts as cut off (``ON``); by
    default a word boundary is required, ``compat=True`` restores the suffix.
    """
    words = "|".join(INCOMPLETE_TAIL_WORDS)

    def rule(s):
        tail = F.upper(rstrip(F.regexp_replace(s, r";\s*$", "")))
        kw = tail.rlike(f"({words})$") if compat else tail.rlike(rf"\b({words})$")
        return (F.coalesce(s, F.lit("")) == "") | (count_sub(s, "(") > count_sub(s, ")")) \
            | (count_sub(s, "'") % 2 == 1) | (count_sub(s, '"') % 2 == 1) | kw | tail.endswith(",")
    return let(strip(sql), rule)


# -- P6 ----------------------------------------------------------------------
def statement_verb(sql: Column) -> Column:
    """Leading DDL/DML verb (upper case) or NULL for a query."""
    v = F.upper(F.regexp_extract(sql, RE_DDL_DML, 1))
    return F.when(v != "", v)


# -- P7..P11 -----------------------------------------------------------------
def _rx(c: Column, pattern: str, repl: str) -> Column:
    return F.regexp_replace(c, pattern, repl)


def to_postgres(sql: Column, compat: bool = False, bool_columns: list[str] | None = None) -> Column:
    """Backticks -> double quotes, AUTOINCREMENT -> SERIAL, ``= 1/0`` -> TRUE/FALSE.

    The original also rewrites ``>= 1`` and ``<= 0``; by default only a bare
    ``=`` (not part of ``<=``, ``>=``, ``!=``) is rewritten. ``bool_columns``
    restricts that to comparisons of these columns, so ``id = 1`` stays.
    """
    out = strip(sql)
    out = _rx(out, r"`([^`]+)`", r'"$1"')
    out = _rx(out, r"(?i)\bAUTOINCREMENT\b", "SERIAL")
    if bool_columns is not None:
        names = "|".join(re.escape(c) for c in bool_columns)
        for digit, word in (("1", "TRUE"), ("0", "FALSE")):
            out = _rx(out, rf"(?i)\b({names})(\"?)\s*=\s*{digit}\b", f"$1$2 = {word}") if names else out
        return out
    eq = r"=" if compat else r"(?<![<>!])="
    out = _rx(out, eq + r"\s*1\b", "= TRUE")
    out = _rx(out, eq + r"\s*0\b", "= FALSE")
    return out


def to_mysql(sql: Column) -> Column:
    """``"word"`` -> backticks, AUTOINCREMENT -> AUTO_INCREMENT, CURRENT_TIMESTAMP(n) -> ()."""
    out = strip(sql)
    out = _rx(out, r'"([A-Za-z0-9_]+)"', r"`$1`")
    out = _rx(out, r"(?i)\bAUTOINCREMENT\b", "AUTO_INCREMENT")
    out = _rx(out, r"(?i)CURRENT_TIMESTAMP\s*\([^\)]*\)", "CURRENT_TIMESTAMP()")
    return out


def _limit_parts(out: Column):
    # ``out`` is a lambda variable here (see ``let``), so using it four times is free.
    has = out.rlike(RE_LIMIT_TAIL)
    n = F.regexp_extract(out, RE_LIMIT_TAIL, 1)
    semi = F.regexp_extract(out, RE_LIMIT_TAIL, 2)
    body = F.regexp_replace(out, RE_LIMIT_TAIL, "")
    return has, n, semi, body


def to_mssql(sql: Column) -> Column:
    """Quoting to ``[x]``, booleans to 1/0, DATETIME2, INT PRIMARY KEY,
    IDENTITY(1,1), and a trailing ``LIMIT n`` to ``TOP n`` after the first
    SELECT (or SELECT DISTINCT) unless a TOP is already present."""
    out = strip(sql)
    out = _rx(out, r"`([^`]+)`", "[$1]")
    out = _rx(out, r'"([A-Za-z0-9_]+)"', "[$1]")
    out = _rx(out, r"(?i)\bTRUE\b", "1")
    out = _rx(out, r"(?i)\bFALSE\b", "0")
    out = _rx(out, r"(?i)\bDATETIME\b", "DATETIME2")
    out = _rx(out, r"(?i)\bTIMESTAMP\b", "DATETIME2")
    out = _rx(out, r"(?i)\bINTEGER\s+PRIMARY\s+KEY\b", "INT PRIMARY KEY")
    out = _rx(out, r"(?i)\b(AUTOINCREMENT|AUTO_INCREMENT|SERIAL)\b", "IDENTITY(1,1)")

    def limit_to_top(o):
        has, n, semi, body = _limit_parts(o)

        def top(b):
            distinct = F.regexp_replace(b, F.lit(r"(?is)^(.*?)SELECT\s+DISTINCT"),
                                        F.concat(F.lit("$1SELECT DISTINCT TOP "), n))
            plain = F.regexp_replace(b, F.lit(r"(?is)^(.*?)SELECT"), F.concat(F.lit("$1SELECT TOP "), n))
            return (F.when(b.rlike(r"(?i)\bTOP\s+\d+"), b)
                    .when(b.rlike(r"(?i)SELECT\s+DISTINCT"), distinct)
                    .otherwise(plain))
        return F.when(has, F.concat(rstrip(let(body, top)), semi)).otherwise(o)

    return strip(_rx(let(out, limit_to_top), r"\s+;", ";"))


def to_oracle(sql: Column, compat: bool = False) -> Column:
    """P10: quoting to ``"x"``, identity, booleans to 1/0, NOW() -> SYSDATE,
    trailing ``LIMIT n`` -> ``FETCH FIRST n ROWS ONLY``.

    The original pattern ``\\bNOW\\(\\)\\b`` only fires before a word
    character; the default drops the trailing boundary, ``compat`` keeps it.
    """
    out = strip(sql)
    out = _rx(out, r"`([^`]+)`", r'"$1"')
    out = _rx(out, r"\[([^\]]+)\]", r'"$1"')
    out = _rx(out, r"(?i)\b(AUTOINCREMENT|AUTO_INCREMENT|SERIAL|IDENTITY\(1,1\))\b",
              "GENERATED BY DEFAULT AS IDENTITY")
    out = _rx(out, r"(?i)\bTRUE\b", "1")
    out = _rx(out, r"(?i)\bFALSE\b", "0")
    out = _rx(out, r"(?i)\bNOW\(\)\b" if compat else r"(?i)\bNOW\(\)", "SYSDATE")

    def limit_to_fetch(o):
        has, n, semi, body = _limit_parts(o)
        return F.when(has, F.concat(rstrip(body), F.lit(" FETCH FIRST "), n, F.lit(" ROWS ONLY"), semi)).otherwise(o)

    return strip(_rx(let(out, limit_to_fetch), r"\s+;", ";"))


def canonical_dialect(dialect: Column) -> Column:
    lut = F.create_map(*[F.lit(x) for kv in DIALECT_ALIASES.items() for x in kv])
    return F.element_at(lut, F.lower(dialect))


def transform_sql(sql: Column, dialect: Column, compat: bool = False) -> Column:
    """Dialect dispatch. Unknown dialects and sqlite are only trimmed; for
    the others one trailing ``;`` is split off, the rules run, and it is put back."""
    d = canonical_dialect(dialect)

    def run(base0):
        semi = F.when(base0.endswith(";"), F.lit(";")).otherwise(F.lit(""))

        def rules(base):
            return (F.when(d == "postgres", to_postgres(base, compat))
                    .when(d == "mysql", to_mysql(base))
                    .when(d == "mssql", to_mssql(base))
                    .when(d == "oracle", to_oracle(base, compat)))
        out = let(F.regexp_replace(base0, r";$", ""), rules)
        return F.concat(rstrip(out), semi)

    return F.when(d.isNull() | (d == "sqlite"), strip(sql)).otherwise(let(rstrip(sql), run))


def strip_trailing_semicolon(sql: Column) -> Column:
    """Oracle refuses a trailing ``;``."""
    return F.regexp_replace(rstrip(sql), r";+$", "")


# -- P16 / P17 ---------------------------------------------------------------
def classify_error(msg: Column) -> Column:
    """connection_lost / aborted_transaction / missing_table / other."""
    low = F.lower(msg)

    def any_of(pats):
        cond = F.lit(False)
        for p in pats:
            cond = cond | low.contains(p)
        return cond

    return (F.when(any_of(CONNECTION_LOST_PATTERNS), "connection_lost")
            .when(any_of(ABORTED_TRANSACTION_PATTERNS), "aborted_transaction")
            .when(any_of(MISSING_TABLE_PATTERNS), "missing_table")
            .otherwise("other"))


# Fixed value: the identifier after a missing-column phrase, as the original reads it.
RE_MISSING_COLUMN = r"(?i)(?:no such column|Unknown column|column\s+)(?:\s|')(\w+)"


def missing_column(msg: Column) -> Column:
    """The identifier named by a missing-column error, NULL when none."""
    v = F.regexp_extract(msg, RE_MISSING_COLUMN, 1)
    return F.when(v != "", v)
