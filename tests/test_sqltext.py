"""String rules on the cases the reference's own unit tests pin down."""

from pyspark.sql import functions as F

from sqlkiln.functions import sqltext as st
from sqlkiln.operators import cleanup as cu


def one(spark, rows, cols, expr):
    df = spark.createDataFrame(rows, cols)
    return [r[0] for r in df.select(expr).collect()]


def test_dialect_transforms(spark):
    cases = [
        ("sqlite", "SELECT 1;", "SELECT 1;"),
        ("postgres", "SELECT `name` FROM users WHERE active=0;", 'SELECT "name" FROM users WHERE active= FALSE;'),
        ("mysql", 'CREATE TABLE t ("id" INTEGER PRIMARY KEY AUTOINCREMENT);',
         "CREATE TABLE t (`id` INTEGER PRIMARY KEY AUTO_INCREMENT);"),
        ("mssql", 'SELECT "name" FROM users LIMIT 5;', "SELECT TOP 5 [name] FROM users;"),
        ("oracle", "SELECT `id` FROM t LIMIT 2;", 'SELECT "id" FROM t FETCH FIRST 2 ROWS ONLY;'),
        ("postgres", "SELECT `id` FROM t LIMIT 1;", 'SELECT "id" FROM t LIMIT 1;'),
        ("mssql", "SELECT * FROM t LIMIT 5;", "SELECT TOP 5 * FROM t;"),
        ("mssql", "SELECT DISTINCT a FROM t LIMIT 3", "SELECT DISTINCT TOP 3 a FROM t"),
        ("mssql", "SELECT TOP 2 a FROM t LIMIT 3;", "SELECT TOP 2 a FROM t;"),
        ("db2", "  SELECT 1;  ", "SELECT 1;"),
    ]
    got = one(spark, [(d, s) for d, s, _ in cases], ["dialect", "sql"],
              st.transform_sql(F.col("sql"), F.col("dialect")))
    assert got == [e for _, _, e in cases]


def test_postgres_bare_equals_default_and_compat(spark):
    rows = [("SELECT a FROM t WHERE n >= 1 AND b = 1",)]
    assert one(spark, rows, ["s"], st.to_postgres(F.col("s"))) == ["SELECT a FROM t WHERE n >= 1 AND b = TRUE"]
    assert one(spark, rows, ["s"], st.to_postgres(F.col("s"), compat=True)) == \
        ["SELECT a FROM t WHERE n >= TRUE AND b = TRUE"]


def test_oracle_now(spark):
    rows = [("SELECT NOW() FROM dual",)]
    assert one(spark, rows, ["s"], st.to_oracle(F.col("s"))) == ["SELECT SYSDATE FROM dual"]
    assert one(spark, rows, ["s"], st.to_oracle(F.col("s"), compat=True)) == ["SELECT NOW() FROM dual"]


def test_schema_qualification(spark):
    corpus = spark.createDataFrame([
        (1, "d1", "mssql", "SELECT TOP 5 Product FROM Products ORDER BY Price DESC;"),
        (2, "d2", "postgres", "SELECT * FROM items JOIN orders ON items.id=orders.item_id;"),
        (3, "d3", "oracle", "SELECT * FROM Products p JOIN Categories c ON p.cat=c.id"),
        (4, "d1", "mssql", "SELECT * FROM products"),
        (5, "d2", "postgres", "SELECT * FROM (SELECT 1) x JOIN shop.items i ON 1=1"),
    ], ["query_id", "db_id", "dialect", "adapted"])
    tables = spark.createDataFrame([
        ("d1", "Products", "Sales"), ("d2", "items", "shop"), ("d2", "orders", "sales"),
        ("d3", "PRODUCTS", "SALES"), ("d3", "CATEGORIES", "HR"), ("d3", "EMP", "SCOTT"),
    ], ["db_id", "table_name", "table_schema"])
    out = cu.qualify_tables(corpus, cu.table_schema_map(tables)).orderBy("query_id")
    assert [r.qualified for r in out.collect()] == [
        "SELECT TOP 5 Product FROM Sales.Products ORDER BY Price DESC;",
        "SELECT * FROM shop.items JOIN sales.orders ON items.id=orders.item_id;",
        "SELECT * FROM SALES.Products p JOIN HR.Categories c ON p.cat=c.id",
        "SELECT * FROM products",
        "SELECT * FROM (SELECT 1) x JOIN shop.items i ON 1=1",
    ]


def test_extract_sql(spark):
    rows = [("", "Some reasoning SELECT name FROM users LIMIT 5; More text"),
            ("SELECT id FROM t;", ""),
            ("", "x ```sql\nSELECT 1 -- c\n-- drop me\nFROM t;\n``` y"),
            ("SELECT a FROM t WHERE b IN (SELECT b FROM u);", "no statement here"),
            ("SELECT 1;<|endoftext|>", "")]
    got = one(spark, rows, ["sql", "cot"], st.extract_sql(F.col("sql"), F.col("cot")))
    assert got == ["SELECT name FROM users LIMIT 5;", "SELECT id FROM t;", "SELECT 1 -- c\nFROM t;",
                   "SELECT a FROM t WHERE b IN (SELECT b FROM u);", "SELECT 1;"]
    compat = one(spark, rows, ["sql", "cot"], st.extract_sql(F.col("sql"), F.col("cot"), compat=True))
    assert compat[3] == ""


def test_split_output(spark):
    rows = [("think hard. sql : SELECT 1;\nSchema: t(a)",), ("no marker at all",)]
    df = spark.createDataFrame(rows, ["raw"])
    cot, sql = st.split_output(F.col("raw"))
    got = [tuple(r) for r in df.select(cot, sql).collect()]
    assert got == [("think hard.", "SELECT 1;"), ("no marker at all", "")]


def test_fix_dbms_names(spark):
    rows = [("Generate an executable SQLite query", "postgres"),
            ("something about SQLITE and mysql", "oracle"),
            ("uses sqlite", "duckdb")]
    got = one(spark, rows, ["cot", "d"], st.fix_dbms_names(F.col("cot"), F.col("d")))
    assert got[0] == "Generate an executable PostgreSQL query"
    assert "Oracle" in got[1] and "SQLITE" not in got[1] and "mysql" not in got[1]
    assert got[2] == "uses Duckdb"


def test_oracle_semicolon(spark):
    assert one(spark, [("SELECT * FROM MY_MEMBERS;",)], ["s"], st.strip_trailing_semicolon(F.col("s"))) == \
        ["SELECT * FROM MY_MEMBERS"]


def test_looks_incomplete(spark):
    rows = [("",), ("SELECT a FROM region",), ("SELECT (a FROM t",), ("SELECT 'a FROM t",),
            ("SELECT a FROM t WHERE",), ("SELECT a,",), ("SELECT a FROM t;",)]
    assert one(spark, rows, ["s"], st.looks_incomplete(F.col("s"))) == [True, False, True, True, True, True, False]
    assert one(spark, rows, ["s"], st.looks_incomplete(F.col("s"), compat=True))[1] is True


def test_classify(spark):
    rows = [("  drop table x",), ("SELECT 1",), ("Insert into t values (1)",)]
    assert one(spark, rows, ["s"], st.statement_verb(F.col("s"))) == ["DROP", None, "INSERT"]
    errs = [("server closed the connection unexpectedly",), ("ERROR: current transaction is aborted",),
            ("relation x does not exist",), ("syntax error",)]
    assert one(spark, errs, ["m"], st.classify_error(F.col("m"))) == \
        ["connection_lost", "aborted_transaction", "missing_table", "other"]
    miss = [("no such column foo",), ("Unknown column 'bar' in 'field list'",), ("column x does not exist",)]
    assert one(spark, miss, ["m"], st.missing_column(F.col("m"))) == ["foo", "bar", None]


def test_portability_report(spark):
    rows = [(1, "mssql", "SELECT a FROM (SELECT a FROM t LIMIT 2) s"),
            (2, "mysql", 'SELECT a FROM t WHERE b = "x"'),
            (3, "oracle", "SELECT a FROM t, u WHERE t.id = u.id"),
            (4, "sqlite", "SELECT 1")]
    df = spark.createDataFrame(rows, "query_id long, dialect string, best_sql string")
    rep = {(r.dialect, r.rule): (r.n_queries, r.n_hits) for r in cu.portability_report(df).collect()}
    assert rep[("mssql", "limit_not_at_end")] == (1, 1)
    assert rep[("mysql", "quoted_literal")] == (1, 1)
    assert rep[("oracle", "comma_from")] == (1, 1)
    assert rep[("sqlite", "limit_not_at_end")] == (0, 0)


def test_suggest_terms_top_k(spark):
    misses = spark.createDataFrame([(1, "d", "prce")], "event_id long, db_id string, token string")
    names = spark.createDataFrame([("d", n) for n in ["orders", "orders.price", "orders.prices", "items", "items.name",
                                                       "items.price_2", "other"]] + [("e", "price")],
                                  "db_id string, name string")
    got = [(r.rank, r.name, r.score) for r in cu.suggest_terms(misses, names, k=3).orderBy("rank").collect()]
    assert [rk for rk, _, _ in got] == [1, 2, 3]
    assert "price" not in [n for _, n, _ in got]             # other databases are never candidates
    scores = [sc for _, _, sc in got]
    assert scores == sorted(scores, reverse=True)
    for (_, n1, s1), (_, n2, s2) in zip(got, got[1:]):
        assert s1 > s2 or n1 < n2                            # ties broken by name
