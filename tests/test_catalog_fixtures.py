"""Catalog, schema text and training format on the FIXTURES.md cases."""

from pyspark.sql import functions as F

from sqlkiln.operators import benchmark_schema as bs
from sqlkiln.operators import catalog as cat
from sqlkiln.operators import retrieval as rt
from sqlkiln.operators import training as tr


def f1_catalog(spark):
    tables = spark.createDataFrame([("f1", None, "users", 0, "BASE TABLE"), ("f1", None, "posts", 1, "BASE TABLE")],
                                   "db_id string, table_schema string, table_name string, table_pos long, table_type string")
    columns = spark.createDataFrame([("f1", "users", 0, "id", "INTEGER"), ("f1", "users", 1, "name", "TEXT"),
                                     ("f1", "posts", 0, "id", "INTEGER"), ("f1", "posts", 1, "user_id", "INTEGER"),
                                     ("f1", "posts", 2, "content", "TEXT")],
                                    "db_id string, table_name string, ordinal_position int, column_name string, data_type string")
    cons = spark.createDataFrame([("f1", "pk_users", "PRIMARY KEY", "users", None),
                                  ("f1", "pk_posts", "PRIMARY KEY", "posts", None),
                                  ("f1", "fk_posts", "FOREIGN KEY", "posts", "pk_users")],
                                 "db_id string, constraint_name string, constraint_type string, table_name string, unique_constraint_name string")
    kcs = spark.createDataFrame([("f1", "pk_users", "users", "id", 1), ("f1", "pk_posts", "posts", "id", 1),
                                 ("f1", "fk_posts", "posts", "user_id", 1)],
                                "db_id string, constraint_name string, table_name string, column_name string, key_pos int")
    inv = cat.table_inventory(tables)
    cols = cat.column_inventory(columns, inv, cons, kcs)
    fks = cat.fk_inventory(cons, kcs)
    return inv, cols, fks


def test_f1_catalog_and_linearized_schema(spark):
    inv, cols, fks = f1_catalog(spark)
    got = sorted((r.table_name, r.pos, r.name, r.type, r.pk) for r in cols.collect())
    assert got == sorted([("users", 0, "id", "INTEGER", True), ("users", 1, "name", "TEXT", False),
                          ("posts", 0, "id", "INTEGER", True), ("posts", 1, "user_id", "INTEGER", False),
                          ("posts", 2, "content", "TEXT", False)])
    assert [tuple(r) for r in fks.collect()] == [("f1", "posts", "user_id", "users", "id", 0)]
    text = rt.full_schema_text(cols, fks).first().schema_text
    assert text == ("<SCHEMA> users(<PK> id:INTEGER </PK>, name:TEXT) posts(<PK> id:INTEGER </PK>, "
                    "<FK> user_id:INTEGER </FK>, content:TEXT) </SCHEMA>")


def test_f1_benchmark_schema_round_trip(spark):
    inv, cols, fks = f1_catalog(spark)
    flat, fk = bs.decode_schema(bs.encode_schema(inv, cols, fks))
    assert sorted(tuple(r) for r in flat.collect()) == sorted(
        (r.db_id, r.table_name, r.name, r.type, r.pk) for r in cols.collect())
    assert [tuple(r) for r in fk.collect()] == [("f1", "posts", "user_id", "users", "id")]


def test_f2_composite_pk(spark):
    cols = spark.createDataFrame([("f2", "enrollments", 0, 0, "student_id", "INTEGER", True),
                                  ("f2", "enrollments", 0, 1, "course_id", "INTEGER", True),
                                  ("f2", "enrollments", 0, 2, "enrolled_on", "DATE", False)],
                                 "db_id string, table_name string, table_pos long, pos int, name string, type string, pk boolean")
    r = cat.composite_pk(cols).first()
    assert (r.pk_columns, r.composite_pk) == ("student_id,course_id", True)


def test_f7_training_format(spark):
    df = spark.createDataFrame([("Generate SQL", "List all users", "SELECT * FROM users;")], "i string, n string, o string")
    assert df.select(tr.sft_text(F.col("i"), F.col("n"), F.col("o"))).first()[0] == \
        "Generate SQL\nList all users\n\nSELECT * FROM users;"


def test_normalize_identifier_and_prefix_filter(spark):
    rows = [('"MyTable"', "postgresql"), ("MyTable", "postgresql"), ("MyTable", "oracle"), ("[Col]", "mssql"),
            ("`c`", "mysql"), ("", "oracle"), ("Plain", "mysql")]
    df = spark.createDataFrame(rows, "name string, d string")
    got = [r[0] for r in df.select(cat.normalize_identifier(F.col("name"), F.col("d"))).collect()]
    assert got == ["MyTable", "mytable", "MYTABLE", "Col", "c", "", "Plain"]
    t = spark.createDataFrame([("DEMO_X",), ("MVIEW$_Y",), ("EMP",), ("tmp_a",)], "table_name string")
    assert sorted(r[0] for r in cat.prefix_filter(t).collect()) == ["EMP", "tmp_a"]
    assert sorted(r[0] for r in cat.prefix_filter(t, ["tmp_"]).collect()) == ["DEMO_X", "EMP", "MVIEW$_Y", "tmp_a"]
    assert len(cat.prefix_filter(t, []).collect()) == 4
