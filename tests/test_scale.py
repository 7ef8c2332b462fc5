"""What a job's plan, and a model in a task, may not do as tables grow."""

import json

from pyspark.sql import functions as F

from sqlkiln.operators import catalog as cat
from sqlkiln.operators import profiling as prof
from sqlkiln.operators import retrieval as rt
from sqlkiln.operators import scoring as sc
from sqlkiln.plans import fixtures as fx
from sqlkiln.plans import retrieval as pr

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def query(col, **more):
    return json.dumps({**sc.EMPTY_QUERY, "select": [False, [[0, [0, [0, f"__{col}__", False], None]]]],
                       "from": {"table_units": [["table_unit", "__t__"]], "conds": []}, **more})


def test_scoring_broadcasts_nothing_by_file_size(spark):
    gold = spark.createDataFrame([(i, "db", query("t.a")) for i in range(4)], "example_id long, db_id string, gold_json string")
    pred = spark.createDataFrame([(i, query("t.b" if i % 2 else "t.a")) for i in range(4)], "example_id long, pred_json string")
    kmap = spark.createDataFrame([("db", "__t.b__", "__t.a__")], "db_id string, col string, rep string")
    scored = sc.score_examples(gold, pred, kmap)
    assert "BroadcastHashJoin" not in plan(scored)
    assert {r.example_id: r.exact for r in scored.collect()} == {0: 1, 1: 1, 2: 1, 3: 1}


def test_nested_rows_meet_their_condition_only(spark):
    def cond(inner):
        return [[False, 8, [0, [0, "__t.a__", False], None], json.loads(inner), None], "and", [False, 2, [0, [0, "__t.b__", False], None], 1, None]]
    gold = spark.createDataFrame([(i, "db", query("t.a", where=cond(query("u.x")))) for i in (1, 2, 2)], "example_id long, db_id string, gold_json string")
    pred = spark.createDataFrame([(1, query("t.a", where=cond(query("u.x")))), (2, query("t.a", where=cond(query("u.y"))))], "example_id long, pred_json string")
    rows = sc.row_texts(sc.prepared(sc.query_tree(sc.sides(sc.align(gold, pred))), once=True))
    assert "collect_list(below" not in plan(rows)             # rows without a subquery go through no aggregate
    got = {(r.example_id, r.side, r.clause, r.pos): r.full for r in rows.collect()}
    assert len(got) == rows.count()                           # the repeated example counts once
    assert got[1, "gold", "where", 0] == got[1, "pred", "where", 0] != got[2, "pred", "where", 0]
    assert "u.x" in got[2, "gold", "where", 0] and "\n" not in got[2, "gold", "where", 2]
    scored = sc.score_examples(gold, pred)
    assert sorted((r.example_id, r.exact) for r in scored.collect()) == [(1, 1), (2, 0), (2, 0)]


def test_catalog_joins_broadcast_nothing_by_file_size(spark):
    cons = spark.createDataFrame([("d", "pk", "PRIMARY KEY", "t", None), ("d", "fk", "FOREIGN KEY", "t", "pk")],
                                 "db_id string, constraint_name string, constraint_type string, table_name string, unique_constraint_name string")
    keys = spark.createDataFrame([("d", "pk", "t", "id", 1), ("d", "pk", "t", "k2", 2), ("d", "fk", "t", "up", 1)],
                                 "db_id string, constraint_name string, table_name string, column_name string, key_pos int")
    cols = spark.createDataFrame([("d", "t", i, c, "INTEGER") for i, c in enumerate(["id", "k2", "up", None])],
                                 "db_id string, table_name string, ordinal_position int, column_name string, data_type string")
    tabs = spark.createDataFrame([("d", "t", 0)], "db_id string, table_name string, table_pos int")
    inv, fks = cat.column_inventory(cols, tabs, cons, keys), cat.fk_inventory(cons, keys)
    for df in (inv, fks, cat.existing_fks(fks, inv), cat.fk_canonical_map(fks, inv)):
        assert "BroadcastHashJoin" not in plan(df)
    assert {(r.name, r.pk) for r in inv.collect()} == {("id", True), ("k2", True), ("up", False), (None, False)}
    assert [(r.from_column, r.to_column) for r in fks.collect()] == [("up", "id")]


def test_lake_columns_are_derived_once(spark):
    for df in (fx.lake_constraints(spark, SMALL), fx.lake_key_columns(spark, SMALL)):
        assert not any("lineitem" in f for f in df.inputFiles())


def test_only_asked_databases_are_embedded(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "db_id string, n int")
    questions = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "db_id string")
    assert sorted(r.n for r in pr.asked(rows, questions).collect()) == [1, 2]


def test_models_get_short_runs_of_texts(spark):
    df = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('x', cast(if(id % 1000 = 7, 900000, id % 3) as int)) AS text")
    given = rt.token_len_with(df, "text", tokenizer=lambda ts: [len(ts)] * len(ts)).agg(F.max("n_tokens").alias("m"), F.count("n_tokens").alias("n")).first()
    assert given.m <= rt.SLICE_ROWS and given.n == 3000
    vecs = rt.embed_with(df, "text", encoder=lambda ts: [[len(t), len(ts)] for t in ts], dim=2)
    row = vecs.agg(F.max(F.col("vec")[1]).alias("m"), F.count_if(F.col("vec")[0] == F.length("text")).alias("n")).first()
    assert row.m <= rt.SLICE_ROWS and row.n == 3000


def test_few_candidates_are_shuffled_whole(spark, monkeypatch):
    rows = spark.range(2000).selectExpr("id AS k", "id % 1999 AS one_twice", "id % 500 AS a", "id div 4 % 500 AS b", "id div 500 AS c", "id % 250 AS d")
    whole, part, real = [], [], prof._duplicated

    def watched(tables, cands, share=1):
        (whole if share == 1 else part).append([c for cs in cands.values() for c in cs])
        return real(tables, cands, share)
    monkeypatch.setattr(prof, "_duplicated", watched)
    keys = {r.key_columns for r in prof.key_profile(spark, {"t": rows}, sample_rows=40).collect()}
    values = {c: [tuple(r[x] for x in c.split(",")) for r in rows.collect()] for c in ("k", "one_twice", "a,c", "b,c", "a,b", "one_twice,c", "one_twice,a", "one_twice,b",
                                                                                     "one_twice,d", "a,d", "b,d", "c,d")}
    assert keys == {c for c, v in values.items() if len(set(v)) == len(v)}        # one pair of equal values counts, too
    # the sample, all singles, all pairs: half of (c, d) are duplicates, so that a share of the values shows it
    assert ("k",) in whole[1] and ("c", "d") in part[1] and ("c", "d") not in whole[2]


def test_parsed_queries_are_written_not_kept_in_memory(spark):
    from urllib.parse import urlparse
    import pyarrow.parquet as pq
    from sqlkiln.plans import scoring as ps
    assert "InMemoryTableScan" not in plan(ps.parsed(spark, SMALL)[0])
    q = F.parse_json(F.lit(query("t.a"))).alias("q")
    tree = sc.query_tree(spark.range(3).select(F.col("id").alias("example_id"), F.lit("gold").alias("side"), q))
    files = [urlparse(f).path for f in tree.inputFiles()]
    assert files and not any("typed_value" in str(pq.read_schema(f)) for f in files)       # variants go whole


def test_clause_lists_are_taken_apart_once(spark):
    df = spark.range(1).select(F.parse_json(F.lit(query("t.a"))).alias("q"))
    found = df.select(sc.children(F.col("q"), F.lit("")).alias("k"))
    assert [found._jdf.queryExecution().analyzed().toString().count(p) for p in ("$.where", "$.having", "$.from.conds")] == [1, 1, 1]


def test_lake_tables_are_read_as_written(spark):
    tables = fx.lake_tables(spark, SMALL)
    assert "InMemoryTableScan" not in plan(tables) and tables.count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert "InMemoryTableScan" not in plan(fx.lake_constraints(spark, SMALL))


def test_scores_are_written_with_short_methods(spark, monkeypatch):
    gold = spark.createDataFrame([(1, "db", query("t.a")), (2, "db", query("t.a"))], "example_id long, db_id string, gold_json string")
    pred = spark.createDataFrame([(1, query("t.a")), (2, query("t.b"))], "example_id long, pred_json string")
    before, limits, cut = spark.conf.get("spark.sql.codegen.hugeMethodLimit"), {}, sc.cut_lineage
    monkeypatch.setattr(sc, "cut_lineage", lambda df, tag, conf=None: (limits.update({tag: conf}), cut(df, tag, conf))[1])
    scored = sc.score_examples(gold, pred)
    assert limits["scores"] == {"spark.sql.codegen.hugeMethodLimit": "8000"} and limits["level-0"] is None
    assert "SortAggregate" not in plan(scored)                # the rows of all queries are matched before, not by each reader
    assert {r.example_id: r.exact for r in scored.collect()} == {1: 1, 2: 0}
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before


def test_questions_are_dealt_over_all_tasks(spark):
    questions = spark.createDataFrame([(i, f"db_{i % 40}", [1.0, float(i)]) for i in range(80)], "vec_id int, db_id string, vec array<double>")
    tables = spark.createDataFrame([(f"db_{i}", "t", 0, [0.0, 1.0]) for i in range(40)], "db_id string, table_name string, table_pos int, vec array<double>")
    sims = rt.similarities(questions, tables, ["vec_id"])
    rows = sims.withColumn("task", F.spark_partition_id()).collect()
    assert {r.vec_id: r.sim for r in rows} == {i: float(i) for i in range(80)}
    assert len({r.task for r in rows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    cogroup = plan(sims).split("FlatMapCoGroupsInPandas")[1]
    assert cogroup.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS, [plan_id" not in cogroup.split("REPARTITION_BY_NUM")[0]


def test_parsed_queries_are_dealt_over_all_tasks(spark):
    text = sc.EMPTY_QUERY_JSON
    gold = spark.createDataFrame([(i, "db", text) for i in range(80)], "example_id long, db_id string, gold_json string")
    pred = gold.select("example_id", F.col("gold_json").alias("pred_json"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda df: {r.task for r in df.select(F.spark_partition_id().alias("task")).collect()}
    aligned = sc.align(gold, pred)
    assert aligned.count() == 80 and len(tasks(aligned)) == n
    rows = sc.row_texts(sc.prepared(sc.query_tree(sc.sides(aligned)), once=True))
    assert len(tasks(rows)) == n and "REPARTITION_BY_NUM" in plan(rows)
    assert {r.exact for r in sc.score_examples(gold, pred).collect()} == {1}
