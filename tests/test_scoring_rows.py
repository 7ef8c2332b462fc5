"""How the component rows of scoring are made: each parsed query once, in code short enough to be compiled."""

import json

from pyspark.sql import functions as F

from sqlkiln.operators import scoring as sc


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def query(col, **more):
    return json.dumps({**sc.EMPTY_QUERY, "select": [False, [[0, [0, [0, f"__{col}__", False], None]]]],
                       "from": {"table_units": [["table_unit", "__t__"]], "conds": []}, **more})


def cond(value, slot=3):
    return [False, 8, [0, [0, "__t.a__", False], None], *([value, None] if slot == 3 else [1, value])]


def texts(spark, golds):
    gold = spark.createDataFrame(list(enumerate(golds)), "example_id long, gold_json string").withColumn("db_id", F.lit("db"))
    kmap = spark.createDataFrame([("db", "__t.b__", "__t.a__")], "db_id string, col string, rep string")
    tree = sc.query_tree(sc.sides(sc.align(gold, gold.select("example_id", F.col("gold_json").alias("pred_json")))))
    return sc.row_texts(sc.prepared(tree, kmap, once=True))


def test_component_rows_are_not_sorted(spark):
    rows = texts(spark, [query("t.b", where=[cond(json.loads(query("u.x")))])])
    above = plan(rows).split("posexplode")[0]
    assert "Sort" not in above and "Join" not in above           # the largest rows of scoring meet nothing else
    got = {(r.side, r.clause): r.full for r in rows.collect()}
    assert "t.a" in got["gold", "select"] and "u.x" in got["gold", "where"]


def test_queries_are_parsed_once(spark):
    gold = spark.createDataFrame([(1, "db", query("t.a")), (2, "db", "{no json"), (3, "db", "[1]")], "example_id long, db_id string, gold_json string")
    pred = spark.createDataFrame([(1, "SELECT 1"), (2, query("t.a"))], "example_id long, pred_json string")
    sides = sc.sides(sc.align(gold, pred))
    assert plan(sides).count("try_parse_json") + plan(sides).count("parseJson") == 2      # gold and prediction
    got = {(r.example_id, r.side): (r.pred_failed, r.outer_columns) for r in sides.collect()}
    assert got == {(1, "gold"): (True, ["__t.a__"]), (1, "pred"): (True, [])}


def test_subqueries_are_found_in_both_slots_and_numbers_read_as_numbers(spark):
    inner = json.loads(query("u.x"))
    odd = query("t.a", where=[cond(inner), "and", cond(inner, 4), "or", cond("select"), "and", cond({"no": "query"})], having=[cond(3000000000)], limit=3)
    rows = texts(spark, [odd]).where("side = 'gold'").collect()
    holds = {r.pos: r.full.count("u.x") for r in rows if r.clause == "where"}
    assert holds == {0: 1, 2: 1, 4: 0, 6: 0}
    one = sc.components(spark.range(1).select(F.lit("gold").alias("side"), F.parse_json(F.lit(
        query("t.a", orderBy=["desc", [[2, [3000000000, "__t.a__", False], [1, "__t.b__", True]]]]))).alias("q"))).where("clause = 'order'").first()
    assert (one.uop, one.a1, one.c1, one.d1, one.a2, one.c2, one.d2, one.word) == (2, None, "__t.a__", False, 1, "__t.b__", True, "desc")


def test_generated_code_of_scores_is_short_enough(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan_ = sc.score_queries(texts(spark, [query("t.b")]))._jdf.queryExecution().executedPlan()
        codes = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan_)
        sizes = [codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sizes and max(sizes) <= 8000, sizes                   # what the JVM still compiles


def test_many_queries_are_dealt_over_more_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(10).withColumnRenamed("id", "example_id")
    assert [sc._dealt(df, q).rdd.getNumPartitions() for q in (0, 1, 9 * n * sc.TASK_QUERIES)] == [n, n, 9 * n]


def test_canonical_columns_are_made_once(spark):
    gold = spark.createDataFrame([(1, "db", query("t.b"))], "example_id long, db_id string, gold_json string")
    kmap = spark.createDataFrame([("db", "__t.b__", "__t.a__")], "db_id string, col string, rep string")
    comp = sc.prepared(sc.query_tree(sc.sides(sc.align(gold, gold.select("example_id", F.col("gold_json").alias("pred_json"))))), kmap)
    rows = comp.where("c1 is not null and clause <> 'from'")
    assert [f for f in plan(rows).splitlines() if "Filter" in f and "element_at" in f] == []       # no filter makes the column anew
    assert {(r.side, r.clause, r.c1, r.c2) for r in rows.collect()} == {(s, "select", "__t.a__", None) for s in ("gold", "pred")}
    assert comp.columns[-2:] == ["q1", "q2"] and "reps" not in comp.columns
