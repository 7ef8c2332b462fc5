"""Scoring on hand-built parsed queries (benchmark layout)."""

import json

from pyspark.sql import functions as F

from sqlkiln.operators import scoring as sc


def q(select, tables, where=None, group=None, having=None, order=None, limit=None, intersect=None):
    return json.dumps({"select": select, "from": {"table_units": [["table_unit", t] for t in tables], "conds": []},
                       "where": where or [], "groupBy": group or [], "having": having or [],
                       "orderBy": order or [], "limit": limit, "intersect": intersect, "except": None, "union": None})


STAR = [0, "__all__", False]
COUNT_STAR = q([False, [[3, [0, STAR, None]]]], ["__club__"])
NAME_WHERE = q([False, [[0, [0, [0, "__club.name__", False], None]]]], ["__club__"],
               where=[[False, 2, [0, [0, "__club.name__", False], None], "\"x\"", None]])
TWO_CONDS = q([False, [[0, [0, [0, "__club.name__", False], None]], [1, [0, [0, "__club.id__", False], None]]]],
              ["__club__"], where=[[False, 2, [0, [0, "__club.id__", False], None], 3, None], "or",
                                   [False, 9, [0, [0, "__club.name__", False], None], "\"%a%\"", None]],
              order=["desc", [[0, [0, "__club.id__", False], None]]], limit=1)
NESTED = q([False, [[0, [0, [0, "__club.id__", False], None]]]], ["__club__"],
           intersect=json.loads(NAME_WHERE))


def frame(spark, pairs):
    gold = spark.createDataFrame([(i, "db", g) for i, (g, _) in enumerate(pairs)], "example_id long, db_id string, gold_json string")
    pred = spark.createDataFrame([(i, p) for i, (_, p) in enumerate(pairs) if p is not None], "example_id long, pred_json string")
    return gold, pred


def test_gold_vs_gold_is_perfect(spark):
    gold, pred = frame(spark, [(x, x) for x in (COUNT_STAR, NAME_WHERE, TWO_CONDS, NESTED)])
    s = sc.score_examples(gold, pred)
    assert [r.exact for r in s.orderBy("example_id").collect()] == [1, 1, 1, 1]
    roll = {(r.level, r.type): r for r in sc.score_rollup(s).collect()}
    assert all(r.f1 == 1.0 for (lv, _), r in roll.items() if lv == "all")
    assert roll[("all", "select")]["count"] == 4


def test_hardness_levels(spark):
    gold, pred = frame(spark, [(COUNT_STAR, COUNT_STAR), (NAME_WHERE, NAME_WHERE), (TWO_CONDS, TWO_CONDS),
                               (NESTED, NESTED)])
    s = {r.example_id: r.hardness for r in sc.score_examples(gold, pred).collect()}
    assert s[0] == "easy" and s[1] == "easy"
    assert s[2] == "extra"          # c1 = where + order + limit + or + like = 5
    assert s[3] == "hard"           # one nested query, nothing else


def test_values_are_blinded_and_failures_score_empty(spark):
    other_value = NAME_WHERE.replace('\\"x\\"', '\\"y\\"')
    gold, pred = frame(spark, [(NAME_WHERE, other_value), (NAME_WHERE, "not json"), (COUNT_STAR, None)])
    rows = {r.example_id: r for r in sc.score_examples(gold, pred).collect()}
    assert rows[0].exact == 1                       # literal values do not count
    assert rows[1].pred_failed and rows[1].exact == 0
    assert rows[2].pred_failed and rows[2].exact == 0   # missing prediction, aligned by id
    sel = [p for p in rows[1].partial if p.type == "select"][0]
    assert (sel.pred_total, sel.label_total, sel.f1) == (0, 1, 0)


def test_partial_select_multiset(spark):
    pred_q = q([False, [[0, [0, [0, "__club.name__", False], None]], [0, [0, [0, "__club.name__", False], None]]]],
               ["__club__"])
    gold_q = q([False, [[0, [0, [0, "__club.name__", False], None]], [2, [0, [0, "__club.name__", False], None]]]],
               ["__club__"])
    gold, pred = frame(spark, [(gold_q, pred_q)])
    r = sc.score_examples(gold, pred).first()
    parts = {p.type: p for p in r.partial}
    assert parts["select"].f1 == 0 and parts["select(no AGG)"].f1 == 1


def test_fk_columns_are_canonical_only_in_the_outer_from(spark):
    by_b = q([False, [[0, [0, [0, "__b.a_id__", False], None]]]], ["__b__"])
    by_a = q([False, [[0, [0, [0, "__a.id__", False], None]]]], ["__b__"])
    kmap = spark.createDataFrame([("db", "__b.a_id__", "__a.id__"), ("db", "__c.x__", "__a.id__"), ("other", "__b.a_id__", "__z.z__")],
                                 "db_id string, col string, rep string")
    gold, pred = frame(spark, [(by_b, by_a), (by_a, by_b.replace("__b.a_id__", "__c.x__"))])
    assert [r.exact for r in sc.score_examples(gold, pred, kmap).orderBy("example_id").collect()] == [1, 0]


def test_values_and_distinct_can_be_compared(spark):
    distinct = q([False, [[0, [0, [0, "__club.name__", True], None]]]], ["__club__"])
    plain = distinct.replace("true", "false")
    other_value = NAME_WHERE.replace('\\"x\\"', '\\"y\\"')
    gold, pred = frame(spark, [(NAME_WHERE, other_value), (distinct, plain)])
    exact = lambda **kw: [r.exact for r in sc.score_examples(gold, pred, **kw).orderBy("example_id").collect()]
    assert exact() == [1, 1] and exact(values=True) == [0, 1] and exact(distinct=True) == [1, 0]


def test_set_operations_match_at_any_depth(spark):
    def deep(n, inner):
        return inner if n == 0 else dict(json.loads(NAME_WHERE), intersect=deep(n - 1, inner))
    pairs = []
    for n in (1, 3, 6):
        a, b = json.loads(TWO_CONDS), json.loads(TWO_CONDS)
        b["select"][1].reverse()                        # the order of SELECT does not count, however deep
        pairs.append((json.dumps(deep(n, a)), json.dumps(deep(n, b))))
        b = dict(b, where=[])
        pairs.append((json.dumps(deep(n, a)), json.dumps(deep(n, b))))
    gold, pred = frame(spark, pairs)
    assert [r.exact for r in sc.score_examples(gold, pred).orderBy("example_id").collect()] == [1, 0] * 3


def test_subqueries_in_conditions_are_compared_whole(spark):
    def sub(**change):
        inner = dict(json.loads(NAME_WHERE), **change)
        return q([False, [[0, [0, [0, "__club.id__", False], None]]]], ["__club__"], where=[[False, 8, [0, [0, "__club.id__", False], None], inner, None]])
    gold, pred = frame(spark, [(sub(), sub()), (sub(), sub(limit=3)), (sub(), sub().replace('\\"x\\"', '\\"y\\"')), (sub(), sub(where=[]))])
    assert [r.exact for r in sc.score_examples(gold, pred).orderBy("example_id").collect()] == [1, 0, 1, 0]


def test_bad_gold_is_reported_and_not_scored(spark):
    gold, pred = frame(spark, [("not json", COUNT_STAR), (COUNT_STAR, COUNT_STAR)])
    assert [r.gold_failed for r in sc.align(gold, pred).orderBy("example_id").collect()] == [True, False]
    assert [r.example_id for r in sc.score_examples(gold, pred).collect()] == [1]


def test_report_has_all_blocks_and_levels(spark):
    gold, pred = frame(spark, [(COUNT_STAR, COUNT_STAR), (TWO_CONDS, COUNT_STAR)])
    run = spark.createDataFrame([(0, True)], "example_id long, exec_match boolean")
    rep = {(r.block, r.type): r for r in sc.score_report(sc.score_rollup(sc.score_examples(gold, pred), run)).collect()}
    assert len(rep) == 3 + 3 * len(sc.PARTIAL_TYPES)
    whole = lambda block: [rep[block, ""][lv] for lv in sc.LEVELS]
    assert whole("count") == [1, 0, 0, 1, 2] and whole("exec") == [1, 0, 0, 0, 0.5] and whole("exact") == [1, 0, 0, 0, 0.5]
    assert rep["f1", "select"].medium == 0


def test_execution_match(spark):
    rows = [(1, "gold", "u", 0, "1"), (1, "pred", "u", 0, "1.0"),
            (2, "gold", "u", 0, "1"), (2, "gold", "u", 1, "2"), (2, "pred", "u", 0, "2"), (2, "pred", "u", 1, "1"),
            (3, "gold", "u", 0, None), (3, "pred", "u", 0, None), (4, "gold", "u", 0, None), (4, "pred", "u", 0, "n"),
            (5, "gold", "u", 0, "a"), (6, "gold", "u", 0, "a"), (6, "gold", "u", 1, "a"), (6, "pred", "u", 0, "a")]
    df = spark.createDataFrame(rows, "example_id long, side string, unit_key string, row_no long, value string")
    ran = spark.createDataFrame([(i, i != 8) for i in range(1, 9)], "example_id long, pred_ok boolean")
    ordered = {r.example_id: r.exec_match for r in sc.execution_match(df, executed=ran).collect()}
    unordered = {r.example_id: r.exec_match for r in sc.execution_match(df, ordered=False, executed=ran).collect()}
    same = {1: True, 3: True, 4: False, 5: False, 6: False, 7: True, 8: False}     # 7: two empty results, 8: a failed prediction
    assert ordered == same | {2: False} and unordered == same | {2: True}


def test_execution_match_by_kind(spark):
    cases = [("7", "number", "007", "text", False), ("007", "text", "7", "text", False), ("007", "text", "007", "text", True),
             ("9007199254740993", "number", "9007199254740992", "number", False), ("1", "number", "1.0", "number", True),
             ("-0", "number", "0.0", "number", True), ("1e3", "number", "1000", "number", True), ("+07.00", "number", "7", "number", True),
             ("123456789012345678901234567890", "number", "123456789012345678901234567890.0", "number", True),
             ("0.1", "number", "0.10", "number", True), ("0.1", "number", "0.2", "number", False), (None, "text", None, "number", True),
             (None, "number", "0", "number", False), ("", "text", None, "text", False)]
    rows = [(i, side, "u", 0, v, k) for i, (a, ka, b, kb, _) in enumerate(cases) for side, v, k in (("gold", a, ka), ("pred", b, kb))]
    df = spark.createDataFrame(rows, "example_id int, side string, unit_key string, row_no long, value string, kind string")
    got = {r.example_id: r.exec_match for r in sc.execution_match(df).collect()}
    assert got == {i: c[-1] for i, c in enumerate(cases)}
