"""Benchmark scoring of predicted against gold parsed queries.

Parsed queries arrive as JSON text in the public benchmark's nested layout.
They are taken apart into one *component table* (E1): a row per select item,
table, condition, connector, group / order unit, limit and set operation of the
query and of every query nested in it, found level by level until none is left.
Everything else reads that table: values and DISTINCT are blinded by leaving
columns out (E3, E4), columns are made canonical by a join to the foreign-key
map on ``(db_id, column)`` (E5). The matchers (E6-E15) count what each side says
per example, query and component; equal counts match. Whether a set operation's
branch matches at any depth is whether all rows of its subtree do, so no depth
is special; the same holds for a subquery in a condition, whose identity is the
list of its subtree's rows.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import SHORT_METHODS, by_shuffle, cut_lineage

# Operator code lists of the parsed-query format (ordinals matter).
WHERE_OPS = ["not", "between", "=", ">", "<", ">=", "<=", "!=", "in", "like", "is", "exists"]
UNIT_OPS = ["none", "-", "+", "*", "/"]
AGG_OPS = ["none", "max", "min", "count", "sum", "avg"]
COND_OPS = ["and", "or"]
SQL_OPS = ["intersect", "union", "except"]
ORDER_OPS = ["desc", "asc"]
PARTIAL_TYPES = ["select", "select(no AGG)", "where", "where(no OP)", "group(no Having)", "group", "order",
                 "and/or", "IUEN", "keywords"]
LEVELS = ["easy", "medium", "hard", "extra", "all"]

EMPTY_QUERY = {"select": [False, []], "from": {"table_units": [], "conds": []}, "where": [], "groupBy": [],
               "having": [], "orderBy": [], "limit": None, "intersect": None, "except": None, "union": None}
EMPTY_QUERY_JSON = json.dumps(EMPTY_QUERY, separators=(",", ":"))

COND_LISTS = (("join", "$.from.conds"), ("where", "$.where"), ("having", "$.having"))


# ---------------------------------------------------------------------------
# VARIANT access. A path that is not there costs an exception inside Spark, and a cast of a whole
# number to int a Cast object; so paths that often miss are asked of the value itself (``$``, with
# the type in question), and numbers are read as long.
# ---------------------------------------------------------------------------
def _get(v: Column, path: str, kind: str) -> Column:
    if kind == "int":
        return F.try_variant_get(v, path, "long").try_cast("int")
    return F.try_variant_get(v, path, kind)


def _arr(q: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(q, path, "array<variant>"), F.array().cast("array<variant>"))


def _is_null(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def _is_query(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<`select`:variant>")["select"].isNotNull()


# The clauses of a query, read in one pass.
_CLAUSES = ("struct<`from`:struct<table_units:array<variant>,conds:array<variant>>,`where`:array<variant>,groupBy:array<variant>,"
            "`having`:array<variant>,orderBy:array<variant>,`limit`:variant,`intersect`:variant,`union`:variant,`except`:variant>")


def _even(a: Column) -> Column:
    return F.filter(a, lambda x, i: i % 2 == 0)


def _odd(a: Column) -> Column:
    return F.filter(a, lambda x, i: i % 2 == 1)


def _sub(q: Column, key: str) -> Column:
    return F.try_variant_get(q, f"$.{key}", "variant")


# ---------------------------------------------------------------------------
# Alignment and failures
# ---------------------------------------------------------------------------
def _query(text: str) -> Column:
    """The parsed query in column ``text``, null if it is none."""
    return F.when(F.col(text).startswith("{"), F.try_parse_json(text))


TASK_QUERIES = 50_000      # parsed queries that a task of scoring takes at most, so that what it counts stays in memory


def _dealt(df: DataFrame, queries: int = 0) -> DataFrame:
    """``df`` dealt by ``example_id`` over the session's tasks, or more for many ``queries``. Parsed queries are
    few bytes for the work they make: merged by bytes, they would be in hardly more tasks than there are cores."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-queries // TASK_QUERIES)), "example_id")


def align(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """E21 + E20: gold rows joined to predictions by id (never by position).

    ``pred_failed``: missing or unparsable, scored as the empty query.
    ``gold_failed``: an unparsable gold query; it is reported and not scored.
    ``gold_q`` / ``pred_q``: the queries, parsed here once.
    """
    j = _dealt(gold).join(by_shuffle(_dealt(pred.select("example_id", "pred_json"))), "example_id", "left")
    j = j.withColumns({"gold_q": _query("gold_json"), "pred_q": _query("pred_json")})
    return j.withColumns({"pred_failed": F.col("pred_q").isNull(), "gold_failed": F.col("gold_q").isNull()})


def sides(aligned: DataFrame) -> DataFrame:
    """``(example_id, db_id, pred_failed, side, outer_columns, q)``: both parsed queries of
    each scorable example, and the columns they name of the tables in their FROM."""
    pred = F.when(F.col("pred_failed"), F.lit(EMPTY_QUERY_JSON)).otherwise(F.col("pred_json"))
    empty = F.parse_json(F.lit(EMPTY_QUERY_JSON))
    two = F.array(F.struct(F.lit("gold").alias("side"), F.col("gold_json").alias("j"), F.col("gold_q").alias("q")),
                  F.struct(F.lit("pred").alias("side"), pred.alias("j"), F.coalesce("pred_q", empty).alias("q")))
    names = F.array_distinct(F.regexp_extract_all("j", F.lit(r'"(__[^".]+\.[^"]+__)"'), 1))
    units = F.coalesce(F.try_variant_get("q", "$.from.table_units", "array<array<string>>"), F.array().cast("array<array<string>>"))
    tables = F.transform(F.filter(units, lambda u: F.get(u, 0) == "table_unit"), lambda u: F.regexp_replace(F.get(u, 1), "__$", ""))
    named = F.filter("names", lambda c: F.array_contains(F.col("tables"), F.split_part(c, F.lit("."), F.lit(1))))
    keys = ["example_id", "db_id", "pred_failed"]
    # an array of none for a bad gold query: a filter would parse it once more
    return (aligned.select(*keys, F.inline(F.when(~F.col("gold_failed"), two)))
            .select(*keys, "side", "q", names.alias("names"), tables.alias("tables"))
            # asked for twice, ``tables`` is a column; asked for once, it would be made again for each name
            .select(*keys, "side", "q", F.when(F.size("tables") > 0, named).otherwise(F.array().cast("array<string>")).alias("outer_columns")))


# ---------------------------------------------------------------------------
# Nested queries (E2) and the component table
# ---------------------------------------------------------------------------
def children(q: Column, path: Column) -> Column:
    """The queries directly inside ``q`` as structs ``(path, q)``.

    Set operations by name; subqueries in conditions by clause, position and
    slot (``where0.3``); subqueries in FROM by position.
    """
    kind = "array<struct<path:string,q:variant>>"
    items = lambda where: F.coalesce(F.try_variant_get(q, where, "array<array<variant>>"), F.array().cast("array<array<variant>>"))

    def named(*parts: Column) -> Column:
        return F.concat(path, F.lit("/"), *parts).alias("path")
    found = [F.filter(F.array(*[F.struct(named(F.lit(k)), _sub(q, k).alias("q")) for k in SQL_OPS]), lambda s: ~_is_null(s["q"]))]

    def inside(clause: str, where: str) -> Column:
        def values(u: Column, i: Column) -> Column:         # a list is taken apart once for both slots
            return F.array(*[F.struct(i.alias("i"), F.lit(slot).alias("slot"), F.get(u, slot).alias("q")) for slot in (3, 4)])
        held = F.filter(F.flatten(F.transform(items(where), values)), lambda s: _is_query(s["q"]))
        return F.transform(held, lambda s: F.struct(named(F.lit(clause), s["i"].cast("string"), F.lit("."), s["slot"].cast("string")), s["q"].alias("q")))

    found += [inside(clause, where) for clause, where in COND_LISTS]
    tables = F.transform(items("$.from.table_units"), lambda u, i: F.struct(i.alias("i"), F.get(u, 1).alias("q")))
    found.append(F.transform(F.filter(tables, lambda s: _is_query(s["q"])), lambda s: F.struct(named(F.lit("from"), s["i"].cast("string")), s["q"].alias("q"))))
    return F.concat(*[f.cast(kind) for f in found])


def query_tree(queries: DataFrame) -> DataFrame:
    """Every query with its ``path`` ('' for the outermost) and ``scope``.

    ``scope`` is 'main' for the outermost query and branches of its set
    operations, 'nested' for anything else. One level of nesting per round,
    until a round finds nothing; each level is written once.
    """
    level = tree = cut_lineage(queries.withColumn("path", F.lit("")), "level-0")
    depth = 0
    while True:
        depth += 1
        keys = [c for c in level.columns if c not in ("path", "q")]
        level = cut_lineage(level.select(*keys, F.inline(children(F.col("q"), F.col("path")))), f"level-{depth}")
        if level.isEmpty():
            break
        tree = tree.unionByName(level)
    main = F.col("path").rlike("^(/(" + "|".join(SQL_OPS) + "))*$")
    return tree.withColumn("scope", F.when(main, "main").otherwise("nested"))


_UNIT = {"uop": ("[0]", "int"), "a1": ("[1][0]", "int"), "c1": ("[1][1]", "string"), "d1": ("[1][2]", "boolean")}


def components(tree: DataFrame) -> DataFrame:
    """A row per clause item of every query in ``tree``.

    Conditions alternate with connectors: clause ``where`` has the units,
    ``where:and/or`` the words between them, at their places in the list (so
    for joins and HAVING). ``v1`` / ``v2`` are values as JSON, ``q1`` / ``q2``
    say whether they are subqueries. The clause lists become rows first; fields
    are then read from each item once, as plain columns.
    """
    q, c = F.col("q"), F.col
    keys = [k for k in tree.columns if k != "q"]
    in_ = lambda clause: c("clauses")[clause]
    lists = {"distinct": F.array("mark"), "select": c("items"), "from": in_("from")["table_units"],
             "join": in_("from")["conds"], "where": in_("where"), "having": in_("having"), "group": in_("groupBy"),
             "order": _get(F.get(in_("orderBy"), 1), "$", "array<variant>"), "limit": F.array(in_("limit")), "set": F.array(*[in_(k) for k in SQL_OPS])}
    no = {clause: i for i, clause in enumerate(lists)}             # compared below instead of names
    named = [F.struct(F.lit(clause).alias("clause"), F.lit(no[clause]).alias("no"), items.alias("items")) for clause, items in lists.items()]
    rows = tree.select(*keys, F.try_variant_get(q, "$", _CLAUSES).alias("clauses"), _get(q, "$.select[0]", "variant").alias("mark"),
                       _get(q, "$.select[1]", "array<variant>").alias("items"))
    rows = rows.select(*keys, _get(F.get(in_("orderBy"), 0), "$", "string").alias("direction"), F.inline(F.array(*named)))
    rows = rows.select(*keys, "direction", "clause", "no", F.posexplode("items").alias("pos", "u"))
    is_ = lambda *names: reduce(Column.__or__, [c("no") == no[x] for x in names])
    listed, u = is_(*[clause for clause, _ in COND_LISTS]), c("u")
    rows = rows.where(~is_("limit", "set") | ~_is_null(u)).withColumn("cond", listed & (c("pos") % 2 == 0))

    # the value unit, and the two places of values or of a table
    at = lambda path: _get(u, path, "variant")
    rows = rows.withColumns({
        "unit": F.when(is_("select"), at("$[1]")).when(c("cond"), at("$[2]")).when(is_("order"), u),
        "x1": F.when(c("cond"), at("$[3]")).when(is_("from"), at("$[1]")).when(is_("limit"), u), "x2": F.when(c("cond"), at("$[4]"))})
    value = lambda n: F.when(~_is_null(c(f"x{n}")), F.to_json(f"x{n}")).alias(f"v{n}")
    subquery = {n: F.when(c("cond") | (is_("from") if n == 1 else F.lit(False)), _is_query(c(f"x{n}"))) for n in (1, 2)}
    # most units have no second column
    rows = rows.withColumn("second", _get(c("unit"), "$[2]", "array<variant>"))
    fields = {k: _get(c("unit"), f"${path}", kind) for k, (path, kind) in _UNIT.items()}
    fields |= {k: _get(F.get("second", i), "$", kind) for i, (k, kind) in enumerate({"a2": "int", "c2": "string", "d2": "boolean"}.items())}
    group = {"a1": _get(u, "$[0]", "int"), "c1": _get(u, "$[1]", "string"), "d1": _get(u, "$[2]", "boolean")}
    fields |= {k: F.when(is_("group"), v).otherwise(fields[k]) for k, v in group.items()}
    fields["c1"] = F.when(is_("from"), F.when(~_is_query(c("x1")), _get(c("x1"), "$", "string"))).otherwise(fields["c1"])
    word = (F.when(is_("distinct") | (listed & ~c("cond")), _get(u, "$", "string")).when(is_("from"), _get(u, "$[0]", "string"))
            .when(is_("order"), c("direction")).when(is_("set"), F.get(F.array(*[F.lit(k) for k in SQL_OPS]), c("pos"))))
    return rows.select(*keys, F.when(listed & ~c("cond"), F.concat("clause", F.lit(":and/or"))).otherwise(c("clause")).alias("clause"), "pos",
                       word.alias("word"), F.when(is_("select"), _get(u, "$[0]", "int")).alias("agg"),
                       F.when(c("cond"), _get(u, "$[0]", "boolean")).alias("not_op"), F.when(c("cond"), _get(u, "$[1]", "int")).alias("op"),
                       *[v.alias(k) for k, v in fields.items()], value(1), value(2), *[v.alias(f"q{n}") for n, v in subquery.items()])


# ---------------------------------------------------------------------------
# Blinding (E3, E4) and canonical columns (E5): columns of the component table
# ---------------------------------------------------------------------------
def blind_values(comp: DataFrame) -> DataFrame:
    """Literals of conditions become null, everywhere; subqueries stay (their rows are blinded too)."""
    cond = F.col("clause").isin(*[c for c, _ in COND_LISTS])
    return comp.withColumns({f"v{n}": F.when(~cond | F.col(f"q{n}"), F.col(f"v{n}")) for n in (1, 2)})


def blind_distinct(comp: DataFrame) -> DataFrame:
    """DISTINCT marks become null in the main query, not in subqueries."""
    main = F.col("scope") == "main"
    return comp.withColumns({"d1": F.when(~main, F.col("d1")), "d2": F.when(~main, F.col("d2")),
                             "word": F.when(~(main & (F.col("clause") == "distinct")), F.col("word"))})


def column_map(canon_map: DataFrame) -> DataFrame:
    """C13 in the notation of parsed queries: ``(db_id, col, rep)``, one row per column."""
    def name(t, c):
        return F.lower(F.concat(F.lit("__"), t, F.lit("."), c, F.lit("__")))
    return canon_map.groupBy("db_id", name("table_name", "column_name").alias("col")).agg(F.min(name("rep_table", "rep_column")).alias("rep"))


def column_reps(queries: DataFrame, kmap: DataFrame) -> DataFrame:
    """``(example_id, reps)``: per example a map from ``side|column`` to its representative.

    Only columns of tables in the outermost FROM count. The join with the
    foreign-key map moves column names alone, and a map holds no more than its
    own queries name.
    """
    names = queries.select("example_id", "db_id", "side", F.explode("outer_columns").alias("col"))
    hits = names.join(by_shuffle(kmap), ["db_id", "col"]).where("col <> rep")
    entry = F.struct(F.concat_ws("|", "side", "col").alias("k"), F.col("rep").alias("v"))
    return hits.groupBy("example_id").agg(F.map_from_entries(F.collect_set(entry)).alias("reps"))


def canonical_columns(comp: DataFrame) -> DataFrame:
    """E5: columns of the main query, and of branches of its set operations,
    replaced by what ``reps`` of the row says."""
    here = (F.col("scope") == "main") & (F.col("clause") != "from")
    both = [F.when(here, F.coalesce(F.element_at("reps", F.concat_ws("|", "side", c)), F.col(c))).otherwise(F.col(c)).alias(c) for c in ("c1", "c2")]
    # as rows of their own: a filter on a plain column would be pushed down, and all that makes the column made twice
    kept = [c for c in comp.columns if c not in ("c1", "c2", "reps")]
    return comp.select(*kept, F.inline(F.array(F.struct(*both)))).select(*[c for c in comp.columns if c != "reps"])


# ---------------------------------------------------------------------------
# Matching (E6-E15)
# ---------------------------------------------------------------------------
def _join(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])


# A nested row's way up to the condition of a main query that holds it.
_OWNER = "^((?:/(?:" + "|".join(SQL_OPS) + "))*)/(" + "|".join(clause for clause, _ in COND_LISTS) + ")([0-9]+)[.]"


def _full() -> Column:
    """What a component row with its value ``unit`` as text says."""
    c = F.col
    cond = c("clause").isin(*[x for x, _ in COND_LISTS])
    # a subquery's own rows say what it is; its text does not
    v1, v2 = (F.when(c(f"q{n}"), F.lit("?")).otherwise(c(f"v{n}")) for n in (1, 2))
    return (F.when(c("clause") == "select", _join(c("agg"), c("unit"))).when(cond, _join(c("not_op"), c("op"), c("unit"), v1, v2))
            .when(c("clause") == "from", _join(c("word"), c("v1"))).when(c("clause") == "limit", _join(c("v1")))
            .when(c("clause") == "group", _join(c("a1"), c("c1"), c("d1"))).when(c("clause") == "order", _join(c("word"), c("unit")))
            .otherwise(_join(c("word"))))


def _with_unit(comp: DataFrame) -> DataFrame:
    return comp.withColumn("unit", _join(*[F.col(x) for x in ("uop", "a1", "c1", "d1", "a2", "c2", "d2")]))


def below_conditions(tree: DataFrame) -> DataFrame:
    """The queries below a condition of a main query: ``of`` tells the condition, ``rest`` is the path below it."""
    up = lambda n: F.regexp_extract("path", _OWNER, n)
    return tree.where(up(2) != "").withColumns({"of": F.concat_ws("|", "side", up(1), up(2), up(3).cast("int")),
                                                "rest": F.regexp_replace("path", _OWNER, "")})


def nested_texts(comp: DataFrame) -> DataFrame:
    """``(example_id, nested)``: what the rows of ``below_conditions`` say, as a sorted list of ``(of, text)``."""
    text = F.concat_ws("|", "rest", "clause", "pos", _full())
    return (_with_unit(comp).select("example_id", F.struct("of", text.alias("text")).alias("b"))
            .groupBy("example_id").agg(F.array_sort(F.collect_list("b")).alias("nested")))


def row_texts(comp: DataFrame) -> DataFrame:
    """The rows of the main queries as ``full``, what a row says, and ``part``,
    the same without its aggregate or operator.

    A condition that holds subqueries says, too, what all rows below it say: ``comp``
    carries these per example as ``nested`` (see ``prepared``), and the few rows that
    hold any look them up. Rows below a FROM are part of its text already. A row is
    told by ``(example_id, side, path, clause, pos)``, which must not repeat.
    """
    c = F.col
    cond = c("clause").isin(*[x for x, _ in COND_LISTS])
    here = F.filter("nested", lambda b: b["of"] == F.concat_ws("|", "side", "path", "clause", "pos"))
    # The look-up, which Spark does not generate code for, parts the generated code of the rows from that of
    # their texts: as one piece, its methods would be too long for the JVM to compile.
    rows = comp.where(c("scope") == "main").withColumn("below", F.when(cond & (c("q1") | c("q2")), F.transform(here, lambda b: b["text"]))).drop("nested", "scope")
    rows = _with_unit(rows).withColumn("said", _full())
    whole = F.when(c("below").isNull(), c("said")).otherwise(F.concat_ws("\n", F.array("said"), "below"))
    part = F.when(c("clause") == "group", F.coalesce("c1", F.lit("~"))).otherwise(c("unit"))
    return rows.select("example_id", "path", "side", "clause", "pos", whole.alias("full"), part.alias("part"), "word", "not_op", "op")


# What a row is counted under. Sequences carry their places, so that equal counts mean equal sequences.
_SETS = ("keywords", "and/or")      # a repeated text counts once


def _counted(rows: DataFrame) -> DataFrame:
    """``(example_id, path, kind, text, p, g)``: how often predicted and gold query say ``text``."""
    c = F.col
    clause, is_ = c("clause"), lambda *names: c("clause").isin(*names)
    placed = F.concat_ws("|", "clause", "pos", F.when(is_("group"), c("part")).otherwise(c("full")))
    column = F.when(c("part").contains("."), F.split_part("part", F.lit("."), F.lit(2))).otherwise(c("part"))
    cond = is_(*[x for x, _ in COND_LISTS])

    def item(kind: Column, text: Column) -> Column:
        return F.struct(kind.alias("kind"), text.alias("text"))

    def keyword(word: Column) -> Column:
        return item(F.when(word.isNotNull(), F.lit("keywords")), word)
    items = F.array(
        item(F.when(is_("select", "where", "from", "set", "limit", "distinct"), clause).when(is_("where:and/or"), F.lit("and/or"))
             .when(is_("having", "having:and/or"), F.lit("having")).when(is_("group", "order"), F.concat(clause, F.lit(" placed"))),
             F.when(is_("having", "having:and/or", "group", "order"), placed)
             .when(is_("set", "where:and/or"), F.coalesce("word", F.lit("~"))).when(~is_("limit", "distinct"), c("full")).otherwise("")),
        item(F.when(is_("select"), F.lit("select(no AGG)")).when(is_("where"), F.lit("where(no OP)")).when(is_("group"), F.lit("group(no Having)")),
             F.when(is_("group"), column).otherwise(c("part"))),
        keyword(F.when(is_("where", "group", "having", "limit", "order"), clause)),
        keyword(F.when(is_("order", "set"), c("word")).when(clause.endswith(":and/or") & (c("word") == "or"), F.lit("or"))
                .when(cond & c("not_op"), F.lit("not"))),
        keyword(F.when(cond & (c("op") == WHERE_OPS.index("in")), F.lit("in")).when(cond & (c("op") == WHERE_OPS.index("like")), F.lit("like"))))
    n = {x[0]: F.count_if(c("side") == x).cast("int") for x in ("pred", "gold")}
    counts = (rows.select("example_id", "path", "side", F.inline(items)).where("kind is not null").groupBy("example_id", "path", "kind", "text")
              .agg(*[v.alias(k) for k, v in n.items()]))
    return counts.withColumns({x: F.when(c("kind").isin(*_SETS), F.least(x, F.lit(1))).otherwise(c(x)) for x in n})


def score_queries(rows: DataFrame) -> DataFrame:
    """``(example_id, partial, exact)``: the ten components of the outermost query, and
    whether it and every branch of its set operations match.

    Both sides' counts of a text meet in one row; a component matches if no
    counts differ. Then one row per main query, then one per example.
    """
    c = F.col
    kinds = {"s": "select", "sp": "select(no AGG)", "w": "where", "wp": "where(no OP)", "g": "group(no Having)", "gs": "group placed",
             "h": "having", "o": "order placed", "l": "limit", "a": "and/or", "k": "keywords", "f": "from", "x": "set"}
    of = lambda k: c("kind") == kinds[k]
    same = [F.coalesce(F.bool_and(F.when(of(k), c("p") == c("g"))), F.lit(True)).alias(f"same_{k}") for k in kinds if k != "l"]
    sizes = [F.sum(F.when(of(k), c(x)).otherwise(0)).cast("int").alias(f"{x}_{k}") for k in ("s", "w", "g", "o", "l", "a", "k", "f", "x") for x in "pg"]
    shared = [F.coalesce(F.bool_or(F.when(of("x") & (c("text") == k), (c("p") > 0) & (c("g") > 0))), F.lit(False)).alias(f"both_{k}") for k in SQL_OPS]
    q = _counted(rows).groupBy("example_id", "path").agg(*same, *sizes, *shared)

    has = {k: (c(f"p_{k}") > 0, c(f"g_{k}") > 0) for k in ("g", "o", "l")}
    both = lambda k, hit: (has[k][0] == has[k][1]) & (~has[k][0] | hit)
    one = lambda k: tuple(x.cast("int") for x in has[k])
    size = lambda k: (c(f"p_{k}"), c(f"g_{k}"))
    local = {
        "select": (c("same_s"), *size("s")), "select(no AGG)": (c("same_sp"), *size("s")),
        "where": (c("same_w"), *size("w")), "where(no OP)": (c("same_wp"), *size("w")),
        "group(no Having)": (c("same_g"), *size("g")), "group": (both("g", c("same_gs") & c("same_h")), *one("g")),
        "order": (both("o", c("same_o") & (has["l"][0] == has["l"][1])), *one("o")),
        # totals of unequal sets come back the other way round
        "and/or": (c("same_a"), *[F.when(c("same_a"), 1).otherwise(c(f"{x}_a")) for x in "gp"]),
        "keywords": (c("same_k"), *size("k"))}
    good = ((c("g_f") == 0) | c("same_f")) & c("same_x")
    for ok, _, _ in local.values():
        good = good & ok
    no = {kind: i for i, kind in enumerate(PARTIAL_TYPES)}
    q = q.select("example_id", "path", good.alias("good"), "p_x", "g_x", *[f"both_{k}" for k in SQL_OPS],
                 *[v.alias(f"{what}{no[kind]}") for kind, scores in local.items() for what, v in zip(("ok", "p", "g"), scores)])
    # A query matches exactly when it and every set-operation branch below it are good.
    root = [F.max(F.when(c("path") == "", c(k))).alias(k) for k in q.columns if k not in ("example_id", "path", "good")]
    branch = [F.bool_and(F.when((c("path") == f"/{k}") | c("path").startswith(f"/{k}/"), c("good"))).alias(f"whole_{k}") for k in SQL_OPS]
    ex = q.groupBy("example_id").agg(*root, *branch, F.bool_and("good").cast("int").alias("exact"))
    hits = sum((c(f"both_{k}") & F.coalesce(f"whole_{k}", F.lit(True))).cast("int") for k in SQL_OPS)

    def scored(kind: str) -> Column:
        ok, p, g = (c(f"{what}{no[kind]}") for what in ("ok", "p", "g")) if kind != "IUEN" else (
            (c("p_x") == c("g_x")) & (hits == c("p_x")), c("p_x"), c("g_x"))
        ok = ok.cast("int")                     # acc, rec and f1 are all ``ok``
        return F.struct(F.lit(kind).alias("type"), ok.alias("acc"), ok.alias("rec"), ok.alias("f1"), g.alias("label_total"), p.alias("pred_total"))
    return ex.select("example_id", F.array(*[scored(kind) for kind in PARTIAL_TYPES]).alias("partial"), "exact")


# ---------------------------------------------------------------------------
# Hardness (E17), from the raw gold query
# ---------------------------------------------------------------------------
def with_hardness(df: DataFrame, g: str, out: str = "hardness") -> DataFrame:
    """E17 on the raw gold query in column ``g``: easy / medium / hard / extra.

    The clause arrays are staged as columns first, so every count below
    reads them instead of re-walking the VARIANT once per reference.
    """
    v = F.col(g)
    order_units = F.coalesce(F.try_variant_get(v, "$.orderBy[1]", "array<variant>"), F.array().cast("array<variant>"))
    staged = df.select(
        "*",
        _arr(v, "$.where").alias("_w"), _arr(v, "$.groupBy").alias("_grp"), _arr(v, "$.having").alias("_hav"),
        _arr(v, "$.from.conds").alias("_fc"), _arr(v, "$.select[1]").alias("_sel"),
        F.size(_arr(v, "$.orderBy")).alias("_n_order"), F.size(_arr(v, "$.from.table_units")).alias("_n_tu"),
        (~_is_null(_sub(v, "limit"))).cast("int").alias("_limit"),
        sum((~_is_null(_sub(v, k))).cast("int") for k in ("intersect", "except", "union")).alias("_n_setops"),
        F.concat(F.filter(F.transform(order_units, lambda u: F.try_variant_get(u, "$[1]", "variant")),
                          lambda x: ~_is_null(x)),
                 F.filter(F.transform(order_units, lambda u: F.try_variant_get(u, "$[2]", "variant")),
                          lambda x: ~_is_null(x))).alias("_ocols"))
    c = F.col
    staged = staged.select(
        "*",
        F.concat(_even(c("_fc")), _even(c("_w")), _even(c("_hav"))).alias("_units"),
        F.concat(_odd(c("_fc")), _odd(c("_w")), _odd(c("_hav"))).alias("_conns"))
    is_obj = _is_query

    def first_nonzero(a):
        # "has an aggregate" = first element is not 0: agg ids, NOT flags, and
        # (for HAVING) connector strings all count, as in the original.
        return F.size(F.filter(a, lambda u: F.coalesce(
            F.try_variant_get(u, "$[0]", "int") != 0,
            F.try_variant_get(u, "$[0]", "boolean"),
            F.try_variant_get(u, "$", "string").isNotNull())))

    counts = staged.select(
        "*",
        ((F.size("_w") > 0).cast("int") + (F.size("_grp") > 0).cast("int") + (c("_n_order") > 0).cast("int")
         + c("_limit") + F.when(c("_n_tu") > 0, c("_n_tu") - 1).otherwise(0)
         + F.size(F.filter("_conns", lambda x: F.try_variant_get(x, "$", "string") == "or"))
         + F.size(F.filter("_units", lambda u: F.try_variant_get(u, "$[1]", "int") == WHERE_OPS.index("like")))
         ).alias("_c1"),
        (F.size(F.filter("_units", lambda u: is_obj(F.try_variant_get(u, "$[3]", "variant"))))
         + F.size(F.filter("_units", lambda u: is_obj(F.try_variant_get(u, "$[4]", "variant"))))
         + c("_n_setops")).alias("_c2"),
        (first_nonzero(c("_sel")) + first_nonzero(_even(c("_w"))) + first_nonzero(c("_grp"))
         + first_nonzero(c("_ocols")) + first_nonzero(c("_hav"))).alias("_agg"))
    c1, c2 = c("_c1"), c("_c2")
    others = ((c("_agg") > 1).cast("int") + (F.size("_sel") > 1).cast("int") + (F.size("_w") > 1).cast("int")
              + (F.size("_grp") > 1).cast("int"))
    level = (F.when((c1 <= 1) & (others == 0) & (c2 == 0), "easy")
             .when(((others <= 2) & (c1 <= 1) & (c2 == 0)) | ((c1 <= 2) & (others < 2) & (c2 == 0)), "medium")
             .when(((others > 2) & (c1 <= 2) & (c2 == 0)) | ((c1 > 2) & (c1 <= 3) & (others <= 2) & (c2 == 0))
                   | ((c1 <= 1) & (others == 0) & (c2 <= 1)), "hard")
             .otherwise("extra"))
    return counts.select(*df.columns, level.alias(out))


# ---------------------------------------------------------------------------
# Job level
# ---------------------------------------------------------------------------
def _repeated(tree: DataFrame) -> bool:
    """Whether an example has two outermost queries of a side; else its rows need no sorting to be told apart."""
    return not tree.where("path = ''").groupBy("example_id", "side").count().where("count > 1").isEmpty()


def prepared(tree: DataFrame, kmap: DataFrame | None = None, values: bool = False, distinct: bool = False, once: bool = False) -> DataFrame:
    """The component table to be scored, of a ``query_tree``. ``values`` / ``distinct``: compare them, too.

    The tree is dealt by ``example_id``, the one shuffle of scoring: what follows
    groups by that and more. ``once``: an ``example_id`` that repeats counts as one
    example, and rows carry its ``nested_texts``. What belongs to an example is joined
    to its queries, so that the many component rows are never sorted.
    """
    dealt = _dealt(tree.drop("outer_columns"), tree.count())      # written: read from the footers
    if once and _repeated(tree):
        dealt = dealt.dropDuplicates(["example_id", "side", "path"])

    def rows(queries: DataFrame) -> DataFrame:
        comp = components(queries)
        if not values:
            comp = blind_values(comp)
        return comp if distinct else blind_distinct(comp)
    nested = nested_texts(rows(below_conditions(dealt))) if once else None          # canonical columns are a matter of main queries alone
    if kmap is not None:
        dealt = dealt.join(by_shuffle(column_reps(tree.where("path = ''"), kmap)), "example_id", "left")
    if once:
        dealt = dealt.join(by_shuffle(nested), "example_id", "left")
    comp = rows(dealt)
    return comp if kmap is None else canonical_columns(comp)


def hardness(gold: DataFrame) -> DataFrame:
    """``(example_id, hardness)`` of gold queries alone."""
    read = gold.select("example_id", _query("gold_json").alias("q"))
    return with_hardness(read, "q").where(F.col("q").isNotNull()).select("example_id", "hardness")


def score_examples(gold: DataFrame, pred: DataFrame, kmap: DataFrame | None = None, values: bool = False, distinct: bool = False) -> DataFrame:
    """Per scorable example: hardness, exact match and the ten partial components.

    The scores, a row per example, are written: that job then runs with compiled code.
    """
    tree = query_tree(sides(align(gold, pred)))
    s = cut_lineage(score_queries(row_texts(prepared(tree, kmap, values, distinct, once=True))), "scores", SHORT_METHODS)
    whole = tree.where("path = '' and side = 'gold'").select("example_id", "db_id", "pred_failed", "q")
    return with_hardness(whole, "q").drop("q").join(by_shuffle(s), "example_id")


def score_rollup(scored: DataFrame, executed: DataFrame | None = None) -> DataFrame:
    """Every level and ``all``, with rows or without: count, exact, exec and,
    per component, acc / rec averaged over examples with pred / label totals > 0.

    f1 comes from the unrounded means and is 1 when both are 0; a level without
    rows has zeros throughout. ``executed``: ``(example_id, exec_match)`` of E16;
    an example it lacks counts as a failure, and without it ``exec`` is null.
    """
    if executed is not None:
        scored = scored.join(by_shuffle(executed.select("example_id", "exec_match")), "example_id", "left")
        ran = F.coalesce("exec_match", F.lit(False)).cast("double")
    else:
        ran = F.lit(None).cast("double")
    rows = scored.withColumn("ran", ran).select("exact", "ran", F.explode(F.array("hardness", F.lit("all"))).alias("level"), F.inline("partial"))
    sums = rows.groupBy("level", "type").agg(
        F.count(F.lit(1)).alias("count"), F.avg("exact").alias("exact"), F.avg("ran").alias("exec"),
        F.avg(F.when(F.col("pred_total") > 0, F.col("acc"))).alias("acc"), F.avg(F.when(F.col("label_total") > 0, F.col("rec"))).alias("rec"))
    spark = scored.sparkSession
    grid = spark.createDataFrame([(x, t) for x in LEVELS for t in PARTIAL_TYPES], "level string, type string")
    out = grid.join(sums, ["level", "type"], "left")
    acc, rec = F.coalesce("acc", F.lit(0.0)), F.coalesce("rec", F.lit(0.0))
    f1 = F.when(F.col("count").isNull(), 0.0).when((acc == 0) & (rec == 0), 1.0).otherwise(2.0 * acc * rec / (acc + rec))
    zero = F.lit(0.0) if executed is not None else F.lit(None).cast("double")
    return out.select("level", "type", F.coalesce("count", F.lit(0)).alias("count"), F.round(F.coalesce("exact", F.lit(0.0)), 6).alias("exact"),
                      F.round(F.coalesce("exec", zero), 6).alias("exec"), F.round(acc, 6).alias("acc"), F.round(rec, 6).alias("rec"),
                      F.round(f1, 6).alias("f1"))


def score_report(rollup: DataFrame) -> DataFrame:
    """``(block, type)`` by level: count, execution, exact match, then acc, rec and f1 of each component."""
    whole = rollup.where(F.col("type") == PARTIAL_TYPES[0]).select("level", F.inline(F.array(
        *[F.struct(F.lit(b).alias("block"), F.lit("").alias("type"), F.col(b).cast("double").alias("v")) for b in ("count", "exec", "exact")])))
    each = rollup.select("level", F.inline(F.array(
        *[F.struct(F.lit(b).alias("block"), F.col("type"), F.col(b).alias("v")) for b in ("acc", "rec", "f1")])))
    return whole.unionByName(each).groupBy("block", "type").pivot("level", LEVELS).agg(F.first("v")).select("block", "type", *LEVELS)


def canonical_value(value: Column, kind: Column) -> Column:
    """One text per distinct value: ``n`` null, ``i`` whole number with all its digits, ``d`` other number, ``s`` text."""
    plain = F.trim(value)
    digits = F.regexp_replace(F.regexp_extract(plain, r"^[+-]?0*(\d+)(?:\.0*)?$", 1), r"^0+(?=\d)", "")
    minus = F.when(plain.startswith("-") & (digits != "0"), "-").otherwise("")
    double = plain.try_cast("double")
    # a fraction or an exponent: whole values below 2^53 are exact as doubles
    exact = (double == F.floor(double)) & (F.abs(double) < 2.0 ** 53)
    number = (F.when(digits != "", F.concat(F.lit("i"), minus, digits))
              .when(exact, F.concat(F.lit("i"), double.cast("long").cast("string")))
              .when(double.isNotNull(), F.concat(F.lit("d"), double.cast("string"))))
    text = F.concat(F.lit("s"), value)
    return F.when(value.isNull(), "n").when(kind == "text", text).otherwise(F.coalesce(number, text))


def execution_match(results: DataFrame, ordered: bool = True, executed: DataFrame | None = None) -> DataFrame:
    """E16 over result sets in long form ``(example_id, side, unit_key, row_no, value[, kind])``.

    Per example the values of every select unit must be equal, in row order
    unless ``ordered=False``, which compares multisets. ``kind`` is what the
    engine returned: ``number`` or ``text``; a number never equals a text
    (``7`` and ``'007'``), numbers are equal as numbers (1 equals 1.0) and whole
    ones exactly, of any size; null equals null of either kind. Without a
    ``kind`` column a value that reads as a number counts as one. ``executed``:
    ``(example_id, pred_ok)`` of all examples; those without rows on either side
    match if the prediction ran (two empty results), and a prediction that
    failed never matches. Without it the examples are those with rows.
    """
    text = canonical_value(F.col("value").cast("string"), F.col("kind") if "kind" in results.columns else F.lit(None).cast("string"))
    key = ["example_id", "unit_key"] + (["row_no"] if ordered else []) + ["text"]
    v = results.withColumn("text", text)
    sign = F.when(F.col("side") == "gold", 1).otherwise(-1)
    # Every (unit, place, value) must occur equally often on both sides.
    diff = v.groupBy(*key).agg(F.sum(sign).alias("d")).groupBy("example_id").agg((F.max(F.abs("d")) == 0).alias("same"))
    if executed is None:
        return diff.select("example_id", F.col("same").alias("exec_match"))
    return (executed.join(diff, "example_id", "left")
            .select("example_id", (F.col("pred_ok") & F.coalesce("same", F.lit(True))).alias("exec_match")))
