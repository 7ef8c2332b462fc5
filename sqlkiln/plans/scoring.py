"""Scoring predicted parsed queries against gold ones.

Gold parsed queries are generated per order (six query shapes, table and
column ids from the lake catalog, so FK canonicalisation has real FKs to
use); predictions copy the gold query with an injected error chosen by the
customer key: none, a changed aggregate, an extra condition, a flipped
order, or unparsable text; every 13th order has no prediction at all.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as sc
from . import fixtures as fx
from . import catalog as pc
from .registry import register


def _tpl(t: str, fields: dict[str, str]) -> str:
    out, rest = [], t
    while rest:
        i = rest.find("<<")
        if i < 0:
            out.append(fx._lit(rest))
            break
        if i:
            out.append(fx._lit(rest[:i]))
        j = rest.index(">>", i)
        out.append(fields[rest[i + 2:j]])
        rest = rest[j + 2:]
    return "(" + " || ".join(out) + ")"


def _q(select, tables, conds="[]", where="[]", group="[]", having="[]", order="[]", limit="null",
       intersect="null", except_="null", union="null"):
    tu = ",".join(f'["table_unit","__{t}__"]' for t in tables)
    return ('{"select":' + select + ',"from":{"table_units":[' + tu + '],"conds":' + conds + '},"where":' + where
            + ',"groupBy":' + group + ',"having":' + having + ',"orderBy":' + order + ',"limit":' + limit
            + ',"intersect":' + intersect + ',"except":' + except_ + ',"union":' + union + '}')


def _cu(t, c, agg=0, dist="false"):
    return f'[{agg},"__{t}.{c}__",{dist}]'


def _vu(cu):
    return f"[0,{cu},null]"


T, U = "t_<<key>>", "t_<<first>>"
STAR = '[0,"__all__",false]'
NESTED = _q(f'[false,[[0,{_vu(_cu(U, "parent_id"))}]]]', [U])
NESTED_VALUE = _q(f'[true,[[0,{_vu(_cu(U, "parent_id", dist="true"))}]]]', [U], where=f'[[false,3,{_vu(_cu(U, "id"))},7,null]]')
ID = f'[false,[[0,{_vu(_cu(T, "id"))}]]]'
DEEP = _q(ID, [T], except_=_q(f'[false,[[0,{_vu(_cu(U, "id"))}],[0,{_vu(_cu(U, "parent_id"))}]]]', [U],
                              intersect=_q(ID, [T], where=f'[[false,4,{_vu(_cu(T, "id"))},9,null]]', union=NESTED)))
GOLD_TEMPLATES = [
    _q(f'[false,[[3,[0,{STAR},null]]]]', [T]),
    _q(f'[false,[[0,{_vu(_cu(T, "id"))}],[0,{_vu(_cu(T, "parent_id"))}]]]', [T],
       where=f'[[false,2,{_vu(_cu(T, "id"))},<<key>>,null],"and",[false,2,{_vu(_cu(T, "parent_id"))},"\\"<<status>>\\"",null]]'),
    _q(f'[false,[[0,{_vu(_cu(T, "parent_id"))}],[3,[0,{STAR},null]]]]', [T], group=f'[{_cu(T, "parent_id")}]',
       having=f'[[false,3,[0,[3,"__all__",false],null],3,null]]', order=f'["desc",[[0,[3,"__all__",false],null]]]', limit="3"),
    _q(f'[false,[[0,{_vu(_cu(T, "id"))}]]]', [T, U],
       conds=f'[[false,2,{_vu(_cu(T, "parent_id"))},{_cu(U, "id")},null]]',
       where=f'[[false,1,{_vu(_cu(U, "id"))},1,5],"or",[false,9,{_vu(_cu(U, "parent_id"))},"\\"%x%\\"",null]]'),
    _q(f'[false,[[0,{_vu(_cu(T, "id"))}]]]', [T], where=f'[[true,8,{_vu(_cu(T, "parent_id"))},{NESTED_VALUE},null]]'),
    _q(f'[true,[[0,{_vu(_cu(T, "id", dist="true"))}]]]', [T], where=f'[[false,3,{_vu(_cu(T, "id"))},10,null]]',
       intersect=NESTED),
    # arithmetic in SELECT and ORDER BY, two aggregates in HAVING
    _q(f'[false,[[1,[1,{_cu(T, "id")},{_cu(T, "parent_id")}]]]]', [T], group=f'[{_cu(T, "id")},{_cu(T, "parent_id")}]',
       having='[[false,3,[0,[3,"__all__",false],null],3,null],"and",[false,4,[0,[1,"__t_<<key>>.id__",false],null],9,null]]',
       order=f'["desc",[[3,{_cu(T, "id")},{_cu(T, "parent_id")}]]]'),
    _q(ID, [T], union=_q(ID, [T], where=f'[[false,2,{_vu(_cu(T, "parent_id"))},4,null]]')),
    DEEP,
    # a subquery in FROM
    _q(ID, [T]).replace('"table_units":[', '"table_units":[["sql",' + NESTED + "],"),
]
EXTRA_COND = f'[false,7,{_vu(_cu(T, "id"))},0,null]'


def parsed_sql() -> str:
    f = {"key": "CAST(o_orderkey AS STRING)", "first": "CAST(first_key AS STRING)", "status": "o_orderstatus"}
    cases = " ".join(f"WHEN {i} THEN {_tpl(t, f)}" for i, t in enumerate(GOLD_TEMPLATES))
    extra = _tpl(EXTRA_COND, f)
    return f"""
WITH o AS (SELECT o.*, m.first_key FROM orders o
           JOIN (SELECT o_custkey AS ck, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey) m
             ON m.ck = o.o_custkey),
g AS (SELECT o_orderkey AS example_id, 'db_' || CAST(o_custkey AS STRING) AS db_id, o_custkey % 6 AS mutation,
             o_orderkey % 13 = 0 AS missing, first_key, {extra} AS extra_cond,
             CASE o_orderkey % {len(GOLD_TEMPLATES)} {cases} END AS gold_json FROM o)
SELECT example_id, db_id, CASE WHEN example_id % 97 = 0 THEN 'SELECT bad gold' ELSE gold_json END AS gold_json, missing,
  CASE mutation
    WHEN 0 THEN gold_json
    WHEN 1 THEN replace(gold_json, '"select":[false,[[0,', '"select":[false,[[2,')
    WHEN 2 THEN CASE WHEN gold_json LIKE '%"where":[]%' THEN replace(gold_json, '"where":[]', '"where":[' || extra_cond || ']')
                     ELSE replace(gold_json, '"where":[', '"where":[' || extra_cond || ',"and",') END
    WHEN 3 THEN replace(replace(gold_json, '"desc"', '"asc"'), '"limit":3', '"limit":null')
    WHEN 4 THEN replace(gold_json, ',7,null]', ',8,null]')
    ELSE 'SELECT broken FROM' END AS pred_json
FROM g"""


def parsed(spark, d):
    df = fx.written_sql(spark, d, "parsed", parsed_sql(), ("orders",))
    gold = df.select("example_id", "db_id", "gold_json")
    pred = df.where(~F.col("missing")).select("example_id", "pred_json")
    return gold, pred


def _canon(spark, d):
    """C13 of the fixture lake, in the notation of parsed queries."""
    from ..operators import catalog as cat
    _, _, cols, fks = pc._lake(spark, d)
    return sc.column_map(cat.fk_canonical_map(fks, cols))


def _tree(spark, d, columns=False):
    """``columns``: with the columns that each query names, which canonical columns need."""
    queries = sc.sides(sc.align(*parsed(spark, d)))
    return sc.query_tree(queries if columns else queries.drop("outer_columns"))


# ---------------------------------------------------------------------------
# DuckDB side: the same component rows by recursive SQL over the JSON text,
# then plain relational matching (grouped counts and joins instead of arrays).
# ---------------------------------------------------------------------------
def _items(path: str) -> str:
    return f"coalesce(CAST(json_extract(q, '{path}') AS JSON[]), CAST([] AS JSON[]))"


def _places(clause: str, path: str, slot: int) -> str:
    return (f"list_transform({_items(path)}, lambda u, i: {{'p': '/{clause}' || (i - 1) || '.{slot}', 'q': json_extract(u, '$[{slot}]')}})")


_KIDS = ("list_filter(list_concat([" + ", ".join(f"{{'p': '/{k}', 'q': json_extract(q, '$.{k}')}}" for k in ("intersect", "union", "except")) + "], "
         + ", ".join(_places(c, p, s) for c, p in (("join", "$.from.conds"), ("where", "$.where"), ("having", "$.having")) for s in (3, 4))
         + f", list_transform({_items('$.from.table_units')}, lambda u, i: {{'p': '/from' || (i - 1), 'q': json_extract(u, '$[1]')}}))"
         + ", lambda s: coalesce(json_type(s.q), 'NULL') = 'OBJECT')")

D_PARSED = "pq AS (" + parsed_sql() + """),
al AS (SELECT example_id, db_id, gold_json, missing, CASE WHEN missing THEN NULL ELSE pred_json END AS pj FROM pq),
af AS (SELECT *, NOT coalesce(json_valid(pj) AND starts_with(pj, '{'), false) AS pred_failed,
         NOT coalesce(json_valid(gold_json) AND starts_with(gold_json, '{'), false) AS gold_failed FROM al),
sd AS (SELECT example_id, db_id, 'gold' AS side, CAST(gold_json AS JSON) AS q FROM af WHERE NOT gold_failed
       UNION ALL SELECT example_id, db_id, 'pred', CAST(CASE WHEN pred_failed THEN '""" + sc.EMPTY_QUERY_JSON + """' ELSE pj END AS JSON) FROM af WHERE NOT gold_failed),
tree(example_id, db_id, side, path, q) AS (
  SELECT example_id, db_id, side, '', q FROM sd
  UNION ALL
  SELECT example_id, db_id, side, path || k.p, k.q FROM (SELECT example_id, db_id, side, path, unnest(""" + _KIDS + """) AS k FROM tree)),
scoped AS (SELECT *, CASE WHEN regexp_matches(path, '^(/(intersect|union|except))*$') THEN 'main' ELSE 'nested' END AS scope FROM tree)"""


def _unit_cols(vu: str) -> str:
    out = [f"CAST(json_extract({vu}, '$[0]') AS INT) AS uop"]
    for n in (1, 2):
        out += [f"CAST(json_extract({vu}, '$[{n}][0]') AS INT) AS a{n}", f"json_extract_string({vu}, '$[{n}][1]') AS c{n}",
                f"CAST(json_extract({vu}, '$[{n}][2]') AS BOOLEAN) AS d{n}"]
    return ", ".join(out)


_NO_UNIT = "CAST(NULL AS INT) AS uop, CAST(NULL AS INT) AS a1, CAST(NULL AS VARCHAR) AS c1, CAST(NULL AS BOOLEAN) AS d1, CAST(NULL AS INT) AS a2, CAST(NULL AS VARCHAR) AS c2, CAST(NULL AS BOOLEAN) AS d2"


def _clause(name: str, items: str, word="NULL", agg="NULL", not_op="NULL", op="NULL", unit=_NO_UNIT, values=("NULL", "NULL"), keep="true") -> str:
    v = [f"CASE WHEN coalesce(json_type({x}), 'NULL') <> 'NULL' THEN CAST({x} AS VARCHAR) END" if x != "NULL" else "CAST(NULL AS VARCHAR)" for x in values]
    q = [f"coalesce(json_type({x}), 'NULL') = 'OBJECT'" if x != "NULL" else "false" for x in values]
    return (f"SELECT example_id, db_id, side, path, scope, '{name}' AS clause, CAST(pos AS INT) AS pos, CAST({word} AS VARCHAR) AS word, CAST({agg} AS INT) AS agg, "
            f"CAST({not_op} AS BOOLEAN) AS not_op, CAST({op} AS INT) AS op, {unit}, {v[0]} AS v1, {v[1]} AS v2, {q[0]} AS q1, {q[1]} AS q2 "
            f"FROM (SELECT example_id, db_id, side, path, scope, q, unnest({items}) AS u, generate_subscripts({items}, 1) - 1 AS pos FROM scoped) WHERE {keep}")


def _duck_components() -> str:
    sel = _clause("select", _items("$.select[1]"), agg="json_extract(u, '$[0]')", unit=_unit_cols("json_extract(u, '$[1]')"))
    dist = _clause("distinct", "[json_extract(q, '$.select[0]')]", word="json_extract_string(u, '$')")
    frm = _clause("from", _items("$.from.table_units"), word="json_extract_string(u, '$[0]')", values=("json_extract(u, '$[1]')", "NULL"),
                  unit=_NO_UNIT.replace("CAST(NULL AS VARCHAR) AS c1", "CASE WHEN json_type(json_extract(u, '$[1]')) = 'VARCHAR' THEN json_extract_string(u, '$[1]') END AS c1"))
    rows = [sel, dist, frm]
    for c, p in (("join", "$.from.conds"), ("where", "$.where"), ("having", "$.having")):
        rows.append(_clause(c, _items(p), not_op="json_extract(u, '$[0]')", op="json_extract(u, '$[1]')", unit=_unit_cols("json_extract(u, '$[2]')"),
                            values=("json_extract(u, '$[3]')", "json_extract(u, '$[4]')"), keep="pos % 2 = 0"))
        rows.append(_clause(f"{c}:and/or", _items(p), word="json_extract_string(u, '$')", keep="pos % 2 = 1"))
    group = ("CAST(NULL AS INT) AS uop, CAST(json_extract(u, '$[0]') AS INT) AS a1, json_extract_string(u, '$[1]') AS c1, CAST(json_extract(u, '$[2]') AS BOOLEAN) AS d1, "
             "CAST(NULL AS INT) AS a2, CAST(NULL AS VARCHAR) AS c2, CAST(NULL AS BOOLEAN) AS d2")
    rows.append(_clause("group", _items("$.groupBy"), unit=group))
    rows.append(_clause("order", _items("$.orderBy[1]"), word="json_extract_string(q, '$.orderBy[0]')", unit=_unit_cols("u")))
    rows.append(_clause("limit", "[json_extract(q, '$.limit')]", values=("u", "NULL"), keep="coalesce(json_type(u), 'NULL') <> 'NULL'"))
    rows.append(_clause("set", "['intersect', 'union', 'except']", word="u", keep="coalesce(json_type(json_extract(q, '$.' || u)), 'NULL') <> 'NULL'"))
    return "comp AS (" + "\nUNION ALL ".join(rows) + ")"


_COND = "clause IN ('join', 'where', 'having')"
D_BLIND = ",\nbv AS (SELECT * REPLACE (CASE WHEN NOT (" + _COND + ") OR q1 THEN v1 END AS v1, CASE WHEN NOT (" + _COND + """) OR q2 THEN v2 END AS v2) FROM comp),
bd AS (SELECT * REPLACE (CASE WHEN scope <> 'main' THEN d1 END AS d1, CASE WHEN scope <> 'main' THEN d2 END AS d2,
         CASE WHEN NOT (scope = 'main' AND clause = 'distinct') THEN word END AS word) FROM bv)"""
D_COLUMNS = """,
km AS (SELECT db_id, lower('__' || table_name || '.' || column_name || '__') AS col, min(lower('__' || rep_table || '.' || rep_column || '__')) AS rep
       FROM canon GROUP BY ALL),
ot AS (SELECT example_id, side, regexp_replace(c1, '__$', '') AS tab FROM comp WHERE path = '' AND clause = 'from' AND word = 'table_unit' GROUP BY ALL),
cc AS (SELECT b.* REPLACE (
         CASE WHEN scope = 'main' AND clause <> 'from' AND o1.tab IS NOT NULL THEN coalesce(k1.rep, c1) ELSE c1 END AS c1,
         CASE WHEN scope = 'main' AND clause <> 'from' AND o2.tab IS NOT NULL THEN coalesce(k2.rep, c2) ELSE c2 END AS c2)
       FROM bd b
       LEFT JOIN ot o1 ON o1.example_id = b.example_id AND o1.side = b.side AND o1.tab = split_part(c1, '.', 1) AND contains(c1, '.')
       LEFT JOIN ot o2 ON o2.example_id = b.example_id AND o2.side = b.side AND o2.tab = split_part(c2, '.', 1) AND contains(c2, '.')
       LEFT JOIN km k1 ON k1.db_id = b.db_id AND k1.col = c1 LEFT JOIN km k2 ON k2.db_id = b.db_id AND k2.col = c2)"""
D_MATCH = """,
un AS (SELECT *, coalesce(uop::VARCHAR, '~') || ';' || coalesce(a1::VARCHAR, '~') || ';' || coalesce(c1, '~') || ';' || coalesce(d1::VARCHAR, '~') || ';'
         || coalesce(a2::VARCHAR, '~') || ';' || coalesce(c2, '~') || ';' || coalesce(d2::VARCHAR, '~') AS unit, """ + _COND + """ AS is_cond FROM cc),
tx AS (SELECT *, CASE WHEN clause = 'select' THEN coalesce(agg, -1) || ';' || unit
         WHEN is_cond THEN coalesce(not_op::VARCHAR, '~') || ';' || coalesce(op, -1) || ';' || unit || ';'
           || CASE WHEN q1 THEN '?' ELSE coalesce(v1, '~') END || ';' || CASE WHEN q2 THEN '?' ELSE coalesce(v2, '~') END
         WHEN clause = 'from' THEN word || ';' || v1 WHEN clause = 'limit' THEN v1 WHEN clause = 'group' THEN unit
         WHEN clause = 'order' THEN word || ';' || unit ELSE coalesce(word, '~') END AS own FROM un),
deep AS (SELECT r.example_id, r.side, r.path, r.clause, r.pos,
           string_agg(s.path || ' ' || s.clause || s.pos || ' ' || s.own, chr(10) ORDER BY s.path, s.clause, s.pos) AS below
         FROM tx r JOIN tx s ON s.example_id = r.example_id AND s.side = r.side AND starts_with(s.path, r.path || '/' || r.clause || r.pos || '.')
         WHERE r.is_cond AND (r.q1 OR r.q2) GROUP BY ALL),
mr AS (SELECT t.*, own || coalesce(chr(10) || regexp_replace(d.below, '(^|\n)' || t.path, '\1', 'g'), '') AS full_text,
         CASE WHEN clause = 'group' THEN c1 ELSE unit END AS part
       FROM tx t LEFT JOIN deep d USING (example_id, side, path, clause, pos) WHERE scope = 'main'),
qs AS (SELECT DISTINCT example_id, path FROM mr),
bag AS (
  SELECT example_id, path, kind, sum(least(np, ng)) AS hits, sum(np) AS pt, sum(ng) AS lt FROM (
    SELECT example_id, path, kind, item, count(*) FILTER (side = 'pred') AS np, count(*) FILTER (side = 'gold') AS ng FROM (
      SELECT example_id, path, side, 'select' AS kind, full_text AS item FROM mr WHERE clause = 'select'
      UNION ALL SELECT example_id, path, side, 'select(no AGG)', part FROM mr WHERE clause = 'select'
      UNION ALL SELECT example_id, path, side, 'where', full_text FROM mr WHERE clause = 'where'
      UNION ALL SELECT example_id, path, side, 'where(no OP)', part FROM mr WHERE clause = 'where'
      UNION ALL SELECT example_id, path, side, 'group(no Having)', CASE WHEN contains(part, '.') THEN split_part(part, '.', 2) ELSE part END FROM mr WHERE clause = 'group'
      UNION ALL SELECT DISTINCT example_id, path, side, 'keywords', kw FROM (
        SELECT example_id, path, side, unnest(list_filter([
          CASE WHEN clause IN ('where', 'group', 'having', 'limit', 'order') THEN clause END, CASE WHEN clause IN ('order', 'set') THEN word END,
          CASE WHEN clause LIKE '%:and/or' AND word = 'or' THEN 'or' END, CASE WHEN is_cond AND not_op THEN 'not' END,
          CASE WHEN is_cond AND op = 8 THEN 'in' END, CASE WHEN is_cond AND op = 9 THEN 'like' END], lambda x: x IS NOT NULL)) AS kw FROM mr))
    GROUP BY ALL) GROUP BY ALL),
seq AS (SELECT example_id, path, side,
          string_agg(part, chr(10) ORDER BY pos) FILTER (clause = 'group') AS grp, string_agg(full_text, chr(10) ORDER BY clause, pos) FILTER (clause LIKE 'having%') AS hav,
          string_agg(full_text, chr(10) ORDER BY pos) FILTER (clause = 'order') AS ord, count(*) FILTER (clause = 'limit') AS lim,
          string_agg(full_text, chr(10) ORDER BY full_text) FILTER (clause = 'from') AS tabs,
          list_sort(list(DISTINCT word) FILTER (clause = 'where:and/or')) AS ao, coalesce(list_sort(list(word) FILTER (clause = 'set')), []) AS ops
        FROM mr GROUP BY ALL),
pg AS (SELECT q.example_id, q.path, p.grp AS p_grp, g.grp AS g_grp, p.hav AS p_hav, g.hav AS g_hav, p.ord AS p_ord, g.ord AS g_ord, p.lim AS p_lim, g.lim AS g_lim,
         p.tabs AS p_tabs, g.tabs AS g_tabs, coalesce(p.ao, []) AS p_ao, coalesce(g.ao, []) AS g_ao, coalesce(p.ops, []) AS p_ops, coalesce(g.ops, []) AS g_ops
       FROM qs q LEFT JOIN (SELECT * FROM seq WHERE side = 'pred') p USING (example_id, path) LEFT JOIN (SELECT * FROM seq WHERE side = 'gold') g USING (example_id, path)),
lo AS (
  SELECT q.example_id, q.path, k.kind, coalesce(hits, 0) AS hits, coalesce(pt, 0) AS pt, coalesce(lt, 0) AS lt
  FROM qs q CROSS JOIN (SELECT unnest(['select', 'select(no AGG)', 'where', 'where(no OP)', 'group(no Having)', 'keywords']) AS kind) k
  LEFT JOIN bag b ON b.example_id = q.example_id AND b.path = q.path AND b.kind = k.kind
  UNION ALL SELECT example_id, path, 'group', (p_grp = g_grp AND p_hav IS NOT DISTINCT FROM g_hav)::INT, (p_grp IS NOT NULL)::INT, (g_grp IS NOT NULL)::INT FROM pg
  UNION ALL SELECT example_id, path, 'order', (p_ord = g_ord AND p_lim = g_lim)::INT, (p_ord IS NOT NULL)::INT, (g_ord IS NOT NULL)::INT FROM pg
  UNION ALL SELECT example_id, path, 'and/or', (p_ao = g_ao)::INT, CASE WHEN p_ao = g_ao THEN 1 ELSE len(g_ao) END, CASE WHEN p_ao = g_ao THEN 1 ELSE len(p_ao) END FROM pg),
ls AS (SELECT example_id, path, kind AS type, coalesce(pt = lt AND coalesce(hits, 0) = pt, false)::INT AS ok, lt, pt FROM lo),
good AS (SELECT l.example_id, l.path, bool_and(l.ok = 1) AND any_value(g_tabs IS NULL OR coalesce(g_tabs = p_tabs, false)) AND any_value(p_ops = g_ops) AS good
         FROM ls l JOIN pg USING (example_id, path) GROUP BY ALL),
ex AS (SELECT a.example_id, a.path, bool_and(b.good)::INT AS exact FROM good a JOIN good b
       ON b.example_id = a.example_id AND (b.path = a.path OR starts_with(b.path, a.path || '/')) GROUP BY ALL),
iu AS (SELECT p.example_id, p.path, len(p_ops) AS pt, len(g_ops) AS lt,
         coalesce((SELECT sum(exact) FROM ex e WHERE e.example_id = p.example_id AND list_contains(list_transform(list_intersect(p_ops, g_ops), lambda o: p.path || '/' || o), e.path)), 0) AS hits FROM pg p),
ps AS (SELECT example_id, type, ok, CAST(lt AS INT) AS label_total, CAST(pt AS INT) AS pred_total FROM ls WHERE path = ''
       UNION ALL SELECT example_id, 'IUEN', (pt = lt AND hits = pt)::INT, lt, pt FROM iu WHERE path = '')"""
D_COMP = "WITH RECURSIVE " + D_PARSED + ",\n" + _duck_components()
D_SCORES = pc.D_CANON + ",\n" + D_PARSED + ",\n" + _duck_components() + D_BLIND + D_COLUMNS + D_MATCH
_OUT = ("example_id", "side", "path", "clause", "pos")


@register("e1_explode_components", sql=D_COMP + """
SELECT example_id, side, path, clause, pos, word, agg, not_op, op, uop, a1, c1, d1, a2, c2, d2,
  CASE WHEN NOT q1 THEN v1 END AS v1, CASE WHEN NOT q2 THEN v2 END AS v2 FROM comp""")
def e1_explode_components(spark, d):
    c = sc.components(_tree(spark, d))
    plain = lambda n: F.when(~F.coalesce(F.col(f"q{n}"), F.lit(False)), F.col(f"v{n}")).alias(f"v{n}")
    return c.select(*_OUT, "word", "agg", "not_op", "op", "uop", "a1", "c1", "d1", "a2", "c2", "d2", plain(1), plain(2))


@register("e2_nested_queries", sql=D_COMP + """
SELECT example_id, path, scope, CAST(json_array_length(q, '$.select[1]') AS INT) AS n_select, json_extract_string(q, '$.from.table_units[0][1]') AS first_table
FROM scoped WHERE side = 'gold' AND path <> ''""")
def e2_nested_queries(spark, d):
    t = _tree(spark, d).where("side = 'gold' and path <> ''")
    return t.select("example_id", "path", "scope", F.size(sc._arr(F.col("q"), "$.select[1]")).alias("n_select"),
                    F.try_variant_get("q", "$.from.table_units[0][1]", "string").alias("first_table"))


@register("e3_blind_values", sql=D_COMP + D_BLIND + f"""
SELECT example_id, side, path, clause, pos, op, v1 IS NOT NULL AS has_v1, v2 IS NOT NULL AS has_v2 FROM bv WHERE {_COND}""")
def e3_blind_values(spark, d):
    c = sc.blind_values(sc.components(_tree(spark, d))).where(_COND)
    return c.select(*_OUT, "op", F.col("v1").isNotNull().alias("has_v1"), F.col("v2").isNotNull().alias("has_v2"))


@register("e4_blind_distinct", sql=D_COMP + D_BLIND + """
SELECT example_id, side, path, clause, pos, word, d1, d2 FROM bd WHERE clause IN ('select', 'distinct')""")
def e4_blind_distinct(spark, d):
    c = sc.blind_distinct(sc.blind_values(sc.components(_tree(spark, d))))
    return c.where("clause in ('select', 'distinct')").select(*_OUT, "word", "d1", "d2")


@register("e5_canonical_columns", sql=pc.D_CANON + ",\n" + D_PARSED + ",\n" + _duck_components() + D_BLIND + D_COLUMNS + """
SELECT example_id, side, path, clause, pos, c1, c2 FROM cc WHERE c1 IS NOT NULL AND clause <> 'from'""")
def e5_canonical_columns(spark, d):
    c = sc.prepared(_tree(spark, d, columns=True), _canon(spark, d))
    return c.where("c1 is not null and clause <> 'from'").select(*_OUT, "c1", "c2")


def _scored(spark, d):
    gold, pred = parsed(spark, d)
    return sc.score_examples(gold, pred, _canon(spark, d))


def _component(name: str, types: list[str]):
    listed = ", ".join(f"'{t}'" for t in types)

    @register(name, sql=D_SCORES + f"\nSELECT example_id, type, ok AS acc, ok AS rec, ok AS f1, label_total, pred_total FROM ps WHERE type IN ({listed})")
    def run(spark, d):
        rows = _scored(spark, d).select("example_id", F.inline("partial")).where(F.col("type").isin(*types))
        return rows.select("example_id", "type", "acc", "rec", "f1", "label_total", "pred_total")
    return run


_component("e6_match_select", ["select", "select(no AGG)"])
_component("e7_match_where", ["where", "where(no OP)"])
_component("e8_match_group", ["group(no Having)"])
_component("e9_match_having", ["group"])
_component("e10_match_order", ["order"])
_component("e11_match_and_or", ["and/or"])
_component("e12_match_set_ops", ["IUEN"])
_component("e13_match_keywords", ["keywords"])
_component("e15_partial_scores", sc.PARTIAL_TYPES)


def _d_list(path):
    return f"coalesce(CAST(json_extract(gold_json, '{path}') AS JSON[]), [])"


def _d_even(l):
    return f"list_filter({l}, lambda x, i: i % 2 = 1)"


def _d_odd(l):
    return f"list_filter({l}, lambda x, i: i % 2 = 0)"


def _d_first_nonzero(l):
    # first element not 0: agg ids, NOT flags, and connector strings all count
    return (f"len(list_filter({l}, lambda u: json_type(u) = 'VARCHAR' OR "
            f"(json_type(json_extract(u, '$[0]')) IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND CAST(json_extract(u, '$[0]') AS DOUBLE) <> 0) OR "
            f"(json_type(json_extract(u, '$[0]')) = 'BOOLEAN' AND CAST(json_extract(u, '$[0]') AS BOOLEAN))))")


def _hardness_sql():
    w, grp, hav, fc = _d_list("$.where"), _d_list("$.groupBy"), _d_list("$.having"), _d_list("$.from.conds")
    sel, order_units = _d_list("$.select[1]"), _d_list("$.orderBy[1]")
    units = f"list_concat({_d_even(fc)}, {_d_even(w)}, {_d_even(hav)})"
    conns = f"list_concat({_d_odd(fc)}, {_d_odd(w)}, {_d_odd(hav)})"
    n_tu = "coalesce(json_array_length(gold_json, '$.from.table_units'), 0)"
    not_null = lambda k: f"(coalesce(json_type(json_extract(gold_json, '$.{k}')), 'NULL') <> 'NULL')::INT"
    order_cols = (f"list_concat(list_filter(list_transform({order_units}, lambda v: json_extract(v, '$[1]')), "
                  f"lambda x: coalesce(json_type(x), 'NULL') <> 'NULL'), list_filter(list_transform({order_units}, "
                  f"lambda v: json_extract(v, '$[2]')), lambda x: coalesce(json_type(x), 'NULL') <> 'NULL'))")
    c1 = (f"(len({w}) > 0)::INT + (len({grp}) > 0)::INT + (coalesce(json_array_length(gold_json, '$.orderBy'), 0) > 0)::INT"
          f" + {not_null('limit')} + CASE WHEN {n_tu} > 0 THEN {n_tu} - 1 ELSE 0 END"
          f" + len(list_filter({conns}, lambda c: json_extract_string(c, '$') = 'or'))"
          f" + len(list_filter({units}, lambda u: CAST(json_extract(u, '$[1]') AS INTEGER) = 9))")
    c2 = (f"len(list_filter({units}, lambda u: json_type(json_extract(u, '$[3]')) = 'OBJECT'))"
          f" + len(list_filter({units}, lambda u: json_type(json_extract(u, '$[4]')) = 'OBJECT'))"
          f" + {not_null('intersect')} + {not_null('except')} + {not_null('union')}")
    agg = (f"{_d_first_nonzero(sel)} + {_d_first_nonzero(_d_even(w))} + {_d_first_nonzero(grp)}"
           f" + {_d_first_nonzero(order_cols)} + {_d_first_nonzero(hav)}")
    others = f"({agg} > 1)::INT + (len({sel}) > 1)::INT + (len({w}) > 1)::INT + (len({grp}) > 1)::INT"
    return ("WITH pq AS (SELECT * FROM (" + parsed_sql() + ") WHERE json_valid(gold_json)),\n"
            f"hc AS (SELECT example_id, {c1} AS c1, {c2} AS c2, {others} AS others FROM pq),\n"
            "hd AS (SELECT example_id, CASE WHEN c1 <= 1 AND others = 0 AND c2 = 0 THEN 'easy' "
            "WHEN (others <= 2 AND c1 <= 1 AND c2 = 0) OR (c1 <= 2 AND others < 2 AND c2 = 0) THEN 'medium' "
            "WHEN (others > 2 AND c1 <= 2 AND c2 = 0) OR (c1 > 2 AND c1 <= 3 AND others <= 2 AND c2 = 0) "
            "OR (c1 <= 1 AND others = 0 AND c2 <= 1) THEN 'hard' ELSE 'extra' END AS hardness FROM hc)\n"
            "SELECT hardness, count(*) AS n FROM hd GROUP BY hardness")



D_HARD = _hardness_sql()


@register("e14_exact_match", sql=D_SCORES + ",\nhq AS (" + D_HARD.replace("\nSELECT hardness, count(*) AS n FROM hd GROUP BY hardness", "\nSELECT * FROM hd")
          + ")\nSELECT e.example_id, hardness, exact FROM ex e JOIN hq USING (example_id) WHERE path = ''")
def e14_exact_match(spark, d):
    return _scored(spark, d).select("example_id", "hardness", "exact")


@register("e17_hardness", sql=D_HARD)
def e17_hardness(spark, d):
    return sc.hardness(parsed(spark, d)[0]).groupBy("hardness").agg(F.count(F.lit(1)).alias("n"))


# Execution match over result sets derived from the data. For every
# order, the gold result is its line-item quantities in line order, with a NULL
# for returned items; the prediction's result carries an injected change chosen
# by the customer key: none, a wrong value, an extra row, reversed row order,
# no result (the predicted query failed), or whole numbers written without a
# fraction (equal), the same digits as a text (not equal), or whole numbers just
# above 2^53 of which the prediction's first is one less (not equal, though both
# are the same double). Orders without items have two empty results.
RESULTS_SQL = """
WITH li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity, o_custkey % 8 AS m
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 11 <> 0),
r AS (SELECT l_orderkey AS example_id, m, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS v,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) - 1 AS rn,
             count(*) OVER (PARTITION BY l_orderkey) AS n FROM li)
SELECT example_id, 'gold' AS side, 'qty' AS unit_key, CAST(rn AS BIGINT) AS row_no,
       CASE WHEN m = 7 THEN CAST(9007199254740993 + 2 * CAST(v AS BIGINT) AS STRING) ELSE CAST(v AS STRING) END AS value, 'number' AS kind FROM r
UNION ALL
SELECT example_id, 'pred', 'qty', CAST(CASE WHEN m = 3 THEN n - 1 - rn ELSE rn END AS BIGINT),
       CASE WHEN m = 1 AND rn = 0 THEN 'changed' WHEN m = 5 THEN CAST(CAST(v AS BIGINT) AS STRING)
            WHEN m = 7 THEN CAST(9007199254740993 + 2 * CAST(v AS BIGINT) - CASE WHEN rn = 0 THEN 1 ELSE 0 END AS STRING)
            ELSE CAST(v AS STRING) END,
       CASE WHEN m = 6 OR m = 1 AND rn = 0 THEN 'text' ELSE 'number' END FROM r WHERE m <> 4
UNION ALL
SELECT example_id, 'pred', 'qty', CAST(n AS BIGINT), '0.0', 'number' FROM r WHERE m = 2 AND rn = 0"""
EXECUTED_SQL = "SELECT o_orderkey AS example_id, o_custkey % 8 <> 4 AS pred_ok FROM orders"


def _duck_exec(ordered: bool) -> str:
    n, place = int(ordered), "row_no" if ordered else "0"
    return (f"v{n} AS (SELECT example_id, side, list_sort(list({{'k': {place}, 'u': unit_key, 'n': CASE WHEN kind = 'number' THEN CAST(value AS DECIMAL(38, 6)) END, "
            f"'s': CASE WHEN kind = 'text' THEN value END}})) AS whole FROM res GROUP BY ALL),\n"
            f"m{n} AS (SELECT x.example_id, pred_ok AND p.whole IS NOT DISTINCT FROM g.whole AS ok FROM xq x "
            f"LEFT JOIN (SELECT * FROM v{n} WHERE side = 'pred') p USING (example_id) LEFT JOIN (SELECT * FROM v{n} WHERE side = 'gold') g USING (example_id))")


D_EXEC = "res AS (" + RESULTS_SQL + "),\nxq AS (" + EXECUTED_SQL + "),\n" + _duck_exec(True) + ",\n" + _duck_exec(False)


def _executed(spark, d, ordered=True):
    res = fx.spark_sql(spark, d, RESULTS_SQL, ("orders", "lineitem"))
    return sc.execution_match(res, ordered, fx.spark_sql(spark, d, EXECUTED_SQL, ("orders",)))


@register("e16_execution_match", sql="WITH " + D_EXEC
          + "\nSELECT m1.example_id, m1.ok AS exec_ordered, m0.ok AS exec_unordered FROM m1 JOIN m0 USING (example_id)")
def e16_execution_match(spark, d):
    return (_executed(spark, d).withColumnRenamed("exec_match", "exec_ordered")
            .join(_executed(spark, d, ordered=False).withColumnRenamed("exec_match", "exec_unordered"), "example_id"))


D_ROLLUP = D_SCORES + ",\nhq AS (" + D_HARD.replace("\nSELECT hardness, count(*) AS n FROM hd GROUP BY hardness", "\nSELECT * FROM hd") + "),\n" + D_EXEC + """,
sr AS (SELECT p.*, e.exact, m1.ok AS ran, h.hardness FROM ps p JOIN (SELECT * FROM ex WHERE path = '') e USING (example_id)
       JOIN hq h USING (example_id) LEFT JOIN m1 USING (example_id)),
lv AS (SELECT *, hardness AS level FROM sr UNION ALL SELECT *, 'all' FROM sr),
ag AS (SELECT level, type, count(*) AS n, avg(exact) AS exact, avg(coalesce(ran, false)::INT) AS ran,
         coalesce(avg(ok) FILTER (pred_total > 0), 0) AS acc, coalesce(avg(ok) FILTER (label_total > 0), 0) AS rec FROM lv GROUP BY ALL),
ru AS (SELECT level, type, coalesce(n, 0) AS count, round(coalesce(exact, 0), 6) AS exact, round(coalesce(ran, 0), 6) AS exec,
         round(coalesce(acc, 0), 6) AS acc, round(coalesce(rec, 0), 6) AS rec,
         round(CASE WHEN n IS NULL THEN 0 WHEN acc = 0 AND rec = 0 THEN 1 ELSE 2 * acc * rec / (acc + rec) END, 6) AS f1
  FROM (SELECT unnest(['easy', 'medium', 'hard', 'extra', 'all']) AS level) CROSS JOIN (SELECT DISTINCT type FROM ps) LEFT JOIN ag USING (level, type))"""


@register("e18_score_rollup", sql=D_ROLLUP + "\nSELECT * FROM ru")
def e18_score_rollup(spark, d):
    return sc.score_rollup(_scored(spark, d), _executed(spark, d))


_PIVOT = ", ".join(f"max(v) FILTER (level = '{lv}') AS \"{lv}\"" for lv in sc.LEVELS)


@register("e19_score_report", sql=D_ROLLUP + f"""
SELECT block, type, {_PIVOT} FROM (
  SELECT level, 'count' AS block, '' AS type, CAST(count AS DOUBLE) AS v FROM ru WHERE type = 'select'
  UNION ALL SELECT level, 'exec', '', exec FROM ru WHERE type = 'select' UNION ALL SELECT level, 'exact', '', exact FROM ru WHERE type = 'select'
  UNION ALL SELECT level, 'acc', type, acc FROM ru UNION ALL SELECT level, 'rec', type, rec FROM ru UNION ALL SELECT level, 'f1', type, f1 FROM ru)
GROUP BY block, type""")
def e19_score_report(spark, d):
    return sc.score_report(sc.score_rollup(_scored(spark, d), _executed(spark, d)))


@register("e20_parse_failures", sql="WITH " + D_PARSED.split(",\nsd AS", 1)[0]
          + "\nSELECT pj IS NULL AS missing, pred_failed, gold_failed, count(*) AS n FROM af GROUP BY ALL")
def e20_parse_failures(spark, d):
    a = sc.align(*parsed(spark, d))
    return a.groupBy(F.col("pred_json").isNull().alias("missing"), "pred_failed", "gold_failed").agg(F.count(F.lit(1)).alias("n"))


@register("e21_align_by_id", sql="WITH " + D_PARSED.split(",\nsd AS", 1)[0]
          + "\nSELECT example_id, db_id, pj IS NULL AS missing, pred_failed, gold_failed FROM af")
def e21_align_by_id(spark, d):
    a = sc.align(*parsed(spark, d))
    return a.select("example_id", "db_id", F.col("pred_json").isNull().alias("missing"), "pred_failed", "gold_failed")


# Clause usage over raw SQL text, per database (SQL-checkable).
PROFILE_RULES = {
    "n_join": r"(?i)\bJOIN\b",
    "n_aggregate": r"(?i)\b(count|sum|avg|min|max)\s*\(",
    "n_set_op": r"(?i)\b(UNION|INTERSECT|EXCEPT)\b",
    "n_nested": r"(?i)\(\s*SELECT\b",
    "n_limit": r"(?i)\bLIMIT\b",
    "n_group_by": r"(?i)\bGROUP\s+BY\b",
    "n_order_by": r"(?i)\bORDER\s+BY\b",
}


@register("e22_corpus_profile", sql=f"WITH c AS ({fx.corpus_sql()}) SELECT db_id, count(*) AS n_queries, "
          + ", ".join(f"CAST(sum(len(regexp_extract_all(raw_output, '{p}'))) AS BIGINT) AS {k}" for k, p in PROFILE_RULES.items())
          + " FROM c GROUP BY db_id")
def e22_corpus_profile(spark, d):
    c = fx.corpus(spark, d)
    return c.groupBy("db_id").agg(F.count(F.lit(1)).alias("n_queries"), *[
        F.sum(F.regexp_count("raw_output", F.lit(p))).cast("long").alias(k) for k, p in PROFILE_RULES.items()])
