"""Line dedup and mixing against brute force; odd inputs."""

import random

import pytest

from sqlkiln.llm import linededup, mixing
from sqlkiln.llm.queries import DOMAIN


def words(line):
    return set(line.encode().split())


def brute_kept(rows, pct=80, least=1):
    """Places of eligible lines with no similar earlier line."""
    lines = [(i, n, words(x)) for i, t in rows if t is not None and i is not None for n, x in enumerate(t.split("\n"))]
    lines = sorted({(i, n, tuple(sorted(w))) for i, n, w in lines if len(w) >= least})
    kept = set()
    for k, (i, n, w) in enumerate(lines):
        w = set(w)
        if not any(100 * len(w & set(v)) >= pct * len(w | set(v)) for _, _, v in lines[:k]):
            kept.add((i, n))
    return kept


def similar_lines(sentence, seed):
    r = random.Random(seed)
    base = [sentence(seed * 50 + k, r.randint(4, 30)) for k in range(6)]
    out = []
    for _ in range(25):
        x = r.choice(base).split()
        for _ in range(r.randrange(4)):
            x[r.randrange(len(x))] = f"new{r.randrange(99)}"
        r.shuffle(x)
        out.append((r.choice([" ", "  ", "\t"])).join(x))
    return out


def test_first_lines_equal_brute_force(make_docs, sentence):
    rows = []
    for d in range(12):
        rows.append((d * 3, "\n".join(similar_lines(sentence, d % 4) + ["short line", "", "a a a a a a"])))
    got = {(r.doc_id, r.line_no) for r in linededup.first_lines(make_docs([(i, t, "en", "s") for i, t in rows])).collect()}
    assert got == brute_kept(rows)


@pytest.mark.parametrize("least", [1, 5])
def test_first_lines_of_any_size_equal_brute_force(make_docs, sentence, least):
    rows = [(d, "\n".join(similar_lines(sentence, d % 3) + [f"short line {d % 2}", "short", "", "  ", "a a a a a a", "one two three four" + " five" * (d % 2)])) for d in range(6)]
    got = {(r.doc_id, r.line_no) for r in linededup.first_lines(make_docs([(i, t, "en", "s") for i, t in rows]), min_tokens=least).collect()}
    assert got == brute_kept(rows, least=least)


def test_a_group_of_near_copies_gives_few_candidates(make_docs, sentence, monkeypatch):
    """Candidates grow with the lines, not with the pairs, of near copies of one line."""
    counts, plain = [], linededup._verified

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return plain(pairs, *rest)
    monkeypatch.setattr(linededup, "_verified", counted)
    base = sentence(77, 30).split()
    lines = [" ".join(w if i != k % 30 else f"other{k}" for i, w in enumerate(base)) for k in range(400)]
    rows = [(k, "\n".join(lines[k * 4:k * 4 + 4])) for k in range(100)]
    got = {(r.doc_id, r.line_no) for r in linededup.first_lines(make_docs([(i, t, "en", "s") for i, t in rows])).collect()}
    assert got == brute_kept(rows) == {(0, 0)}
    assert sum(counts) <= 2 * 400


def test_lines_similar_to_a_removed_line_only(make_docs):
    """Each line is like the one before it, but not like the first: all but the first go."""
    w = [f"w{i:03d}" for i in range(80)]
    chain = [" ".join(w[k:k + 20]) for k in range(0, 40, 2)]
    rows = [(k, x) for k, x in enumerate(chain)]
    got = {(r.doc_id, r.line_no) for r in linededup.first_lines(make_docs([(i, t, "en", "s") for i, t in rows])).collect()}
    assert got == brute_kept(rows) == {(0, 0)}


def test_dedup_keeps_columns_and_order(make_docs, sentence):
    a, b, c = (sentence(i, 12) for i in (1, 2, 3))
    rows = [(2, f"{a}\nhi\n\n{b}\nhi", "en", "s"), (1, f"{c}\n{a}", "en", "s"), (3, a, "en", "s"), (4, None, "en", "s"), (5, "", None, None), (None, a, "en", "s")]
    docs = make_docs(rows)
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: f"{c}\n{a}", 2: f"hi\n\n{b}", 3: "", 4: None, 5: "", None: a}


def test_two_texts_of_one_doc_id(make_docs, sentence):
    a, b, c, d = (sentence(i, 12) for i in (1, 2, 3, 4))
    rows = [(1, f"{a}\n{b}\n{c}\n{d}", "en", "s"), (1, d, "en", "s"), (1, d, "en", "s"), (2, f"{b}\nx", "en", "s")]
    got = sorted((r.doc_id, r.n_lines, r.n_eligible, r.n_removed) for r in linededup.line_report(make_docs(rows)).collect())
    lost = sum(r[3] for r in got if r[0] == 1)
    assert [r[:3] for r in got] == [(1, 1, 1), (1, 1, 1), (1, 4, 4), (2, 2, 2)] and got[3][3] == 1 and lost in (1, 2)
    texts = sorted(r.text for r in linededup.dedup_lines(make_docs(rows)).collect())
    assert "x" in texts and sum(d in t for t in texts) in (1, 2)


def test_report_of_odd_rows(make_docs, odd_rows):
    rows = linededup.line_report(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_eligible, by[1].n_removed, by[1].kept_lines) == (1, 0, "0")
    assert by[5].n_removed == 1 and by[2].n_lines == 0 and by[3].n_lines == 1 and by[None].n_removed == 0
    assert by[7].n_eligible == 120 and by[7].n_removed == 0 and by[8].n_eligible == 1
    assert linededup.line_report(make_docs([])).count() == 0


def water_fill(budget, children):
    """Share by weight with caps, exact up to single tokens."""
    grant = {k: 0.0 for k in children}
    left, active = min(budget, sum(c for w, c in children.values() if w)), {k for k, (w, c) in children.items() if w and c}
    while active and left > 1e-9:
        total = sum(children[k][0] for k in active)
        step = min(left / total, min((children[k][1] - grant[k]) / children[k][0] for k in active))
        for k in active:
            grant[k] += step * children[k][0]
        left -= step * total
        active = {k for k in active if children[k][1] - grant[k] > 1e-9}
    return grant


def test_share_is_a_water_filling(spark):
    r = random.Random(3)
    rows, expect = [], {}
    for p in range(40):
        kids = {f"c{k}": (r.choice([0, 1, 2, 5, 9]), r.choice([0, 3, 50, 400, 3000])) for k in range(r.randint(1, 7))}
        budget = r.choice([0, 7, 100, 1000, 10**5])
        rows += [(p, k, w, c, budget) for k, (w, c) in kids.items()]
        expect |= {(p, k): v for k, v in water_fill(budget, kids).items()}
    df = spark.createDataFrame(rows, "p int, name string, weight long, capacity long, given long")
    got = mixing.share(df, ["p"], "given", ["name"]).collect()
    sums = {}
    for x in got:
        assert abs(x.granted - expect[x.p, x.name]) <= 1 + 1e-6 and 0 <= x.granted <= x.capacity
        sums[x.p] = sums.get(x.p, 0) + x.granted
    for p in sums:
        own = [x for x in rows if x[0] == p]
        assert sums[p] == min(own[0][4], sum(c for _, _, w, c, _ in own if w))


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 100), ("a", "en", "s2", 5000), ("b", "en", "s3", 9000)],
                                   "domain string, lang string, source string, tokens long")
    got = {r.source: r.granted for r in mixing.leaf_budgets(leaves, 4000, 1, {}).collect()}
    assert got == {"s1": 100, "s2": 1900, "s3": 2000}
    got = {r.source: r.granted for r in mixing.leaf_budgets(leaves.where("source <> 's2'"), 4000, 1, {}).collect()}
    assert got == {"s1": 100, "s3": 3900}


def test_mixture_takes_whole_passes_and_a_prefix(make_docs, sentence):
    rows = [(i, sentence(i, 10 + i % 7), "en", "src0" if i % 3 else "src1") for i in range(90)]
    out = mixing.mix(make_docs(rows), DOMAIN, {("domain0",): 1, ("domain1",): 3}, budget_permille=900, max_epochs=2, seed=5).collect()
    total = sum(len(t.split()) for _, t, *_ in rows)
    assert sum(r.take_tokens for r in out) == total * 900 // 1000
    size = {i: len(t.split()) for i, t, *_ in rows}
    for source in ("src0", "src1"):
        own = [r for r in out if r.source == source]
        leaf = {i for i, _, _, s in rows if s == source}
        for epoch in {r.epoch for r in own}:
            part = [r for r in own if r.epoch == epoch]
            assert len({r.doc_id for r in part}) == len(part)
            if epoch < max(r.epoch for r in own):
                assert {r.doc_id for r in part} == leaf
            cut = [r for r in part if r.take_tokens < size[r.doc_id]]
            assert len(cut) <= 1
            if {r.doc_id for r in part} != leaf:
                import hashlib
                order = sorted(leaf, key=lambda i: hashlib.md5(f"5-{epoch}-{i}".encode()).hexdigest())
                assert {r.doc_id for r in part} == set(order[:len(part)])
                assert all(r.doc_id == order[len(part) - 1] for r in cut)


def test_mixing_odd_rows(make_docs, odd_rows):
    out = mixing.mix(make_docs(odd_rows), DOMAIN, {}, budget_permille=1000, max_epochs=1).collect()
    assert sorted(r.doc_id for r in out) == [1, 5, 6, 6, 7, 8, 9]
    assert {(r.doc_id, r.domain, r.lang, r.source) for r in out if r.doc_id in (7, 8)} == {(7, "domain3", "und", "src3"), (8, "unknown", "fr", "unknown")}
    assert mixing.mix(make_docs([]), DOMAIN, {}).count() == 0


@pytest.mark.parametrize("name", ["op4_hierarchical_mixing", "op9_line_dedup"])
def test_equals_oracle_sql(spark, name):
    import duckdb
    from sqlkiln.llm.queries import ORACLE, QUERIES
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    rel = con.execute(ORACLE[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(rel.fetchall())
