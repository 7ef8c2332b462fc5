"""Near-duplicates against brute force over all pairs."""

import itertools
import random

import numpy as np
import pytest

from sqlkiln.llm import minhash
from sqlkiln.llm.shingles import shingle_set


def shingles(text, width=5):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, pct=85):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def mutants(sentence, seed, copies, edits, n=160):
    r = random.Random(seed)
    base = sentence(seed, n).split()
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(n)] = f"edit{r.randrange(10**6)}"
        yield " ".join(w)


def test_equals_brute_force_with_a_chained_group(make_docs, sentence):
    texts = [t for s in range(6) for t in mutants(sentence, s, 12, 4)] + [sentence(100 + i, 50) for i in range(20)]
    texts += [sentence(100, 50)] * 4 + ["two words", "Two WORDS", "other words"] + [sentence(50, 4)] * 2
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           minhash.near_duplicates(make_docs([(i, t, "en", "s") for i, t in rows])).collect()}
    assert got == brute(rows)


def test_odd_rows_have_defined_results(make_docs, odd_rows):
    rows = minhash.near_duplicates(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows}
    assert [by[i].component_id for i in (1, 5, 6)] == [1, 1, 1] and not by[5].kept
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (2, 3, 4))
    assert by[None].component_id is None and by[None].kept


def test_empty_table(make_docs):
    assert minhash.near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize("n", [1, 3, 17, 400])
def test_densified_signature_has_no_empty_bin_and_equal_sets_agree(n, sentence):
    s = shingle_set(sentence(n, n + 4))
    v = minhash.signature(s)
    assert len(v) == minhash.BINS and np.isin(v, s).all()
    assert (minhash.band_keys(s) == minhash.band_keys(s.copy())).all()


def test_band_agreement_estimates_similarity(sentence):
    a = shingle_set(sentence(3, 3000))
    b = np.union1d(a[: int(len(a) * 0.9)], shingle_set(sentence(4, 300)))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - j) < 0.15


def test_two_texts_of_one_doc_id_in_any_order(make_docs, sentence):
    a, b = sentence(1, 60), sentence(2, 60)
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, b, "en", "s")]
    results = [sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(make_docs(x)).collect()) for x in (rows, rows[::-1])]
    assert results[0] == results[1] == [(1, 1), (1, 1), (2, 1)]


def test_many_edges_are_not_broadcast_for_the_size_of_their_files(spark, make_docs, sentence, monkeypatch):
    from sqlkiln.llm import common
    base = [sentence(i, 60) for i in range(6)]
    rows = [(10 * i + k, " ".join(t.split()[:60 - k]), "en", "s") for i, t in enumerate(base) for k in range(4)]
    few = sorted(minhash.near_duplicates(make_docs(rows)).collect())
    plans, larges, real, comps = {}, [], minhash.stored, minhash.connected_components
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(minhash, "stored", lambda df, tag: (plans.update({tag: df._jdf.queryExecution().executedPlan().toString()}), real(df, tag))[1])
    monkeypatch.setattr(minhash, "connected_components", lambda *a: (larges.append(a[3]), comps(*a))[1])
    many = minhash.near_duplicates(make_docs(rows))
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(many.collect()) == few and len({r.component_id for r in few}) == 6
    assert all(larges) and not any("BroadcastHashJoin" in plans[tag] for tag in ("links", "members"))
