"""Merkle fingerprints, divergence rules and language identification."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from sqlkiln.llm import langid, merkle, quality


def test_edited_texts_and_order(make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    got = merkle.fingerprints(make_docs(rows)).collect()
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    expect = Counter()
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        expect[i, len(t), hashlib.sha256((t[:len(t) - h] + nxt[:h]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expect
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[5].fingerprint == by[6].fingerprint != by[7].fingerprint
    assert by[5].near_next == 1.0 and by[2].near_next == 1.0 and all(0 <= r.near_edited <= 1 for r in got)


def test_many_partitions_agree(make_docs, sentence, spark):
    rows = [(i * 7 % 101, sentence(i, 30), "en", "s") for i in range(101)] + [(None, "no id", "en", "s")]
    docs = make_docs(rows)
    key = lambda df: sorted((str(r.doc_id), r.edited_sha256, r.near_edited, r.near_next) for r in df.collect())
    one = key(merkle.fingerprints(docs.coalesce(1)))
    many = key(merkle.fingerprints(docs.repartition(17)))
    assert one == many and len(one) == 102
    assert merkle.fingerprints(make_docs([])).count() == 0 and merkle.fingerprints(make_docs(rows[:1])).count() == 1


def test_tree_locates_an_edit_and_measures_likeness(sentence):
    paragraphs = [sentence(i, 40) for i in range(60)]
    a = merkle.Tree("\n".join(paragraphs))
    changed = list(paragraphs)
    changed[33] = sentence(999, 40)
    b = merkle.Tree("\n".join(changed))
    assert merkle.changed_paragraphs(a, b) == [33] and a.root != b.root
    assert 0.95 < merkle.likeness(a, b) < 1 and merkle.likeness(a, merkle.Tree("\n".join(paragraphs))) == 1.0
    assert merkle.Tree("x").root != merkle.Tree("x ").root != merkle.Tree("x\n").root
    assert merkle.likeness(merkle.Tree(""), merkle.Tree("a b")) == 0.0


@pytest.mark.parametrize("text", ["", " ", "a  b", "one two three " * 9, "x"])
def test_phrases_join_back(text):
    assert " ".join(merkle.phrases(text)) == text


def base(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = {k + d for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_base_figures(make_docs, odd_rows, sentence):
    rows = odd_rows + [(20, ("a b c d\n" * 40) + " \t\n \n# x <b>|", "en", "s"), (21, "été ñ 世界 x\x85y " * 30, "fr", "s"), (22, "aa bb cc aa bb cc", "en", "s")]
    got = {r.doc_id: r for r in quality.quality(make_docs(rows)).collect()}
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), i
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality.quality(make_docs([])).count() == 0


def test_divergent_texts_go_and_clean_ones_stay(make_docs, sentence):
    clean = [(i, ("The " + sentence(i, 110) + ". ") * 1, "en", "s") for i in range(60)]
    junk = [(100 + i, " ".join(w + "$%#" for w in sentence(500 + i, 110).split()), "en", "s") for i in range(4)]
    got = {r.doc_id: r.kept for r in quality.quality(make_docs(clean + junk)).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)


def test_js_distance():
    p, q = np.array([[1.0, 1, 0], [1, 0, 0], [0, 0, 0]]), np.array([1.0, 1, 0])
    d = quality.js_distance(p, q)
    assert d[0] == 0 and 0 < d[1] < 1 and d[2] == 1
    assert quality.js_distance(np.array([[5.0, 0]]), np.array([0.0, 3]))[0] == 1


def test_labelled_junk_is_told_from_clean(spark):
    d = "/root/testdata/sf0.01"
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in quality.quality(spark.read.parquet(f"{d}/documents.parquet")).collect() if not r.base_failed and r.doc_id in lab]
    clean = [r.kept for r in rows if lab[r.doc_id] == 1]
    junk = [r.kept for r in rows if lab[r.doc_id] == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.1 * len(junk)


def test_tabulated_scorer_equals_the_network():
    net = langid.ByteCNN(3, seed=1)
    x = np.random.default_rng(0).integers(1, 255, (5, langid.WINDOW)).astype(np.uint8)
    wide = np.zeros((5, langid.WINDOW + 2), int)
    wide[:, :langid.WINDOW] = x
    pooled = []
    for w, t in zip(langid.WIDTHS, net.t):
        n = langid.WINDOW - 1
        pooled.append(sum(t[j][wide[:, j:j + n]] for j in range(w)).max(axis=1))
    h = np.maximum(np.concatenate(pooled, axis=1), 0)
    z = h @ net.out + net.bias
    p = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(langid.Scorer(net).probabilities(x), p / p.sum(1, keepdims=True), atol=1e-4)


def test_gradients_match_differences():
    net = langid.ByteCNN(3, seed=2)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 255, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss, grads = net.gradients(x, y)
    for p, g in zip(net.params(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = net.gradients(x, y)[0]
        p[at] = old - 1e-2
        down = net.gradients(x, y)[0]
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_language_accuracy_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    true = [(r.lang, got[r.doc_id]) for r in docs.select("doc_id", "lang").collect() if r.lang]
    held = [lang == g.lang_pred for lang, g in true if g.held_out]
    assert len(held) > 150 and np.mean(held) >= 0.97
    assert all(0 <= g.score <= 1 for _, g in true)


def test_language_of_odd_rows(make_docs, odd_rows, sentence):
    rows = odd_rows + [(30, "123 -- 456", "en", "s")]
    got = {r.doc_id: r for r in langid.identify(make_docs(rows)).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4, 30)] == ["und"] * 4 and got[2].score == 0
    assert got[7].lang_pred != "und" and len(got) == len({r[0] for r in rows})
    none = langid.identify(make_docs([(1, "some text", None, "s")])).first()
    assert none.lang_pred == "und" and langid.identify(make_docs([])).count() == 0


def test_number_signs_are_no_letters():
    assert not any(langid.has_letter(x) for x in ("½ ²", "Ⅷ", "٣ 12_", "", None))
    assert langid.has_letter("½ ª") and langid.has_letter("Ⅷ x")
