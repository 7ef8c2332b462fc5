"""Each stage of the pipeline against brute force over its own input (sf0.001)."""

import numpy as np
import pytest

import corpus_pipeline as cp
from sqlkiln.llm import packing
from test_lines_mixing import brute_kept, words
from test_minhash import brute, shingles

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, D)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen[name] = ({r.doc_id: r for r in docs.collect()}, out.collect())
        assert name == "pack_sequences" or out.columns == columns
        docs = out

    before, after = seen["quality_rules"]
    assert 0 < len(after) < len(before) and all(r == before[r.doc_id] for r in after)
    assert all(len(r.text.encode().split()) >= 50 for r in after)

    before, after = seen["line_dedup"]
    kept = brute_kept([(i, r.text) for i, r in before.items()])
    expect = {}
    for i, r in before.items():
        text = "\n".join(x for n, x in enumerate(r.text.split("\n")) if not words(x) or (i, n) in kept)
        if text.encode().split():
            expect[i] = text
    assert {r.doc_id: r.text for r in after} == expect and all(r.n_chars == len(r.text) for r in after)

    before, after = seen["near_dedup"]
    comp = brute([(i, r.text) for i, r in before.items()], pct=80)
    assert {r.doc_id for r in after} == {i for i, (_, c) in comp.items() if c == i}

    before, after = seen["mix_sources"]
    assert {r.doc_id for r in after} <= set(before) and len({r.doc_id for r in after}) == len(after)
    tokens = lambda rows: sum(len(r.text.encode().split()) for r in rows)
    assert tokens(after) >= tokens(before.values()) * cp.BUDGET_PERMILLE // 1000

    before, after = seen["pack_sequences"]
    assert {r.doc_id for r in after} == set(before)
    pieces, filled = {}, {}
    for r in sorted(after, key=lambda r: (r.doc_id, r.piece)):
        pieces.setdefault(r.doc_id, []).append(r.length)
    assert all(p == packing.cut(sum(p), cp.CAPACITY) for p in pieces.values())
    for r in sorted(after, key=lambda r: r.offset):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= cp.CAPACITY


def test_quality_rules_equal_brute_force(spark, make_docs, sentence):
    """Base rules by counting, distances by histograms that are added up anew."""
    import math
    from collections import Counter
    from sqlkiln.llm import quality
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    docs += [(9001, sentence(5, 60), None, "s"), (9002, None, "en", "s"), (9003, "", "en", "s"), (9004, "na " * 200, "en", "s")]
    split = lambda t: t.encode().split() if t else []

    def base_failed(t):
        w = split(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        repeat = {k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(i, i + 3)}
        return len(w) < 50 or 100 * len(repeat) > 50 * len(w)

    def classes(t):
        return np.array(quality.base_and_histograms(t, np.empty(0, np.uint64))[-2], float)

    def js(p, q):
        if not sum(p) or not sum(q):
            return 1.0
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        kl = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x)
        return math.sqrt(max(0.0, (kl(p, q) + kl(q, p)) / 2))

    langs = sorted({x[2] for x in docs if x[2]})
    top, refs = {}, {}
    for lang in langs:
        counts = Counter(w for _, t, x, _ in docs if x == lang for w in split(t))
        top[lang] = [w for w, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:quality.COMMON_WORDS]]
        good = [t for _, t, x, _ in docs if x == lang and not base_failed(t)]
        words = Counter(w for t in good for w in split(t))
        own = [words[w] for w in top[lang]]
        refs[lang] = (sum(classes(t) for t in good), [*own, sum(words.values()) - sum(own)])
    expect = {}
    for i, t, lang, _ in docs:
        w, c = Counter(split(t)), classes(t)
        n = sum(w.values())
        near = []
        for x in [lang] if lang in refs else langs:
            own = [w[k] for k in top[x]]
            near.append((js(c, refs[x][0]), js([*own, n - sum(own)], refs[x][1])))
        d_char, d_word = (min(v) for v in zip(*near))
        far = (d_char > quality.MAX_CHAR_DISTANCE and c.sum() >= quality.MIN_CHARS) or (d_word > quality.MAX_WORD_DISTANCE and n >= quality.MIN_WORDS)
        expect[i] = (base_failed(t), not base_failed(t) and not far, d_char, d_word)
    table = make_docs(docs)
    for r in quality.quality(table).collect():
        failed, kept, d_char, d_word = expect[r.doc_id]
        assert (r.base_failed, r.kept) == (failed, kept)
        assert abs(r.char_distance - d_char) < 1e-9 and abs(r.word_distance - d_word) < 1e-9
    assert {r.doc_id for r in cp.quality_rules(spark, table, D).collect()} == {i for i, e in expect.items() if e[1]}


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, make_docs, odd_rows, name, stage):
    docs = make_docs(odd_rows)
    out = stage(spark, docs, D)
    rows = out.collect()
    if name != "pack_sequences":
        assert out.columns == docs.columns
    kept = {r.doc_id for r in rows}
    if name == "quality_rules":
        assert None not in kept and {1, 5, 6} <= kept and not kept & {2, 3, 4, 8, 9}
    elif name == "line_dedup":
        assert {1, 7, 8, 9, None} <= kept and not kept & {2, 3, 4, 5, 6}
    elif name == "near_dedup":
        assert {1, 2, 3, 4, 7, 8, 9, None} == kept
    elif name == "mix_sources":
        assert kept <= {1, 5, 6, 7, 8, 9}
    else:
        assert len({(r.doc_id, r.sequence_id, r.offset) for r in rows if r.piece == 0}) == len(odd_rows)
    assert stage(spark, make_docs([]), D).count() == 0


def test_near_dedup_takes_pairs_from_080(spark, make_docs, sentence):
    base = sentence(1, 160).split()
    edited = lambda n: " ".join(f"edit{i}" if i in range(20, 20 + 20 * n, 20) else w for i, w in enumerate(base))
    rows = [(1, " ".join(base)), (2, edited(3)), (3, edited(5)), (4, sentence(2, 160))]
    similarity = [100 * len(shingles(rows[0][1]) & shingles(t)) / len(shingles(rows[0][1]) | shingles(t)) for _, t in rows]
    assert 80 <= similarity[1] < 85 and similarity[2] < 80
    expect = {i for i, (_, c) in brute(rows, pct=80).items() if c == i}
    assert 2 not in expect
    out = cp.near_dedup(spark, make_docs([(i, t, "en", "s") for i, t in rows]), D)
    assert {r.doc_id for r in out.collect()} == expect


def test_mix_sources_cuts_the_last_document_of_a_leaf(spark, make_docs, sentence):
    rows = [(i, " \t" + sentence(i, 10 + i % 7).replace(" ", "  \n", 3) + " ", "en", "src0" if i % 3 else "src1") for i in range(60)]
    rows.append((60, sentence(60, 5000), "de", "src2"))
    docs = make_docs(rows)
    out = cp.mix_sources(spark, docs, D)
    assert out.columns == docs.columns
    got, size = out.collect(), lambda t: len(t.split())
    full = {i: t for i, t, *_ in rows}
    assert sum(size(r.text) for r in got) == sum(map(size, full.values())) * cp.BUDGET_PERMILLE // 1000
    assert all(full[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in got)
    assert 0 < sum(r.text != full[r.doc_id] for r in got) <= 3
