"""SimHash with Golay keys, periodic runs and the Merkle manifest against brute force; odd inputs."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash

from sqlkiln.llm import manifest, runs, simhash


# --- SimHash ---------------------------------------------------------------

def plain_fingerprint(text):
    w = text.encode().lower().split() if text else []
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """id -> least id reachable over fingerprints of at most three differing bits."""
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_golay_code_is_perfect():
    words = np.arange(1 << 12, dtype=np.int64) << 11
    code = words | simhash._remainder(words)
    assert (simhash._remainder(code) == 0).all()
    assert min(np.bitwise_count(code[1:])) == 7
    assert (np.bitwise_count(simhash.PATTERNS[:, 0]) <= 3).all()
    assert {len(set(p)) for p in simhash.PATTERNS.tolist()} == {1, 6}


def test_every_pair_within_three_bits_shares_a_posted_key():
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(4)]
    for fp in base:
        pairs = [fp ^ sum(1 << b for b in c) for k in range(4) for c in (itertools.combinations(range(64), k) if k < 3 else
                                                                          [r.sample(range(64), 3) for _ in range(4000)])]
        all_fps = np.array([fp, *pairs], np.uint64).view(np.int64)
        row, key, posted = simhash.bucket_keys(all_fps)
        probes, posts = {}, {}
        for x, k, p in zip(row.tolist(), key.tolist(), posted.tolist()):
            probes.setdefault(x, set()).add(k)
            if p:
                posts.setdefault(x, set()).add(k)
        assert all(posts[0] & probes[i] or posts[i] & probes[0] for i in range(1, len(all_fps)))


def mutants(sentence, seed, copies, edits, n=120):
    r = random.Random(seed)
    base = sentence(seed, n).split()
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(n)] = f"edit{r.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("small", [256, 2])
def test_components_equal_brute_force(make_docs, sentence, monkeypatch, small):
    """``small`` = 2 sends every bucket of three and more through the step for large ones."""
    monkeypatch.setattr(simhash, "SMALL", small)
    texts = [t for s in range(5) for t in mutants(sentence, s, 14, 3)] + [sentence(100 + i, 40) for i in range(10)]
    texts += [sentence(100, 40)] * 3 + ["two words", "Two WORDS", "", None, " \t", "one"]
    rows = list(enumerate(texts))
    random.Random(2).shuffle(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(make_docs([(i, t, "en", "s") for i, t in rows])).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    comp = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", comp[i]) for i, _ in rows}
    assert len(set(comp.values())) < len(comp) - 20


def test_links_of_planted_fingerprints(spark, monkeypatch):
    """Chains of one to four bits: linked up to three, whatever the buckets hold."""
    r = random.Random(9)
    fps = []
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(6):
            fps.append(x)
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
    fps = list(dict.fromkeys(fps))
    expect = brute_components({i: f for i, f in enumerate(fps)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    for small in (256, 2):
        monkeypatch.setattr(simhash, "SMALL", small)
        got = {r.fp: r.comp for r in simhash.fingerprint_components(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
        groups = {}
        for i, f in enumerate(signed):
            groups.setdefault(got.get(f, f), set()).add(i)
        want = {}
        for i, c in expect.items():
            want.setdefault(c, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_odd_rows(make_docs, odd_rows):
    rows = simhash.near_duplicates(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows}
    assert {by[i].component_id for i in (1, 5, 6)} == {1} and by[1].kept and not by[5].kept and by[1].copies == 4
    assert {by[i].component_id for i in (2, 3, 4)} == {2} and by[2].fingerprint == "0" * 16
    assert by[None].component_id is None and by[None].kept
    assert simhash.near_duplicates(make_docs([])).count() == 0
    two = simhash.near_duplicates(make_docs([(1, "a b c d", "en", "s"), (1, "x y z q", "en", "s"), (2, "x y z q", "en", "s")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in two) == [(1, 1), (1, 1), (2, 1)]


# --- runs ------------------------------------------------------------------

def brute_runs(w, least=6, times=4):
    out = set()
    for q in range(1, len(w) // times + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e > s and e - s + q >= max(least, times * q):
                out.add((s, e - s + q, q))
            s = max(e, s + 1)
    smallest = [(s, n, q) for s, n, q in out if all(w[s:s + n - d] != w[s + d:s + n] for d in range(1, q))]
    return sorted(smallest, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (5, 3)])
def test_runs_equal_brute_force(least, times):
    r = random.Random(least)
    for _ in range(1500):
        n, k = r.randrange(50), r.choice([1, 2, 2, 3, 5])
        w = [str(r.randrange(k)) for _ in range(n)]
        if n and r.random() < 0.6:
            a, p = r.randrange(n), r.randint(1, 7)
            w[a:] = [w[min(a + i % p, n - 1)] for i in range(n - a)]
        assert runs.find_runs(w, least, times) == brute_runs(w, least, times)


def test_long_periodic_text_is_linear_enough():
    assert runs.find_runs(["a"] * 50_000) == [(0, 50_000, 1)]
    assert runs.find_runs(["x"] + ["a", "b", "c"] * 20_000) == [(1, 60_000, 3)]


def contract_row(doc_id, text):
    w = text.split() if text else []
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


def test_report_equals_brute_force_on_planted_texts(make_docs, sentence):
    rows = [(i, sentence(i, 5 + i % 90) + (" na" * (i % 9)), "en", "s") for i in range(150)]
    rows += [(1000, "la la la la la la", "en", "s"), (1001, "a b a b a b a b a", "en", "s"), (1002, None, None, None), (1003, " \n", "en", "s")]
    got = {(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
           for r in runs.report(make_docs(rows), plant=True).collect()}
    assert got == {contract_row(i, t) for i, t, *_ in rows}
    assert sum(r[1] > 0 for r in got) > 20


def test_runs_odd_rows(make_docs, odd_rows):
    rows = runs.detect(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].n_words == by[3].n_words == by[4].n_runs == 0 and by[2].collapsed == "" and by[2].start is None
    assert by[7].n_words == 4800 and by[None].n_runs == 0
    assert runs.detect(make_docs([])).count() == 0
    one = runs.detect(make_docs([(1, "x\ta a a  a a a\ny", "en", "s")])).first()
    assert one.collapsed == "x a y" and [tuple(r) for r in one.runs] == [(1, 6, 1)]


# --- manifest --------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """Contract rows, by folding lists."""
    def leaf(*values):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    def up(tree, at, digest):
        proof = []
        for nodes in tree[:-1]:
            run = list(nodes[at // 16 * 16:at // 16 * 16 + 16])
            run[at % 16] = digest
            proof += [x for k, x in enumerate(run) if k != at % 16]
            digest, at = H(*run), at // 16
        return proof, digest

    groups = {}
    for i, t, lang, src in rows:
        n = None if t is None else len(t)
        low = None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        own = leaf(i, src, lang, n, t)
        bad = leaf(i, src, lang, n, low) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else own
        groups.setdefault(src, []).append((i, own, bad))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: levels([x[1] for x in groups[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (i, own, bad) in enumerate(groups[s]):
            proof, end = up(trees[s], at, bad)
            more, end = up(top, k, end)
            out.append((i, own, trees[s][-1][0], top[-1][0], H(*proof, *more), end, end == top[-1][0]))
    return sorted(out, key=str)


def got_manifest(docs):
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in cols) for r in manifest.prove_documents(docs).collect()), key=str)


def test_proofs_equal_brute_force(make_docs, sentence):
    rows = [(i * 7 % 1009, ("Big " if i % 3 else "") + sentence(i % 50, 6) + " Ünï", "en" if i % 4 else None, f"src{min(i % 40, 22)}" if i % 11 else None)
            for i in range(700)]
    got = got_manifest(make_docs(rows))
    assert got == brute_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_one_source_of_any_size(make_docs, n):
    rows = [(i, f"Text {i}", "en", "s") for i in range(n)]
    assert got_manifest(make_docs(rows)) == brute_manifest(rows)


def test_manifest_odd_rows(make_docs, odd_rows):
    assert got_manifest(make_docs(odd_rows)) == brute_manifest(odd_rows)
    assert manifest.prove_documents(make_docs([])).count() == 0


def test_requested_leaves_only(spark, make_docs):
    rows = [(i, f"t{i}", "en", f"s{i % 3}") for i in range(900)]
    m = manifest.build(manifest.document_leaves(make_docs(rows)), "source", ["doc_id"])
    everything = {(r.source, r.rank): r for r in manifest.prove(m).collect()}
    assert len(everything) == 900
    asked = [("s0", 0), ("s2", 299), ("s1", 17)]
    some = manifest.prove(m, spark.createDataFrame(asked, "source string, rank long")).collect()
    assert sorted((r.source, r.rank) for r in some) == sorted(asked)
    for r in some:
        assert r == everything[r.source, r.rank]
        end = r.leaf
        for s in r.path:
            end = H(s.left, end, s.right)
        assert end == m.root


def test_op13_equals_sql(spark):
    import duckdb
    from sqlkiln.llm.queries import ORACLE, QUERIES
    got = QUERIES["op13_merkle_manifest"](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    rel = con.execute(ORACLE["op13_merkle_manifest"])
    cols = [c[0] for c in rel.description]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(rel.fetchall())


@pytest.mark.parametrize("name", ["op11_simhash_golay", "op12_periodic_runs"])
def test_queries_equal_brute_force(spark, name):
    from sqlkiln.llm.queries import QUERIES
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    if name.startswith("op11"):
        prints = {r.doc_id: plain_fingerprint(r.text) for r in docs}
        comp = brute_components(prints)
        assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", comp[i]) for i in prints}
    else:
        # the contract's white space is ASCII only
        import re
        rows = {contract_row(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text) if r.text else r.text) for r in docs if not r.text or r.text.split() == re.split(r"[\x20\x09-\x0D]+", r.text.strip(" \t\n\v\f\r"))}
        assert rows <= {(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got}
        assert len(rows) > 150
