"""Model hooks, block retrieval and column profiles against plain Python."""

import os
import random

import numpy as np
import pytest

from sqlkiln.operators import profiling as prof
from sqlkiln.operators import retrieval as rt


def test_encoder_is_made_once_per_worker(spark, scratch):
    log = f"{scratch}/made"

    def make():
        class Own:
            def __init__(self):
                with open(log, "a") as f:
                    f.write(f"{os.getpid()}\n")

            def __call__(self, texts):
                return [[float(len(t)), 1.0] for t in texts]
        return Own()
    df = spark.range(4000).selectExpr("id", "if(id % 7 = 0, null, repeat('x', cast(id % 5 as int))) AS text").repartition(16)
    rows = rt.embed_with(df, "text", factory=make, dim=2).collect()
    assert all(r.vec == [float(len(r.text or "")), 1.0] for r in rows) and len(rows) == 4000
    pids = open(log).read().split()
    assert 1 <= len(pids) == len(set(pids)) < 16                  # 16 tasks, one making per worker


def test_wrong_length_stops_the_job(spark):
    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(Exception, match="do not have 3 numbers"):
        rt.embed_with(df, "text", encoder=lambda xs: [[1.0, 2.0] for _ in xs], dim=3).collect()


def test_token_counts_equal_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["", "plain words", "Zeilen\nund\tZeichen ½", None, "x" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.n_tokens for r in rt.token_len_with(df, "text", factory=lambda: rt.FileTokenizer(path)).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_block_retrieval_equals_plain_python(spark):
    r = random.Random(3)
    unit = lambda v: [float(x / (np.linalg.norm(v) or 1)) for x in v]
    tables = [(f"db{d}", f"t{(k * 7) % 10}", k, unit([r.choice([-1.0, 0, 0, 1, 2]) for _ in range(6)])) for d in range(3) for k in range(5 * d)]
    near = [(f"db{d}", f"t{(k * 7) % 10}", f"t{((k + 1) * 7) % 10}") for d in range(3) for k in range(0, 5 * d, 2)] + [("db1", "t0", "gone")]
    questions = [(q, f"db{0 if q % 11 == 0 else 2 if q % 3 else 1}", unit([r.choice([-1.0, 0, 1, 3]) for _ in range(6)])) for q in range(600)]
    got = rt.retrieve_tables(spark.createDataFrame(questions, "q int, db_id string, vec array<double>"),
                             spark.createDataFrame(tables, "db_id string, table_name string, table_pos int, vec array<double>"),
                             spark.createDataFrame(near, "db_id string, table_name string, neighbour string"), ["q"]).collect()
    expect = set()
    for q, db, v in questions:
        own = [(name, pos, round(float(np.dot(v, w)), 9)) for d, name, pos, w in tables if d == db]
        if not own:
            expect.add((q, db, None, None, False, False, None))
            continue
        limit = max(0.2, 0.5 * max(s for *_, s in own))
        passed = {n for n, _, s in own if s >= limit}
        chosen = passed or {min(own, key=lambda x: (-x[2], x[1]))[0]}
        taken = chosen | {b for d, a, b in near if d == db and a in chosen and b in {n for n, *_ in own}}
        ranked = sorted([x for x in own if x[0] in taken], key=lambda x: (-x[2], x[0]))
        expect |= {(q, db, n, p, n in passed, n in chosen, i + 1) for i, (n, p, _) in enumerate(ranked)}
    assert {(x.q, x.db_id, x.table_name, x.table_pos, x.passes, x.chosen, x["rank"]) for x in got} == expect
    assert len(got) == len(expect)


def test_keys_and_inclusions_equal_plain_python(spark):
    r = random.Random(1)
    a = [(i, i // 2, i % 2, f"v{r.randrange(40)}", None if i == 3 else i) for i in range(300)]
    b = [(r.randrange(400), f"v{r.randrange(60)}") for _ in range(200)]
    dfs = {"a": spark.createDataFrame(a, "id int, half int, odd int, name string, gap int"),
           "b": spark.createDataFrame(b, "ref long, label string"), "c": spark.createDataFrame([], "x int, y string")}
    for sample in (20_000, 50):
        keys = prof.key_profile(spark, dfs, sample_rows=sample)
        rows = [tuple(x) for x in keys.collect()]
        assert ("a", "id", 1, 300) in rows and ("a", "half,odd", 2, 300) in rows
        assert not any("gap" in x[1] or "id," in x[1] or x[0] == "c" for x in rows)
    got = {(x.dep_table, x.dep_column): (x.n_values, x.n_covered) for x in prof.inclusion_dependencies(dfs, keys).collect() if x.ref_column == "id"}
    ids = {x[0] for x in a}
    assert got["b", "ref"] == (len({x[0] for x in b}), len({x[0] for x in b} & ids))
    assert got["a", "half"] == (150, 150) and got["a", "gap"] == (299, 299) and got["c", "x"] == (0, 0)
