"""Ids, bit-packed shards and packing against the library and brute force."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sqlkiln.llm import packing, tokenfile
from sqlkiln.llm.queries import tokenizer_path
from sqlkiln.llm.tokens import END_ID, ChunkEncoder


@pytest.fixture(scope="module")
def enc():
    return ChunkEncoder(tokenizer_path())


def whole(enc, text):
    return enc.tok.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab 'sé\n\t  0.,<|>世x ")), max_size=40), max_size=5))
def test_chunked_ids_equal_whole_texts(texts):
    e = test_chunked_ids_equal_whole_texts.__dict__.setdefault("enc", None) or ChunkEncoder(tokenizer_path())
    test_chunked_ids_equal_whole_texts.__dict__["enc"] = e
    assert [np.frombuffer(x, np.uint32).tolist() for x in e.encode(texts)] == [whole(e, t) for t in texts]


def test_special_strings_long_chunks_and_cache_reset(enc, monkeypatch):
    from sqlkiln.llm import tokens
    texts = ["a <|endoftext|> b", "x" * 3000 + " y", "  lead", "trail ", "", " ", "don't stop\r\nnow  ok"]
    expect = [whole(enc, t) for t in texts]
    assert [np.frombuffer(x, np.uint32).tolist() for x in enc.encode(texts)] == expect
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 2)
    enc.known.clear()
    assert [np.frombuffer(x, np.uint32).tolist() for x in enc.encode(texts)] == expect


def test_added_tokens_are_encoded_as_by_the_library(enc):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "plain words", "x<|endoftext|>y z", "<|endoftext|>", "a b <|endoftext|>\n", "<|endoftext |>", "", "more words"]
    expect = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert expect[0] == [64, 220, 50256, 275]
    for _ in range(2):                                     # the second time from the cache
        assert [np.frombuffer(x, np.uint32).tolist() for x in enc.encode(texts)] == expect


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 2**32))
def test_bits_round_trip(width, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
    raw = tokenfile.pack_bits(ids, width)
    assert len(raw) == -(-n * width // 64) * 8
    assert (tokenfile.unpack_bits(raw, n, width) == ids).all()


def test_width_is_least():
    assert [tokenfile.bit_width(n) for n in (2, 4, 5, 50257, 65536, 65537)] == [2, 2, 3, 16, 16, 17]


def test_shards_round_trip_and_random_access(spark, make_docs, odd_rows, enc, tmp_path):
    rows = odd_rows + [(10, "word " * 70000, "en", "s")]
    manifest = tokenfile.write_shards(make_docs(rows), tokenizer_path(), str(tmp_path / "t"), shards=3)
    got = tokenfile.read_shards(manifest, with_ids=True).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, expect = 0, []
    for doc_id, text, *_ in order:
        ids = whole(enc, text) + [END_ID]
        expect.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got], key=key) == expect
    path = manifest.orderBy("shard").first()["path"]
    file, size = tokenfile.open_shared(path, "r")
    with file:
        shard = tokenfile.ShardReader(file, size)
        i = len(shard.doc_ids) - 1
        assert shard.document(i).tolist() == expect[i][4]
    assert tokenfile.read_shards(tokenfile.write_shards(make_docs([]), tokenizer_path(), str(tmp_path / "e"), shards=2)).count() == 0


def optimum(sizes, capacity):
    """Fewest bins by exhaustive search (small instances)."""
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        seen = set()
        for k, b in enumerate(bins):
            if b + sizes[i] <= capacity and b not in seen:
                seen.add(b)
                place(i + 1, bins[:k] + [b + sizes[i]] + bins[k + 1:])
        place(i + 1, bins + [sizes[i]])
    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    r = random.Random(5)
    for _ in range(150):
        c = r.choice([10, 20, 37])
        sizes = [r.randint(1, c) for _ in range(r.randint(1, 9))]
        count = [0] * (c + 1)
        for s in sizes:
            count[s] += 1
        fixed = packing.reduce_instance(count, c)
        rest = [s for s, n in enumerate(count) for _ in range(n)]
        assert sum(n for _, n in fixed) + (optimum(rest, c) if rest else 0) == optimum(sizes, c), sizes


def test_plan_places_every_piece_once_within_capacity():
    r = random.Random(6)
    hist = {s: r.randint(1, 5000) for s in r.sample(range(1, 1025), 300)}
    patterns = packing.plan(hist, 1024)
    used = {}
    for items, n in patterns:
        assert sum(items) <= 1024 and n > 0
        for s in items:
            used[s] = used.get(s, 0) + n
    assert used == hist
    assert sum(n for _, n in patterns) <= 1.01 * lower_bound(hist, 1024) + 1


def lower_bound(hist, c):
    """Martello and Toth's L2: for every k, large items alone plus what of the small ones does not fit beside them."""
    best = 0
    for k in range(0, c // 2 + 1):
        alone = sum(n for s, n in hist.items() if s > c - k)
        big = [(s, n) for s, n in hist.items() if c / 2 < s <= c - k]
        small = sum(s * n for s, n in hist.items() if k <= s <= c / 2)
        free = sum((c - s) * n for s, n in big)
        best = max(best, alone + sum(n for _, n in big) + max(0, -(-(small - free) // c)))
    return best


@pytest.mark.parametrize("n,expect", [(1, [1]), (8, [8]), (9, [1, 8]), (16, [8, 8]), (19, [3, 8, 8])])
def test_cut(n, expect):
    assert packing.cut(n, 8) == expect


def test_pack_is_gapless_and_whole(make_docs, odd_rows, sentence, enc):
    rows = odd_rows + [(100 + i, sentence(i, 5 + 7 * i), "en", "s") for i in range(60)]
    out = packing.pack(make_docs(rows), tokenizer_path(), capacity=128, with_ids=True).collect()
    docs, seqs = {}, {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    for doc_id, text, *_ in rows:
        if doc_id not in (6, None):
            pieces = sorted(docs[doc_id], key=lambda r: r.piece)
            assert [i for r in pieces for i in r.ids] == whole(enc, text) + [END_ID]
            assert [r.length for r in pieces] == packing.cut(sum(r.length for r in pieces), 128)
    assert len(docs[6]) == 2 * max(r.piece + 1 for r in docs[6])
    assert packing.pack(make_docs([]), tokenizer_path()).count() == 0


def test_texts_are_encoded_in_short_groups(enc, monkeypatch):
    from sqlkiln.llm import tokens
    sizes, real = [], ChunkEncoder.encode

    def watched(self, texts):
        sizes.append(sum(map(len, texts)))
        return real(self, texts)
    monkeypatch.setattr(ChunkEncoder, "encode", watched)
    texts = ["word " * 2000 + str(i) for i in range(250)]
    ids = list(tokens.document_ids(texts, tokenizer_path()))
    assert max(sizes) <= 1_000_000 + 10_100 and len(sizes) > 2
    assert np.frombuffer(ids[7], np.uint32).tolist() == whole(enc, texts[7]) + [END_ID]
