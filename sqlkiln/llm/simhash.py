"""Near-duplicate documents by SimHash and fuzzy hashing with the binary Golay code.

A text's 64-bit fingerprint is the bitwise majority of its word shingles'
hashes; fingerprints link at ``MAX_BITS`` = 3 or fewer differing bits. To find
links without comparing all pairs, a fingerprint is cut into segments of 23, 23
and 18 bits. The [23,12,7] Golay code is perfect: each 23-bit word has one
codeword within 3 bits, and of two words that differ in one bit, the second has
the first's codeword within 4. So the 12-bit index of the nearest codeword
*posts* a segment, and the one or six codewords within 4 bits *probe* for it.

Three errors over three segments leave one of two cases:

* a segment has no error, and then one of the other two has at most one. Key:
  the error-free segment as it is, with an index of the other (6 choices);
* each segment has exactly one. Then all three segment parities flip, and one
  half of the second and of the third segment is free of errors. Key: the first
  segment's index, the two halves, the parities (4 choices).

Keys have 30 to 39 bits. Equal fingerprints collapse into one before. A bucket
of up to ``SMALL`` fingerprints is settled in one place by a forest of its
links; members of larger ones meet at the words within one bit (all of which
lie within 2 of each other, so a star of edges says it all), and those outside
a bucket's largest component then also at the words within two bits: a pair of
distance 3 meets at a word one bit from one and two from the other. Both steps
are linear in the members, emit no pairs, and lose no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from sqlkiln.operators.components import connected_components

from .common import attach, by_chars, stored

MAX_BITS = 3
SHINGLE = 3
SEED = 42
CHUNK = 1 << 16                                    # shingles counted at a time
SEGMENTS = ((0, 23), (23, 23), (46, 18))          # (shift, bits)
SMALL = 256                                        # fingerprints of a bucket settled in one place
GENERATOR = 0b110001110101                         # x^11+x^10+x^6+x^5+x^4+x^2+1 of the Golay code


def fingerprint(text: str | None) -> int:
    """64-bit majority of the hashes of all 3-word shingles; 0 without words.

    A-Z is lower-cased, words are runs of anything but ASCII white space, a
    shingle is three words joined by a space (fewer words: all of them) and
    hashed by XXH64. A bit is set if more than half of the hashes have it.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    span = min(SHINGLE, len(words))
    digest, total = xxhash.xxh64_digest, len(words) - span + 1
    shingles = zip(*[words[i:i + total] for i in range(span)])
    count = np.zeros(64, np.int64)
    while part := [digest(b" ".join(g), SEED) for g in islice(shingles, CHUNK)]:
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8)).reshape(-1, 64)      # digests are big-endian
        count += (np.ones(len(bits), np.float32) @ bits.astype(np.float32)).astype(np.int64)
    return int.from_bytes(np.packbits(2 * count > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in by_chars(batches):
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"),
                            "fp": np.array([fingerprint(t if isinstance(t, str) else None) for t in pdf["text"]], np.uint64).view(np.int64)})


def _remainder(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials over GF(2) divided by the generator: the syndrome."""
    v = v.copy()
    for i in range(22, 10, -1):
        v ^= np.where((v >> i) & 1, GENERATOR << (i - 11), 0).astype(v.dtype)
    return v


def _patterns() -> np.ndarray:
    """Per syndrome the error patterns of at most 4 bits, the least first, padded by repetition (2048 x 6)."""
    found: list[list[int]] = [[] for _ in range(2048)]
    for k in range(5):
        words = np.array([sum(1 << i for i in c) for c in combinations(range(23), k)], np.int64)
        for s, w in zip(_remainder(words).tolist(), words.tolist()):
            found[s].append(w)
    return np.array([p + [p[0]] * (6 - len(p)) for p in found], np.int64)


PATTERNS = _patterns()


def codewords(v: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within 4 bits of 23-bit words, the nearest first;
    a word with a single one repeats it."""
    return (v[:, None] ^ PATTERNS[_remainder(v)]) >> 11      # systematic: the top 12 bits name the codeword


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, key, posted)`` of all bucket keys of distinct fingerprints.

    Two fingerprints of at most ``MAX_BITS`` differing bits share a key that at
    least one of them posts.
    """
    u = fp.view(np.uint64)
    seg = [((u >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    near = [codewords(v) for v in seg]
    rows, keys, posted = [], [], []
    at = np.arange(len(fp))

    def put(kind: int, base: np.ndarray, index: np.ndarray, base_post: np.ndarray | None = None) -> None:
        """Probe ``base`` with every index; post ``base_post`` (default: the same) with the nearest."""
        for j in range(6):
            new = np.ones(len(fp), bool) if j == 0 else index[:, j] != index[:, 0]
            k = (base[new] << 12 | index[new, j]) << 4 | kind
            rows.append(at[new])
            keys.append(k)
            posted.append(np.full(len(k), j == 0 and base_post is None))
        if base_post is not None:
            rows.append(at)
            keys.append((base_post << 12 | index[:, 0]) << 4 | kind)
            posted.append(np.ones(len(fp), bool))

    kind = 0
    for i in range(3):                       # segment i free of errors, another with one at most
        for j in range(3):
            if i != j:
                put(kind, seg[i], near[j])
                kind += 1
    parity = sum(((np.bitwise_count(s) & 1).astype(np.int64) << i) for i, s in enumerate(seg))
    for high in (seg[1] >> 12, seg[1] & 0xFFF):      # one error each
        for low in (seg[2] >> 9, seg[2] & 0x1FF):
            base = (high << 9 | low) << 3
            put(kind, base | parity, near[0], base | (parity ^ 7))
            kind += 1
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(posted)


def _bucket_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fp = pdf["fp"].to_numpy(np.int64)
        for a in range(0, len(fp), 4096):
            part = fp[a:a + 4096]
            row, key, posted = bucket_keys(part)
            yield pd.DataFrame({"key": key, "fp": part[row], "posted": posted.astype(np.int8)})


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per bucket of at most ``SMALL`` fingerprints a spanning forest of its links."""
    for pdf in batches:
        src: list[int] = []
        dst: list[int] = []
        for members in pdf["members"]:
            left = np.unique(np.asarray(members, np.int64))
            while len(left) > 1:                       # grow one tree after the other
                tree, left = left[:1], left[1:]
                while len(tree) and len(left):
                    head, tree = tree[0], tree[1:]
                    hit = np.bitwise_count((left ^ head).view(np.uint64)) <= MAX_BITS
                    if hit.any():
                        src += [int(head)] * int(hit.sum())
                        dst += left[hit].tolist()
                        tree, left = np.concatenate([tree, left[hit]]), left[~hit]
        yield pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})


ONE_BIT = np.concatenate([[0], 1 << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
TWO_BITS = np.array([(1 << i) | (1 << j) for i, j in combinations(range(64), 2)], np.uint64)


def _ball(flips: np.ndarray, step: int):
    """``(word, fp)``: the words that differ from a fingerprint by one of ``flips``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            for a in range(0, len(fp), step):
                part = fp[a:a + step]
                yield pd.DataFrame({"word": (part.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64), "fp": np.repeat(part, len(flips))})
    return run


def _star(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """Edges from each word's hub to its other fingerprints."""
    return rows.join(hubs, "word").where("fp <> src").select("src", F.col("fp").alias("dst")).distinct()


def _large_bucket_links(large: DataFrame, links: DataFrame) -> DataFrame:
    """Links that settle ``large`` buckets ``(key, fp)``, given the ``links`` known so far."""
    near = stored(large.select("fp").distinct().mapInPandas(_ball(ONE_BIT, 1024), "word long, fp long"), "ball-1")
    hubs = near.groupBy("word").agg(F.min("fp").alias("src"), F.count("*").alias("m"))
    found = stored(links.unionByName(_star(near, hubs.where("m > 1").drop("m"))), "links-near")
    comp = connected_components(found).select(F.col("vertex").alias("fp"), F.col("component").alias("comp"))
    placed = stored(large.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "large-members")
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    top = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("t"), F.count("*").alias("parts")).where("parts > 1")
    outside = stored(placed.join(top.select("key", "t.comp", F.lit(True).alias("is_top")), ["key", "comp"], "left")
                     .join(top.select("key"), "key", "left_semi").where("is_top is null").select("fp").distinct(), "outsiders")
    if outside.isEmpty():
        return found
    far = outside.mapInPandas(_ball(TWO_BITS, 64), "word long, fp long")
    return found.unionByName(_star(far, hubs.drop("m")))


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """``(fp, comp)`` for distinct fingerprints that have a link; ``comp`` names a component.

    ``prints`` has one row ``fp`` (long) per distinct fingerprint.
    """
    rows = prints.select("fp").mapInPandas(_bucket_rows, "key long, fp long, posted byte")
    sizes = rows.groupBy("key").agg(F.count("*").alias("m"), F.max("posted").alias("p"))
    shared = stored(sizes.where("m > 1 and p = 1").select("key", "m"), "bucket-sizes")
    members = stored(rows.select("key", "fp").join(shared, "key").distinct(), "bucket-members")
    small = (members.where(F.col("m") <= SMALL).groupBy("key").agg(F.collect_list("fp").alias("members"))
             .select("members").distinct())
    links = stored(small.mapInPandas(_forests, "src long, dst long").distinct(), "links")
    large = members.where(F.col("m") > SMALL).select("key", "fp")
    if not large.isEmpty():
        links = stored(_large_bucket_links(large, links), "links-all")
    return connected_components(links).select(F.col("vertex").alias("fp"), F.col("component").alias("comp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id, kept, copies)`` for every row of ``docs``.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored.
    ``component_id`` is the least doc_id reachable over links, ``kept`` marks
    it, ``copies`` counts the rows of this fingerprint. Null, empty and blank
    texts have fingerprint zero and are linked like any other. Rows that share
    a doc_id come back one by one, each by its own text. A null doc_id is never
    a component's least: such rows get their component too, and null if it has
    no other. An empty table gives an empty result.
    """
    sig = stored(docs.select("doc_id", "text").mapInPandas(_fingerprints, "doc_id long, fp long"), "fingerprints")
    prints = stored(sig.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "prints")
    comp = fingerprint_components(prints)
    placed = prints.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    linked = stored(placed.where("copies > 1").unionByName(placed.where("copies = 1").join(comp.select("fp"), "fp", "left_semi")), "placed")
    least = linked.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = stored(linked.join(least, "comp").select("fp", "component_id", "copies"), "classes")
    out = attach(sig, classes, "fp")
    # a fingerprint of one row without links is not in ``classes``
    component = F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
                      F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
