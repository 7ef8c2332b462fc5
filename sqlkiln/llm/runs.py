"""Periodic runs of words by a Kruskal sweep over the suffixes, the longest common prefix first.

A text's words are numbered and its suffixes sorted. Neighbours in that order
are united by decreasing length of their common prefix (LCP), with union-find;
each class keeps its positions in order. Take a run of smallest period q from
word s to e: suffixes s and s + q have an LCP of e - s - q. They come into one
class at that level, and no position between them is in it, as the run's first
q words would then be a power of something shorter. So every run shows up as a
pair of newly adjacent positions at distance d within the level l, with
period d and length l + d; a pair whose left neighbours agree lies inside a run
and is skipped, so each run is found once, with its whole extent.

Runs that repeat at least ``min_times`` times need l >= (min_times - 1) * d and
hence an LCP of some words at least; suffixes with less in common are never
united, and a text without a repeated window of that many words is done at once.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import by_chars

MIN_LENGTH, MIN_TIMES = 6, 4


def least_level(min_length: int, min_times: int) -> int:
    """The least LCP that the seed of any run can have."""
    return max(1, min(max((min_times - 1) * d, min_length - d) for d in range(1, min_length + 1)))


def _suffixes(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by doubling, and the ranks of all windows of 1, 2, 4, ... words (0: past the end)."""
    n = len(ids)
    rank = (ids + 1).astype(np.int64)
    ranks = [rank.astype(np.int32)]
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:max(0, n - width)] = rank[width:]
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
        rank = new
        width *= 2
        if rank.max() == n or width >= 2 * n:
            return order, ranks
        ranks.append(rank.astype(np.int32))


def _neighbour_lcp(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix with the one before it in ``order`` (first: 0)."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        width = 1 << k
        fits = (np.maximum(a, b) + width <= n)
        same = np.zeros(n - 1, bool)
        same[fits] = ranks[k][a[fits]] == ranks[k][b[fits]]
        step = same * width
        a, b, lcp = a + step, b + step, lcp + step
    return np.concatenate([[0], lcp])


def _new_neighbours(big: list[int], small: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs of positions next to each other in the union of two ordered sets, one from each."""
    for t, p in enumerate(small):
        k = bisect_left(big, p)
        if k and (t == 0 or small[t - 1] < big[k - 1]):
            yield big[k - 1], p
        if k < len(big) and (t + 1 == len(small) or small[t + 1] > big[k]):
            yield p, big[k]


def find_runs(words: list, min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the maximal runs with ``length >= max(min_length, min_times * period)``.

    ``period`` is the smallest, ``min_times`` at least 2. Sorted by start, then period.
    """
    n, least = len(words), least_level(min_length, min_times)
    if n < least + 1:
        return []
    windows = n - least + 1
    if len(set(zip(*[words[i:i + windows] for i in range(least)]))) == windows:
        return []                                   # no window occurs twice
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    order, ranks = _suffixes(ids)
    lcp = _neighbour_lcp(order, ranks)
    rows = np.flatnonzero(lcp >= least)
    rows = rows[np.argsort(-lcp[rows], kind="stable")]
    parent: dict[int, int] = {}
    places: dict[int, list[int]] = {}               # of classes with more than one position

    def find(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    found = []
    for i, j, level in zip(order[rows - 1].tolist(), order[rows].tolist(), lcp[rows].tolist()):
        a, b = find(i), find(j)
        big, small = places.pop(a, None) or [a], places.pop(b, None) or [b]
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        for p, q in _new_neighbours(big, small):
            d = q - p
            if (min_times - 1) * d <= level and level + d >= min_length and (p == 0 or words[p - 1] != words[q - 1]):
                found.append((p, level + d, d))
        if len(small) * 8 < len(big):
            for p in small:
                insort(big, p)
        else:
            big += small
            big.sort()                              # two ordered runs: linear
        parent[b] = a
        places[a] = big
    return sorted(found, key=lambda r: (r[0], r[2]))


def plant(words: list, doc_id: int | None) -> list:
    """``words``, made periodic from some word on if a tenth of the ids' checksums says so; a null id leaves them."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a:a + p]
    return words[:a] + (block * ((n - a) // p + 1))[:n - a]


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]


SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _detect(planted: bool, min_length: int, min_times: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_chars(batches):
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
                words = plant(words, doc_id) if planted else words
                runs = find_runs(words, min_length, min_times)
                best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                kept = b" ".join(collapse(words, runs))
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                rows.append((doc_id, len(words), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                             hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest(),
                             [{"start": s, "length": n, "period": q} for s, n, q in runs], kept.decode("utf-8", "surrogatepass")))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli",
                                              "runs_sha256", "collapsed_sha256", "runs", "collapsed"])
            yield out.astype({c: "Int64" for c in ("doc_id", "start", "length", "period", "exponent_milli")})
    return run


def detect(docs: DataFrame, planted: bool = False, min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> DataFrame:
    """The runs of every row of ``docs`` and its text with each run cut to one period.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored.
    Columns: ``SCHEMA``; the four numbers of the longest run (ties: smallest
    start, then period) are null without runs. Words are runs of anything but
    ASCII white space; ``collapsed`` joins those kept by a space. Null, empty
    and blank texts have no words and no runs. Rows are taken one by one, so
    repeated rows and null ids stay; an empty table gives an empty result. A
    task holds one slice of texts and the suffixes of one text.
    """
    return docs.select("doc_id", "text").mapInPandas(_detect(planted, min_length, min_times), SCHEMA)


def report(docs: DataFrame, plant: bool = False) -> DataFrame:
    """The digest columns of ``detect``."""
    return detect(docs, plant).drop("runs", "collapsed")
