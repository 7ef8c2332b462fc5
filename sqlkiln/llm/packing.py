"""Best-fit packing of documents into fixed-length token sequences.

Only how many pieces there are of each length decides a packing. So the plan is
made from that histogram (at most ``capacity`` numbers, whatever the corpus) and
the pieces are then dealt to planned places by their rank among equals.

Planning follows Martello and Toth's reduction: a set of items that dominates
every other way to fill the bin of one of its members is fixed for good -- an
item that nothing fits beside; a pair that fills the bin exactly, or whose
second item is the largest that fits where only one can; a triple whose items
bound those of every other feasible set. Fixing shrinks the instance, which
makes more sets dominant; what is left is placed best-fit, largest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored
from .tokens import document_ids

SLICES = 128     # parts the pieces of one length are ranked in

Pattern = tuple[tuple[int, ...], int]      # lengths in one sequence, number of such sequences


def cut(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids: all full but, perhaps, the first."""
    first = n % capacity or capacity
    return [first] + [capacity] * ((n - first) // capacity)


def _take(count: list[int], items: tuple[int, ...]) -> int:
    """How many times ``items`` can be drawn from the multiset."""
    need = {s: items.count(s) for s in items}
    return min(count[s] // k for s, k in need.items())


def dominant(j: int, count: list[int], capacity: int) -> tuple[int, ...] | None:
    """A set with ``j`` that dominates all feasible sets with ``j``, or None.

    ``count[s]`` items of size ``s`` are left, ``j`` among them.
    """
    room = capacity - j
    count[j] -= 1
    try:
        fits = [s for s in range(1, room + 1) if count[s]]
        if not fits:
            return (j,)
        if count[room] if room else False:
            return (j, room)                    # whatever else went in fits into the partner's place
        least: list[int] = []                   # the three smallest items left
        for s in fits:
            least += [s] * min(3 - len(least), count[s])
            if len(least) == 3:
                break
        big = fits[-1]
        if len(least) < 2 or least[0] + least[1] > room:
            return (j, big)                     # only one item fits beside j: the largest is best
        if len(least) == 3 and sum(least) <= room:
            return None
        # At most two fit. (big, second) dominates if no feasible pair has a
        # smaller item above ``second``.
        count[big] -= 1
        second = next((s for s in reversed(fits) if s <= room - big and count[s]), None)
        count[big] += 1
        if second is None:
            return None
        for k in range(len(fits) - 1, -1, -1):
            d = fits[k]
            if 2 * d <= room and (count[d] > 1 or (k + 1 < len(fits) and fits[k + 1] <= room - d)):
                return (j, big, second) if second >= d else None
        return None
    finally:
        count[j] += 1


def reduce_instance(count: list[int], capacity: int) -> list[Pattern]:
    """Fix dominating sets until none is left; ``count`` keeps the remainder.

    A set stays dominant while its own items last (what is removed can only
    narrow the other feasible sets), so it is fixed as often as it can be drawn.
    """
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while count[j]:
                items = dominant(j, count, capacity)
                times = _take(count, items) if items else 0
                if not times:
                    break
                for s in items:
                    count[s] -= times
                fixed.append((tuple(sorted(items, reverse=True)), times))
                changed = True
    return fixed


def best_fit(count: list[int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram; equal open bins are kept as one group.

    Having taken an item, a bin has less room than its equals, so it is the best
    fit for the next equal item too: one bin is filled before the next.
    """
    room: dict[int, list[list]] = {}            # room left -> [items, bins] groups
    for s in range(capacity, 0, -1):
        n = count[s]
        for r in sorted(r for r in room if r >= s):
            if not n:
                break
            each, groups, keep = r // s, room.pop(r), []
            for items, bins in groups:
                whole = min(bins, n // each)
                if whole:
                    room.setdefault(r - each * s, []).append([items + (s,) * each, whole])
                    n -= whole * each
                    bins -= whole
                if bins and n and n < each:
                    room.setdefault(r - n * s, []).append([items + (s,) * n, 1])
                    n, bins = 0, bins - 1
                if bins:
                    keep.append([items, bins])
            if keep:
                room.setdefault(r, []).extend(keep)
        each = capacity // s
        if n >= each:
            room.setdefault(capacity - each * s, []).append([(s,) * each, n // each])
            n %= each
        if n:
            room.setdefault(capacity - n * s, []).append([(s,) * n, 1])
    return [(items, bins) for groups in room.values() for items, bins in groups]


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Sequences, as patterns with multiplicity, that hold every piece once."""
    count = [0] * (capacity + 1)
    for s, n in histogram.items():
        count[s] = n
    return reduce_instance(count, capacity) + best_fit(count, capacity)


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """Per length the places in rank order: rows ``(first rank, first sequence, offset)``."""
    rank: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for items, bins in patterns:
        offset = 0
        for s in items:
            out.setdefault(s, []).append((rank.get(s, 0), sequence, offset))
            rank[s] = rank.get(s, 0) + bins
            offset += s
        sequence += bins
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def _pieces(tokenizer: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, ids in zip(pdf["doc_id"], document_ids(pdf["text"], tokenizer)):
                at = 0
                view = memoryview(ids)
                for k, length in enumerate(cut(len(ids) // 4, capacity)):
                    part = view[4 * at:4 * (at + length)]
                    row = (doc_id, k, at, length, zlib.crc32(part))
                    rows.append(row + (np.frombuffer(part, np.uint32).astype(np.int32),) if with_ids else row)
                    at += length
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                               ).astype({"doc_id": "Int64"})
    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places in as few sequences as found.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored.
    A document is its ids by ``tokenizer`` (a tokenizers file) and the end id;
    null and empty texts are the end id alone. Returns ``doc_id, piece, start,
    length, ids_crc32, sequence_id, offset`` (and ``ids`` on demand), one row
    per piece; repeated rows are packed once each, a null doc_id stays null,
    an empty table gives an empty result.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    pieces = stored(docs.select("doc_id", "text").mapInPandas(_pieces(tokenizer, capacity, with_ids), schema), "pieces")
    # A full piece is a sequence of its own (nothing fits beside it).
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()) \
                 .withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < capacity).withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SLICES)).cast("int"))

    counts = short.groupBy("length", "slice").count().toPandas()      # at most capacity * SLICES rows
    counts = counts.sort_values(["length", "slice"])
    counts["before"] = counts.groupby("length")["count"].cumsum() - counts["count"]
    before = np.zeros((capacity + 1, SLICES), np.int64)
    before[counts["length"].to_numpy(int), counts["slice"].to_numpy(int)] = counts["before"]
    histogram = {int(s): int(n) for s, n in counts.groupby("length")["count"].sum().items()}
    where = places(plan(histogram, capacity))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length = pdf["length"].to_numpy(int)
            rank = before[length, pdf["slice"].to_numpy(int)] + pdf["nth"].to_numpy(int) - 1
            sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            for s in np.unique(length):
                rows, table = length == s, where[int(s)]
                k = np.searchsorted(table[:, 0], rank[rows], side="right") - 1
                sequence[rows] = table[k, 1] + rank[rows] - table[k, 0]
                offset[rows] = table[k, 2]
            yield pdf.drop(columns=["slice", "nth"]).assign(sequence_id=sequence, offset=offset)

    order = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    dealt = (short.withColumn("nth", F.row_number().over(order))
             .mapInPandas(deal, schema + ", sequence_id long, offset long"))
    return full.unionByName(dealt)
