"""Near-duplicate documents by MinHash: one-permutation hashing with optimal
densification, banded buckets, star-shaped candidate edges, exact confirmation.

Every word shingle is hashed once; the top of the hash picks one of
``BINS`` bins and the bin keeps its least hash. An empty bin copies the value
of the first non-empty bin in a fixed random order of its own (optimal
densification), so short texts get signatures as good as long ones. Four
consecutive bins make a band and equal bands a bucket. At similarity 0.85 a
pair shares none of the 24 bands with probability (1 - 0.85^4)^24, 2e-8.

A bucket of m texts gives m - 1 edges, all to its least member. Edges are
confirmed on full shingle sets. A star alone could miss a link between two
members that both differ from the hub; so where a candidate cluster still
falls into several components, the members outside its largest component are
compared, in blocks, with all members they share a bucket with. No bucket is
capped and no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sqlkiln.operators.components import connected_components
from sqlkiln.session import by_shuffle

from .common import BROADCAST_ROWS, attach, by_chars, rows_of, stored
from .shingles import mix, shingle_set

BANDS, ROWS = 24, 4
BINS = BANDS * ROWS
BLOCK = 256            # members a block task holds of either side
HUB_SPREAD = 64        # parts that the edges of one hub are dealt over


def _donor_order() -> np.ndarray:
    """For each bin a fixed random order of all bins, itself first."""
    rng = np.random.default_rng(20240607)
    order = np.array([rng.permutation(BINS) for _ in range(BINS)])
    for i, row in enumerate(order):
        row[row == i], row[0] = row[0], i
    return order


DONORS = _donor_order()
# Bins are equal slices of the 64-bit range: a sorted set is binned by search.
EDGES = (np.arange(BINS, dtype=np.float64) / BINS * 2.0**64).astype(np.uint64)
BAND_SEED = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def signature(s: np.ndarray) -> np.ndarray:
    """``BINS`` values of a non-empty sorted hash set, empty bins densified."""
    first = np.searchsorted(s, EDGES)
    end = np.append(first[1:], len(s))
    full = first < end
    values = s[np.minimum(first, len(s) - 1)]
    if not full.all():
        donor = DONORS[np.arange(BINS), full[DONORS].argmax(axis=1)]
        values = values[donor]
    return values


def band_keys(s: np.ndarray) -> np.ndarray:
    """The bucket key of each band (the band's number goes into the hash)."""
    v = signature(s).reshape(BANDS, ROWS)
    key = BAND_SEED
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + v[:, i])
    return key.view(np.int64)


def _set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signatures(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_chars(batches):
            sets = [shingle_set(t, width) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "n": [len(s) for s in sets],
                "set_id": [_set_id(s) for s in sets],
                "bands": [band_keys(s) if len(s) else np.empty(0, np.int64) for s in sets],
            })
    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_chars(batches):
            sets = [shingle_set(t, width) for t in pdf["text"]]
            yield pd.DataFrame({"rep": pdf["doc_id"], "set_id": [_set_id(s) for s in sets],
                                "shingles": [s.view(np.int64) for s in sets]})
    return run


def _similar(na, nb, inter, pct: int):
    return 100 * inter >= pct * (na + nb - inter)


def _block_links(pct: int):
    """Links between outsiders and members of one block pair (a forest of them)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        out_rows, mem = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        found: list[tuple[int, int]] = []
        if len(out_rows) and len(mem):
            bands = np.stack(mem["bands"].to_numpy())
            sizes = mem["n"].to_numpy()
            reps = mem["rep"].to_numpy()
            sets = mem["shingles"].to_list()
            # current component of every text seen here; merged as links turn up
            comp = {r: c for r, c in zip(pdf["rep"], pdf["comp"])}
            mcomp = np.array([comp[r] for r in reps])
            for rep, n, own, mine in zip(out_rows["rep"], out_rows["n"], out_rows["bands"], out_rows["shingles"]):
                near = (bands == np.asarray(own)).any(axis=1)
                near &= 100 * np.minimum(sizes, n) >= pct * np.maximum(sizes, n)
                for i in np.flatnonzero(near):
                    if mcomp[i] == comp[rep]:
                        continue
                    inter = len(np.intersect1d(mine, sets[i], assume_unique=True))
                    if _similar(n, sizes[i], inter, pct):
                        found.append((min(rep, reps[i]), max(rep, reps[i])))
                        old, new = mcomp[i], comp[rep]
                        mcomp[mcomp == old] = new
                        for r, c in comp.items():
                            if c == old:
                                comp[r] = new
        return pd.DataFrame(found, columns=["hub", "rep"], dtype="int64")
    return run


def near_duplicates(docs: DataFrame, pct: int = 85, width: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, copies)`` for every row of ``docs``.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored.
    Two texts are linked when 100 * |A & B| >= pct * |A | B| for their sets of
    ``width``-word shingles; ``component_id`` is the least doc_id reachable,
    ``kept`` marks it, ``copies`` counts the rows with exactly this set.
    Null, empty and blank texts have no shingles and are alone. Rows of one
    doc_id come back once each and are one document, with the text of the least
    set digest; a copy of another of its texts has the same component. With a null doc_id, n_shingles and kept = true
    and a null component. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    sig = stored(docs.mapInPandas(_signatures(width), "doc_id long, n long, set_id binary, bands array<long>"), "signatures")
    named = sig.where("doc_id is not null and n > 0")
    classes = named.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    chosen = classes.groupBy("rep").agg(F.min("set_id").alias("set_id"))
    reps = (named.join(chosen.withColumnRenamed("rep", "doc_id"), ["doc_id", "set_id"])
            .select(F.col("doc_id").alias("rep"), "set_id", "n", "bands").dropDuplicates(["rep"]))

    # Buckets: every member gets an edge to the least member.
    rows = reps.select("rep", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1").drop("m")
    edges = stored(rows.join(hubs, "key").where("rep <> hub").select("hub", "rep").distinct(), "star-edges")
    n_edges = edges.count()
    if not n_edges:
        return _answer(sig, classes, None)
    # Ids take few bytes in files: beyond a count, no side of a join is broadcast for the size of its files.
    large = n_edges > BROADCAST_ROWS
    side = by_shuffle if large else (lambda df: df)

    # Full sets of the texts that occur in an edge.
    ends = edges.select(F.explode(F.array("hub", "rep")).alias("doc_id")).distinct()
    sets = (rows_of(docs, ends).mapInPandas(_sets(width), "rep long, set_id binary, shingles array<long>")
            .join(chosen, ["rep", "set_id"], "left_semi"))
    sets = stored(sets.dropDuplicates(["rep"]).drop("set_id"), "sets")

    # Confirm the edges; a hub's edges are dealt over HUB_SPREAD parts.
    salted = edges.withColumn("part", F.pmod(F.hash("rep"), F.lit(HUB_SPREAD)))
    hub_sets = (salted.select("hub", "part").distinct()
                .join(side(sets.select(F.col("rep").alias("hub"), F.col("shingles").alias("hub_set"))), "hub"))
    inter = F.size(F.array_intersect("shingles", "hub_set"))
    union = F.size("shingles") + F.size("hub_set") - inter
    links = stored(salted.join(side(sets), "rep").join(side(hub_sets), ["hub", "part"])
                   .where(100 * inter >= pct * union).select("hub", "rep"), "links")

    # Candidate clusters that still hold several components.
    cluster = connected_components(edges, "hub", "rep", large).select(F.col("vertex").alias("rep"), F.col("component").alias("cluster"))
    linked = connected_components(links, "hub", "rep", large).select(F.col("vertex").alias("rep"), F.col("component").alias("comp"))
    members = stored(cluster.join(side(linked), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "members")
    sizes = members.groupBy("cluster", "comp").agg(F.count("*").alias("m"))
    # two texts are one checked edge; largest component = greatest (size, id)
    open_clusters = (sizes.groupBy("cluster")
                     .agg(F.sum("m").alias("total"), F.count("*").alias("parts"), F.max(F.struct("m", "comp")).alias("top"))
                     .where("parts > 1 and total > 2")
                     .select("cluster", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"), F.col("top.comp").alias("top")))
    rest = stored(members.join(open_clusters, "cluster").withColumn("block", F.pmod(F.hash("rep"), F.col("blocks"))), "open-clusters")
    if rest.isEmpty():
        return _answer(sig, classes, linked, side)
    # members go only where outsiders are
    outside = rest.where("comp <> top").groupBy("cluster").agg(F.collect_set("block").alias("at"))
    rest = rest.join(outside, "cluster")
    roles = F.concat(
        F.transform("at", lambda i: F.struct(F.lit(1).alias("role"), i.alias("i"), F.col("block").alias("j"))),
        F.when(F.col("comp") != F.col("top"),
               F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                           lambda j: F.struct(F.lit(0).alias("role"), F.col("block").alias("i"), j.alias("j")))
               ).otherwise(F.array().cast("array<struct<role:int,i:int,j:int>>")))
    tasks = (rest.select("cluster", "rep", "comp", F.inline(roles))
             .join(by_shuffle(reps.drop("set_id")), "rep").join(by_shuffle(sets), "rep"))      # a member is many rows here
    more = stored(tasks.groupBy("cluster", "i", "j").applyInPandas(_block_links(pct), "hub long, rep long"), "block-links")
    if not more.isEmpty():
        merged = links.unionByName(more)
        linked = connected_components(merged, "hub", "rep", large).select(F.col("vertex").alias("rep"), F.col("component").alias("comp"))
    return _answer(sig, classes, linked, side)


def _answer(sig: DataFrame, classes: DataFrame, linked: DataFrame | None, side=by_shuffle) -> DataFrame:
    """Every document with its class's representative and component."""
    if linked is None:
        classes = classes.withColumn("comp", F.col("rep"))
    else:
        classes = classes.join(side(linked), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    # a set of one row that is in no link needs no look-up; texts without words have none
    shared = stored(classes.where("copies > 1 or comp <> rep").select("set_id", "comp", "copies"), "shared-sets")
    out = attach(sig.select("doc_id", "n", "set_id"), shared, "set_id")
    alone = F.col("n") == 0
    comp = F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"),
                      F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"),
                      F.when(alone, F.lit(1)).otherwise(F.coalesce("copies", F.lit(1))).cast("long").alias("copies"))
