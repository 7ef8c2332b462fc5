"""Merkle manifest of a dataset as a content-addressed DAG, and inclusion proofs by descent.

Leaves are the digests of rows, in order within their group; every ``FANOUT``
consecutive nodes get a parent, the digest of their digests, until one is left:
the group's subroot. The subroots, in the order of the groups, are the leaves of
the tree on top. All parents go into one store of ``(digest, children)``.

A proof is found by descending from the root: at each step a request looks up
the record of the digest it stands at, takes the child that the next digit of
its rank (base ``FANOUT``) names, and collects the children it did not take. The
segments are then reversed, so that a proof reads from the leaf to the root.
Requests that share their digits so far travel as one, down to the parents of
the leaves; a parent's leaves are split off last, in the row. So the lookups
touch each record once per place, no key is hot, and a segment is moved once for
up to ``FANOUT`` proofs.

Ranks come from ranges: rows are dealt by ranges of the sort key, numbered
within a range, and shifted by the counts of the ranges before it, so no group
is sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shuffle_partitions, stored

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts), 256)


def record_digest(values: list[Column]) -> Column:
    """Digest of a record: each value as ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    return digest(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values])


def ranked(rows: DataFrame, group: str | None, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: the number from 0 of a row within its ``group`` (null is a group) by ``order``, nulls first."""
    keys = ([group] if group else []) + order
    dealt = stored(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).withColumn("__part", F.spark_partition_id()), "ranges")
    per = ["__part"] + ([group] if group else [])
    counts = dealt.groupBy(*per).agg(F.count("*").alias("__n"))
    # a row per range and group that meet: as many as ranges and groups together
    before = Window.partitionBy(group or F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy(*per).orderBy(*[F.asc_nulls_first(c) for c in order]))
    left, right = dealt.withColumn("__row", within).alias("l"), base.alias("r")
    same = F.col("l.__part") == F.col("r.__part")
    if group:
        same = same & F.col(f"l.{group}").eqNullSafe(F.col(f"r.{group}"))
    return left.join(right, same).select("l.*", (F.col("r.__base") + F.col("l.__row") - 1).alias(name)).drop("__part", "__row")


def _in_order(pairs: Column, value: str) -> Column:
    """The ``value`` fields of an array of structs, by their first field."""
    return F.transform(F.array_sort(pairs), lambda x: x[value])


def _levels(nodes: DataFrame, group: str) -> tuple[DataFrame, DataFrame | None]:
    """Fold ``(group, idx, digest)`` until each group has one node.

    Returns ``(group, digest, depth)`` and the records made on the way, None if
    there were none. A written table a level: as many as the logarithm of the
    largest group.
    """
    records: DataFrame | None = None
    roots: DataFrame | None = None
    depth = 0
    while True:
        # a group is done when its node 0 is its only one
        many = nodes.where("idx = 1").select(F.col(group).alias("__g"))
        done = nodes.join(many, nodes[group].eqNullSafe(F.col("__g")), "left_anti").select(group, "digest", F.lit(depth).alias("depth"))
        roots = done if roots is None else roots.unionByName(done)
        if many.isEmpty():
            return stored(roots, "roots"), records
        rest = nodes.join(many, nodes[group].eqNullSafe(F.col("__g")), "left_semi")
        depth += 1
        made = stored(parents(rest, group), f"level-{depth}")
        records = made if records is None else records.unionByName(made)
        nodes = made.select(group, "idx", "digest")


def parents(nodes: DataFrame, group: str, *extra: Column) -> DataFrame:
    """One level up: ``(group, idx, children, digest)``, ``extra`` aggregates in between."""
    up = nodes.groupBy(group, F.floor(F.col("idx") / FANOUT).cast("long").alias("idx")).agg(
        F.collect_list(F.struct("idx", "digest")).alias("kids"), *extra)
    children = _in_order(F.col("kids"), "digest")
    return up.withColumn("children", children).drop("kids").withColumn("digest", F.sha2(F.concat_ws("", "children"), 256))


@dataclass
class Manifest:
    """``store``: (digest, children); ``root``; ``groups``: (group, rank, subroot, depth); ``top_depth``;
    ``leaves``: (group, rank, digest and the rows' other columns)."""

    store: DataFrame | None
    root: str | None
    groups: DataFrame
    top_depth: int
    leaves: DataFrame
    group: str


def build(leaves: DataFrame, group: str, order: list[str]) -> Manifest:
    """The manifest of rows with a ``digest``, by ``group`` and in ``order`` within it (ties: by digest)."""
    leaves = stored(ranked(leaves, group, [*order, "digest"], "rank"), "leaves")
    subroots, records = _levels(leaves.select(group, F.col("rank").alias("idx"), "digest"), group)
    numbered = ranked(subroots, None, [group], "no")
    groups = stored(numbered.select(group, F.col("no").alias("rank"), F.col("digest").alias("subroot"), "depth"), "groups")
    top, more = _levels(groups.select(F.lit(0).alias("one"), F.col("rank").alias("idx"), F.col("subroot").alias("digest")), "one")
    tip = top.first()
    both = [x.select("digest", "children") for x in (records, more) if x is not None]
    store = None
    if both:
        store = both[0] if len(both) == 1 else both[0].unionByName(both[1])
        store = stored(store.dropDuplicates(["digest"]), "store")
    return Manifest(store, tip["digest"] if tip else None, groups, tip["depth"] if tip else 0, leaves, group)


NO_PATH = "array<struct<left:string,right:string>>"


def _segment(children: Column, digit: Column) -> Column:
    """The children that were not taken, as the digests left and right of the one that was."""
    n = F.size(children)
    return F.struct(F.concat_ws("", F.slice(children, 1, digit)).alias("left"),
                    F.concat_ws("", F.slice(children, digit + 2, F.greatest(n - digit - 1, F.lit(0)))).alias("right"))


def _descend(at: DataFrame, store: DataFrame, keep: list[str], wanted: DataFrame | None) -> DataFrame:
    """Every request of ``at`` (``keep``, prefix, level, digest, path) moved one level down, to each child that is wanted.

    ``wanted`` has (``keep``, level, prefix) of the places that lie on a
    requested path; None asks for all.
    """
    met = at.join(store, "digest")
    down = met.select(*keep, "prefix", "level", "path", "children", F.posexplode("children").alias("digit", "child"))
    down = down.select(*keep, (F.col("prefix") * FANOUT + F.col("digit")).alias("prefix"), (F.col("level") - 1).alias("level"),
                       F.col("child").alias("digest"), F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))).alias("path"))
    if wanted is None:
        return down
    same = (F.col("d.prefix") == F.col("w.prefix")) & (F.col("d.level") == F.col("w.level"))
    for c in keep:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"w.{c}"))
    return down.alias("d").join(wanted.alias("w"), same, "left_semi")


def paths(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``(group, idx, children, path)``: for the requested leaves' parents their children and the
    segments from the root down to them; ``idx`` is the parent's number.

    ``requests`` has (group, rank) of leaves; None asks for all. A subroot that
    is a lone leaf has the number -1 and itself as its only child.
    """
    spark = m.leaves.sparkSession
    groups = m.groups
    if requests is not None:
        named = requests.select(F.col(m.group).alias("__g")).distinct()
        groups = groups.join(named, groups[m.group].eqNullSafe(F.col("__g")), "left_semi")
    start = spark.createDataFrame([(0, 0, m.top_depth, m.root)], "one int, prefix long, level int, digest string").withColumn(
        "path", F.array().cast(NO_PATH))
    for step in range(m.top_depth):
        level = m.top_depth - step - 1
        on_path = groups.select(F.lit(0).alias("one"), F.lit(level).alias("level"),
                                F.floor(F.col("rank") / FANOUT ** level).cast("long").alias("prefix")).distinct()
        start = stored(_descend(start, m.store, ["one"], on_path if requests is not None else None), f"descent-top-{step}")
    at = groups.join(start.select(F.col("prefix").alias("rank"), "path"), "rank").select(
        m.group, F.lit(0).cast("long").alias("prefix"), F.col("depth").alias("level"), F.col("subroot").alias("digest"), "path")
    lone = at.where("level = 0").select(m.group, F.lit(-1).cast("long").alias("idx"), F.array("digest").alias("children"), "path")
    at = stored(at.where("level > 0"), "descent-0")
    out, step = lone, 0
    while m.store is not None:
        ready = at.where("level = 1").join(m.store, "digest").select(m.group, F.col("prefix").alias("idx"), "children", "path")
        out = out.unionByName(ready)
        rest = at.where("level > 1")
        if rest.isEmpty():
            break
        step += 1
        on_path = None
        if requests is not None:
            depth = requests.join(m.groups.select(F.col(m.group).alias("__g"), "depth"), requests[m.group].eqNullSafe(F.col("__g")))
            on_path = depth.withColumn("level", F.col("depth") - step).where("level >= 1").select(
                m.group, "level", F.floor(F.col("rank") / F.pow(F.lit(float(FANOUT)), F.col("level"))).cast("long").alias("prefix")).distinct()
        at = stored(_descend(rest, m.store, [m.group], on_path), f"descent-{step}")
    return out


def fold(leaf: Column, segments: Column) -> Column:
    """The root recomputed from a leaf and its proof."""
    return F.aggregate(segments, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def prove(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``(group, rank, leaf, path)`` of the requested leaves (None: all); ``path`` from the leaf to the root.

    A path's segment holds the digests left and right of the node it passes.
    """
    found = paths(m, requests)
    lone = F.col("idx") < 0
    split = found.select(m.group, "idx", "children", "path", F.posexplode("children").alias("digit", "leaf"))
    path = F.when(lone, F.col("path")).otherwise(F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))))
    out = split.select(m.group, F.when(lone, F.lit(0)).otherwise(F.col("idx") * FANOUT + F.col("digit")).cast("long").alias("rank"),
                       "leaf", F.reverse(path).alias("path"))
    if requests is None:
        return out
    asked = requests.select(F.col(m.group).alias("__g"), F.col("rank").alias("__r")).distinct()
    return out.join(asked, out[m.group].eqNullSafe(F.col("__g")) & (F.col("rank") == F.col("__r")), "left_semi")


def document_leaves(docs: DataFrame) -> DataFrame:
    """``(source, doc_id, digest, tampered)``; ``tampered`` is the digest of the row with its
    text's A-Z lower-cased where 5 divides the checksum of doc_id, else null."""
    fields = [F.col(c) for c in FIELDS]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = [*fields[:-1], F.translate("text", upper, upper.lower())]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select("source", "doc_id", record_digest(fields).alias("digest"), F.when(hit, record_digest(lower)).alias("tampered"))


def prove_documents(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root, proof and the check of a partly tampered copy for every row of ``docs``.

    ``docs`` needs the columns ``FIELDS``; others are ignored. Null values have
    their own mark in a leaf; a null source is a group, the first; null doc_ids
    come first in theirs and are never tampered with. Repeated rows are leaves
    of their own, side by side; rows of one doc_id with different content are
    ordered by digest. A source's lone row is its own subroot. An empty table
    gives an empty result.
    """
    m = build(document_leaves(docs), "source", ["doc_id"])
    # The rows of a parent's leaves ride in one row with the parent's path.
    found, held = paths(m), F.struct("rank", "doc_id", "digest", "tampered")
    depth = m.groups.select(F.col("source").alias("g_source"), "subroot", "depth")
    leaves = m.leaves.join(depth, m.leaves["source"].eqNullSafe(F.col("g_source")))
    owner = F.when(F.col("depth") == 0, F.lit(-1)).otherwise(F.floor(F.col("rank") / FANOUT)).cast("long")
    rows = leaves.groupBy("source", owner.alias("p_idx")).agg(F.sort_array(F.collect_list(held)).alias("rows"), F.first("subroot").alias("subroot"))
    same = rows["source"].eqNullSafe(found["source"]) & (F.col("p_idx") == F.col("idx"))
    one = rows.join(found.withColumnRenamed("path", "down"), same).select("subroot", "idx", "children", "down", F.posexplode("rows").alias("digit", "row"))
    path = F.when(F.col("idx") < 0, F.col("down")).otherwise(F.concat("down", F.array(_segment(F.col("children"), F.col("digit")))))
    one = one.select("row.doc_id", F.element_at("children", F.col("digit") + 1).alias("leaf"), "row.tampered", "subroot", F.reverse(path).alias("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = one.select("doc_id", "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
