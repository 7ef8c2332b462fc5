"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

A text is cut at line ends into paragraphs; paragraphs are grouped into
sections, which end after a blank line or after a paragraph whose hash says so
(one in eight), so that an edit moves no boundary elsewhere. Inside a paragraph
the leaves are phrases: runs of words that end where a word's hash says so (one
in six). All cuts depend on the content around them alone.

A node hashes its children's hashes, the root those of the sections and the
text's size. Equal texts have equal roots; where roots differ, only differing
branches need a look, which locates the edit and measures what both share.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import shuffle_partitions

SECTION_EVERY, PHRASE_EVERY = 8, 6
_CUTS_HELD = 300_000


class _WordEnds(dict):
    """word -> whether it ends a phrase; remembers a bounded number of words."""

    def __missing__(self, word: str) -> bool:
        ends = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % PHRASE_EVERY == 0
        if len(self) < _CUTS_HELD:
            self[word] = ends
        return ends


_ENDS = _WordEnds()


def phrases(paragraph: str) -> list[str]:
    """The paragraph's phrases; joined by single spaces they are the paragraph."""
    words = paragraph.split(" ")
    flags = list(map(_ENDS.__getitem__, words))
    out, a = [], 0
    for b in [i + 1 for i, end in enumerate(flags) if end]:
        out.append(" ".join(words[a:b]))
        a = b
    if a < len(words):
        out.append(" ".join(words[a:]))
    return out


def _node(children: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(children), digest_size=16).digest()


class Tree:
    """Hashes of a text's sections and paragraphs, and its leaves with their sizes."""

    __slots__ = ("root", "sections", "leaves", "weight")

    def __init__(self, text: str):
        self.sections: list[tuple[bytes, list[bytes]]] = []
        self.leaves: Counter = Counter()
        held: list[bytes] = []
        for paragraph in text.split("\n"):
            leaf_hashes = []
            for phrase in phrases(paragraph):
                raw = phrase.encode("utf-8", "surrogatepass")
                h = xxhash.xxh3_128_digest(raw)
                leaf_hashes.append(h)
                if raw:
                    self.leaves[h] += len(raw)
            held.append(_node(leaf_hashes))
            if not paragraph.strip() or held[-1][0] % SECTION_EVERY == 0:
                self.sections.append((_node(held), held))
                held = []
        if held:
            self.sections.append((_node(held), held))
        self.weight = sum(self.leaves.values())
        size = str(len(text)).encode()
        self.root = hashlib.blake2b(size + b"".join(s for s, _ in self.sections), digest_size=16).hexdigest()


def likeness(a: Tree, b: Tree) -> float:
    """Share of the two texts' bytes in common leaves (Dice, 0 to 1); equal roots give 1."""
    if a.root == b.root:
        return 1.0
    if not a.weight or not b.weight:
        return 0.0
    small, large = (a, b) if len(a.leaves) <= len(b.leaves) else (b, a)
    other = large.leaves
    both = sum(min(n, other[h]) for h, n in small.leaves.items() if h in other)
    return 2.0 * both / (a.weight + b.weight)


def changed_paragraphs(a: Tree, b: Tree) -> list[int]:
    """Positions of the paragraphs of ``b`` that ``a`` lacks; equal sections are skipped whole."""
    known_sections = {s for s, _ in a.sections}
    known = {p for _, ps in a.sections for p in ps}
    out, at = [], 0
    for section, ps in b.sections:
        if section not in known_sections:
            out += [at + i for i, p in enumerate(ps) if p not in known]
        at += len(ps)
    return out


def _next_rows(docs: DataFrame) -> DataFrame:
    """``docs`` dealt by ranges of doc_id, each range followed by the row after it.

    Rows of ``(part, tail, doc_id, text)``, sorted: parts are ranges between
    ids that occur, so the row after a range is the next range's first; it is
    dealt twice, the second time (``tail``) to the range before. The last range
    gets the table's first row.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark) * 2
    ids = docs.select("doc_id").where("doc_id is not null")
    edges = (ids.repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("p"))
             .agg(F.min("doc_id").alias("first")).orderBy("first").toPandas()["first"].to_numpy("int64"))   # at most n ids
    if not len(edges):
        edges = np.zeros(1, np.int64)
    has_null = not docs.where("doc_id is null").isEmpty()

    @F.pandas_udf("struct<part:int,starts:boolean>")
    def place(doc_id: pd.Series) -> pd.DataFrame:
        """The range of an id and whether it is the range's first; only ids pass here."""
        given = doc_id.notna().to_numpy()
        x = doc_id.fillna(0).to_numpy("int64")
        part = np.where(given, np.maximum(np.searchsorted(edges, x, "right") - 1, 0), 0)
        return pd.DataFrame({"part": part.astype("int32"), "starts": given & (edges[part] == x)})

    placed = docs.select("doc_id", "text").withColumn("at", place("doc_id"))
    part = F.col("at.part")
    first = F.col("doc_id").isNull() if has_null else F.col("at.starts") & (part == 0)
    own = F.struct(part.alias("part"), F.lit(0).alias("tail"))
    before = F.struct((part - 1).alias("part"), F.lit(1).alias("tail"))
    last = F.struct(F.lit(len(edges) - 1).alias("part"), F.lit(1).alias("tail"))
    none = F.array().cast("array<struct<part:int,tail:int>>")
    copies = F.concat(F.array(own), F.when(F.col("at.starts") & (part > 0), F.array(before)).otherwise(none),
                      F.when(first, F.array(last)).otherwise(none))
    return (placed.select("doc_id", "text", F.inline(copies)).repartitionById(len(edges), F.col("part"))
            .sortWithinPartitions("part", "tail", "doc_id", "text"))


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fingerprints of each row, its edited text and the next row, in one stream."""
    held = None                 # (part, doc_id, text, tree) waiting for the row after it
    closed = None               # the part whose tail has been used
    for pdf in batches:
        rows = []
        for part, tail, doc_id, text in zip(pdf["part"], pdf["tail"], pdf["doc_id"], pdf["text"]):
            if tail and part == closed:
                continue
            text = text if isinstance(text, str) else ""
            tree = Tree(text)
            if held is not None and held[0] == part:
                _, own_id, own, own_tree = held
                cut = len(own) // 2
                edited = own[:len(own) - cut] + text[:cut]
                edited_tree = Tree(edited)
                rows.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                             own_tree.root, edited_tree.root, likeness(own_tree, edited_tree), likeness(own_tree, tree),
                             len(own_tree.sections), sum(len(p) for _, p in own_tree.sections),
                             changed_paragraphs(own_tree, edited_tree)))
            held = None if tail else (part, doc_id, text, tree)
            if tail:
                closed = part
        yield pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                                          "near_next", "n_sections", "n_paragraphs", "edited_paragraphs"]).astype({"doc_id": "Int64"})


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited text, and their likeness.

    ``docs`` needs ``doc_id`` (long) and ``text`` (null: empty). The edited text
    swaps the last half of a text for the start of the next document's. The
    order is by doc_id, then text, null ids first; the last row's next is the
    first. Repeated rows count one by one. An empty table gives an empty result.
    """
    return _next_rows(docs.select("doc_id", "text")).mapInPandas(
        _walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
               "near_next double, n_sections long, n_paragraphs long, edited_paragraphs array<long>")
