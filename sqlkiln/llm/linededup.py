"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words. Words are ordered by rarity, rarest first; two
lines with a Jaccard similarity of at least ``pct`` % must share a word among
the first few of each (prefix filter). A shared word then has to leave room for
the overlap that is needed, by the lines' sizes (length filter) and by its place
in both (positional filter), and the lines' parity sketches (64 bits, up to 256
for lines of many words) may not differ in more bits than the lines may differ
in words. What passes is verified on the words themselves. A line goes when any earlier line of the corpus -- by
doc_id, then text, then line number -- is that similar; equal lines first
collapse into one, so a line that is everywhere costs one row.

One similar earlier line is enough, so most pairs of a group of near copies are
never needed. First each line is held against *hubs*, the earliest lines with
two words of its prefix in a row: the closest is its one candidate, whatever the
group's size. Lines of such groups that this leaves open choose hubs among themselves,
as long as that settles a good part. Only what is still open is looked up in the prefix join,
among all lines before them; a line's candidates are reduced to the closest
where they arise. Lines whose closest candidate fails, and only these, have all
theirs verified.

Rarity is counted over all words of all texts in ``BUCKETS`` hash buckets, a
table of fixed size. Any fixed order keeps the join exact; the counts make it
fast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_IDS, shuffle_partitions, stored

BUCKETS = 1 << 17
LEAD = 4               # words that a prefix has at least; two in a row name a hub
HALVES, QUARTERS = 24, 64   # words from which a sketch is kept in two, or four, parts
HUB_SPREAD = 64        # parts that the lines of one hub are dealt over
PASSES = 4             # shares of the words that the prefix join takes one after the other


def _plain(text: Column) -> Column:
    """``text`` with a space for every other blank but the line end; these are rare."""
    odd = F.lit(False)
    for c in "\t\v\f\r":
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.translate(text, "\t\v\f\r", "    ")).otherwise(text)


def _words(line: Column) -> Column:
    """Distinct words of a plain line; splitting at one character needs no regular expression."""
    return F.array_remove(F.array_distinct(F.split(line, " ", -1)), "")


def _eligible(line: Column, min_tokens: int) -> Column:
    """Whether a plain line has ``min_tokens`` distinct words."""
    return F.trim(line) != "" if min_tokens == 1 else F.size(_words(line)) >= min_tokens


def _rarity(docs: DataFrame) -> Column:
    """Per bucket of word hashes the magnitude of its count, as an array literal.

    ``BUCKETS`` counts reach the driver, whatever the corpus, and go back as a
    constant.
    """
    words = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1)).alias("word")).where("word <> ''")
    rows = (words.groupBy(F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")).count()
            .select("bucket", F.least(F.floor(F.log2("count")), F.lit(31)).cast("int").alias("size")).toPandas())
    table = ["0"] * BUCKETS
    for bucket, size in zip(rows["bucket"], rows["size"]):
        table[bucket] = str(size)
    return F.split(F.lit(",".join(table)), ",").cast("array<int>")


def _needed(n: Column, pct: int) -> Column:
    """Words that a set of ``n`` shares at least with any similar set."""
    return F.floor((pct * n + 99) / 100).cast("int")


SKETCH = ("s_all", "s_more")


def _sketches(keys: Column, n: Column) -> list[Column]:
    """Parity sketch of a set: bit b tells whether an odd number of hashes has b in its low 6 bits.

    ``s_all`` counts all words. From ``HALVES`` words on ``s_more`` has ``half``
    of those with hash bit 6, and from ``QUARTERS`` on ``q2`` and ``q3`` of those
    with bit 7 and without or with bit 6. The other parts are differences of these.
    """
    def parity(*bits: tuple[int, int]) -> Column:
        def step(acc: Column, k: Column) -> Column:
            flip = acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int")))
            mask, want = sum(1 << b for b, _ in bits), sum(v << b for b, v in bits)
            return F.when(k.bitwiseAND(F.lit(mask)) == want, flip).otherwise(acc) if bits else flip
        return F.aggregate(keys, F.lit(0).cast("long"), step)
    quarters = n >= QUARTERS
    more = F.struct(parity((6, 1)).alias("half"), F.when(quarters, parity((6, 0), (7, 1))).alias("q2"),
                    F.when(quarters, parity((6, 1), (7, 1))).alias("q3"))
    return [parity().alias("s_all"), F.when(n >= HALVES, more).alias("s_more")]


def _differing(a: str, b: str) -> Column:
    """Bits in which two sketches differ, in as many parts as both have: words differ in no fewer."""
    d_all, d_half, d2, d3 = (F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")) for c in ("s_all", "s_more.half", "s_more.q2", "s_more.q3"))
    rest = d_all.bitwiseXOR(d_half)
    four = F.bit_count(d2) + F.bit_count(d3) + F.bit_count(d_half.bitwiseXOR(d3)) + F.bit_count(rest.bitwiseXOR(d2))
    return F.coalesce(four, F.bit_count(d_half) + F.bit_count(rest), F.bit_count(d_all))


def _line_sets(docs: DataFrame, pct: int, min_tokens: int) -> DataFrame:
    """One row per distinct word set: ``(set_no, at, n, prefix)`` and its sketch.

    ``at`` is its first place ``(doc_id, rev, line_no)``, and ``set_no`` ascends
    with it. ``prefix``: the rarest words' hashes (31 bits), ``LEAD`` at least.
    """
    table = _rarity(docs)

    def key(h: Column) -> Column:
        """Magnitude of the word's count, then 58 bits of its hash: sorts by rarity."""
        size = F.get(table, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        return F.shiftleft(size.cast("long"), 58).bitwiseOR(h.bitwiseAND(F.lit((1 << 58) - 1)))

    # array_except also drops repetitions
    hashes = F.array_except(F.transform(F.split("line", " ", -1), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))
    lines = docs.select("doc_id", "rev", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(_eligible(F.col("line"), 1))
    keyed = lines.select(F.struct("doc_id", "rev", "line_no").alias("at"), F.sort_array(F.transform(hashes, key)).alias("keys"))
    n = F.size("keys")
    first = F.slice("keys", 1, F.greatest(n - _needed(n, pct) + 1, F.lit(LEAD)))
    # small sets leave after the aggregate, so that keys are computed once
    sets = (keyed.select("at", F.xxhash64("keys").alias("c1"), F.xxhash64(F.lit(1), "keys").alias("c2"), n.alias("n"), *_sketches(F.col("keys"), n),
                    F.transform(first, lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("prefix"))
            .groupBy("c1", "c2").agg(F.min("at").alias("at"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in SKETCH], F.first("prefix").alias("prefix"))
            .where(F.col("n") >= min_tokens))
    ordered = sets.drop("c1", "c2").repartitionByRange(shuffle_partitions(docs.sparkSession), "at").sortWithinPartitions("at")
    return stored(ordered.withColumn("set_no", F.monotonically_increasing_id()), "line-sets")


def _overlap(na: Column, nb: Column, pct: int) -> Column:
    """Common words that two sets of these sizes need."""
    return F.floor((pct * (na + nb) + 99 + pct) / (100 + pct))


def _hub_candidates(sets: DataFrame, pct: int) -> tuple[DataFrame, DataFrame]:
    """``(later, earlier)``: per set its closest hub that the filters leave, if any;
    and ``set_no`` of all sets that have a hub."""
    ahead = F.size("prefix") - 1
    key = F.explode(F.zip_with(F.slice("prefix", 1, ahead), F.slice("prefix", 2, ahead),
                               lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long")))).alias("key")
    hubs = stored(sets.select("set_no", key).groupBy("key").agg(F.min("set_no").alias("earlier"), F.count("*").alias("m"))
                  .where("m > 1").select("key", "earlier"), "hubs")
    few = hubs.count() <= BROADCAST_IDS
    hubs = sets.select(F.col("set_no").alias("earlier"), F.col("n").alias("hub_n"), *[F.col(c).alias(f"hub_{c}") for c in SKETCH]).join(
        F.broadcast(hubs) if few else hubs, "earlier")
    hubs = stored(hubs, "hub-sketches")
    rows, hubs = sets.select("set_no", *SKETCH, "n", key), F.broadcast(hubs) if few else hubs
    n, hub_n, bits = F.col("n"), F.col("hub_n"), _differing("", "hub_")
    met = rows.join(hubs, "key").where(F.col("earlier") < F.col("set_no"))
    near = met.where((100 * F.least(n, hub_n) >= pct * F.greatest(n, hub_n))
                                        & (bits <= n + hub_n - 2 * _overlap(n, hub_n, pct)))
    best = near.groupBy(F.col("set_no").alias("later")).agg(F.min(F.struct(bits.alias("bits"), "earlier")).alias("b")).select("later", "b.earlier")
    return stored(best, "hub-candidates"), met.select("set_no").distinct()


def _settled_by_hubs(docs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The distinct ``later`` that are similar to a hub, in rounds over the lines that groups leave open."""
    open_sets, found, n_first = sets, None, 0
    while True:
        tried, members = _hub_candidates(open_sets, pct)
        n = tried.count()
        got = stored(_verified(tried, docs, sets, pct), "lines-settled")
        found = got if found is None else found.unionByName(got)
        n_got, n_first = got.count(), n_first or n
        if n_got * 10 < n or n_got * 50 < n_first or not n:
            return stored(found, "lines-settled-by-hubs")
        ids = stored(members, "hub-members")
        few = ids.count() <= BROADCAST_IDS
        open_sets = stored(_without(open_sets.join(F.broadcast(ids) if few else ids, "set_no", "left_semi"), got), "open-members")


def _in_passes(sets: DataFrame, open_sets: DataFrame, pct: int, reduce, tag: str) -> DataFrame:
    """``reduce`` of the prefix candidates, word share by word share: the join of all words
    takes ``PASSES`` steps, each written, so that the shuffle of one share is on disk at a time."""
    out = None
    for k in range(PASSES):
        part = stored(reduce(_prefix_candidates(sets, open_sets, pct, k)), f"{tag}-{k}")
        out = part if out is None else out.unionByName(part)
    return out


def _prefix_candidates(sets: DataFrame, open_sets: DataFrame, pct: int, share: int) -> DataFrame:
    """``(later, earlier, bits)``: pairs of an open set and any earlier set that pass all filters
    and have a prefix word of the given share (of ``PASSES``) in common.

    A row of the join is a word of a prefix; its place and its line's size share
    a number, to keep what is shuffled small. A pair may come more than once.
    """
    def rows(df: DataFrame, prefix: str) -> DataFrame:
        n = F.col("n")
        part = df.select("set_no", *SKETCH, "n", F.posexplode(F.slice("prefix", 1, n - _needed(n, pct) + 1)).alias("pos", "token"))
        part = part.where(F.col("token") % PASSES == share)
        return part.select("token", F.col("set_no").alias(f"{prefix}_no"), *[F.col(c).alias(f"{prefix}_{c}") for c in SKETCH],
                           (n * F.lit(1 << 24).cast("long") + F.col("pos")).alias(f"{prefix}_place"))
    y, x = rows(open_sets, "y"), rows(sets, "x")
    nx, ny = (F.shiftright(F.col(f"{c}_place"), 24) for c in "xy")
    px, py = (F.col(f"{c}_place").bitwiseAND(F.lit((1 << 24) - 1)) for c in "xy")
    need, bits = _overlap(nx, ny, pct), _differing("x_", "y_")
    near = ((F.col("x_no") < F.col("y_no")) & (100 * F.least(nx, ny) >= pct * F.greatest(nx, ny))
            & (F.least(px, py) + F.least(nx - px, ny - py) >= need) & (bits <= nx + ny - 2 * need))
    return y.join(x, "token").where(near).select(F.col("y_no").alias("later"), F.col("x_no").alias("earlier"), bits.alias("bits"))


def _without(sets: DataFrame, gone: DataFrame) -> DataFrame:
    """``sets`` but those in ``gone`` (``later``, distinct, stored), broadcast as long as these are few enough."""
    gone = gone.select(F.col("later").alias("set_no"))
    return sets.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "set_no", "left_anti")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The distinct ``later`` of ``pairs`` (stored) whose words are similar enough.

    Only the lines concerned are read again, picked from their documents by number.
    """
    ends = pairs.select(F.col("earlier").alias("set_no")).distinct().unionByName(pairs.select(F.col("later").alias("set_no")).distinct()).distinct()
    places = sets.select("set_no", "at").join(ends, "set_no").select("at.*", "set_no")
    wanted = stored(places.groupBy("doc_id", "rev").agg(F.collect_list(F.struct("line_no", "set_no")).alias("wanted"), F.count("*").alias("n")),
                    "lines-wanted")
    few = (wanted.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_IDS
    texts = docs.join(F.broadcast(wanted) if few else wanted, ["doc_id", "rev"]).withColumn("lines", F.split("text", "\n", -1))
    lines = texts.select("lines", F.explode("wanted").alias("w")).select("w.set_no", F.get("lines", F.col("w.line_no")).alias("line"))
    lines = stored(lines.dropDuplicates(["set_no"]), "lines")          # repeated rows hold a line more than once
    # A hub's pairs are dealt over HUB_SPREAD parts.
    salted = pairs.withColumn("part", F.pmod(F.hash("later"), F.lit(HUB_SPREAD)))
    hubs = (salted.select("earlier", "part").distinct()
            .join(lines.select(F.col("set_no").alias("earlier"), _words(F.col("line")).alias("we")), "earlier"))
    both = (salted.join(lines.select(F.col("set_no").alias("later"), F.col("line").alias("ll")), "later").join(hubs, ["earlier", "part"])
            .select("later", "we", _words(F.col("ll")).alias("wl")))
    inter = F.size(F.array_intersect("we", "wl"))
    return both.where(100 * inter >= pct * (F.size("we") + F.size("wl") - inter)).select("later").distinct()


def _revisions(docs: DataFrame) -> DataFrame:
    """``(doc_id, rev, text)`` of the rows that have a place; ``rev`` tells texts of one doc_id apart."""
    docs = docs.where("doc_id is not null and text is not null")
    return docs.select("doc_id", F.xxhash64("text").alias("rev"), _plain(F.col("text")).alias("text"))


def first_lines(docs: DataFrame, pct: int = 80, min_tokens: int = 1) -> DataFrame:
    """``(doc_id, rev, line_no)`` of the eligible lines that stay, one row each.

    Eligible are lines of at least ``min_tokens`` distinct words. ``docs`` has
    ``doc_id`` and ``text``; rows without either are left out. ``rev`` is the
    text's ``xxhash64``.
    """
    docs = _revisions(docs)
    every = _line_sets(docs, pct, min_tokens)
    # A set of n words can be similar to another only if one word more or less still is.
    sets = every.where(100 * F.col("n") >= pct * (F.col("n") + 1))
    settled = _settled_by_hubs(docs, sets, pct)

    def closest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("later").agg(F.min(F.struct("bits", "earlier")).alias("b")).select("later", "b.earlier", "b.bits")

    best = closest(_in_passes(sets, _without(sets, settled), pct, closest, "closest"))
    best = stored(best.drop("bits"), "closest")
    more = stored(_verified(best, docs, sets, pct), "lines-settled-2")
    left = stored(best.join(more, "later", "left_anti").select("later", F.col("earlier").alias("failed")), "lines-left")
    settled = settled.unionByName(more)
    if not left.isEmpty():
        still = sets.join(left.select(F.col("later").alias("set_no")), "set_no", "left_semi")
        others = _in_passes(sets, stored(still, "sets-left"), pct, lambda pairs: pairs.select("later", "earlier").distinct(), "pairs")
        others = others.distinct().join(left, "later").where("earlier <> failed").select("later", "earlier")
        settled = settled.unionByName(_verified(stored(others, "pairs-left"), docs, sets, pct))
    gone = stored(settled, "lines-gone")
    return _without(every.select("set_no", "at"), gone).select("at.*")


def line_report(docs: DataFrame, pct: int = 80, min_tokens: int = 1) -> DataFrame:
    """``(doc_id, n_lines, n_eligible, n_removed, kept_lines)`` per row of ``docs``.

    ``kept_lines``: numbers (from 0) of the eligible lines that stay, ascending,
    joined by commas. Null text has no lines; an empty text has one line with
    no words. Repeated rows (one doc_id, one text) share their places, so both
    keep the first's lines; rows of one doc_id with different texts are texts
    of their own, in an order fixed by their content. A null doc_id has no
    place in the order: its lines stay and remove nothing. An empty table gives
    an empty result.
    """
    docs = docs.select("doc_id", "text")
    kept = (first_lines(docs, pct, min_tokens).groupBy("doc_id", "rev")
            .agg(F.array_join(F.array_sort(F.collect_list("line_no")), ",").alias("kept_lines"), F.count("*").alias("n_kept")))
    lines = F.coalesce(F.split("text", "\n", -1), F.array().cast("array<string>"))
    sizes = (docs.select("doc_id", F.xxhash64("text").alias("rev"), _plain(F.col("text")).alias("text"))
             .select("doc_id", "rev", F.size(lines).cast("long").alias("n_lines"),
                     F.size(F.filter(lines, lambda x: _eligible(x, min_tokens))).cast("long").alias("n_eligible")))
    out = sizes.join(kept, ["doc_id", "rev"], "left")
    return out.select("doc_id", "n_lines", "n_eligible",
                      F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("n_eligible") - F.coalesce("n_kept", F.lit(0))).cast("long").alias("n_removed"),
                      F.coalesce("kept_lines", F.lit("")).alias("kept_lines"))


def dedup_lines(docs: DataFrame, pct: int = 80, min_tokens: int = 1) -> DataFrame:
    """``docs`` with its repeated lines removed from ``text``; all columns stay.

    Lines that stay keep their order and their text; lines without words stay.
    A text that loses every line becomes empty; null texts and rows of a null
    doc_id stay as they are. Repeated rows and doc_ids: as in ``line_report``.
    """
    kept = (first_lines(docs.select("doc_id", "text"), pct, min_tokens).groupBy("doc_id", F.col("rev").alias("__rev"))
            .agg(F.collect_list("line_no").alias("__kept")))
    none = F.array().cast("array<int>")
    lines = F.split("text", "\n", -1)
    text = F.array_join(F.filter(lines, lambda x, i: ~_eligible(_plain(x), min_tokens) | F.array_contains(F.coalesce("__kept", none), i)), "\n")
    return (docs.withColumn("__rev", F.xxhash64("text")).join(kept, ["doc_id", "__rev"], "left")
            .withColumn("text", F.when(F.col("doc_id").isNull(), F.col("text")).otherwise(text)).select(*docs.columns))
