"""Key and inclusion-dependency discovery over table data.

For tables without declared keys (Parquet, CSV, spreadsheets) the pk and FK
flags the schema graph needs are inferred from the data itself.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

KEY_TYPES = (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.StringType, T.DateType, T.TimestampType,
             T.TimestampNTZType)
INTEGRAL = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)


def family(dt: T.DataType) -> str | None:
    if isinstance(dt, INTEGRAL):
        return "integer"
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return None


KEY_PROFILE_SCHEMA = "table_name string, key_columns string, n_columns int, n_rows long"


SAMPLE_ROWS = 20_000       # rows in which duplicates are looked for first


def digest(*cols) -> list:
    """Two 64-bit hashes of the columns' text: a 128-bit stand-in for long values."""
    text = [F.col(c).cast("string") for c in cols]
    return [F.xxhash64(*text).alias("h1"), F.xxhash64(F.lit(1), *text).alias("h2")]


VALUE_SHARE = 64           # one in so many values is looked at before all are


def _duplicated(tables: dict[str, DataFrame], cands: dict[str, list[tuple[str, ...]]], share: int = 1) -> set[tuple[str, tuple[str, ...]]]:
    """Column sets that hold a duplicate value, over all tables in one job.

    Rows are fanned out once per candidate as (number, digest) and grouped;
    partial aggregation runs map-side. The result is at most one row per candidate.
    ``share``: only of one in ``share`` values, with all their rows, so that what is
    found is a duplicate, and what is not may still be one.
    """
    numbered = [(t, c) for t, cs in cands.items() for c in cs]
    rows = None
    for t in cands:
        own = [F.struct(F.lit(i).alias("no"), *digest(*c)) for i, (u, c) in enumerate(numbered) if u == t]
        if own:
            part = tables[t].select(F.inline(F.array(*own)))
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return set()
    if share > 1:
        rows = rows.where(F.pmod("h1", F.lit(share)) == 0)
    dup = rows.groupBy("no", "h1", "h2").count().where(F.col("count") > 1).select("no").distinct()
    return {numbered[r.no] for r in dup.collect()}


def _all_duplicated(tables: dict[str, DataFrame], cands: dict[str, list[tuple[str, ...]]]) -> set[tuple[str, tuple[str, ...]]]:
    """As ``_duplicated`` over all rows; only what a share of the values leaves open is shuffled whole."""
    bad = _duplicated(tables, cands, VALUE_SHARE)
    return bad | _duplicated(tables, {t: [c for c in cs if (t, c) not in bad] for t, cs in cands.items()})


def key_profile(spark: SparkSession, tables: dict[str, DataFrame], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Minimal candidate keys of one or two columns per table.

    A duplicate found in a sample of rows proves that a candidate is no key;
    whatever the sample cannot disprove gets the exact check over all rows,
    singles first, then the pairs that hold no key. Nothing is decided by an
    estimate. Columns with nulls and floating-point measures are never keys.
    Exact checks look at a share of the values first, which drops most candidates
    that are none. Six jobs in all, however many tables there are: each takes all tables.
    """
    cols = {t: [f.name for f in df.schema.fields if isinstance(f.dataType, KEY_TYPES)] for t, df in tables.items()}
    counts = None
    for t, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count(c) for c in cols[t]]).cast("array<long>").alias("filled")).withColumn("t", F.lit(t))
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        return spark.createDataFrame([], KEY_PROFILE_SCHEMA)
    stats = {r["t"]: r for r in counts.collect()}                  # one row a table
    n = {t: stats[t]["n"] for t in tables}
    full = {t: [c for c, k in zip(cols[t], stats[t]["filled"]) if n[t] and k == n[t]] for t in tables}
    cands = {t: [(c,) for c in full[t]] + list(combinations(full[t], 2)) for t in tables}
    some = {t: df if n[t] <= sample_rows else df.sample(sample_rows / n[t], seed=11) for t, df in tables.items()}
    bad = _duplicated(some, cands)
    left = {t: [c for c in cs if (t, c) not in bad] for t, cs in cands.items()}
    large = [t for t in tables if n[t] > sample_rows]
    bad = _all_duplicated(tables, {t: [c for c in left[t] if len(c) == 1] for t in large})
    keys = {t: [c[0] for c in left[t] if len(c) == 1 and (t, c) not in bad] for t in tables}
    pairs = {t: [c for c in left[t] if len(c) == 2 and not set(keys[t]) & set(c)] for t in tables}
    bad = _all_duplicated(tables, {t: pairs[t] for t in large})
    out = []
    for t in tables:
        out += [(t, c, 1, n[t]) for c in keys[t]] + [(t, f"{a},{b}", 2, n[t]) for a, b in pairs[t] if (t, (a, b)) not in bad]
    return spark.createDataFrame(out, KEY_PROFILE_SCHEMA)


def typed_columns(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """``(table, column, family)`` of every key-typed column."""
    return [(name, f.name, family(f.dataType)) for name, df in tables.items() for f in df.schema.fields if family(f.dataType)]


WORD_BITS = 62           # columns that one number of a bitmap stands for


def value_bitmaps(tables: dict[str, DataFrame]) -> DataFrame:
    """Per distinct value of a type family a bitmap of the columns that hold it, counted:
    ``(family, w0, w1, ..., n)``, one row per family and distinct bitmap.

    Column i of ``typed_columns`` is bit ``i % WORD_BITS`` of word ``i // WORD_BITS``.
    One scan per table and one shuffle of values, combined within tasks before;
    a value is a 128-bit digest, so a long text is no wider than a number.
    """
    cols = typed_columns(tables)
    words = [f"w{i}" for i in range(-(-len(cols) // WORD_BITS))]
    rows = None
    for name, df in tables.items():
        own = [(i, c, fam) for i, (t, c, fam) in enumerate(cols) if t == name]
        if not own:
            continue
        bit = {i: [F.lit(1 << i % WORD_BITS if k == i // WORD_BITS else 0).cast("long").alias(w) for k, w in enumerate(words)] for i, _, _ in own}
        values = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(fam).alias("family"), *digest(c), *bit[i])) for i, c, fam in own])
        part = df.select(F.explode(F.filter(values, lambda v: v.isNotNull())).alias("v")).select("v.*")
        rows = part if rows is None else rows.unionByName(part)
    held = rows.groupBy("family", "h1", "h2").agg(*[F.bit_or(w).alias(w) for w in words])
    return held.groupBy("family", *words).agg(F.count(F.lit(1)).alias("n"))


def inclusion_dependencies(tables: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """For every column A and single-column key B of the same type family,
    the share of A's distinct values found in B (1.0 = candidate foreign key, 0.0 = nothing in common).

    Values meet in one aggregate that leaves a bitmap of columns per value; all
    counts come from the distinct bitmaps, of which there are few.
    """
    cols = typed_columns(tables)
    bitmaps = cut_lineage(value_bitmaps(tables), "column-bitmaps")
    spark = bitmaps.sparkSession
    columns = spark.createDataFrame([(i, *c) for i, c in enumerate(cols)], "id int, table_name string, column_name string, family string")
    ref_cols = keys.where(F.col("n_columns") == 1).select("table_name", F.col("key_columns").alias("column_name")).join(columns, ["table_name", "column_name"])
    dep, ref = (df.select("family", F.col("id").alias(f"{x}_id"), F.col("table_name").alias(f"{x}_table"), F.col("column_name").alias(f"{x}_column"))
                for df, x in ((columns, "dep"), (ref_cols, "ref")))
    pairs = dep.join(ref, "family").where(F.col("dep_id") != F.col("ref_id"))
    here = F.array_compact(F.array(*[F.when(F.col(f"w{i // WORD_BITS}").bitwiseAND(F.lit(1 << i % WORD_BITS).cast("long")) != 0, F.lit(i))
                                     for i in range(len(cols))]))
    held = bitmaps.select("n", here.alias("here"))
    n_values = held.select(F.explode("here").alias("dep_id"), "n").groupBy("dep_id").agg(F.sum("n").alias("n_values"))
    both = held.select("n", "here", F.explode("here").alias("dep_id")).select("n", "dep_id", F.explode("here").alias("ref_id"))
    hits = both.groupBy("dep_id", "ref_id").agg(F.sum("n").alias("n_covered"))
    n, k = F.coalesce("n_values", F.lit(0)).cast("long"), F.coalesce("n_covered", F.lit(0)).cast("long")
    return (pairs.join(n_values, "dep_id", "left").join(hits, ["dep_id", "ref_id"], "left")
            .select("dep_table", "dep_column", "ref_table", "ref_column", n.alias("n_values"), k.alias("n_covered"),
                    F.round(F.when(n > 0, k / n).otherwise(0.0), 4).alias("coverage")))
