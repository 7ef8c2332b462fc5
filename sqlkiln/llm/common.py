"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sqlkiln.session import by_shuffle, cut_lineage

# ASCII white space, the separators between words everywhere in this package.
WS = r"[\x20\x09-\x0D]"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read back."""
    return cut_lineage(df, tag)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Ids that are broadcast to filter a scan (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


# Rows of more than an id that are broadcast, or that Spark may broadcast for the size of their
# files; the driver holds some hundred bytes of each.
BROADCAST_ROWS = 100_000


def rows_of(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (distinct), without moving
    texts as long as the ids are few enough to broadcast; counted first."""
    ids = stored(ids, "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def without_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids`` (distinct); see ``rows_of``."""
    return rows_of(docs, ids, "left_anti")


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` in ``text`` (null: 0), JVM-side."""
    t = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(t, WS + "+"))
    lead = t.rlike("^" + WS).cast("int")
    trail = t.rlike(WS + r"\z").cast("int")
    blank = ~t.rlike("[^\\x20\\x09-\\x0D]")
    return F.when(blank, F.lit(0)).otherwise(pieces - lead - trail).cast("long")


# Characters of text that a Python task holds at a time, and rows likewise.
BATCH_CHARS, BATCH_ROWS = 4_000_000, 1024


def by_chars(batches: Iterator[pd.DataFrame], column: str = "text") -> Iterator[pd.DataFrame]:
    """``batches`` cut into slices of about ``BATCH_CHARS`` characters and at most
    ``BATCH_ROWS`` rows; a longer text is a slice of its own."""
    for pdf in batches:
        sizes = pdf[column].str.len().fillna(0).to_numpy(np.int64) if len(pdf) else np.empty(0, np.int64)
        a = 0
        while a < len(pdf):
            b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:a + BATCH_ROWS]), BATCH_CHARS, "right")))
            yield pdf.iloc[a:b].reset_index(drop=True)
            a = b


def by_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``batches`` cut into slices of at most ``BATCH_ROWS`` rows."""
    for pdf in batches:
        for a in range(0, len(pdf), BATCH_ROWS):
            yield pdf.iloc[a:a + BATCH_ROWS].reset_index(drop=True)


SALTS = 32


def attach(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with ``classes`` (one row per ``key``, stored), whose keys may be hot in ``rows``.

    Counted first: broadcast up to ``BROADCAST_ROWS``; beyond, each class is
    repeated once per salt and a row takes one, so a hot key is dealt over
    ``SALTS`` tasks.
    """
    if classes.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(classes), key, "left")
    spread = classes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(by_shuffle(spread), [key, "__salt"], "left").drop("__salt")
