"""Catalog of a folder of Parquet tables, from the files' footers.

Spark lists the folder and deals the files over tasks; a task reads footers only,
so the work grows with the number of files, not with their size.
"""

from __future__ import annotations

import re
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

FOOTER_SCHEMA = ("table_name string, path string, bytes long, n_rows long, position int, column_name string, data_type string, "
                 "n_nulls long, error string")


def _open(uri: str):
    """The file behind a URI as Spark names it, for random reads."""
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(re.sub("^file:/*", "/", uri))
    return system.open_input_file(path)


def _column_nulls(meta, n_leaves: int) -> list[int | None]:
    """Nulls per leaf column over all row groups; None where a row group does not say."""
    nulls: list[int | None] = [0] * n_leaves
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        if not group.num_rows:
            continue                     # an empty group keeps no statistics
        for i in range(n_leaves):
            stats = group.column(i).statistics
            known = stats is not None and stats.has_null_count and nulls[i] is not None
            nulls[i] = nulls[i] + stats.null_count if known else None
    return nulls


def _footer_rows(uri: str) -> list[tuple]:
    """``(n_rows, position, column_name, data_type, n_nulls)`` per column of one file."""
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_type

    with _open(uri) as f:
        meta = pq.read_metadata(f)
    schema = meta.schema.to_arrow_schema()
    leaves = [meta.schema.column(i) for i in range(meta.num_columns)]
    nulls = dict(zip((leaf.path for leaf in leaves), _column_nulls(meta, len(leaves))))
    rows = [(meta.num_rows, i, field.name, from_arrow_type(field.type, prefer_timestamp_ntz=True).simpleString(), nulls.get(field.name)) for i, field in enumerate(schema)]
    return rows or [(meta.num_rows, 0, None, None, None)]


def parquet_footers(spark: SparkSession, folder: str) -> DataFrame:
    """A row per file and column below ``folder``; see ``FOOTER_SCHEMA``.

    A table is a file ``name.parquet`` or a folder ``name`` or ``name.parquet``
    of such files. ``n_nulls`` is null for nested columns and where a file keeps
    no statistics. A file without a readable footer gives one row with its
    ``error``; a file without columns one row without a column. Only files named
    ``*.parquet`` count; a folder that does not exist raises.
    """
    ship_package(spark)
    root = urlparse(folder).path.rstrip("/")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
             .select(F.regexp_extract("path", rf"\Q{root}\E/+([^/]+)", 1).alias("entry"), "path", "length"))
    named = files.select(F.regexp_replace("entry", r"\.parquet$", "").alias("table_name"), "path", F.col("length").alias("bytes"))

    def read(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for name, path, size in pdf.itertuples(index=False):
                try:
                    out += [(name, path, size, *row, None) for row in _footer_rows(path)]
                except Exception as e:  # noqa: BLE001 -- a broken file is a finding, not the end of the inventory
                    out.append((name, path, size, None, 0, None, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(out, columns=["table_name", "path", "bytes", "n_rows", "position", "column_name", "data_type", "n_nulls", "error"])
            yield frame.astype({"n_rows": "Int64", "n_nulls": "Int64", "column_name": "object", "data_type": "object", "error": "object"})

    return named.mapInPandas(read, FOOTER_SCHEMA)


def lake_tables(footers: DataFrame) -> DataFrame:
    """C1 over files: ``(table_name, n_files, n_unreadable, bytes, n_rows, n_columns)``.

    Rows and bytes are sums over files, so each file is counted by its first column.
    """
    first = F.col("position") == 0
    return footers.groupBy("table_name").agg(
        F.count_if(first).alias("n_files"), F.count_if(F.col("error").isNotNull()).alias("n_unreadable"),
        F.sum(F.when(first, F.col("bytes"))).alias("bytes"), F.coalesce(F.sum(F.when(first, F.col("n_rows"))), F.lit(0)).alias("n_rows"),
        F.count_distinct("column_name").alias("n_columns"))


def lake_columns(footers: DataFrame) -> DataFrame:
    """C2 over files: ``(table_name, position, column_name, data_type, n_files, n_values, n_nulls)``.

    A column whose type differs between files has all its types, joined by
    `` | ``; its position is the least. ``n_values`` and ``n_nulls`` are null where a
    file does not tell.
    """
    known = F.count("n_nulls") == F.count(F.lit(1))
    return (footers.where("column_name is not null").groupBy("table_name", "column_name")
            .agg(F.min("position").alias("position"), F.array_join(F.array_sort(F.collect_set("data_type")), " | ").alias("data_type"),
                 F.count(F.lit(1)).alias("n_files"), F.when(known, F.sum(F.col("n_rows") - F.col("n_nulls"))).alias("n_values"),
                 F.when(known, F.sum("n_nulls")).alias("n_nulls"))
            .select("table_name", "position", "column_name", "data_type", "n_files", "n_values", "n_nulls"))
