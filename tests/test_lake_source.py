"""The catalog of a folder of Parquet files, against files written here."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException

from sqlkiln.sources import lake


def put(scratch, name, table, **kw):
    path = os.path.join(scratch, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pq.write_table(table, path, **kw)


@pytest.fixture()
def folder(scratch):
    put(scratch, "a.parquet", pa.table({"id": pa.array([1, 2, None], pa.int64()), "name": ["x", None, None], "v": [[1.0], None, []]}))
    put(scratch, "b/part-0.parquet", pa.table({"k": pa.array([1, 2], pa.int32()), "t": ["p", "q"]}), row_group_size=1)
    put(scratch, "b/day=1/part-1.parquet", pa.table({"t": ["r"], "k": pa.array([None], pa.int64()), "new": [True]}))
    put(scratch, "c.parquet/part-0.parquet", pa.table({"z": pa.array([], pa.string())}))
    put(scratch, "nostats.parquet", pa.table({"n": [1, None]}), write_statistics=False)
    with open(os.path.join(scratch, "broken.parquet"), "wb") as f:
        f.write(b"not a parquet file")
    with open(os.path.join(scratch, "notes.txt"), "w") as f:
        f.write("no table")
    return scratch


def test_tables_of_files_and_folders(spark, folder):
    got = {r.table_name: (r.n_files, r.n_unreadable, r.n_rows, r.n_columns) for r in lake.lake_tables(lake.parquet_footers(spark, folder)).collect()}
    assert got == {"a": (1, 0, 3, 3), "b": (2, 0, 3, 3), "c": (1, 0, 0, 1), "nostats": (1, 0, 2, 1), "broken": (1, 1, 0, 0)}


def test_columns_with_types_and_nulls(spark, folder):
    rows = lake.lake_columns(lake.parquet_footers(spark, folder + "/")).collect()
    got = {(r.table_name, r.column_name): (r.position, r.data_type, r.n_files, r.n_values, r.n_nulls) for r in rows}
    assert got == {("a", "id"): (0, "bigint", 1, 2, 1), ("a", "name"): (1, "string", 1, 1, 2), ("a", "v"): (2, "array<double>", 1, None, None),
                   ("b", "k"): (0, "bigint | int", 2, 2, 1), ("b", "t"): (0, "string", 2, 3, 0), ("b", "new"): (2, "boolean", 1, 1, 0),
                   ("c", "z"): (0, "string", 1, 0, 0), ("nostats", "n"): (0, "bigint", 1, None, None)}


def test_broken_files_keep_their_message(spark, folder):
    bad = lake.parquet_footers(spark, folder).where("error is not null").collect()
    assert [r.table_name for r in bad] == ["broken"] and bad[0].n_rows is None and bad[0].path.endswith("broken.parquet")


def test_missing_folder_raises(spark, scratch):
    with pytest.raises(AnalysisException):
        lake.parquet_footers(spark, scratch + "/none").collect()
