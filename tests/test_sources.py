"""Readers, writers, listings and array archives."""

import numpy as np
from pyspark.sql import types as T

from quadrat.sources import files


def test_csv_round_trip(spark, small, tmp_path):
    path = str(tmp_path / "out")
    files.write_csv(small.fillna(0.0), path, key="g")
    again = files.read_csv(spark, path, "g string, k bigint, x double", key="k")
    assert again.columns == ["k", "g", "x"] and again.count() == 7


def test_mixed_separators(spark, tmp_path):
    (tmp_path / "mixed.txt").write_text("site;when,flux\nA; 2001 , 1.5\nB, ;bad\n\nC;;\n")
    schema = T.StructType(
        [T.StructField("site", T.StringType()), T.StructField("when", T.IntegerType()),
         T.StructField("flux", T.DoubleType())]
    )
    rows = files.read_delimited(spark, str(tmp_path / "mixed.txt"), schema, null_token=" ").collect()
    assert [tuple(r) for r in rows] == [("A", 2001, 1.5), ("B", None, None), ("C", None, None)]


def test_table_round_trip(spark, small, tmp_path):
    path = str(tmp_path / "table")
    files.write_table(small, path)
    assert files.read_table(spark, path, verbose=True).schema == small.schema


def test_listing(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.v2.mat").write_text("x")
    (tmp_path / "b.mat").write_text("yy")
    (tmp_path / "c.txt").write_text("z")
    rows = {r["name"]: r for r in files.list_files(spark, str(tmp_path), ".mat").collect()}
    assert {n: r["stem"] for n, r in rows.items()} == {"a.v2.mat": "a.v2", "b.mat": "b"}
    assert rows["b.mat"]["length"] == 2
    assert files.list_folders(spark, str(tmp_path)).count() == 2


def test_archives(spark, tmp_path):
    np.savez(tmp_path / "good.npz", m=np.arange(6).reshape(2, 3), v=np.array([]))
    (tmp_path / "bad.npz").write_bytes(b"not an archive")
    arrays = files.read_array_archives(spark, str(tmp_path))
    rows = {r["key"]: r for r in arrays.collect()}
    assert rows["m"]["values"] == [0.0, 1, 2, 3, 4, 5] and rows["m"]["shape"] == [2, 3]
    assert rows["v"]["values"] == [] and rows[None]["error"]
    summary = {r["read"]: r["files"] for r in files.archive_summary(arrays).collect()}
    assert summary == {True: 1, False: 1}
