"""Readers of tables that lie in several files."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_catalogue import rows_of

from sluicebox.plans import catalogue
from sluicebox.sources import tables


def parts(spark, folder, sizes):
    """Files part-0, part-1 and so on of consecutive ids."""
    low = 0
    for n, size in enumerate(sizes):
        spark.range(low, low + size, 1, 1).withColumnRenamed("id", "doc_id").write.parquet(f"{folder}/written-{n}")
        next((folder / f"written-{n}").glob("part-*")).rename(folder / f"part-{n}.parquet")
        low += size


def test_provenance_of_a_table_in_parts(spark, tmp_path, duck):
    """Its SQL numbers the rows of the whole table, also where it is a folder."""
    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    parts(spark, folder, (3, 1, 4))
    got = catalogue.QUERIES["src_provenance"](spark, str(tmp_path))
    want = duck.sql(f"with documents as (from '{folder}/part-*.parquet') {catalogue.ORACLES['src_provenance']}")
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_provenance_by_files(spark, tmp_path):
    """Numbers by the file read; or by what it is a part of."""
    parts(spark, tmp_path, (3, 1, 4))
    rows = spark.read.parquet(*(str(tmp_path / f"part-{n}.parquet") for n in range(3)))
    by_file = tables.with_provenance(rows).orderBy("doc_id").collect()
    assert [(r["row_in_file"], r["global_index"]) for r in by_file] == list(zip((0, 1, 2, 0, 0, 1, 2, 3), range(8)))
    assert [r["file"][-14:] for r in by_file] == ["part-0.parquet"] * 3 + ["part-1.parquet"] + ["part-2.parquet"] * 4
    two = F.when(F.col("_metadata.file_name") == "part-0.parquet", "b").otherwise("a")
    by_name = tables.with_provenance(rows, two).orderBy("doc_id").collect()
    assert [(r["file"], r["row_in_file"], r["global_index"]) for r in by_name] == [("b", n, n + 5) for n in range(3)] + [("a", n, n) for n in range(5)]
    assert sorted(by_name[0].asDict()) == ["doc_id", "file", "global_index", "row_in_file"]
