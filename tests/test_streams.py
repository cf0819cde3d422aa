"""Streaming jobs: what a micro-batch reads."""

from __future__ import annotations

from sluicebox.plans import catalogue
from sluicebox.streaming import resume


def test_bounded_inflight_with_many_files_in_the_target(spark, data, duck):
    """The target's files aren't the micro-batch's: without coalescing there are four a batch."""
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = catalogue.QUERIES["stream_bounded_inflight"](spark, data).first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", keep)
    assert tuple(got) == duck.sql(catalogue.ORACLES["stream_bounded_inflight"]).fetchall()[0]


def test_files_by_batch(spark, tmp_path):
    """Each file is counted in its micro-batch, also where the log has been compacted."""
    for most, wanted in ((2, [2] * 12 + [1]), (25, [25])):
        folder = tmp_path / str(most)
        spark.range(0, 25, 1, 25).write.json(f"{folder}/in")
        resume.resume(spark, f"{folder}/in", "id long", f"{folder}/out", f"{folder}/checkpoint", "id", lambda rows: rows, files=most).awaitTermination()
        assert [r["files"] for r in resume.files_by_batch(spark, f"{folder}/checkpoint").orderBy("batch").collect()] == wanted
        assert spark.read.parquet(f"{folder}/out").count() == 25
