"""Queries that run a streaming job to its end and read what it keeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dedup import latest
from ..sources import tables
from ..streaming import judging, resume
from . import fixtures as fx
from .registry import query


@query("stream_resume", "select user_id, min(event_id) >= 0 as seen from events group by user_id")
def stream_resume(spark, sf_dir):
    """Two runs over a growing folder: the second one adds only what the first one hadn't done."""
    folder = tables.scratch(spark)
    events = fx.table(spark, sf_dir, "events").select("user_id", "event_id")
    step = lambda rows: rows.select("user_id", (F.col("event_id") >= 0).alias("seen"))
    for part in (events.filter("user_id % 2 = 0"), events):
        part.write.mode("append").json(f"{folder}/in")
        resume.resume(spark, f"{folder}/in", "user_id long, event_id long", f"{folder}/out", f"{folder}/checkpoint", "user_id", step).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("stream_rejected_state", """with a as (select user_id, event_id, event_type, event_type = 'purchase' and value > 60 as won from events)
  select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from a group by user_id having not bool_or(won)""")
def stream_rejected(spark, sf_dir):
    folder = tables.scratch(spark)
    events = fx.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    won = "event_type = 'purchase' and value > 60"
    schema = "user_id long, event_id long, event_type string, value double"
    for part in (events.filter("event_id % 2 = 1"), events.filter("event_id % 2 = 0")):
        part.write.mode("append").json(f"{folder}/in")
        resume.rejected_snapshot(spark, f"{folder}/in", schema, f"{folder}/state", f"{folder}/checkpoint", "user_id", "event_id", won).awaitTermination()
    return resume.current_rejected(spark, f"{folder}/state", won).select("user_id", "event_id", "event_type")


@query("stream_latest", "select user_id, max(event_id) as event_id from events group by user_id")
def stream_latest(spark, sf_dir):
    """Append-only lines, read tolerantly, the last one of each key."""
    folder = tables.scratch(spark)
    tables.append_lines(fx.table(spark, sf_dir, "events").select("user_id", "event_id"), f"{folder}/lines")
    rows = tables.json_lines(spark, f"{folder}/lines", "user_id long, event_id long", strict=False)
    return latest(rows, "user_id", "event_id")


@query("stream_async_judge", """select event_id, event_type as provider, case when event_type = 'error' and event_id % 2 = 0 then 'provider_left_out' when event_type = 'error' then 'insufficient_balance' end as reason from events where event_id % 3 > 0""")
def stream_judge(spark, sf_dir):
    """Requests come in two lots; the provider that fails in the first is asked no more in the second. Some come twice."""
    folder = tables.scratch(spark)
    events = fx.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("provider")).filter("event_id % 3 > 0")
    ask = lambda rows: rows.withColumns({"status": F.when(F.col("provider") == "error", 402).otherwise(200), "message": F.lit("ok")})
    for part in (events.filter("event_id % 2 = 1"), events):
        part.coalesce(1).write.mode("append").json(f"{folder}/in")
        judging.judge(spark, f"{folder}/in", "event_id long, provider string", f"{folder}/out", f"{folder}/checkpoint", "event_id", ask).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "provider", "reason")


@query("stream_bounded_inflight", "select count(*) as keys, count(*) filter (event_id % 2 = 0) as even from events")
def bounded_inflight(spark, sf_dir):
    """A few files to a micro-batch, however many wait."""
    folder = tables.scratch(spark)
    fx.table(spark, sf_dir, "events").select("event_id").repartition(5).write.json(f"{folder}/in")
    resume.resume(spark, f"{folder}/in", "event_id long", f"{folder}/out", f"{folder}/checkpoint", "event_id", lambda rows: rows, files=2).awaitTermination()
    most = resume.files_by_batch(spark, f"{folder}/checkpoint").agg(F.max("files")).first()[0]
    if most is None or most > 2:
        raise AssertionError(f"a micro-batch of {most} files")
    return spark.read.parquet(f"{folder}/out").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("event_id") % 2 == 0).alias("even"))
