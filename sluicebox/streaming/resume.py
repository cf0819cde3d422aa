"""Jobs that resume: append-only results, and a snapshot of what is still rejected.

Each run reads what is new in a folder since the last one (a checkpoint holds that), in bounded micro-batches, and ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import latest
from ..sources.tables import exists, json_lines


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def done_ids(*tables: DataFrame, key: str) -> DataFrame:
    """Ids of any of the tables, each once."""
    out = tables[0].select(key)
    for other in tables[1:]:
        out = out.unionByName(other.select(key))
    return out.distinct()


def resume(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, step: Callable[[DataFrame], DataFrame], files: int = 8, kind: str = "json") -> StreamingQuery:
    """Applies step to new rows whose key isn't in the target yet, and appends the results, a few files at a time.

    A micro-batch that is run again after a failure appends nothing twice: its keys are then in the target. Of several new rows of a key in
    a micro-batch the least by its other columns, in their order, counts.
    """

    def batch(rows: DataFrame, number: int) -> None:  # noqa: ARG001
        rest = [c for c in rows.columns if c != key]
        new = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("__r")).select(key, "__r.*").select(*rows.columns)
        if exists(spark, f"{target}/*.parquet"):
            new = pending(new, spark.read.parquet(target), key)
        step(new).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files_by_batch(spark: SparkSession, checkpoint: str) -> DataFrame:
    """batch and files: how many files each micro-batch of a job has read, by the log of its one source. (`inputFiles` in a step tells of the target alone.)"""
    # A line that is no entry names the log's version; compacted files repeat entries.
    log = json_lines(spark, f"{checkpoint}/sources/0", "path string, batchId long", strict=False).filter("path is not null").distinct()
    return log.groupBy(F.col("batchId").alias("batch")).agg(F.count(F.lit(1)).alias("files"))


def unresolved(attempts: DataFrame, accepted: DataFrame, key: str, order: str) -> DataFrame:
    """The last rejection of each key that was never accepted."""
    return latest(attempts, key, order).join(accepted.select(key).distinct(), key, "left_anti")


def rejected_snapshot(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, key: str, order: str, is_accepted: str) -> StreamingQuery:
    """Keeps the newest attempt of each key (accepted or not) in folder/version=N; read with `current_rejected`.

    A micro-batch writes the version of its own number from the one before, so running it again changes nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        state = rows
        if number and exists(spark, f"{folder}/version={number - 1}"):
            state = state.unionByName(spark.read.schema(rows.schema).parquet(f"{folder}/version={number - 1}"))
        marked = state.withColumn("__won", F.expr(is_accepted))
        # An accepted key stays accepted, whatever is appended later.
        best = marked.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct("__won", order)).alias("r"))
        best.select(key, "r.*").select(*rows.columns).write.mode("overwrite").parquet(f"{folder}/version={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rejected(spark: SparkSession, folder: str, is_accepted: str) -> DataFrame:
    """What the newest version holds as rejected."""
    rows = spark.read.parquet(folder)
    newest = rows.agg(F.max("version")).first()[0]
    return rows.filter((F.col("version") == newest) & ~F.expr(is_accepted)).drop("version")
