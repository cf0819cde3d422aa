"""A stream of requests to providers that may break down: one that failed for good is asked no more, also after a restart.

Asking is the caller's: a function from rows to answers. What a provider said stays in the target, and from there the next micro-batch
knows whom to leave out; so nothing but the target and the checkpoint has to survive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import fatal_status
from ..sources.tables import exists
from .resume import pending

#: What a request gets whose provider is left out.
LEFT_OUT = "provider_left_out"


def judge(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, ask: Callable[[DataFrame], DataFrame], files: int = 1, kind: str = "json") -> StreamingQuery:
    """Appends to target, for each new request once: its columns, status, message, and reason (null if it was answered well enough to go on).

    Requests have a column provider; ask adds status and message. A micro-batch is `files` files: so many requests may still reach a provider
    that has just failed.
    """

    def batch(rows: DataFrame, number: int) -> None:  # noqa: ARG001
        broken = spark.createDataFrame([], "provider string")
        if exists(spark, f"{target}/*.parquet"):
            there = spark.read.parquet(target)
            rows = pending(rows, there, key)
            broken = there.filter((F.col("reason") != LEFT_OUT) & F.col("reason").isNotNull()).select("provider").distinct()
        # One row for each provider that failed.
        asked = ask(rows.join(F.broadcast(broken), "provider", "left_anti"))
        asked = asked.withColumn("reason", fatal_status(F.col("status"), F.col("message")))
        left_out = rows.join(F.broadcast(broken), "provider", "left_semi").withColumns({"status": F.lit(None).cast("int"), "message": F.lit(None).cast("string"), "reason": F.lit(LEFT_OUT)})
        columns = [*rows.columns, "status", "message", "reason"]
        asked.select(columns).unionByName(left_out.select(columns)).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
