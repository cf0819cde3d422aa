"""Token arrays for training and generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the label of tokens without loss.
IGNORED = -100


def label_mask(prompt: Column, full: Column) -> Column:
    """Labels: IGNORED over the prompt, ids over the completion; null if the prompt is no prefix or nothing is left."""
    n = F.size(prompt)
    ok = (F.size(full) > n) & (F.slice(full, F.lit(1), n) == prompt)
    labels = F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(full, n + 1, F.greatest(F.size(full) - n, F.lit(0))))
    return F.when(F.coalesce(ok, F.lit(False)), labels)


def supervised(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORED))


def pad_batch(rows: DataFrame, ids: str, batch: str, pad: int, multiple: int = 8) -> DataFrame:
    """Adds padded and attention: each array filled up to the batch's longest, rounded up to a multiple."""
    # The longest by an aggregate that combines first; a batch that holds most rows is split as a skewed join.
    width = (F.ceil(F.max(F.size(ids)) / multiple) * multiple).cast("int")
    widths = rows.groupBy(F.col(batch).alias("__batch")).agg(width.alias("__width"))
    rows = rows.join(widths, F.col(batch).eqNullSafe(F.col("__batch"))).drop("__batch")
    fill = F.col("__width") - F.size(ids)
    padded = F.concat(F.col(ids), F.array_repeat(F.lit(pad), fill))
    attention = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), fill))
    return rows.withColumn("padded", padded).withColumn("attention", attention).drop("__width")


def trim_at_end(ids: Column, end: int, pad: int) -> Column:
    """Ids before the first end id; without one, ids without the padding at their end."""
    at = F.array_position(ids, F.lit(end))
    last = F.aggregate(F.transform(ids, lambda x, i: F.when(x != pad, i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(F.slice(ids, F.lit(1), last))


def length_buckets(rows: DataFrame, tokens: str, key: str, size: int, within: list[str] | None = None) -> DataFrame:
    """Adds bucket: `size` rows of like length each. Without groups, positions come from a range sort in parallel."""
    if within:
        at = F.row_number().over(Window.partitionBy(*within).orderBy(tokens, key)) - 1
        return rows.withColumn("bucket", F.floor(at / size).cast("long"))
    from .sampling import positions

    return positions(rows, [tokens, key], "__at").withColumn("bucket", F.floor(F.col("__at") / size).cast("long")).drop("__at")


def longest(rows: DataFrame, tokens: str, key: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(tokens), F.desc(key)).limit(k)


def trimmed_history(messages: Column, most: int = 14, last: int = 12) -> Column:
    """The first message and the last ones, once there are more than `most`."""
    return F.when(F.size(messages) > most, F.concat(F.slice(messages, 1, 1), F.slice(messages, -last, last))).otherwise(messages)
