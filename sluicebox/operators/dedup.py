"""First or last row per key, in a stated order: never an arbitrary survivor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(rows: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """The first row of each key in a total order. Spark keeps one row per key and task before it shuffles."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def first_by_prefix(rows: DataFrame, text: str, order: str, n: int = 200) -> DataFrame:
    """One row for each beginning of n characters."""
    return first_per(rows, F.substring(F.col(text), 1, n), order)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last appended row of each key, by a map-side combined maximum."""
    rest = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("__last"))
    return best.select(key, "__last.*").select(*rows.columns)


def conflicts(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def duplicate_counts(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows beyond the first of their key, and keys that have such."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("ignored_rows"), F.count_if(F.col("n") > 1).alias("keys_with_duplicates"))


def first_passing(verdicts: DataFrame, key: str, rank: str, rate: str, enough: float = 1.0) -> DataFrame:
    """key, selected_rank (null: none passes), attempted: candidates up to the first that passes, else all that have a verdict."""
    passed = F.col(rate) >= enough
    out = verdicts.groupBy(key).agg(F.min(F.when(passed, F.col(rank))).alias("selected_rank"), F.count(F.lit(1)).alias("__all"))
    return out.select(key, "selected_rank", F.coalesce(F.col("selected_rank") + 1, F.col("__all")).cast("long").alias("attempted"))


def best_failed(verdicts: DataFrame, key: str, rank: str, rate: str) -> DataFrame:
    """key, rank and rate of the best candidate; of equals the first."""
    best = F.max(F.struct(F.col(rate).alias("rate"), (-F.col(rank)).alias("minus")))
    return verdicts.groupBy(key).agg(best.alias("b")).select(key, (-F.col("b.minus")).alias("best_rank"), F.col("b.rate").alias("best_rate"))


def islands(rows: DataFrame, order: str, flag: Column, partition: list[str] | None = None) -> DataFrame:
    """Adds streak: how long the current run of flagged rows is; 0 for rows without the flag.

    A run is one sequence, so each partition's rows are walked through in one task: name columns that divide the table, such as
    a job or a log. A table that is one single sequence says so by partition=[].
    """
    if partition is None:
        raise ValueError("islands needs the columns that divide the table into sequences, [] for one")
    whole = Window.partitionBy(*partition).orderBy(order)
    rows = rows.withColumn("__flag", flag).withColumn("__island", F.sum(F.when(F.col("__flag"), 0).otherwise(1)).over(whole))
    run = Window.partitionBy(*partition, "__island").orderBy(order)
    return rows.withColumn("streak", F.when(F.col("__flag"), F.sum(F.col("__flag").cast("int")).over(run)).otherwise(0).cast("long")).drop("__flag", "__island")
