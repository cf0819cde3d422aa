"""Evaluation tables and judges' verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import smallest_by_hash


def variant_summary(rows: DataFrame) -> DataFrame:
    """One row per variant: samples, strict passes, rates, flags and token percentiles."""
    at = lambda p: F.round(F.percentile("generated_tokens", F.lit(p)), 6)
    return rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if("strict_pass").alias("passed"),
        F.round(F.avg(F.col("strict_pass").cast("int")), 6).alias("pass_at_1"),
        F.round(F.avg("pass_rate"), 6).alias("mean_pass_rate"),
        F.count_if("hit_limit").alias("limit_hits"),
        F.count_if("unclosed").alias("unclosed_fences"),
        at(0.5).alias("tokens_p50"),
        at(0.9).alias("tokens_p90"),
        F.max("generated_tokens").cast("long").alias("tokens_max"),
    )


def failure_histogram(rows: DataFrame) -> DataFrame:
    return rows.filter("failure_type is not null").groupBy("variant", "failure_type").agg(F.count(F.lit(1)).alias("n"))


def compare_variants(rows: DataFrame, base: str, other: str) -> DataFrame:
    """problem_id and change (rescued, lost, both, neither) between two variants."""
    flags = rows.filter(F.col("variant").isin(base, other)).groupBy("problem_id").agg(
        F.max(F.when(F.col("variant") == base, F.col("strict_pass").cast("int"))).alias("before"),
        F.max(F.when(F.col("variant") == other, F.col("strict_pass").cast("int"))).alias("after"),
    )
    before, after = F.coalesce("before", F.lit(0)) == 1, F.coalesce("after", F.lit(0)) == 1
    change = F.when(before & after, "both").when(before, "lost").when(after, "rescued").otherwise("neither")
    return flags.select("problem_id", change.alias("change"))


def incomplete(done: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """key and status (missing or extra): empty if both sets are equal."""
    missing = selected.select(key).distinct().join(done.select(key).distinct(), key, "left_anti").withColumn("status", F.lit("missing"))
    extra = done.select(key).distinct().join(selected.select(key).distinct(), key, "left_anti").withColumn("status", F.lit("extra"))
    return missing.unionByName(extra)


def over_thresholds(rows: DataFrame, value: str, thresholds: list[int]) -> DataFrame:
    """threshold, over, ratio: one pass over the rows for all thresholds."""
    n = F.count(F.lit(1))
    counts = rows.agg(F.array(*(F.struct(F.lit(t).cast("long").alias("threshold"), F.count_if(F.col(value) > t).alias("over"), (F.count_if(F.col(value) > t) / n).alias("ratio")) for t in thresholds)).alias("t"))
    return counts.select(F.explode("t").alias("t")).select("t.threshold", "t.over", F.round("t.ratio", 6).alias("ratio"))


def dimension_means(judgments: DataFrame, weights: dict[str, float]) -> DataFrame:
    """judge ('combined' for all), model, dimension ('weighted_total' for the sum by weight), mean."""
    sides = judgments.select("judge", F.explode("dimensions").alias("dimension", "s"), "model_a", "model_b")
    long = sides.select("judge", "dimension", F.explode(F.array(F.struct(F.col("model_a").alias("model"), F.col("s.A").alias("score")), F.struct(F.col("model_b").alias("model"), F.col("s.B").alias("score")))).alias("x")).select("judge", "dimension", "x.*")
    means = long.rollup("model", "dimension", "judge").agg(F.avg("score").alias("mean")).filter("dimension is not null").withColumn("judge", F.coalesce("judge", F.lit("combined")))
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    total = means.groupBy("judge", "model").agg(F.sum(F.col("mean") * weight[F.col("dimension")]).alias("mean")).withColumn("dimension", F.lit("weighted_total"))
    return means.select("judge", "model", "dimension", "mean").unionByName(total.select("judge", "model", "dimension", "mean")).withColumn("mean", F.round("mean", 6))


def pairwise(judgments: DataFrame) -> DataFrame:
    """pair, judgments, wins of either side, ties and their rates; a winner of no side makes it fail."""
    side = F.when(F.col("winner_model") == F.col("left"), "left").when(F.col("winner_model") == F.col("right"), "right").when(F.col("winner_model") == "tie", "tie").otherwise(F.raise_error(F.concat(F.lit("unknown winner: "), F.coalesce("winner_model", F.lit("null")))).cast("string"))
    rows = judgments.withColumn("__side", side)
    n = F.count(F.lit(1))
    wins = {k: F.count_if(F.col("__side") == k) for k in ("left", "right", "tie")}
    return rows.groupBy("pair").agg(n.alias("judgments"), *(c.alias(f"{k}_wins" if k != "tie" else "ties") for k, c in wins.items()), *(F.round(c / n, 6).alias(f"{k}_rate") for k, c in wins.items()))


def disagreement(judgments: DataFrame) -> DataFrame:
    """One row: comparisons by more than one judge, those with different winners, their rate."""
    each = judgments.groupBy("id", "pair").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("winner_model").alias("winners")).filter("n > 1")
    return each.agg(F.count(F.lit(1)).alias("comparisons"), F.count_if(F.col("winners") > 1).alias("disagreements"), F.round(F.coalesce(F.avg((F.col("winners") > 1).cast("int")), F.lit(0.0)), 6).alias("rate"))


def blind_order(rows: DataFrame, pair: str, key: str, seed: int) -> DataFrame:
    """Adds swapped: half of each pair's rows (rounded down), by hash order. Keys must differ within a pair; a null pair is a pair."""
    named = rows.withColumn("__pair", F.coalesce(F.col(pair).cast("string"), F.lit(""))).withColumn("__hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__pair"), F.lit(":"), F.col(key).cast("string")), 256))
    halves = named.groupBy("__pair").agg(F.floor(F.count(F.lit(1)) / 2).alias("quota"))
    swapped = smallest_by_hash(named.select("__pair", "__hash"), "__pair", "__hash", halves).withColumn("swapped", F.lit(True))
    return named.join(swapped, ["__pair", "__hash"], "left").withColumn("swapped", F.coalesce("swapped", F.lit(False))).drop("__pair", "__hash")


def group_rewards(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """group, std and whether all rewards of the group are alike."""
    return rows.groupBy(group).agg(F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("std")).withColumn("zero_std", F.col("std") == 0)


def reference_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Totals and pass rates, overall and by each of some columns, in one aggregation over grouping sets."""
    out = rows.groupingSets([[], *([c] for c in by)], *by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("selected_rank") == 0).alias("first_candidate"), F.count_if(F.col("selected_rank") > 0).alias("fallback"), F.count_if(F.col("selected_rank").isNull()).alias("failed"),
        F.round(F.avg("attempted"), 6).alias("mean_attempted"), *(F.grouping(c).alias(f"__{c}") for c in by),
    )
    dimension = F.lit("all")
    value = F.lit("")
    for c in by:
        dimension = F.when(F.col(f"__{c}") == 0, F.lit(c)).otherwise(dimension)
        value = F.when(F.col(f"__{c}") == 0, F.coalesce(F.col(c).cast("string"), F.lit("None"))).otherwise(value)
    return out.select(dimension.alias("dimension"), value.alias("value"), "total", "first_candidate", "fallback", "failed", "mean_attempted")


def last_user(messages: Column) -> Column:
    """Place (from 0) of the last user message; -1 without one."""
    return F.aggregate(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i).otherwise(-1)), F.lit(-1), lambda a, x: F.greatest(a, x))


def eval_messages(messages: Column, system: str, suffix: str) -> Column:
    """The prompt for evaluation: without a final answer, with this system message, the suffix on the last user message."""
    message = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    body = F.filter(messages, lambda m: m["role"] != "system")
    body = F.when(F.try_element_at(body, F.lit(-1))["role"] == "assistant", F.slice(body, F.lit(1), F.greatest(F.size(body) - 1, F.lit(0)))).otherwise(body)
    at = last_user(body)
    body = F.transform(body, lambda m, i: F.when(i == at, message(m["role"], F.concat(m["text"], F.lit(suffix)))).otherwise(message(m["role"], m["text"])))
    return F.concat(F.array(message(F.lit("system"), F.lit(system))), body)
