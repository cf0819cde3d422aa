"""Records that go to prompts, rejection stores and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shortened

#: What a rejection keeps of its metadata, the longest diagnostics, samples shown, and statuses that end a provider's use.
KEPT_METADATA = (
    "source", "difficulty", "io_mode", "fn_name", "distill_mode", "reference_guided", "reference_verified", "reference_pass_rate",
    "selected_reference_index", "recovery_attempted", "recovery_version", "initial_failure",
)
DIAGNOSTIC_CHARS, SAMPLE_CHARS, SAMPLES = 600, 240, 2
FATAL_STATUS = {401: "unauthorized", 402: "insufficient_balance", 403: "forbidden", 404: "endpoint_or_model_not_found"}


def compact_rejected(rows: DataFrame) -> DataFrame:
    """id, failure_type, pass_rate, error, first_failure and the metadata worth keeping."""
    fields = dict(rows.select("metadata.*").dtypes)
    metadata = F.struct(*(F.col(f"metadata.{k}").alias(k) for k in KEPT_METADATA if k in fields))
    return rows.select("id", "failure_type", F.coalesce("pass_rate", F.lit(0.0)).alias("pass_rate"), "error", "first_failure", metadata.alias("metadata"))


def rejected(failure_type: Column, rate: Column, error: Column, failure: Column, attempted: Column) -> Column:
    """The verdict part of a new rejection."""
    return F.struct(
        failure_type.alias("failure_type"),
        F.round(F.coalesce(rate, F.lit(0.0)), 3).alias("pass_rate"),
        shortened(error, DIAGNOSTIC_CHARS).alias("error"),
        shortened(failure, DIAGNOSTIC_CHARS).alias("first_failure"),
        F.coalesce(attempted, F.lit(False)).alias("recovery_attempted"),
        F.when(F.coalesce(attempted, F.lit(False)), 2).otherwise(0).alias("recovery_version"),
    )


def has_verified_reference(reference: Column, verified: Column, rate: Column, enough: float = 1.0) -> Column:
    """Present, verified, and with a rate (as text) that is enough; a rate that is no number is not."""
    return F.coalesce((reference != "") & verified & (rate.try_cast("double") >= enough), F.lit(False))


def merged_reference(candidates: Column, selected: Column, own: Column) -> Column:
    """The code of the candidate with the selected rank; else the row's own."""
    code = F.try_element_at(F.filter(candidates, lambda c: c["rank"] == selected), F.lit(1))["code"]
    return F.coalesce(F.nullif(code, F.lit("")), own)


def test_summary(cases: Column) -> Column:
    """How many cases there are and the first of them, for a teacher's prompt."""
    n = F.size(cases)
    line = lambda c, i: F.concat(F.lit("- 样例 "), (i + 1).cast("string"), F.lit(": input="), shortened(F.coalesce(c["input_args"], c["input"], F.lit("")), SAMPLE_CHARS), F.lit(" | expected="), shortened(F.coalesce(c["expected_output"], c["output"], F.lit("")), SAMPLE_CHARS))
    head = F.concat(F.lit("共有 "), n.cast("string"), F.lit(" 个公开测试样例，下面展示前 "), F.least(n, F.lit(SAMPLES)).cast("string"), F.lit(" 个："))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit("暂无公开测试样例。")).otherwise(F.concat_ws("\n", head, F.array_join(F.transform(F.slice(cases, 1, SAMPLES), line), "\n")))


def select_seeds(problems: DataFrame, key: str, categories: str, seeds: DataFrame, n: int) -> DataFrame:
    """Up to n seeds per problem (key, nth, seed_id): by the problem's order of categories, then the seeds' order.

    seeds: category, ord, seed_id; a small table, so each category keeps at most n of them before the join.
    """
    few = seeds.withColumn("__r", F.row_number().over(Window.partitionBy("category").orderBy("ord"))).filter(F.col("__r") <= n).drop("__r")
    wanted = problems.select(key, F.posexplode(categories).alias("__c", "category"))
    order = Window.partitionBy(key).orderBy("__c", "ord")
    return wanted.join(few, "category").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n).select(key, "nth", "seed_id")


def fatal_status(status: Column, message: Column) -> Column:
    """Why a provider can't be used any more; null for what may pass."""
    said = F.lower(F.coalesce(message, F.lit("")))
    table = F.create_map(*(F.lit(x) for pair in FATAL_STATUS.items() for x in pair))
    poor = F.contains(said, F.lit("insufficient balance")) | F.contains(said, F.lit("insufficient_balance"))
    return F.coalesce(F.try_element_at(table, status.cast("int")), F.when(poor, "insufficient_balance"))


def imported_answers(results: DataFrame, answers: DataFrame, variants: list[str], key: str = "id") -> DataFrame:
    """key, one column per variant, and status: missing (no answer), conflict (another non-empty answer is there), or ok.

    results: key and a column per variant; answers: key, variant, text.
    """
    new = answers.groupBy(key).pivot("variant", variants).agg(F.first("text"))
    new = new.select(key, *(F.col(v).alias(f"new_{v}") for v in variants))
    rows = results.join(new, key, "left")
    missing, conflict = F.lit(False), F.lit(False)
    for v in variants:
        own = F.trim(F.coalesce(F.col(v), F.lit("")))
        missing = missing | F.col(f"new_{v}").isNull()
        conflict = conflict | ((own != "") & ~own.eqNullSafe(F.col(f"new_{v}")))
    return rows.select(key, *(F.coalesce(F.col(f"new_{v}"), F.col(v)).alias(v) for v in variants), F.when(missing, "missing").when(conflict, "conflict").otherwise("ok").alias("status"))


def changed_selection(existing: DataFrame, expected: DataFrame) -> DataFrame:
    """Positions at which a stored selection (ord, id, question) differs from the expected one: empty if it may be resumed."""
    a, b = (x.select("ord", "id", "question") for x in (existing, expected))
    joined = a.join(b.withColumnsRenamed({"id": "want_id", "question": "want_question"}), "ord", "full")
    return joined.filter(~F.col("id").eqNullSafe(F.col("want_id")) | ~F.col("question").eqNullSafe(F.col("want_question"))).select("ord", F.when(F.col("id").eqNullSafe(F.col("want_id")), "question").otherwise("selection").alias("changed"))
