"""Freezing accepted records: backfill, fatal reasons in fixed order, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_leak, unclosed_fence

#: Keys that the source table may fill in, and the standard-input tokens whose absence is a warning.
BACKFILLED = ("source", "difficulty", "io_mode", "fn_name", "starter_code")
IO_TOKENS = r"\b(input|print)\s*\(|sys\.(stdin|stdout)|os\.(read|write)"


def filled(own: Column, other: Column) -> Column:
    """The own value, or the other's where it is null or ''."""
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(other, F.lit("")), own)


def was_filled(own: Column, other: Column) -> Column:
    return F.nullif(own, F.lit("")).isNull() & F.nullif(other, F.lit("")).isNotNull()


def label_strategy(strategy: Column) -> Column:
    return F.coalesce(F.nullif(strategy, F.lit("")), F.lit("pedagogical_rewrite"))


def code_source(source: Column, strategy: Column) -> Column:
    made = F.when(strategy == "reference_locked", "verified_reference_with_comments").otherwise("teacher_generated_docker_verified")
    return F.coalesce(F.nullif(source, F.lit("")), made)


def role_sequence(messages: Column) -> Column:
    return F.transform(messages, lambda m: m["role"])


def fatal_reason(rejected: Column, roles: Column, code: Column, syntax_ok: Column, assistant: Column, user: Column, rate: Column, verified: Column, has_source: Column, io_mode: Column, fn_name: Column, functions: Column) -> Column:
    """Why a record can't be frozen: the first reason that holds; null if none does."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    name = F.coalesce(fn_name, F.lit(""))
    return (
        F.when(F.coalesce(rejected, F.lit(False)), "accepted_rejected_overlap")
        .when(no(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))), "invalid_chatml_roles")
        .when(F.coalesce(code, F.lit("")) == "", "missing_python_code_block")
        .when(no(syntax_ok), "syntax_error")
        .when(F.coalesce(unclosed_fence(assistant), F.lit(False)), "obvious_truncation")
        .when(F.coalesce(has_leak(user), F.lit(False)), "reference_leak_marker")
        .when(no(rate >= 1.0) | no(verified), "missing_final_execution_evidence")
        .when(no(has_source), "missing_source_bank_record")
        .when((io_mode == "call_based") & ((name == "") | no(F.array_contains(functions, name))), "call_based_fn_name_mismatch")
    )


def raise_if_fatal(checked: DataFrame, key: str, reason: str = "fatal_reason") -> DataFrame:
    """The rows, or an error that names the first ten fatal ones."""
    bad = checked.filter(F.col(reason).isNotNull())
    n = bad.count()
    if n:
        first = [(r[0], r[1]) for r in bad.select(key, reason).orderBy(key).limit(10).collect()]
        raise ValueError(f"validation failed for {n} records; first={first}")
    return checked


def distributions(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, value (None for null), n: counts of several columns in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("None")).alias("value")) for f in fields))).alias("p")
    return rows.select(pairs).select("p.*").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def nearest_rank(rows: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """min, p50, p90, p95, p99, max by the value at ceil(p * n), and the mean, not rounded."""
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by `{value}`)").cast("long")
    return rows.groupBy(*(group or [])).agg(F.min(value).cast("long").alias("min"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max(value).cast("long").alias("max"), F.avg(value).alias("mean"))


def manifest(files: DataFrame) -> DataFrame:
    """path, bytes, sha256 of files read as binaryFile."""
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
