"""From teachers' answers to accepted and rejected records: a rewrite first, then an explanation tied to the verified reference.

A problem has up to two answers. The first may bring code of its own; it is accepted if that runs. Whatever fails there, or was
rejected before, or is forced, goes the second way: the answer's explanation and its plan of comments are put around the reference, whose
code stays as it is but for comments. What fails there too is rejected, with both failures.

All steps are columns and joins; programs run on the executors, each distinct one once, and verdicts are written before they are read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pysource as py
from ..sources.tables import small_batches, written
from ..functions.text import quality_points, shortened
from .records import DIAGNOSTIC_CHARS
from .verify import accepted, classify_distilled, verify

#: Names of the two strategies, and of failures.
REWRITE, LOCKED = "pedagogical_rewrite", "reference_locked"
NO_ANSWER, NO_CODE, NO_SYNTAX, NO_REFERENCE, RECOVERY = "llm_failed", "no_code_block", "syntax_error", "no_verified_reference", "recovery_"
FAILURE = "struct<failure_type:string,pass_rate:double,error:string,first_failure:string>"
OUTCOME = ("id", "saved", "label_strategy", "content", "pass_rate", "failure_type", "error", "first_failure", "initial_failure", "answer_failure", "recovered", "comment_count", "comments_only")


def answer_with_reference(answer: str, reference: str) -> dict:
    """The second way's content: the answer without its plan and its own code, then the reference with the plan's comments."""
    plan, explanation = py.comment_plan(answer)
    code, count = py.inject_comments(reference, plan)
    if py.extract_code(explanation) is not None:
        explanation = py.replace_final_block(explanation, "").replace("```python\n\n```", "").rstrip()
    return {"final": code, "content": f"{explanation}\n\n```python\n{code.strip()}\n```", "comments": count, "only": py.same_but_comments(code, reference)}


def code_and_problem(answer: str) -> dict:
    """The code of an answer, and why it doesn't parse."""
    code = py.extract_code(answer)
    return {"code": code, "problem": None if code is None else py.syntax_error(code)}


def _locked(answer: str, reference: str) -> dict:
    made = answer_with_reference(answer, reference)
    return made | {"problem": py.syntax_error(made["final"])}


# One function for all that a text must tell: each takes Python workers of its own.
_read = py.column(code_and_problem, "struct<code:string,problem:string>")
_combined = py.column(_locked, "struct<final:string,content:string,comments:long,only:boolean,problem:string>")


@dataclass
class Runs:
    """Whether and how code is run."""

    run: bool = True
    timeout: float = 5.0
    command: object = None


def _tried(rows: DataFrame, how: Runs) -> DataFrame:
    """rows, with columns code and problem (why it doesn't parse), and: ok, rate, said, first, kind (why it failed when run).

    Texts and verdicts are written apart: other readings neither read the answers nor run the programs again, and texts move only where they're wanted.
    """
    rows = written(rows)
    if not how.run:
        none = F.lit(None).cast("string")
        return rows.withColumns({"ok": F.col("problem").isNull() & F.col("code").isNotNull(), "rate": F.lit(0.0), "said": none, "first": none, "kind": none})
    parses = F.col("code").isNotNull() & F.col("problem").isNull()
    runs = verify(rows.filter(parses), "code", "cases", "io_mode", "fn_name", how.timeout, how.command).select(
        "id", F.col("pass_rate").alias("rate"), F.col("error").alias("said"), F.col("first_failure").alias("first"),
        accepted(F.col("unsupported"), F.col("error"), F.col("total_cases"), F.col("pass_rate")).alias("ok"),
        classify_distilled(F.col("error"), F.col("first_failure"), F.col("unsupported")).alias("kind"),
    )
    return rows.join(written(runs), "id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def _failure(kind: Column, rate: Column | None = None, error: Column | None = None, first: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(kind.alias("failure_type"), (F.lit(0.0) if rate is None else rate).alias("pass_rate"), (none if error is None else error).alias("error"), (none if first is None else first).alias("first_failure"))


def process(problems: DataFrame, first: DataFrame, second: DataFrame, rejections: DataFrame | None = None, how: Runs | None = None) -> DataFrame:
    """One outcome per problem (columns OUTCOME). initial_failure: why the first answer failed, now or earlier; answer_failure: now.

    problems: id (each once), reference, cases (JSON), io_mode, fn_name, and, if there, force (skips the first way). first and second: id, text:
    the teachers' answers, null or missing where there is none. rejections: id, failure_type, pass_rate, error, first_failure of earlier runs.
    """
    how = how or Runs()
    small_batches(problems.sparkSession)
    wanted = ["id", "reference", "cases", "io_mode", "fn_name"]
    force = F.coalesce(F.col("force"), F.lit(False)) if "force" in problems.columns else F.lit(False)
    rows = problems.select(*wanted, force.alias("force"))
    if rejections is None:
        rows = rows.withColumn("earlier", F.lit(None).cast(FAILURE))
    else:
        rows = rows.join(rejections.select("id", F.struct("failure_type", F.col("pass_rate").cast("double").alias("pass_rate"), "error", "first_failure").alias("earlier")), "id", "left")

    # The first way.
    answered = rows.join(first.select("id", F.col("text").alias("answer")), "id", "left").withColumn("r", F.when(~F.col("force"), _read("answer")))
    # Whether there is an answer is noted beside it, so that its text need not move.
    tried = _tried(answered.withColumns({"silent": F.col("answer").isNull(), "code": F.col("r.code"), "problem": F.col("r.problem")}).drop("r"), how)
    brief = lambda c: shortened(F.col(c), DIAGNOSTIC_CHARS)
    failed = (
        F.when(F.col("force"), F.col("earlier"))
        .when(F.col("silent"), _failure(F.lit(NO_ANSWER)))
        .when(F.col("code").isNull(), _failure(F.lit(NO_CODE)))
        .when(F.col("problem").isNotNull(), _failure(F.lit(NO_SYNTAX), error=F.col("problem")))
        .when(~F.col("ok"), _failure(F.col("kind"), F.col("rate"), brief("said"), brief("first")))
        .otherwise(F.col("earlier"))
    )
    failed_now = ~F.col("force") & (F.col("silent") | F.col("code").isNull() | F.col("problem").isNotNull() | ~F.col("ok"))
    judged = tried.withColumn("initial_failure", failed.cast(FAILURE)).withColumn("answer_failure", F.when(failed_now, F.col("initial_failure.failure_type")))
    done = ~F.col("force") & F.col("initial_failure").isNull()
    none, no_count = F.lit(None).cast("string"), F.lit(None).cast("long")
    direct = judged.filter(done).select(
        "id", F.lit(True).alias("saved"), F.lit(REWRITE).alias("label_strategy"), F.col("answer").alias("content"), F.round(F.coalesce("rate", F.lit(0.0)), 3).alias("pass_rate"), none.alias("failure_type"), none.alias("error"),
        none.alias("first_failure"), "initial_failure", "answer_failure", F.lit(False).alias("recovered"), no_count.alias("comment_count"), F.lit(None).cast("boolean").alias("comments_only"),
    )

    # The second way.
    left = judged.filter(~done).select(*wanted, "initial_failure", "answer_failure").join(second.select("id", F.col("text").alias("locked")), "id", "left")
    has_reference = F.coalesce("reference", F.lit("")) != ""
    combined = left.withColumn("m", F.when(has_reference & F.col("locked").isNotNull(), _combined("locked", "reference"))).withColumns({"silent": F.col("locked").isNull(), "code": F.col("m.final"), "problem": F.col("m.problem")})
    tried = _tried(combined, how)
    why = (
        F.when(~has_reference, F.lit(NO_REFERENCE))
        .when(F.col("silent"), F.lit(RECOVERY + NO_ANSWER))
        .when(F.col("problem").isNotNull(), F.lit(RECOVERY + NO_SYNTAX))
        .when(~F.col("ok"), F.concat(F.lit(RECOVERY), F.coalesce("kind", F.lit("unsupported"))))
    )
    tried = tried.withColumn("why", why)
    saved = F.col("why").isNull()
    second_way = tried.select(
        "id", saved.alias("saved"), F.when(saved, F.lit(LOCKED)).alias("label_strategy"), F.col("m.content").alias("content"), F.round(F.coalesce("rate", F.lit(0.0)), 3).alias("pass_rate"), F.col("why").alias("failure_type"),
        F.when(~saved, F.coalesce("problem", brief("said"))).alias("error"), F.when(~saved, brief("first")).alias("first_failure"), "initial_failure", "answer_failure", F.lit(True).alias("recovered"), F.when(saved, F.col("m.comments")).alias("comment_count"), F.when(saved, F.col("m.only")).alias("comments_only"),
    )
    return direct.select(*OUTCOME).unionByName(second_way.select(*OUTCOME))


def usable_answers(attempts: DataFrame, tries: int, least_points: int = 60) -> DataFrame:
    """id, attempt and text of the first usable answer of each id: not cut off at its length, and good enough; rows without one are left out.

    attempts: id, attempt (from 0), text, finish_reason; those from `tries` on don't count.
    """
    good = (F.coalesce("finish_reason", F.lit("")) != "length") & (quality_points(F.coalesce("text", F.lit(""))) >= least_points)
    return attempts.filter(F.col("attempt") < max(1, tries)).filter(good).groupBy("id").agg(F.min(F.struct("attempt", "text")).alias("a")).select("id", "a.*")


def counters(outcomes: DataFrame) -> DataFrame:
    """One row: how many problems went which way, and why first answers and second ones failed."""
    first, last = F.col("answer_failure"), F.col("failure_type")
    either = lambda a, b: F.sum(F.coalesce((first == a).cast("int"), F.lit(0)) + F.coalesce(last.isin(*b).cast("int"), F.lit(0)))
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("saved").alias("saved"), F.count_if(F.col("saved") & ~F.col("recovered")).alias("direct_saved"), F.count_if("recovered").alias("recovery_attempted"),
        F.count_if(F.col("saved") & F.col("recovered")).alias("recovery_saved"), F.count_if(~F.col("saved")).alias("final_rejected"),
        either(NO_ANSWER, (NO_REFERENCE, RECOVERY + NO_ANSWER)).alias("llm_failed"), F.count_if(F.coalesce(first == NO_CODE, F.lit(False))).alias("no_code"), either(NO_SYNTAX, (RECOVERY + NO_SYNTAX,)).alias("syntax_fail"),
    )


def render(template: str, **parts: Column) -> Column:
    """A template's text with {name} replaced by columns; null parts are ''. A name without a column, or a column without a name, is an error."""
    import string

    pieces, used = [], set()
    for text, name, spec, conversion in string.Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if name is not None:
            if name not in parts or spec or conversion:
                raise ValueError(f"a template part without a column: {name!r}")
            used.add(name)
            pieces.append(F.coalesce(parts[name].cast("string"), F.lit("")))
    if unused := set(parts) - used:
        raise ValueError(f"columns without a place in the template: {sorted(unused)}")
    return F.concat(F.lit(""), *pieces)


def teacher_prompt(templates: dict[str, str], mode: Column, reference: Column, locked: Column, shared: dict[str, Column], limit: int = 12_000) -> Column:
    """The teacher's prompt of each row by its way: `locked` (the whole reference, with line numbers and the lines that may get a comment),
    `guided` or `explained` (with the reference, cut to a limit) where there is a reference and the mode asks for it, else `scratch`.

    templates: the text of each of the four, with {names} of `shared` and, but for scratch, {reference}; locked also {numbered} and {lines}.
    """
    from ..functions.text import number_lines

    whole = F.coalesce(reference, F.lit(""))
    lines = F.array_join(F.transform(_lines_of(whole), lambda x: x.cast("string")), ", ")
    cut = shortened(whole, limit)
    with_reference = lambda name: render(templates[name], reference=cut, **shared)
    return (
        F.when(locked, render(templates["locked"], reference=whole, numbered=number_lines(whole), lines=lines, **shared))
        .when((mode == "reference_guided_label") & (whole != ""), with_reference("guided"))
        .when((mode == "code_explanation") & (whole != ""), with_reference("explained"))
        .otherwise(render(templates["scratch"], **shared))
    )


_lines_of = py.column(py.comment_lines, "array<long>")
