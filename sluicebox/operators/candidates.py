"""Candidate solutions and test cases: arrays of structs, ranked and built inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, is_json, strip

#: Marks of other languages (in lower case) and of Python (case counts).
OTHER_LANGUAGES = ("#include", "using namespace", "int main(", "public static void main", "class main", "console.log(", "function ", "package main")
PYTHON = ("def ", "class Solution", "import ", "from ", "input(", "sys.stdin", "print(", "lambda ")
READS = ("input(", "sys.stdin", "stdin.readline", ".readline()")
WRITES = ("print(", "sys.stdout")
#: Tags of problems that need another judge.
OTHER_JUDGES = ("interactive", "special judge", "custom checker")


def looks_python(code: Column) -> Column:
    return ~contains_any(F.lower(code), OTHER_LANGUAGES) & contains_any(code, PYTHON)


def _quoted(name: Column) -> Column:
    return F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|\-#&~ ])", r"\\$1")


def priority(code: Column, io_mode: Column, fn_name: Column) -> Column:
    """struct(priority, reason): 0 to 2 for a known mode, else 10."""
    pick = lambda n, why: F.struct(F.lit(n).alias("priority"), F.lit(why).alias("reason"))
    exact = (F.coalesce(fn_name, F.lit("")) != "") & F.coalesce(F.regexp_like(code, F.concat(F.lit(r"(?U)\bdef\s+"), _quoted(fn_name), F.lit(r"\s*\("))), F.lit(False))
    reads = contains_any(code, READS)
    writes = contains_any(code, WRITES) | F.contains(F.lower(code), F.lit("stdout.write"))
    call = F.when(exact, pick(0, "exact_fn_name")).when(F.contains(code, F.lit("class Solution")), pick(1, "class_solution")).otherwise(pick(2, "python_like_call_based"))
    stdin = F.when(reads & writes, pick(0, "stdin_stdout_program")).when(reads, pick(1, "stdin_program")).otherwise(pick(2, "python_like_standard_input"))
    return F.when(io_mode == "call_based", call).when(io_mode == "standard_input", stdin).otherwise(pick(10, "python_like"))


def rank_candidates(problems: DataFrame, key: str, solutions: str, io_mode: str = "io_mode", fn_name: str = "fn_name") -> DataFrame:
    """One row per Python candidate: key, raw_index, code, priority, reason, rank (from 0, by priority, then place)."""
    # Blank entries go before places are counted.
    usable = F.filter(F.transform(F.col(solutions), lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
    rows = problems.select(key, F.col(io_mode).alias("__mode"), F.col(fn_name).alias("__name"), F.posexplode(usable).alias("raw_index", "code")).filter(looks_python(F.col("code")))
    rows = rows.withColumn("__p", priority(F.col("code"), F.col("__mode"), F.col("__name"))).select(key, "raw_index", "code", "__p.*")
    order = Window.partitionBy(key).orderBy("priority", "raw_index")
    return rows.withColumn("rank", F.row_number().over(order) - 1)


def pick_candidate(ranked: DataFrame) -> DataFrame:
    return ranked.filter("rank = 0")


def io_mode_of(mode: Column, fn_name: Column, any_args: Column | None = None) -> Column:
    """An explicit mode counts; else call_based with a function name or with argument lists."""
    call = F.coalesce(fn_name, F.lit("")) != ""
    if any_args is not None:
        call = call | F.coalesce(any_args, F.lit(False))
    return F.when(mode.isin("standard_input", "call_based"), mode).when(call, F.lit("call_based")).otherwise(F.lit("standard_input"))


def build_test_cases(inputs: Column, outputs: Column, fn_name: Column, source: Column) -> Column:
    """Array of (input, output, fn_name, input_args, expected_output) from arrays of JSON texts.

    The shorter array counts. Strings lose their quotes in input and output. With a function name, arguments that aren't a list become
    one, and a source that wraps each result in a list of one is unwrapped.
    """
    n = F.least(F.size(inputs), F.size(outputs))
    plain = lambda x: F.when(F.startswith(x, F.lit('"')), F.from_json(F.concat(F.lit('{"v":'), x, F.lit("}")), "v string")["v"]).otherwise(x)
    named = F.coalesce(fn_name, F.lit("")) != ""

    def case(pair: Column) -> Column:
        given, wanted = pair["0"], pair["1"]
        listed = F.from_json(wanted, "array<string>")
        unwrapped = F.when((F.lower(source) == "codewars") & F.startswith(wanted, F.lit("[")) & (F.size(listed) == 1), F.get_json_object(wanted, "$[0]")).otherwise(wanted)
        return F.struct(
            plain(given).alias("input"),
            plain(wanted).alias("output"),
            F.when(named, fn_name).alias("fn_name"),
            F.when(named, F.when(F.startswith(given, F.lit("[")), given).otherwise(F.concat(F.lit("["), given, F.lit("]")))).alias("input_args"),
            F.when(named, unwrapped).alias("expected_output"),
        )

    pairs = F.arrays_zip(F.slice(inputs, F.lit(1), n).alias("0"), F.slice(outputs, F.lit(1), n).alias("1"))
    return F.when(n > 0, F.transform(pairs, case)).otherwise(F.array().cast("array<struct<input:string,output:string,fn_name:string,input_args:string,expected_output:string>>"))


def supports_verification(mode: Column, fn_name: Column, cases: Column, tags: Column) -> Column:
    """Whether the verifier can run these cases; unsupported shapes are no failures."""
    other = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: contains_any(F.lower(t), OTHER_JUDGES))
    found = F.coalesce(mode, io_mode_of(F.lit(None).cast("string"), fn_name, F.exists(cases, lambda c: c["input_args"].isNotNull())))
    name = F.coalesce(F.nullif(fn_name, F.lit("")), F.try_element_at(F.filter(F.transform(cases, lambda c: F.nullif(c["fn_name"], F.lit(""))), lambda x: x.isNotNull()), F.lit(1)))
    stdin = F.forall(cases, lambda c: c["input"].isNotNull() & c["output"].isNotNull())
    call = (strip(F.coalesce(name, F.lit(""))) != "") & F.forall(cases, lambda c: F.coalesce(F.startswith(c["input_args"], F.lit("[")) & is_json(c["input_args"]) & is_json(c["expected_output"]), F.lit(False)))
    return F.coalesce((F.size(cases) > 0) & ~other & F.when(found == "standard_input", stdin).when(found == "call_based", call).otherwise(False), F.lit(False))


def seed_categories(tags: Column, aliases: dict[str, str]) -> Column:
    """Categories of tags by an alias table, each once, in the order of tags."""
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.try_element_at(table, F.lower(strip(t)))), lambda x: x.isNotNull()))
