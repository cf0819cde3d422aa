"""Queries on source code and its execution. What each case must give is stated, and said in SQL as a table of literals."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import pysource as py
from ..operators import candidates, verify
from . import fixtures as fx
from .registry import query

Q = "```"
ADD = "def add(a, b):\n    return a + b"
ECHO = "n = int(input())\nprint(n * 2)"
METHOD = "class Solution:\n    def add(self, a, b):\n        return a + b"
BROKEN = "def add(a, b:\n    return"


def _block(code: str, tag: str = "python") -> str:
    return f"{Q}{tag}\n{code}\n{Q}\n"


def truth(name: str, cases: list[dict], expected: list[dict], function) -> None:  # noqa: ANN001
    """Registers a query that applies a function to the case of each document, and its table of results."""

    @query(name, fx.truth_sql(expected))
    def run(spark, sf_dir):  # noqa: ANN202
        return function(fx.by_case(spark, sf_dir, cases)).select("doc_id", *expected[0])

    TRUTH[name] = (cases, expected, function)


TRUTH: dict[str, tuple] = {}
c = F.col


# Inside the JVM.

truth(
    "looks_python",
    [{"code": ADD}, {"code": "#include <x>\nint main() {}"}, {"code": "x = 1"}, {"code": "print(1)  # a function here"}, {"code": "import os"}, {"code": "CLASS MAIN {}\nimport java"}],
    [{"ok": True}, {"ok": False}, {"ok": False}, {"ok": False}, {"ok": True}, {"ok": False}],
    lambda rows: rows.select("doc_id", candidates.looks_python(c("code")).alias("ok")),
)


def _ranked(rows):  # noqa: ANN001, ANN202
    lists = rows.withColumn("solutions", F.from_json("solutions", "array<string>"))
    ranked = candidates.rank_candidates(lists, "doc_id", "solutions")
    every = ranked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "raw_index", "reason"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.concat(x["raw_index"].cast("string"), F.lit(":"), x["reason"])), ",")
    return lists.select("doc_id").join(every.select("doc_id", text.alias("ranking")), "doc_id", "left").select("doc_id", F.coalesce("ranking", F.lit("")).alias("ranking"))


truth(
    "rank_candidates",
    [
        {"solutions": json.dumps(["x = lambda a: a", "class Solution:\n    def other(self): pass", " ", ADD]), "io_mode": "call_based", "fn_name": "add"},
        {"solutions": json.dumps(["print(1)", "import sys\nfor l in sys.stdin: pass", ECHO, "#include"]), "io_mode": "standard_input", "fn_name": None},
        {"solutions": json.dumps(["def  a.b (", "def axb(x): pass"]), "io_mode": "call_based", "fn_name": "a.b"},
        {"solutions": json.dumps([ADD, ECHO]), "io_mode": None, "fn_name": None},
        {"solutions": None, "io_mode": "call_based", "fn_name": "f"},
    ],
    [{"ranking": "2:exact_fn_name,1:class_solution,0:python_like_call_based"}, {"ranking": "2:stdin_stdout_program,1:stdin_program,0:python_like_standard_input"}, {"ranking": "0:exact_fn_name,1:python_like_call_based"}, {"ranking": "0:python_like,1:python_like"}, {"ranking": ""}],
    _ranked,
)
truth(
    "pick_candidate",
    [{"solutions": json.dumps(["x = lambda a: a", ADD]), "io_mode": "call_based", "fn_name": "add"}, {"solutions": json.dumps(["int main("]), "io_mode": "standard_input", "fn_name": None}],
    [{"raw_index": 1, "rank": 0}, {"raw_index": None, "rank": None}],
    lambda rows: rows.select("doc_id").join(candidates.pick_candidate(candidates.rank_candidates(rows.withColumn("solutions", F.from_json("solutions", "array<string>")), "doc_id", "solutions")).select("doc_id", c("raw_index").cast("long").alias("raw_index"), c("rank").cast("long").alias("rank")), "doc_id", "left"),
)


def _tests(rows):  # noqa: ANN001, ANN202
    built = candidates.build_test_cases(F.from_json("inputs", "array<string>"), F.from_json("outputs", "array<string>"), c("fn_name"), c("source"))
    one = lambda x: F.concat_ws("|", x["input"], x["output"], F.coalesce(x["input_args"], F.lit("-")), F.coalesce(x["expected_output"], F.lit("-")))
    return rows.select("doc_id", F.array_join(F.transform(built, one), ";").alias("cases"))


truth(
    "build_test_cases",
    [
        {"inputs": '["1 2", "3"]', "outputs": '["3", "4", "5"]', "fn_name": None, "source": "x"},
        {"inputs": "[[1, 2], 5]", "outputs": "[[3], [6]]", "fn_name": "f", "source": "codewars"},
        {"inputs": "[[1,2]]", "outputs": "[[3]]", "fn_name": "f", "source": "leetcode"},
        {"inputs": "[]", "outputs": "[]", "fn_name": "f", "source": None},
    ],
    [{"cases": '"1 2"|"3"|-|-;"3"|"4"|-|-'.replace('"', "")}, {"cases": "[1,2]|[3]|[1,2]|3;5|[6]|[5]|6"}, {"cases": "[1,2]|[3]|[1,2]|[3]"}, {"cases": ""}],
    _tests,
)
_CASES = "array<struct<input:string,output:string,fn_name:string,input_args:string,expected_output:string>>"
truth(
    "supports_verification",
    [
        {"cases": '[{"input":"1","output":"2"}]', "fn_name": None, "tags": "dp"},
        {"cases": '[{"input":"1"}]', "fn_name": None, "tags": "dp"},
        {"cases": '[{"input_args":"[1]","expected_output":"2"}]', "fn_name": "f", "tags": "dp"},
        {"cases": '[{"input_args":"1","expected_output":"2"}]', "fn_name": "f", "tags": "dp"},
        {"cases": '[{"input":"1","output":"2"}]', "fn_name": None, "tags": "Interactive"},
        {"cases": "[]", "fn_name": None, "tags": "dp"},
    ],
    [{"ok": True}, {"ok": False}, {"ok": True}, {"ok": False}, {"ok": False}, {"ok": False}],
    lambda rows: rows.select("doc_id", candidates.supports_verification(F.lit(None).cast("string"), c("fn_name"), F.from_json("cases", _CASES), F.array("tags")).alias("ok")),
)

# Arrow-batched.

_extract = py.column(py.extract_code, "string", nulls=True)
truth(
    "extract_code",
    [
        {"text": "no code", "mode": None, "name": None},
        {"text": _block("x = 1", ""), "mode": None, "name": None},
        {"text": _block("a = 1") + _block("b = 2", ""), "mode": None, "name": None},
        {"text": _block(ADD) + _block("add(1, 2)"), "mode": "call_based", "name": "add"},
        {"text": _block("print(1)") + _block(ECHO), "mode": "standard_input", "name": None},
        {"text": _block("a = 1") + f"{Q}python\nb = 2", "mode": None, "name": None},
        {"text": _block("int x;", "cpp") + _block("y = 1", "py"), "mode": None, "name": None},
        {"text": _block(METHOD) + _block(BROKEN), "mode": "call_based", "name": "add"},
    ],
    [{"code": None}, {"code": "x = 1"}, {"code": "a = 1"}, {"code": ADD}, {"code": ECHO}, {"code": "a = 1"}, {"code": "y = 1"}, {"code": METHOD}],
    lambda rows: rows.select("doc_id", _extract("text", "mode", "name").alias("code")),
)
_score = py.column(lambda code, tagged, mode, name: py.candidate_score(code, bool(tagged), mode, name), "long")
truth(
    "candidate_score",
    [
        {"code": ADD, "tagged": True, "mode": "call_based", "name": "add"},
        {"code": METHOD, "tagged": False, "mode": "call_based", "name": "add"},
        {"code": "x = [1]", "tagged": True, "mode": "call_based", "name": "add"},
        {"code": ECHO, "tagged": True, "mode": "standard_input", "name": None},
        {"code": "print(1)", "tagged": False, "mode": "standard_input", "name": None},
        {"code": BROKEN, "tagged": True, "mode": None, "name": None},
        {"code": ADD, "tagged": False, "mode": None, "name": None},
    ],
    [{"points": 236}, {"points": 225}, {"points": -144}, {"points": 166}, {"points": -15}, {"points": -10000}, {"points": 15}],
    lambda rows: rows.select("doc_id", _score("code", "tagged", "mode", "name").alias("points")),
)
_syntax = py.column(lambda code: py.syntax_error(code) is None, "boolean")
truth(
    "validate_syntax",
    [{"code": ADD}, {"code": BROKEN}, {"code": ""}, {"code": "x = = 1"}, {"code": "a\x00b"}],
    [{"ok": True}, {"ok": False}, {"ok": True}, {"ok": False}, {"ok": False}],
    lambda rows: rows.select("doc_id", _syntax("code").alias("ok")),
)
_functions = py.column(lambda code: ",".join(py.declared_functions(code)), "string")
truth(
    "declared_functions",
    [{"code": ADD}, {"code": METHOD + "\nasync def b():\n    def a(): pass"}, {"code": BROKEN}, {"code": "x = 1"}],
    [{"names": "add"}, {"names": "a,add,b"}, {"names": ""}, {"names": ""}],
    lambda rows: rows.select("doc_id", _functions("code").alias("names")),
)
_static = py.column(py.static_validity, "double", nulls=True)
truth(
    "static_validity",
    [
        {"code": ADD, "mode": "call_based", "name": "add"}, {"code": ADD, "mode": "call_based", "name": "sub"}, {"code": ECHO, "mode": "standard_input", "name": None},
        {"code": "import socket\n" + ECHO, "mode": "standard_input", "name": None}, {"code": "import os\nos.system(input())\nprint(1)", "mode": "standard_input", "name": None},
        {"code": "print(eval(input()))", "mode": "standard_input", "name": None}, {"code": "from urllib.request import urlopen\nprint(input())", "mode": "standard_input", "name": None}, {"code": BROKEN, "mode": "call_based", "name": "add"}, {"code": ADD, "mode": None, "name": None},
    ],
    [{"score": 1.0}, {"score": 0.0}, {"score": 1.0}, {"score": 0.0}, {"score": 0.0}, {"score": 0.0}, {"score": 0.0}, {"score": 0.0}, {"score": 0.0}],
    lambda rows: rows.select("doc_id", _static("code", "mode", "name").alias("score")),
)
_same = py.column(lambda a, b: py.same_output(json.loads(a), json.loads(b)), "boolean")
truth(
    "compare_outputs",
    [{"a": "1", "b": "true"}, {"a": "1", "b": "1.0000000001"}, {"a": "[1, [2, 3]]", "b": "[1, [2, 3]]"}, {"a": '{"x": 1.0}', "b": '{"x": 1}'}, {"a": '"1"', "b": "1"}, {"a": "null", "b": "null"}, {"a": "[1]", "b": "[1, 2]"}, {"a": "100000000000000000000001", "b": "100000000000000000000002"}],
    [{"ok": False}, {"ok": True}, {"ok": True}, {"ok": True}, {"ok": False}, {"ok": True}, {"ok": False}, {"ok": False}],
    lambda rows: rows.select("doc_id", _same("a", "b").alias("ok")),
)
_lines = py.column(lambda code: ",".join(map(str, py.comment_lines(code))), "string")
truth(
    "safe_comment_lines",
    [{"code": ADD}, {"code": "@d\n@e\ndef f():\n    x = (1 +\n         2)\n    return x"}, {"code": BROKEN}],
    [{"lines": "1,2"}, {"lines": "1,4,6"}, {"lines": ""}],
    lambda rows: rows.select("doc_id", _lines("code").alias("lines")),
)
_equivalent = py.column(py.same_but_comments, "boolean")
truth(
    "comments_only_equivalent",
    [{"a": "# hi\n" + ADD, "b": ADD}, {"a": ADD + "\n\n", "b": ADD}, {"a": "x = 1", "b": "x = 2"}, {"a": "x = (", "b": "x = ("}, {"a": "if x:\n    y", "b": "if x:\n  y"}],
    [{"ok": True}, {"ok": True}, {"ok": False}, {"ok": False}, {"ok": False}],
    lambda rows: rows.select("doc_id", _equivalent("a", "b").alias("ok")),
)
_replace = py.column(py.replace_final_block, "string")
truth(
    "replace_final_block",
    [{"text": "a\n" + _block("x") + _block("y") + "b", "code": " z "}, {"text": "a  ", "code": "z"}],
    [{"out": "a\n" + _block("x") + f"{Q}python\nz\n{Q}\nb"}, {"out": f"a\n\n{Q}python\nz\n{Q}"}],
    lambda rows: rows.select("doc_id", _replace("text", "code").alias("out")),
)
_plan = py.column(lambda text: json.dumps(py.comment_plan(text)[0]), "string")
_rest = py.column(lambda text: py.comment_plan(text)[1], "string")
truth(
    "comment_plan",
    [{"text": "a " + _block("[1]", "json") + "b " + _block('[{"line": 2}]', "json")}, {"text": "none "}, {"text": _block("{}", "json")}, {"text": _block("[", "JSON") + "x"}],
    [{"plan": '[{"line": 2}]', "rest": "a " + _block("[1]", "json") + "b"}, {"plan": "[]", "rest": "none"}, {"plan": "[]", "rest": ""}, {"plan": "[]", "rest": "\nx"}],
    lambda rows: rows.select("doc_id", _plan("text").alias("plan"), _rest("text").alias("rest")),
)
_inject = py.column(lambda code, plan: dict(zip(("code", "n"), py.inject_comments(code, json.loads(plan)), strict=True)), "struct<code:string,n:long>")
truth(
    "inject_comments",
    [{"code": ADD, "plan": '[{"line": 2, "comment": "# sum  of\\nboth"}, {"line": 9, "comment": "no"}]'}, {"code": ADD, "plan": "[]"}, {"code": BROKEN, "plan": '[{"line": 1, "comment": "x"}]'}, {"code": "", "plan": "[]"}],
    [{"code": "def add(a, b):\n    # sum of both\n    return a + b", "n": 1}, {"code": f"# {py.DEFAULT_COMMENT}\n{ADD}", "n": 1}, {"code": BROKEN, "n": 0}, {"code": "", "n": 0}],
    lambda rows: rows.select("doc_id", _inject("code", "plan").alias("x")).select("doc_id", "x.code", "x.n"),
)
_list = py.column(lambda text: json.dumps(py.as_list(text)), "string", nulls=True)
truth(
    "as_list",
    [{"text": "['a', 'b']"}, {"text": '["a", null]'}, {"text": "plain"}, {"text": "  "}, {"text": None}, {"text": "{'a': 1}"}],
    [{"items": '["a", "b"]'}, {"items": '["a", null]'}, {"items": '["plain"]'}, {"items": "[]"}, {"items": "[]"}, {"items": '["{\'a\': 1}"]'}],
    lambda rows: rows.select("doc_id", _list("text").alias("items")),
)
_WEIGHTS = {"clarity": 0.6, "care": 0.4}
_judged = py.column(lambda text: py.parse_judgment(text, _WEIGHTS), "struct<winner:string,score_a:double,score_b:double,reported_a:double,reported_b:double>")
_GOOD = '{"winner": "a", "score_A": 8, "score_B": 7.5, "dimensions": {"clarity": {"A": 8, "B": 5}, "care": {"A": 6, "B": 10}}}'
truth(
    "parse_judgment",
    [{"text": _GOOD}, {"text": f"{Q}json\n{_GOOD}\n{Q}"}, {"text": "Sure: " + _GOOD.replace('"a"', '"tie"') + " done"}, {"text": _GOOD.replace('"a"', '"C"')}, {"text": _GOOD.replace("10}", "11}")}, {"text": _GOOD.replace("care", "cost")}, {"text": "nothing"}],
    [{"winner": "A", "score_a": 7.2, "score_b": 7.0}, {"winner": "A", "score_a": 7.2, "score_b": 7.0}, {"winner": "TIE", "score_a": 7.2, "score_b": 7.0}, *({"winner": None, "score_a": None, "score_b": None},) * 4],
    lambda rows: rows.select("doc_id", _judged("text").alias("x")).select("doc_id", "x.winner", "x.score_a", "x.score_b"),
)
_BODY = ["read the numbers from the input and keep all of them in a list", "sort that list once, then walk over neighbouring pairs quickly", "print the smallest difference that was seen during this walk"]
_contract = py.column(py.contract_score, "double", nulls=True)
truth(
    "contract_score",
    [{"text": None}, {"text": "short"}, {"text": "## A\n" + _BODY[0] + "\n## B\n" + _BODY[1] + "\n## C\n" + _BODY[2] + "\n" + _block("a = 1\nb = 2\n# no\nprint(a)") + "O(n) 因为 所以 因此 注意 关键"}, {"text": "## A\n" + _BODY[0] + "\n## B\n" + _BODY[0] + "\n" + _block("x = 1")}, {"text": "## A\nempty\n## B\nempty"}],
    [{"score": 0.0}, {"score": 0.0}, {"score": 1.0}, {"score": 0.283333}, {"score": 0.0}],
    lambda rows: rows.select("doc_id", _contract("text").alias("score")),
)

# By execution: each distinct program runs once. All are constants of this file, so they are trusted, on a cluster too.

_VERIFY = [
    {"code": ECHO, "cases": '[{"input": "2\\n", "output": "4"}, {"input": "5", "output": "10\\n"}]', "io_mode": "standard_input", "fn_name": None},
    {"code": "print(4)", "cases": '[{"input": "2", "output": "4"}, {"input": "5", "output": "10"}]', "io_mode": "standard_input", "fn_name": None},
    {"code": "import sys\nsys.exit()", "cases": '[{"input": "", "output": ""}]', "io_mode": "standard_input", "fn_name": None},
    {"code": ADD, "cases": '[{"input_args": [1, 2], "expected_output": 3}, {"input_args": [0.1, 0.2], "expected_output": 0.3}]', "io_mode": "call_based", "fn_name": "add"},
    {"code": METHOD, "cases": '[{"input_args": [1, 2], "expected_output": 3}]', "io_mode": "call_based", "fn_name": "add"},
    {"code": ADD, "cases": '[{"input_args": [1, 2], "expected_output": 3}]', "io_mode": "call_based", "fn_name": "sub"},
    {"code": "def f(x):\n    return (x, [x])", "cases": '[{"input_args": [1], "expected_output": [1, [1]]}, {"input_args": [true], "expected_output": [1, [1]]}]', "io_mode": "call_based", "fn_name": "f"},
    {"code": "while True: pass", "cases": '[{"input": "", "output": ""}]', "io_mode": "standard_input", "fn_name": None},
    {"code": "", "cases": '[{"input": "", "output": ""}]', "io_mode": "standard_input", "fn_name": None},
    {"code": ADD, "cases": "[]", "io_mode": None, "fn_name": None},
]
truth(
    "verify_code",
    _VERIFY,
    [
        {"passed_cases": 2, "total_cases": 2, "pass_rate": 1.0, "unsupported": False, "error": None}, {"passed_cases": 1, "total_cases": 2, "pass_rate": 0.5, "unsupported": False, "error": None}, {"passed_cases": 0, "total_cases": 1, "pass_rate": 0.0, "unsupported": False, "error": "no harness output"},
        {"passed_cases": 2, "total_cases": 2, "pass_rate": 1.0, "unsupported": False, "error": None}, {"passed_cases": 1, "total_cases": 1, "pass_rate": 1.0, "unsupported": False, "error": None}, {"passed_cases": 0, "total_cases": 1, "pass_rate": 0.0, "unsupported": True, "error": "no top-level function or Solution.sub found"},
        {"passed_cases": 1, "total_cases": 2, "pass_rate": 0.5, "unsupported": False, "error": None}, {"passed_cases": 0, "total_cases": 1, "pass_rate": 0.0, "unsupported": False, "error": "timeout after 2.0s"}, {"passed_cases": 0, "total_cases": 1, "pass_rate": 0.0, "unsupported": False, "error": "missing code"}, {"passed_cases": 0, "total_cases": 0, "pass_rate": 0.0, "unsupported": True, "error": "missing test cases"},
    ],
    lambda rows: verify.verify(rows, timeout=2.0, command=verify.local),
)


def _scored(rows):  # noqa: ANN001, ANN202
    """Completion -> code -> static check and one verification -> reward."""
    rows = rows.withColumn("code", _extract("text", "io_mode", "fn_name"))
    rows = verify.verify(rows, timeout=2.0, command=verify.local).withColumn("static", _static("code", "io_mode", "fn_name")).withColumn("contract", _contract("text"))
    rate = F.when(~c("unsupported"), c("pass_rate")).otherwise(0.0)
    return rows.withColumn("r", verify.combined_reward(c("static"), rate, c("contract"))).select("doc_id", "r.total", "r.code_reward", "r.static_validity")


_TWO = '[{"input_args": [1, 2], "expected_output": 3}, {"input_args": [1, 1], "expected_output": 3}]'
truth(
    "score_completion",
    [
        {"text": _block(ADD), "cases": _TWO.replace("[1, 1]", "[1, 2]"), "io_mode": "call_based", "fn_name": "add"},
        {"text": _block(ADD), "cases": _TWO, "io_mode": "call_based", "fn_name": "add"},
        {"text": "no code at all", "cases": _TWO, "io_mode": "call_based", "fn_name": "add"},
    ],
    [{"total": 0.64, "code_reward": 1.0, "static_validity": 1.0}, {"total": 0.265, "code_reward": 0.4, "static_validity": 1.0}, {"total": 0.0, "code_reward": 0.0, "static_validity": 0.0}],
    _scored,
)


def _references(rows):  # noqa: ANN001, ANN202
    """Candidates in rank order -> verdicts -> the first that passes."""
    from ..operators.dedup import first_passing

    lists = rows.withColumn("solutions", F.from_json("solutions", "array<string>"))
    ranked = candidates.rank_candidates(lists, "doc_id", "solutions").join(rows.select("doc_id", "cases", "io_mode", "fn_name"), "doc_id")
    chosen = first_passing(verify.verify_in_waves(ranked, "doc_id", timeout=2.0, command=verify.local), "doc_id", "rank", "pass_rate")
    return chosen.select("doc_id", c("selected_rank").cast("long").alias("selected_rank"), "attempted")


truth(
    "verify_reference",
    [
        {"solutions": json.dumps(["def add(a, b):\n    return a - b", ADD, METHOD]), "cases": _TWO.replace("[1, 1]", "[2, 1]"), "io_mode": "call_based", "fn_name": "add"},
        {"solutions": json.dumps(["print(1)", "print(input())"]), "cases": '[{"input": "7", "output": "8"}]', "io_mode": "standard_input", "fn_name": None},
    ],
    [{"selected_rank": 1, "attempted": 2}, {"selected_rank": None, "attempted": 2}],
    _references,
)
