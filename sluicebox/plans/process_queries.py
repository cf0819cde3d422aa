"""Queries on distillation, frozen runs and files that are written and read again."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from ..functions import pysource as py
from ..functions.text import json_or
from ..operators import distill, evaluation, freeze, runs, sampling, verify
from ..sources import tables
from . import fixtures as fx
from .code_queries import ADD, BROKEN, Q, truth
from .registry import query
from .text_queries import _POINTS

c = F.col

# Distillation. A document is a problem by doc_id; its text stands in the teachers' answers, before the code.

_OK = '[{"input_args": [1, 2], "expected_output": 3}]'
_WRONG = "def add(a, b):\n    return a - b"
_PLAN = f'\n{Q}json\n[{{"line": 2, "comment": "the sum"}}]\n{Q}'
_WITH_COMMENT = "def add(a, b):\n    # the sum\n    return a + b"
#: first: code of the first answer ('' none, null no answer); second: what follows the text in the second; and what must come out.
_CASES = [
    {"first": ADD, "second": None, "reference": ADD, "force": False},
    {"first": _WRONG, "second": _PLAN, "reference": ADD, "force": False},
    {"first": BROKEN, "second": _PLAN, "reference": ADD, "force": False},
    {"first": "", "second": None, "reference": ADD, "force": False},
    {"first": None, "second": _PLAN, "reference": "", "force": False},
    {"first": ADD, "second": _PLAN, "reference": ADD, "force": True},
    {"first": _WRONG, "second": _PLAN, "reference": _WRONG, "force": False},
    {"first": None, "second": f"\n{Q}python\nx = 1\n{Q}", "reference": ADD, "force": False},
]
_DEFAULT_COMMENT = f"# {py.DEFAULT_COMMENT}\n{ADD}"
_EXPECTED = [
    {"saved": True, "label_strategy": "pedagogical_rewrite", "failure_type": None, "initial": None, "comment_count": None, "tail": f"\n{Q}python\n{ADD}\n{Q}\n"},
    {"saved": True, "label_strategy": "reference_locked", "failure_type": None, "initial": "wrong_answer", "comment_count": 1, "tail": f"\n\n{Q}python\n{_WITH_COMMENT}\n{Q}"},
    {"saved": True, "label_strategy": "reference_locked", "failure_type": None, "initial": "syntax_error", "comment_count": 1, "tail": f"\n\n{Q}python\n{_WITH_COMMENT}\n{Q}"},
    {"saved": False, "label_strategy": None, "failure_type": "recovery_llm_failed", "initial": "no_code_block", "comment_count": None, "tail": None},
    {"saved": False, "label_strategy": None, "failure_type": "no_verified_reference", "initial": "llm_failed", "comment_count": None, "tail": None},
    {"saved": True, "label_strategy": "reference_locked", "failure_type": None, "initial": None, "comment_count": 1, "tail": f"\n\n{Q}python\n{_WITH_COMMENT}\n{Q}"},
    {"saved": False, "label_strategy": None, "failure_type": "recovery_wrong_answer", "initial": "wrong_answer", "comment_count": None, "tail": f"\n\n{Q}python\ndef add(a, b):\n    # the sum\n    return a - b\n{Q}"},
    {"saved": True, "label_strategy": "reference_locked", "failure_type": None, "initial": "llm_failed", "comment_count": 1, "tail": f"\n\n{Q}python\n{_DEFAULT_COMMENT}\n{Q}"},
]


def _outcomes(spark, sf_dir):  # noqa: ANN001, ANN202
    rows = fx.by_case(spark, sf_dir, _CASES).withColumnRenamed("doc_id", "id")
    texts = fx.table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), F.regexp_replace(F.regexp_replace("text", "```", ""), r"\s+$", "").alias("body"))
    rows = rows.join(texts, "id")
    problems = rows.select("id", "reference", F.lit(_OK).alias("cases"), F.lit("call_based").alias("io_mode"), F.lit("add").alias("fn_name"), "force")
    first = rows.select("id", F.when(c("first") == "", c("body")).when(c("first").isNotNull(), F.concat("body", F.lit(f"\n{Q}python\n"), "first", F.lit(f"\n{Q}\n"))).alias("text"))
    second = rows.select("id", F.when(c("second").isNotNull(), F.concat("body", "second")).alias("text")).filter("text is not null")
    # Only programs of _CASES run (bodies have no fences), so they are trusted, on a cluster too.
    return distill.process(problems, first, second, how=distill.Runs(timeout=5.0, command=verify.local))


_BODY = r"regexp_replace(regexp_replace(text, '```', '', 'g'), '\s+$', '')"


@query("process_one", f"select id, saved, label_strategy, failure_type, initial, comment_count, md5({_BODY} || tail) as content_md5 from ({fx.truth_sql(_EXPECTED).replace('select doc_id', 'select doc_id as id')}) join (select doc_id, text from documents) on id = doc_id")
def process_one(spark, sf_dir):
    rows = _outcomes(spark, sf_dir)
    return rows.select("id", "saved", "label_strategy", "failure_type", c("initial_failure.failure_type").alias("initial"), "comment_count", F.md5("content").alias("content_md5"))


@query("process_counters", """select count(*) as total, count(*) filter (doc_id % 8 in (0, 1, 2, 5, 7)) as saved, count(*) filter (doc_id % 8 = 0) as direct_saved, count(*) filter (doc_id % 8 > 0) as recovery_attempted, count(*) filter (doc_id % 8 in (1, 2, 5, 7)) as recovery_saved,
  count(*) filter (doc_id % 8 in (3, 4, 6)) as final_rejected, (count(*) filter (doc_id % 8 in (3, 7)) + 2 * count(*) filter (doc_id % 8 = 4))::bigint as llm_failed, count(*) filter (doc_id % 8 = 3) as no_code, count(*) filter (doc_id % 8 = 2)::bigint as syntax_fail from documents""")
def process_counters(spark, sf_dir):
    return distill.counters(_outcomes(spark, sf_dir))


@query("usable_answers", f"""with {fx.COMPLETIONS}, a as (select doc_id // 3 as id, doc_id % 3 as attempt, text, doc_id % 5 = 0 as cut from completions),
  g as (select * from a where not cut and ({_POINTS}) >= 60) select id, min(attempt) as attempt, md5(arg_min(text, attempt)) as text_md5 from g where attempt < 2 group by id""")
def usable_answers(spark, sf_dir):
    i = c("doc_id")
    rows = fx.completions(spark, sf_dir).select(F.floor(i / 3).cast("long").alias("id"), (i % 3).alias("attempt"), "text", F.when(i % 5 == 0, "length").otherwise("stop").alias("finish_reason"))
    return distill.usable_answers(rows, 2).select("id", "attempt", F.md5("text").alias("text_md5"))


_TEMPLATES = {"locked": "L {description}|{reference}|{numbered}|{lines}", "guided": "G {description}|{reference}", "explained": "E {description}|{reference}", "scratch": "S {description}"}


@query("prompt_render", f"""select doc_id, case doc_id % 4 when 0 then 'L ' || text || '|' || {fx.literal(ADD)} || '|1 | def add(a, b):' || chr(10) || '2 |     return a + b|1, 2'
  when 1 then 'G ' || text || '|' || substr({fx.literal(ADD)}, 1, 9) || '...' when 2 then 'E ' || text || '|' || substr({fx.literal(ADD)}, 1, 9) || '...' else 'S ' || text end as prompt from (select doc_id, coalesce(text, '') as text from documents)""")
def prompt_render(spark, sf_dir):
    mode = F.get(F.array(F.lit("x"), F.lit("reference_guided_label"), F.lit("code_explanation"), F.lit("reference_guided_label")), (c("doc_id") % 4).cast("int"))
    prompt = distill.teacher_prompt(_TEMPLATES, mode, F.when(c("doc_id") % 4 < 3, F.lit(ADD)), c("doc_id") % 4 == 0, {"description": c("text")}, limit=9)
    return fx.table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"))


_solutions = py.column(lambda text: json.dumps(py.solution_list(text)), "string", nulls=True)
truth(
    "normalize_solutions",
    [{"text": '["a ", "", null, "b"]'}, {"text": '{"solution": ["a"], "code": "z"}'}, {"text": '[{"code": " a"}, {"text": "b"}, {"solution": "c"}, {"other": "d"}]'}, {"text": "['a', 'b']"}, {"text": "x = 1"}, {"text": None}, {"text": '{"code": "x"}'}, {"text": '{"other": 1}'}],
    [{"items": '["a", "b"]'}, {"items": '["a"]'}, {"items": '["a", "b", "c"]'}, {"items": '["a", "b"]'}, {"items": '["x = 1"]'}, {"items": "[]"}, {"items": '["x"]'}, {"items": "[]"}],
    lambda rows: rows.select("doc_id", _solutions("text").alias("items")),
)


# Extraction and inspection of whole texts.


@query("extract_code_texts", f"""select doc_id, case doc_id % 7 when 3 then 'n = int(input())' || chr(10) || 'print(n)' when 4 then 'def solve(a, b):' || chr(10) || '    return a + b' when 6 then 'print(2)' when 2 then 'x = 1' when 5 then 'print(3)' end as code
  from documents where not contains(text, '```')""")
def extract_code_texts(spark, sf_dir):
    """Whole documents in the wraps of the fixtures; documents with fences of their own are left to `extract_code`."""
    return _wrapped(spark, sf_dir).select("doc_id", py.column(py.extract_code, "string", nulls=True)("text").alias("code"))


_NO_FENCE = "not contains(text, '```')"


def _wrapped(spark, sf_dir):  # noqa: ANN001, ANN202
    plain = fx.table(spark, sf_dir, "documents").filter(_NO_FENCE).select("doc_id")
    return fx.completions(spark, sf_dir).join(plain, "doc_id", "left_semi")


_NEW = f"'{Q}python' || chr(10) || 'z' || chr(10) || '{Q}'"


@query("replace_final_block_texts", rf"""select doc_id, md5(case doc_id % 7 when 0 then regexp_replace(text, '\s+$', '') || chr(10) || chr(10) || {_NEW}
    when 1 then text || chr(10) || '{Q}python' || chr(10) || 'print(1)' || chr(10) || chr(10) || {_NEW}
    when 2 then {_NEW} || chr(10) || text when 3 then '## Idea one' || chr(10) || text || chr(10) || '## Idea two' || chr(10) || {_NEW} || chr(10)
    when 4 then '**Step 1** read' || chr(10) || '**Step 2** add' || chr(10) || {_NEW} || chr(10) || 'Time complexity O(n). ' || text
    when 5 then '{Q}python' || chr(10) || 'print(3)' || chr(10) || '{Q}' || chr(10) || text || chr(10) || '  ' || {_NEW} || chr(10) || 'REFERENCE_SOLUTION'
    else '## Plan' || chr(10) || '1. **First** 首先 因为' || chr(10) || text || chr(10) || {_NEW} || chr(10) || 'O(n log n) 最后 总结 所以' || chr(10) end) as out_md5 from documents where {_NO_FENCE}""")
def replace_final_block_texts(spark, sf_dir):
    return _wrapped(spark, sf_dir).select("doc_id", F.md5(py.column(py.replace_final_block, "string")("text", F.lit(" z "))).alias("out_md5"))


@query("static_validity_texts", f"""select doc_id, 1.0::double as score, case when doc_id % 7 = 4 then 'solve' else '' end as functions, (case when doc_id % 7 = 3 then 166 else 236 end)::bigint as points
  from documents where {_NO_FENCE} and doc_id % 7 in (3, 4)""")
def static_validity_texts(spark, sf_dir):
    """The code of whole texts, by its mode: what it scores as a candidate, whether it is valid, what it declares."""
    mode, name = F.when(c("doc_id") % 7 == 4, "call_based").otherwise("standard_input"), F.when(c("doc_id") % 7 == 4, "solve")
    rows = _wrapped(spark, sf_dir).filter(c("doc_id") % 7 > 2).filter(c("doc_id") % 7 < 5).withColumn("code", py.column(py.extract_code, "string", nulls=True)("text", mode, name))
    score = py.column(py.static_validity, "double", nulls=True)("code", mode, name)
    functions = py.column(lambda code: ",".join(py.declared_functions(code)), "string")("code")
    points = py.column(lambda code, m, n: py.candidate_score(code, True, m, n), "long")("code", mode, name)
    return rows.select("doc_id", score.alias("score"), functions.alias("functions"), points.alias("points"))


# Frozen runs.


@query("load_frozen_run", "select row_number() over (order by doc_id) - 1 as ord, 'd' || doc_id::varchar as id from documents where lang = 'en'")
def load_frozen_run(spark, sf_dir):
    folder, ids = _run(spark, sf_dir)
    rows, manifest = runs.load_frozen(spark, folder, {"seed": 7, "count": len(ids)})
    replayed, _ = runs.replay(spark, folder, rows.select(c("id").alias("problem_id")), count=manifest["count"])
    return rows.join(replayed.select("id"), "id").select(c("ord").cast("long").alias("ord"), "id")


def _run(spark, sf_dir) -> tuple[str, list[str]]:  # noqa: ANN001
    """A run's folder; its selection is as long as an evaluation's list of ids."""
    folder = tables.scratch(spark)
    docs = fx.table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id")
    ids = [f"d{r['doc_id']}" for r in docs.orderBy("doc_id").collect()]
    for name, value in ((runs.SELECTION, {runs.SELECTED: ids}), (runs.MANIFEST, {"seed": 7, "count": len(ids)})):
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    return folder, ids


@query("join_source_subset", "select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def source_subset(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    known = docs.select("doc_id")
    selected = fx.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").join(known, "doc_id", "left_semi")
    return runs.source_subset(docs.select("doc_id", "source"), selected, "doc_id")


@query("variant_status", f"""with {fx.GENERATIONS}, s as (select doc_id from documents where doc_id % 3 = 0)
  select variant, count(*) as selected, count(*) filter (variant <> 'tuned' or doc_id % 6 = 0) as generated, count(*) filter (variant = 'base' or (variant = 'sft' and doc_id % 9 = 0) or (variant = 'tuned' and doc_id % 6 = 0)) as verified,
    case variant when 'base' then 'complete' when 'sft' then 'generated' else 'partial' end as status from s, (values ('base'), ('sft'), ('tuned')) t(variant) group by variant""")
def variant_status(spark, sf_dir):
    rows, i, v = fx.generations(spark, sf_dir), c("problem_id"), c("variant")
    selected = fx.table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(c("doc_id").alias("problem_id"))
    generated, verified = rows.filter((v != "tuned") | (i % 6 == 0)), rows.filter((v != "sft") | (i % 9 == 0))
    return runs.variant_status(selected, generated, verified, list(fx.VARIANTS))


_REPORT = {
    "HostConfig": {"NetworkMode": "none", "ReadonlyRootfs": True, "CapDrop": ["ALL"], "SecurityOpt": ["no-new-privileges"], "PidsLimit": 64, "Memory": 256 << 20, "MemorySwap": 256 << 20, "NanoCpus": 10**9, "Tmpfs": {"/tmp": "rw,noexec,nosuid,size=16m"}},
    "Config": {"User": "65534:65534", "Image": "python@sha256:" + "a" * 64}, "Mounts": [{"Destination": "/job", "RW": False}],
}
_OPEN = _REPORT | {"HostConfig": _REPORT["HostConfig"] | {"NetworkMode": "bridge", "CapDrop": None}, "Mounts": []}


@query("container_contract", """select doc_id, check_name, case when doc_id % 2 = 0 then true else check_name not in ('network_none', 'cap_drop_all', 'one_read_only_mount', 'all_passed') end as ok from documents,
  (values ('network_none'), ('read_only_root'), ('cap_drop_all'), ('no_new_privileges'), ('pids_limit'), ('memory'), ('no_swap'), ('one_cpu'), ('other_user'), ('tmpfs_restricted'), ('one_read_only_mount'), ('digest_pinned'), ('all_passed')) t(check_name)""")
def container_contract(spark, sf_dir):
    rows = fx.by_case(spark, sf_dir, [{"report": json.dumps(_REPORT)}, {"report": json.dumps(_OPEN)}])
    return runs.contract_report(rows, "doc_id", "report").withColumnRenamed("check", "check_name")


@query("classify_evaluated", "select doc_id, case doc_id % 5 when 0 then 'missing_code' when 1 then 'unsupported' when 2 then 'runtime_or_timeout' when 3 then 'wrong_answer' end as kind from documents")
def classify_evaluated(spark, sf_dir):
    from ..operators.verify import classify_evaluated as kind

    i = c("doc_id") % 5
    return fx.table(spark, sf_dir, "documents").select("doc_id", kind(i != 0, i <= 1, F.when(i <= 2, "boom"), F.when(i == 4, 1.0).otherwise(0.5)).alias("kind"))


# Files that are written, then read.


@query("src_parquet_split", "select doc_id, lang from documents where doc_id % 4 = 0")
def parquet_split(spark, sf_dir):
    folder, docs = tables.scratch(spark), fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    docs.filter("doc_id % 4 = 0").write.parquet(f"{folder}/test-0.parquet")
    docs.filter("doc_id % 4 > 0").write.parquet(f"{folder}/train-0.parquet")
    return tables.parquet_split(spark, folder, " Validation")


@query("src_jsonl_strict", "select doc_id, text from documents")
def jsonl_strict(spark, sf_dir):
    path = tables.scratch(spark)
    fx.table(spark, sf_dir, "documents").select("doc_id", "text").write.option("ignoreNullFields", "false").json(path)
    return tables.json_lines(spark, path, "doc_id long, text string")


@query("src_gzip_bank", "select doc_id, text, n_chars from documents")
def gzip_bank(spark, sf_dir):
    path = tables.scratch(spark)
    tables.write_bank(fx.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), path)
    return tables.read_bank(spark, path, "doc_id long, text string, n_chars long")


@query("src_jsonl_keyed", "select user_id::varchar as problem_id, max(event_id) as event_id from events group by user_id")
def jsonl_keyed(spark, sf_dir):
    path = tables.scratch(spark)
    rows = fx.table(spark, sf_dir, "events").select(c("user_id").cast("string").alias("problem_id"), "event_id")
    rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.json(path)
    return tables.keyed_lines(spark, path, "problem_id string, event_id long")


@query("src_generation_import", "select doc_id::varchar as problem_id, md5(trim(text)) as text_md5, 'p0' as protocol from documents where trim(coalesce(text, '')) <> ''")
def generation_import(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").filter("trim(coalesce(text, '')) <> ''")
    rows = docs.select(c("doc_id").alias("id"), c("text").alias("answer"), F.when(c("doc_id") % 2 == 0, "base").alias("variant"), F.lit("p0").alias("protocol_name"))
    answers, protocols = tables.imported_generations(rows, "base")
    return answers.join(F.broadcast(protocols)).select("problem_id", F.md5("text").alias("text_md5"), "protocol")  # one protocol


@query("src_seed_dir", "select doc_id, lower(case when doc_id % 2 = 0 then lang else 'seeds' end) as category from documents where doc_id % 5 = 0")
def seed_dir(spark, sf_dir):
    folder = tables.scratch(spark)
    rows = fx.table(spark, sf_dir, "documents").filter("doc_id % 5 = 0").select("doc_id", F.when(c("doc_id") % 2 == 0, F.upper("lang")).alias("category"))
    whole = rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("doc_id", "category"))), ","), F.lit("]")).alias("value"))
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/seeds.json")
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(whole.first()["value"].encode()))
    stream.close()
    return tables.seeds(spark, folder).select("doc_id", "category")


@query("src_id_file", "select row_number() over (order by doc_id) - 1 as ord, doc_id::varchar as id from documents where lang = 'fr'")
def id_file_again(spark, sf_dir):
    path = tables.scratch(spark)
    ids = fx.table(spark, sf_dir, "documents").filter("lang = 'fr'").select(c("lang").alias("split"), c("doc_id").alias("ord"), c("doc_id").alias("id"))
    tables.id_file(ids, 7, "documents").select("value").write.text(path)
    return tables.read_ids(spark, f"{path}/*.txt").select(c("ord").cast("long").alias("ord"), "id")


@query("sink_id_lines", "select lang as split, row_number() over (partition by lang order by doc_id) - 1 as ord, doc_id::varchar as id from documents")
def id_lines(spark, sf_dir):
    """Written as lines, a folder for each split, and read again."""
    path, docs = tables.scratch(spark), fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    placed = sampling.positions(docs, ["lang", "doc_id"], "at")
    first = placed.groupBy("lang").agg(F.min("at").alias("first"))
    ids = placed.join(first, "lang").select(c("lang").alias("split"), (c("at") - c("first")).alias("ord"), c("doc_id").alias("id"))
    tables.id_lines(ids, 7, "documents").select("split", "value").write.partitionBy("split").text(path)
    out = None
    for split in sorted(r["split"] for r in ids.select("split").distinct().collect()):
        rows = tables.read_id_lines(spark, f"{path}/split={split}").select(F.lit(split).alias("split"), "ord", "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("sink_frozen_exact", "select doc_id, lang from documents")
def frozen_exact(spark, sf_dir):
    path, rows = tables.scratch(spark), fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    tables.write_exactly_once(rows, path)
    tables.write_exactly_once(rows.repartition(3), path)  # the same rows
    return spark.read.parquet(path)


@query("sink_manifest", f"select 3::bigint as bytes, '{hashlib.sha256(b'ab' + chr(10).encode()).hexdigest()}' as sha256, count(*) as files from (select distinct lang from documents)")
def file_manifest(spark, sf_dir):
    path = tables.scratch(spark)
    fx.table(spark, sf_dir, "documents").select("lang", F.lit("ab").alias("value")).distinct().repartition("lang").write.partitionBy("lang").text(path)
    rows = freeze.manifest(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path))
    return rows.groupBy("bytes", "sha256").agg(F.count(F.lit(1)).alias("files"))


@query("inspect_tasks", "select count(*) as n_rows, count(distinct doc_id) as unique_ids, (select array_to_string(list(doc_id::varchar order by doc_id), ',') from (select doc_id from documents where doc_id % 7 = 0 order by doc_id limit 5)) as first_offenders from documents")
def task_inspection(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select(c("doc_id").alias("task_id"), F.when(c("doc_id") % 7 > 0, "p").alias("prompt"))
    got = tables.inspect_tasks(rows, ("task_id", "prompt"))
    return spark.createDataFrame([(got["rows"], got["unique_ids"], ",".join(str(i) for i, _ in got["offenders"]))], "n_rows long, unique_ids long, first_offenders string")


# Samples.


@query("stratified_sample_ids", "with o as (select doc_id from documents) select row_number() over (order by doc_id) - 1 as ord, doc_id as id from o")
def sample_of_all(spark, sf_dir):
    """As many asked for as there are: all, in the order of ids; smaller samples are `stratified_take` (and a test)."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sampling.stratified_sample_ids(docs, "doc_id", ["lang", "source"], docs.count(), 42)


@query("sample_by_two_keys", """with w as (values ('fr', 1, 4, 0), ('en', 0, 6, 1), ('de', 1, 5, 2)), r as (select doc_id, lang, doc_id % 2 as odd, row_number() over (partition by lang, doc_id % 2 order by sha256('42:' || lang || ':' || (doc_id % 2)::varchar || ':' || doc_id::varchar), doc_id) as n from documents)
  select doc_id, lang, odd, col3::integer as bucket_order from r join w on lang = col0 and odd = col1 where n <= col2""")
def by_two_keys(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", (c("doc_id") % 2).alias("odd"))
    return sampling.take_per_bucket(rows, ["lang", "odd"], {("fr", 1): 4, ("en", 0): 6, ("de", 1): 5}, "doc_id", 42)


@query("last_is_assistant", f"with {fx.CONVERSATIONS} select conv_id, coalesce(messages[-1].role = 'assistant', false) as ok from convs")
def last_is_assistant(spark, sf_dir):
    return fx.conversations(spark, sf_dir).select("conv_id", F.coalesce(F.try_element_at("messages", F.lit(-1))["role"] == "assistant", F.lit(False)).alias("ok"))


@query("max_items", "select doc_id from documents where n_chars >= 80 order by doc_id limit 40")
def max_items(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").filter("n_chars >= 80").select("doc_id").orderBy("doc_id").limit(40)


@query("failing_variants", f"with {fx.GENERATIONS} select variant, count(*) as failing from generations where pass_rate < 1.0 group by variant")
def failing_variants(spark, sf_dir):
    rows = fx.generations(spark, sf_dir).withColumn("failure_type", F.when(c("pass_rate") < 1.0, "wrong_answer"))
    return evaluation.failure_histogram(rows).select("variant", c("n").alias("failing"))


# Small things of the driver.


@query("src_split_alias", "select unnest(['train', 'test', 'Valid', ' validation', 'EVAL', 'dev ']) as name, unnest(['train', 'test', 'test', 'test', 'test', 'test']) as split")
def split_alias(spark, sf_dir):  # noqa: ARG001
    names = ["train", "test", "Valid", " validation", "EVAL", "dev "]
    return spark.createDataFrame([(n, tables.split_name(n)) for n in names], "name string, split string")


@query("adapter_fingerprint", "select sha256(sha256(string_agg(x, chr(10) order by x) || chr(10)) || sha256('b' || chr(10))) as fingerprint from (select distinct lang as x from documents where lang is not null)")
def adapter_fingerprint(spark, sf_dir):
    folder = tables.scratch(spark)
    langs = fx.table(spark, sf_dir, "documents").filter("lang is not null").select("lang").distinct().coalesce(1).sortWithinPartitions("lang")
    langs.write.text(f"{folder}/a")
    spark.range(1).select(F.lit("b")).coalesce(1).write.text(f"{folder}/b")
    return spark.createDataFrame([(tables.fingerprint(spark, [f"{folder}/a/*.txt", f"{folder}/b/*.txt"]),)], "fingerprint string")


@query("sink_report_md", """select '# Languages' || chr(10) || chr(10) || '| lang | n |' || chr(10) || '|-|-|' || chr(10) || string_agg('| ' || lang || ' | ' || n::varchar || ' |' || chr(10), '' order by lang) as report
  from (select lang, count(*) as n from documents where lang is not null group by lang)""")
def report_md(spark, sf_dir):
    counts = fx.table(spark, sf_dir, "documents").filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang")
    return spark.createDataFrame([(tables.markdown(counts, "Languages"),)], "report string")


truth(
    "json_list",
    [{"text": '["a", 1, null]'}, {"text": "[1"}, {"text": ""}, {"text": None}, {"text": '{"a": 1}'}, {"text": "[]"}],
    [{"items": "a,1", "n": 3}, {"items": "", "n": 0}, {"items": "", "n": 0}, {"items": "", "n": 0}, {"items": "", "n": 0}, {"items": "", "n": 0}],
    lambda rows: rows.withColumn("l", json_or(c("text"), "array<string>", F.array().cast("array<string>"))).withColumn("l", F.when(F.startswith(F.ltrim("text"), F.lit("[")), c("l")).otherwise(F.array().cast("array<string>"))).select("doc_id", F.array_join("l", ",").alias("items"), F.size("l").cast("long").alias("n")),
)
