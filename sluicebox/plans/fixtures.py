"""Inputs derived from the tables by rules that Spark and SQL say alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Q = "```"
#: What stands before and after a document's whole text, by doc_id modulo their number.
WRAPS = [
    ("", ""),
    ("", f"\n{Q}python\nprint(1)\n"),
    (f"{Q}\nx = 1\n{Q}\n", ""),
    ("## Idea one\n", f"\n## Idea two\n{Q}python\nn = int(input())\nprint(n)\n{Q}\n"),
    (f"**Step 1** read\n**Step 2** add\n{Q}python\ndef solve(a, b):\n    return a + b\n{Q}\nTime complexity O(n). ", ""),
    (f"{Q}python\nprint(3)\n{Q}\n", f"\n  {Q}\nprint(4)\n{Q}\nREFERENCE_SOLUTION"),
    ("## Plan\n1. **First** 首先 因为\n", f"\n{Q}python\nprint(2)\n{Q}\nO(n log n) 最后 总结 所以\n"),
]


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: whole documents in the wraps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    wraps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in WRAPS))
    return docs.withColumn("w", F.get(wraps, (F.col("doc_id") % len(WRAPS)).cast("int"))).select("doc_id", F.concat("w.a", "text", "w.b").alias("text"))


COMPLETIONS = "completions as (select doc_id, case doc_id % {n} {cases} end as text from documents)".format(
    n=len(WRAPS), cases=" ".join(f"when {i} then {literal(a)} || text || {literal(b)}" for i, (a, b) in enumerate(WRAPS))
)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and its messages (role, text), in order."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))


CONVERSATIONS = "convs as (select conv_id, list(struct_pack(role := role, \"text\" := \"text\") order by turn, role, text) as messages from conversations group by conv_id)"

VARIANTS = ("base", "sft", "tuned")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and variant, all numbers by rule."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("problem_id"), F.posexplode(F.array(*map(F.lit, VARIANTS))).alias("v", "variant"), (F.col("n_chars") % 2048).alias("generated_tokens"), "text")
    rate = F.least(((F.col("problem_id") * 7 + F.col("v") * 3) % 13) / F.lit(10.0), F.lit(1.0))
    rows = rows.withColumn("pass_rate", rate).withColumn("strict_pass", F.col("pass_rate") == 1.0)
    return rows.withColumn("hit_limit", F.col("generated_tokens") >= 2000).withColumn("unclosed", (F.col("problem_id") + F.col("v")) % 5 == 0)


GENERATIONS = """generations as (
  select doc_id as problem_id, variant, v, n_chars % 2048 as generated_tokens,
    least(((doc_id * 7 + v * 3) % 13) / 10.0::double, 1.0) as pass_rate,
    least(((doc_id * 7 + v * 3) % 13) / 10.0::double, 1.0) = 1.0 as strict_pass,
    n_chars % 2048 >= 2000 as hit_limit, (doc_id + v) % 5 = 0 as unclosed, text
  from documents, (values (0, 'base'), (1, 'sft'), (2, 'tuned')) t(v, variant))"""

DIMENSIONS = {"clarity": 0.5, "depth": 0.3, "care": 0.2}


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judges on three pairs of variants for each document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    pairs = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(f"{a}_vs_{b}").alias("pair"), F.lit(a).alias("left"), F.lit(b).alias("right")) for p, (a, b) in enumerate((("sft", "base"), ("tuned", "base"), ("tuned", "sft")))))
    rows = docs.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumn("x", F.explode(pairs)).select("id", "j", "x.*").withColumn("judge", F.concat(F.lit("judge"), F.col("j").cast("string")))
    pick = (F.col("id") * 5 + F.col("p") * 2 + F.col("j") * (F.col("id") % 3)) % 7
    winner = F.when(pick < 3, F.col("left")).when(pick < 6, F.col("right")).otherwise(F.lit("tie"))
    score = lambda k, side: ((F.col("id") + F.col("j") + k * 3 + side * (F.col("p") + 1)) % 11).cast("double")
    dims = F.create_map(*(x for k, name in enumerate(DIMENSIONS) for x in (F.lit(name), F.struct(score(k, 0).alias("A"), score(k, 1).alias("B")))))
    return rows.withColumn("winner_model", winner).withColumn("dimensions", dims).withColumn("model_a", F.col("left")).withColumn("model_b", F.col("right"))


JUDGMENTS = """judgments as (
  select *, case when pick < 3 then "left" when pick < 6 then "right" else 'tie' end as winner_model from (
    select doc_id as id, j, 'judge' || j::varchar as judge, p, "left" || '_vs_' || "right" as pair, "left", "right", (doc_id * 5 + p * 2 + j * (doc_id % 3)) % 7 as pick
    from documents, (values (0), (1)) a(j), (values (0, 'sft', 'base'), (1, 'tuned', 'base'), (2, 'tuned', 'sft')) b(p, "left", "right")))"""


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, prompt and full arrays of ids: full is longer than prompt by doc_id % 7, and not an extension where doc_id % 11 = 0."""
    docs = table(spark, sf_dir, "documents")
    start = F.col("doc_id") * 3 % 17
    prompt = F.transform(F.sequence(F.lit(1), (F.col("n_chars") % 13 + 1).cast("int")), lambda i: ((i * 5 + start) % 23).cast("int"))
    full = F.concat(F.when(F.col("doc_id") % 11 == 0, F.transform(prompt, lambda x: x + 1)).otherwise(prompt), F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 7).cast("int")), lambda i: (i + 100).cast("int")))
    full = F.when(F.col("doc_id") % 7 == 0, F.slice(full, F.lit(1), F.size(prompt))).otherwise(full)
    return docs.select("doc_id", "source", prompt.alias("prompt"), full.alias("full_ids"))


TOKEN_ROWS = """base_tokens as (
    select doc_id, source, list_transform(range(1, n_chars % 13 + 2), lambda i: ((i * 5 + doc_id * 3 % 17) % 23)::integer) as prompt from documents),
  token_rows as (
    select doc_id, source, prompt, case when doc_id % 7 = 0 then (case when doc_id % 11 = 0 then list_transform(prompt, lambda x: x + 1) else prompt end)
      else list_concat(case when doc_id % 11 = 0 then list_transform(prompt, lambda x: x + 1) else prompt end, list_transform(range(0, doc_id % 7 + 1), lambda i: (i + 100)::integer)) end as full_ids from base_tokens)"""


def by_case(spark: SparkSession, sf_dir: str, cases: list[dict]) -> DataFrame:
    """doc_id, k and the columns of case k = doc_id modulo the number of cases."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rows = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), *(_constant(v).alias(n) for n, v in case.items())) for k, case in enumerate(cases)))
    return docs.withColumn("c", F.get(rows, (F.col("doc_id") % len(cases)).cast("int"))).select("doc_id", "c.*")


def _constant(value: object) -> Column:
    return F.lit(None).cast("string") if value is None else F.lit(value)


def sql_constant(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}::bigint"
    if isinstance(value, float):
        return f"{value!r}::double"
    return literal(str(value))


def truth_sql(expected: list[dict]) -> str:
    """SQL for doc_id and the expected columns by case."""
    rows = ", ".join(f"({k}, {', '.join(sql_constant(v) for v in row.values())})" for k, row in enumerate(expected))
    names = ", ".join(expected[0])
    return f"select doc_id, {names} from documents join (values {rows}) t(k, {names}) on doc_id % {len(expected)} = k"
