"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. What a stage learns, it learns from its own input. Rules:

* quality: documents that the classifier predicts as 0 go.
* language: documents without a letter, or whose language no tree explains better than the others together, go;
  a missing language is filled in.
* duplicates: of each component of linked documents the one with the smallest doc_id stays, and among those the one with the
  smallest hash of its text; so an id that repeats with another text stays with both. Documents without an id stay.
* private data: every span is replaced by its kind; n_chars follows. A null text stays null.
* packing: one row per piece, see sluicebox.llm.packing.

An empty table passes through as an empty table; extra columns pass through until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.llm import gam, jaccard, packing, pii, ppm
from sluicebox.llm.common import crc_mod, kept_table, remove, table

ORACLE_SQL = None  # learned models, tokenization and packing can't be said in SQL


def _rows(docs: DataFrame) -> DataFrame:
    """A row's columns in one, so that no name can clash, beside its text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("text").alias("__body"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model = gam.fit(docs, labels.filter(crc_mod(F.col("doc_id"), 5) != 0))
    return gam.score(_rows(docs), model, "__body").filter("predicted = 1").select("__row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    model = ppm.fit(docs, use=crc_mod(F.col("doc_id"), 4) != 2)
    found = ppm.identify(_rows(docs), model, "__body").filter((F.col("lang_pred") != ppm.UNDETERMINED) & (F.col("score") >= 0.5))
    return found.select(*(F.coalesce(F.col("__row.lang"), F.col("lang_pred")).alias("lang") if c == "lang" else F.col(f"__row.`{c}`") for c in docs.columns))


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]  # maps can't be hashed
    marks = {"__copy": F.xxhash64("text"), "__whole": F.xxhash64(*hashed)}
    chosen = jaccard.JaccardJoin().survivors(docs, marks).withColumnRenamed("doc_id", "__id")
    key = ["__id", *marks]
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    rows = docs.filter("doc_id is not null").select(whole, F.col("doc_id").cast("long").alias("__id"), *(c.alias(n) for n, c in marks.items()))
    return rows.join(chosen, key, "left_semi").dropDuplicates(key).select("__row.*").unionByName(docs.filter("doc_id is null")).select(docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    masked = pii.mask_private(_rows(docs), "__body", "__masked")
    new = {"text": F.col("__masked"), "n_chars": F.length("__masked").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return masked.select(*(new[c].alias(c) if c in new else F.col(f"__row.`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("duplicates", duplicates), ("private data", private_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = kept_table(stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)  # nothing reads it any more
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
