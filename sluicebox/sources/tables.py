"""Readers of raw problems, JSON lines, seeds, ids and generations, and writers with stated guarantees."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_html

#: Names of the splits, and the keys that a task of the coding benchmarks must have.
SPLIT_NAMES = {"train": "train", "test": "test", "valid": "test", "validation": "test", "eval": "test", "dev": "test"}
TASK_KEYS = ("task_id", "prompt", "contract", "canonical_solution", "base_input", "plus_input", "atol")
#: The language number of Python 3, the difficulties taken, the shortest description.
PYTHON3, DIFFICULTIES, SHORTEST = 3, (2, 3), 80


def split_name(name: str) -> str:
    try:
        return SPLIT_NAMES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown split: {name}") from None


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path, or a pattern, has files: asked of Spark's own file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def parquet_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """A split's files; both splits must be there, and nothing is fetched from elsewhere."""
    name = split_name(split)
    missing = [s for s in ("train", "test") if not exists(spark, f"{root}/{s}-*.parquet")]
    if missing:
        raise FileNotFoundError(f"no files of {', '.join(missing)} under {root}")
    return spark.read.parquet(f"{root}/{name}-*.parquet")


def with_provenance(rows: DataFrame, file: Column | None = None) -> DataFrame:
    """Adds file, row_in_file and global_index (files by name, rows by place); only one row per file is sorted as a whole.

    file: what a file read is a part of, where a writer has made several of one; rows are then numbered through the parts, by their names.
    """
    part = F.col("_metadata.file_path")
    rows = rows.select("*", (part if file is None else file).alias("file"), part.alias("__part"), F.col("_metadata.row_index").alias("__row"))
    counts = rows.groupBy("file", "__part").agg(F.count(F.lit(1)).alias("n"))
    ahead = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("__part", ahead(Window.partitionBy("file").orderBy("__part")).alias("__in_file"), ahead(Window.orderBy("file", "__part")).alias("__before"))
    # One row for each file read.
    placed = rows.join(F.broadcast(before), "__part").withColumns({"row_in_file": F.col("__in_file") + F.col("__row"), "global_index": F.col("__before") + F.col("__row")})
    return placed.drop("__part", "__row", "__in_file", "__before")


def code_contests(rows: DataFrame, most: int | None = None) -> DataFrame:
    """description, difficulty, first Python solution, tests; easy kinds with a long enough description."""
    cleaned = strip_html(F.col("description"))
    pairs = F.arrays_zip(F.col("solutions.language").alias("l"), F.col("solutions.solution").alias("s"))
    python = F.try_element_at(F.filter(pairs, lambda p: p["l"] == PYTHON3), F.lit(1))["s"]
    out = rows.filter(F.col("difficulty").isin(*DIFFICULTIES)).select(cleaned.alias("description"), "difficulty", python.alias("solution"), "public_tests").filter(F.length("description") >= SHORTEST)
    return out.orderBy(F.md5("description")).limit(most) if most else out


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Objects of JSON lines; blank lines are skipped. Strict: a bad line fails the read; else it is dropped."""
    if not exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def keyed_lines(spark: SparkSession, path: str, schema: str, key: str = "problem_id", repeated: str = "last") -> DataFrame:
    """Objects of JSON lines by their key; a file that isn't there has none. A bad line, or one without a key, fails the read.

    repeated: of lines with one key the last counts (by file name, then place), or, with "error", there must be none.
    """
    if repeated not in ("last", "error"):
        raise ValueError(f"repeated is last or error, not {repeated}")
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    # A task reads a block of a file from its beginning to its end.
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("__place")
    rows = lines.select(place, F.from_json("value", schema, {"mode": "FAILFAST"}).alias("__row"))
    no_key = F.coalesce(F.col(f"__row.{key}").cast("string"), F.lit("")) == ""
    rows = rows.withColumn("__key", F.when(no_key, F.raise_error(F.concat(F.lit(f"a line without {key}: "), F.to_json("__row"))).cast("string")).otherwise(F.col(f"__row.{key}").cast("string")))
    if repeated == "error":
        return unique(rows.select("__row.*"), key)
    return rows.groupBy("__key").agg(F.max_by("__row", "__place").alias("__row")).select("__row.*")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows; an error if a key occurs twice."""
    twice = rows.groupBy(key).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate {key}: {[r[0] for r in twice]}")
    return rows


def canonical(rows: DataFrame) -> DataFrame:
    """Rows keyed by id (or problem_id), each once."""
    own = [F.col(c) for c in ("id", "problem_id") if c in rows.columns]
    return unique(rows.withColumn("id", F.coalesce(*own)), "id")


def point_lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The first row with this key; the filter reaches the files' statistics."""
    return rows.filter(F.col(key) == value).limit(1)


def seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seed examples of all files, with their category: the item's own, else the file's name; in lower case."""
    rows = spark.read.option("multiLine", True).json(f"{folder}/*.json").withColumn("__file", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1))
    own = F.col("category") if "category" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("category", F.lower(F.coalesce(F.nullif(own, F.lit("")), F.col("__file")))).drop("__file")


def id_list(text: Column) -> Column:
    """Ids, in order, from a JSON object with `ids` or a bare JSON list."""
    return F.coalesce(F.from_json(text, "ids array<string>")["ids"], F.from_json(text, "array<string>"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """ord and id of an id file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(id_list(F.col("value"))).alias("ord", "id"))


def generations(rows: DataFrame, variant: str) -> DataFrame:
    """Generations of one variant: non-empty, each problem once; an error names what breaks this."""
    bad = rows.agg(F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"), F.count_if(~F.col("variant").eqNullSafe(variant)).alias("other")).first()
    if bad["empty"] or bad["other"]:
        raise ValueError(f"{bad['empty']} empty texts, {bad['other']} rows of other variants")
    return unique(rows, "problem_id")


def imported_generations(rows: DataFrame, variant: str) -> tuple[DataFrame, DataFrame]:
    """(problem_id and text of another system's answers, the names of the protocols they followed, each once).

    The id may be called id, the text answer, a missing variant is the one expected; an error names what is missing, empty, of another
    variant or twice there.
    """
    said = lambda *names: F.trim(F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in names if c in rows.columns), F.lit("")))
    rows = rows.select(said("problem_id", "id").alias("problem_id"), said("text", "answer").alias("text"), F.coalesce(F.nullif(said("variant"), F.lit("")), F.lit(variant)).alias("variant"), said("protocol_name").alias("protocol"))
    bad = rows.agg(F.count_if(F.col("problem_id") == "").alias("no_id"), F.count_if(F.col("text") == "").alias("empty"), F.count_if(F.col("variant") != variant).alias("other")).first()
    if any(bad):
        raise ValueError(f"{bad['no_id']} rows without an id, {bad['empty']} empty texts, {bad['other']} rows of other variants")
    return unique(rows, "problem_id").select("problem_id", "text"), rows.filter("protocol <> ''").select("protocol").distinct()


def inspect_tasks(rows: DataFrame, keys: tuple[str, ...] = TASK_KEYS, key: str = "task_id", first: int = 5) -> dict:
    """Row count, unique ids, and the first rows (by id) that lack a required key."""
    have = [c for c in keys if c in rows.columns]
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in have), *(F.lit(c) for c in keys if c not in have)))
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("unique_ids")).first()
    bad = rows.select(F.col(key).alias("id"), lacking.alias("lacking")).filter(F.size("lacking") > 0).orderBy("id").limit(first).collect()
    return {"rows": counts["rows"], "unique_ids": counts["unique_ids"], "offenders": [(r["id"], r["lacking"]) for r in bad]}


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, else a temporary one, on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sluicebox-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/sluicebox-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: worked out once, and whole if an executor is lost. `release` removes them."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


#: Rows and bytes of an Arrow batch of whole texts.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of an Arrow batch to what whole texts need; lower ones stay. It bounds memory, no results."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def release(spark: SparkSession) -> None:
    """Removes all tables that this application has written to the shared folder, once nothing reads them any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark)).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# Writers.


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_exactly_once(rows: DataFrame, path: str) -> None:
    """Creates a frozen table, or checks that the one there has the same rows."""
    spark = rows.sparkSession
    if not exists(spark, path):
        rows.write.parquet(path)
        return
    there = spark.read.parquet(path)
    if there.columns != rows.columns or not there.exceptAll(rows).isEmpty() or not rows.exceptAll(there).isEmpty():
        raise ValueError(f"frozen table differs: {path}")


def write_bank(rows: DataFrame, path: str, codec: str = "gzip") -> None:
    """A bank of source records as compressed JSON lines. Text can't be written with zstd here; a bank for this engine alone is better a parquet table."""
    rows.write.option("compression", codec).json(path)


def read_bank(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a bank of JSON lines, plain or compressed as the files' names say; a bad line fails the read."""
    return json_lines(spark, path, schema)


def write_json(value: object, path: str, tries: int = 5, pause: float = 0.05) -> None:
    """A small JSON file on the driver, replaced as a whole; where another process holds the file, tried again after longer and longer pauses."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        json.dump(value, file, ensure_ascii=False, indent=2)
        file.write("\n")
        file.flush()
        os.fsync(file.fileno())
    for n in range(tries):
        try:
            os.replace(name, target)
            return
        except PermissionError:
            if n == tries - 1:
                os.unlink(name)
                raise
            time.sleep(pause * 2**n)


#: Ids that one JSON text holds at most.
ID_FILE_ROWS = 1_000_000


def id_file(ids: DataFrame, seed: int, parent: str) -> DataFrame:
    """One row per split: the JSON text of its id file, ids in order. Columns split, ord, id.

    One text for a split of any size would be one cell of any size: beyond ID_FILE_ROWS it is an error, and `id_lines` is the form to write.
    """
    large = ids.groupBy("split").count().filter(F.col("count") > ID_FILE_ROWS).limit(1).collect()
    if large:
        raise ValueError(f"split {large[0]['split']} has {large[0]['count']} ids: write id_lines")
    rows = ids.groupBy("split").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("id").cast("string").alias("id")))), lambda x: x["id"]).alias("ids"))
    return rows.select("split", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(seed).alias("seed"), F.lit(parent).alias("parent"), F.size("ids").alias("count"), "ids")).alias("value"))


def id_lines(ids: DataFrame, seed: int, parent: str) -> DataFrame:
    """Lines of id files of any size (split, ord, value): a head at ord -1 with the count, then a line for each id. Columns split, ord, id."""
    heads = ids.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    head = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(seed).alias("seed"), F.lit(parent).alias("parent"), F.col("n").alias("count")))
    line = F.to_json(F.struct(F.col("ord").cast("long").alias("ord"), F.col("id").cast("string").alias("id")))
    return heads.select("split", F.lit(-1).cast("long").alias("ord"), head.alias("value")).unionByName(ids.select("split", F.col("ord").cast("long").alias("ord"), line.alias("value")))


def read_id_lines(spark: SparkSession, path: str) -> DataFrame:
    """ord and id of files of `id_lines`; an error if a head's count isn't that of its ids."""
    rows = json_lines(spark, path, "count long, ord long, id string")
    counts = rows.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("said"), F.count("id").alias("there")).first()
    if counts["said"] != counts["there"]:
        raise ValueError(f"{counts['there']} ids where {counts['said']} are named")
    return rows.filter("id is not null").select("ord", "id")


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """sha256 over the digests of files, in the order given."""
    digests = []
    for path in paths:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()
        if found is None:
            raise FileNotFoundError(path)
        digests.append(found[0])
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A report of an aggregated table; an error if it has more rows than a report should."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(cell(x) for x in line)} |" for line in (rows.columns, *got)]
    return "\n".join([f"# {title}", "", lines[0], "|" + "-|" * len(rows.columns), *lines[1:], ""])
