"""What the operators of this folder share: reading, durable tables, text batches, digests."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a step holds in work arrays at once; steps with wide arrays for each byte take fewer.
SLICE_BYTES, NARROW_SLICE = 3 << 20, 1 << 20


#: Rows and bytes of an Arrow batch: whole texts vary in length, and two Python workers share an executor with the JVM.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits to what whole texts need; lower ones stay.

    The limits count when a query runs, after this library has returned it, so they stay lowered in the session: it bounds memory,
    no results.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column, modulus: int) -> Column:
    """crc32 of a number as text, modulo; null stays null."""
    return F.crc32(col.cast("string")) % F.lit(modulus)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set, on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sluicebox-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/sluicebox-{spark.sparkContext.applicationId}"


def durable(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them again: lineage ends, and a lost executor costs nothing.

    The tables live in one folder per application; `release` removes it.
    """
    return kept_table(df)[0]


def kept_table(df: DataFrame) -> tuple[DataFrame, str]:
    """As `durable`, with the table's path, for who can tell when it is of no more use."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables of one computation: all but those that its result reads are removed when it ends."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        """As `durable`, until `clear`."""
        table, path = kept_table(df)
        self.paths.append((df.sparkSession, path))
        return table

    def clear(self) -> None:
        for spark, path in self.paths:
            remove(spark, path)
        self.paths = []


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Removes every table that `durable` wrote in this application."""
    remove(spark, shared_dir(spark))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts a batch by bytes of text, so that work arrays stay bounded; a row is never cut. Null texts come as ''."""
    texts = batch.column(column).to_pylist()
    begin = size = 0
    for i, text in enumerate(texts):
        if text is None:
            texts[i] = text = ""
        if size and size + len(text) > limit:
            yield batch.slice(begin, i - begin), texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield batch.slice(begin), texts[begin:]
    # Workers outlive their tasks; what Arrow has freed goes back to the system.
    pa.default_memory_pool().release_unused()


#: Characters of a text that is worked on as a whole; longer ones go in blocks.
LONG = 4 << 20
_PLACE = re.compile(r"(?<=[!-~]) ")


def at_blanks(text: str, size: int | None = None) -> list[str]:
    """A long text in blocks of about `size` characters (LONG, if not given), each but the first beginning with a blank after a printable
    ASCII sign. No match of a byte-level vocabulary's pattern spans such a place, nor looks across it: the blocks' tokens are the text's.
    Where there is none, a block is longer.
    """
    size = size or LONG
    cuts = [0]
    while cuts[-1] + size < len(text) and (m := _PLACE.search(text, cuts[-1] + size)):
        cuts.append(m.start())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def map_texts(df: DataFrame, text_col: str, keep: list[str], schema: str, function: Callable[[], Callable[[list[str], pa.RecordBatch], dict]], limit: int = SLICE_BYTES) -> DataFrame:
    """Columns `keep` of df beside what the function returns for each text.

    function() is called once per task and returns the worker: (texts, their rows) -> {column: values}.
    A kept column with the name of a result gives way to it.
    """
    small_batches(df.sparkSession)
    names = [x.split()[0] for x in schema.split(",")]
    keep = [c for c in keep if c not in names]
    kept = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").alias("__text"))
    out = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes if c != "__text")
    out = f"{out}, {schema}" if out else schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = function()
        for batch in batches:
            for rows, texts in text_slices(batch, "__text", limit):
                got = worker(texts, rows)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *(_array(got[n]) for n in names)], [*keep, *names])

    return kept.mapInArrow(work, out)


def _array(values: object) -> pa.Array:
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)


def sums_by_chunk(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, chunk: int = 4096, cap: int | None = None) -> np.ndarray:
    """Adds up a fixed-size array of counters over all tasks, chunk by chunk: what reaches the driver has a fixed size.

    count() makes one task's array of `size` counters from its batches. With cap, sums stop there.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = count(batches)
        for k in range(0, size, chunk):
            part = counters[k : k + chunk].astype("<i8")
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // chunk]), pa.array([part.astype("<u4").tobytes()], pa.binary())], ["chunk", "part"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(chunk, "<i8")
        for part in rows.column("part").to_pylist():
            add_to = np.frombuffer(part, "<u4")
            total[: len(add_to)] += add_to
        if cap is not None:
            total = np.minimum(total, cap)
        return pa.table({"chunk": [key[0].as_py()], "total": pa.array([total.tobytes()], pa.binary())})

    rows = df.mapInArrow(partial, "chunk long, part binary").groupBy("chunk").applyInArrow(add, "chunk long, total binary").collect()
    out = np.zeros(-(-size // chunk) * chunk, "<i8")
    for chunk_id, total in rows:
        out[chunk_id * chunk : (chunk_id + 1) * chunk] = np.frombuffer(bytes(total), "<i8")
    return out[:size]
