"""What both searches share: which vectors take part, cells around sampled vectors, pages of bounded size, blocks of queries.

Vectors live in cells (nearest of sampled centres) and a cell is dealt over as many pages as its row count asks for, so a
page is bounded even if a third of all vectors are alike. Pages give their best rows per query, and the best of those are the answer.

A vector takes part if it has no null or non-finite component and the table's most common length (the longer of
equally common ones). Rows that repeat a vec_id count as one row: of different vectors under one vec_id the least counts (by its
components, in order). An empty table, or one in which no vector takes part, gives no rows. Only the two columns named are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

MAX_CELLS = 512
PAGE_ROWS = 512
BLOCK_QUERIES = 512


def taking_part(df: DataFrame, id_col: str, vector_col: str, non_zero: bool = False) -> tuple[DataFrame, int, int]:
    """(vec_id, vec) rows that take part, how many, their length."""
    vec = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    fine = vec.isNotNull() & F.col("vec_id").isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if non_zero:
        fine &= F.exists(vec, lambda x: x != 0)
    rows = rows.filter(fine)
    lengths = rows.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    if not lengths:
        return rows, 0, 0
    length = lengths[0]["length"]
    rows = rows.filter(F.size("vec") == length)
    n = rows.select("vec_id").distinct().count()
    if n < lengths[0]["count"]:  # only then are vectors moved
        rows = rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return rows, n, length


def sample(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of at most `most` rows, chosen by a hash of the id."""
    got = rows.orderBy(F.xxhash64("vec_id", F.lit(31)), "vec_id").limit(most).toPandas().drop_duplicates("vec_id")
    return got["vec_id"].to_numpy(np.int64), np.array(got["vec"].tolist(), float).reshape(len(got), -1)


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def in_cells(rows: DataFrame, length: int, place: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], scratch: Scratch) -> DataFrame:
    """vec_id, vec, cell and spread, written; place: vectors -> (cell, distance from its centre)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, spread = place(matrix(batch.column("vec"), length))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(spread, pa.float64())], ["vec_id", "vec", "cell", "spread"])

    return scratch(rows.mapInArrow(work, "vec_id long, vec array<double>, cell long, spread double"))


def page_layout(cells: DataFrame, page_rows: int = PAGE_ROWS) -> tuple[dict[int, range], dict[int, float]]:
    """(pages of each cell, largest distance from each cell's centre): as many rows as there are centres."""
    pages, spread, at = {}, {}, 0
    for cell, n, far in cells.groupBy("cell").agg(F.count(F.lit(1)), F.max("spread")).orderBy("cell").collect():
        pages[cell] = range(at, at := at + -(-n // page_rows))
        spread[cell] = far
    return pages, spread


def packed_pages(cells: DataFrame, length: int, pages: dict[int, range], build: Callable[[np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """page and the bytes that build(ids, vectors) makes of its rows."""
    # A row for each cell: as many as there are centres.
    layout = F.broadcast(cells.sparkSession.createDataFrame([(c, p.start, len(p)) for c, p in pages.items()], "cell long, first long, held long"))
    page = (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(37)), F.col("held"))).cast("long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches(kept).combine_chunks()
            ids, first = np.unique(rows.column("vec_id").to_numpy(), return_index=True)
            vectors = matrix(rows.column("vec").chunk(0), length)[first]
            return pa.RecordBatch.from_arrays([rows.column("page").chunk(0)[:1], pa.array([build(ids, vectors)], pa.binary())], ["page", "content"])

        for batch in batches:
            numbers = batch.column("page").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if kept and kept[-1].column("page")[0].as_py() != numbers[a]:
                    yield done()
                    kept = []
                kept.append(batch.slice(a, b - a))
        if kept:
            yield done()

    dealt = cells.join(layout, "cell").select(page.alias("page"), "vec_id", "vec").repartition("page").sortWithinPartitions("page", "vec_id")
    return dealt.mapInArrow(work, "page long, content binary")


def query_tasks(queries: DataFrame, length: int, send: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, bytes]]], block: int = BLOCK_QUERIES) -> DataFrame:
    """page and the bytes of queries for it: send(ids, vectors, reach) yields them for a block of queries.

    queries: vec_id, vec, reach (the k-th best score known so far).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, block):
                part = batch.slice(k, block)
                for page, content in send(part.column("vec_id").to_numpy(), matrix(part.column("vec"), length), part.column("reach").to_numpy()):
                    yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([content], pa.binary())], ["page", "asked"])

    # Full blocks: queries are gathered, a few thousand to a task.
    n = queries.count()
    dealt = queries.repartition(max(1, -(-n // (4 * block))), "vec_id")
    return dealt.mapInArrow(work, "page long, asked binary")


def answers(tasks: DataFrame, pages: DataFrame, search: Callable[[bytes, bytes], tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, kind: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best over all pages; search(asked, content) -> (query ids, ids, scores)."""
    number = pa.int64() if kind == "long" else pa.float64()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, content in zip(batch.column("asked"), batch.column("content"), strict=True):
                query, found, score = search(asked.as_py(), content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(found, pa.int64()), pa.array(score, number)], ["query_id", "vec_id", "score"])

    return best(tasks.join(pages, "page").mapInArrow(work, f"query_id long, vec_id long, score {kind}"), k)


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of query_id, vec_id, score; each vec_id once."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
