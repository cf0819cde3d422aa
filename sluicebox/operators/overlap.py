"""Which documents hold which of some given texts, as a whole."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of items that one automaton holds and one broadcast sends, and how many of such blocks there may be.
BLOCK_BYTES, BLOCKS = 16 << 20, 32


def blocks_of(items: DataFrame, key: str, text: str) -> Iterator[dict[str, list[int]]]:
    """Keys by text, in blocks of bounded size; equal texts are in one block."""
    block: dict[str, list[int]] = {}
    size = 0
    rows = items.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("t")).agg(F.sort_array(F.collect_list(F.col(key).cast("long"))).alias("k"))
    for row in rows.toLocalIterator():
        size += len(row["t"].encode())
        block[row["t"]] = row["k"]
        if size >= BLOCK_BYTES:
            yield block
            block, size = {}, 0
    if block:
        yield block


def contained(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """doc_key and item_key of each document that holds an item's whole text; null texts hold nothing and are held by nothing.

    One automaton finds all items in one pass over a document; no pair is formed that isn't an answer, and documents aren't moved. Items come to
    the driver and are sent to all tasks in blocks of BLOCK_BYTES; each block is a pass over the documents. More than BLOCKS are an error.
    """
    spark = docs.sparkSession
    schema = f"`{doc_key}` long, `{item_key}` long"
    rows = docs.select(F.col(doc_key).cast("long").alias("d"), F.col(doc_text).alias("t")).filter("t is not null")
    found = None
    for n, block in enumerate(blocks_of(items, item_key, item_text)):
        if n >= BLOCKS:
            raise ValueError(f"more than {BLOCKS * BLOCK_BYTES} bytes of items")
        part = rows.mapInArrow(_finder(spark.sparkContext.broadcast(block), doc_key, item_key), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def _finder(shared, doc_key: str, item_key: str):  # noqa: ANN001, ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for text, keys in shared.value.items():
            if text:
                automaton.add_word(text, keys)
        automaton.make_automaton()
        everywhere = shared.value.get("", [])
        for batch in batches:
            docs, items = [], []
            for doc, text in zip(batch.column("d").to_pylist(), batch.column("t"), strict=True):
                own = set(everywhere)
                if len(automaton):
                    for _, keys in automaton.iter(text.as_py()):
                        own.update(keys)
                docs += [doc] * len(own)
                items += sorted(own)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], [doc_key, item_key])

    return work
