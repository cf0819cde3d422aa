"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors are assigned to the nearest of some centres (k-means over a bounded sample) and kept in lists, rotated by one random
orthogonal matrix, in column blocks of BLOCK dimensions with the squared norms of their prefixes. A query looks into the
lists whose centres are nearest; within a list, block after block is added to the partial distances, and after each a hypothesis test
abandons the candidates whose distance, estimated from the t of D dimensions seen, is surely beyond the k-th best known:
(D / t) d_t^2 > (1 + EPS / sqrt(t))^2 d_k^2. For what survives all blocks the score is computed on the original vectors in
double precision.

The exact k best of up to KNOWN sampled rows are candidates of every query, and the k-th of them is the first bound, so a bound
never stands for rows that are not answers. Queries look into the nearest lists first; the k-th best score found so far is what the
others must reach. If the sample can't fill the answers, queries short of k rows look into all lists: an answer has
fewer than k rows only if there are fewer candidates.

How many lists to look into is learned: on the sample, so many that the true neighbours of sampled queries are found with the
recall asked for. The sample (by a hash of the id, `sample_rows` rows at most below MAX_LISTS lists' need of LIST_ROWS each) fits centres and
that number; all rows are indexed. There are about a third of the square root of the number of rows as lists, up to MAX_LISTS.

Zero vectors take no part. Equal scores go to the smaller vec_id. What else takes part, repeated ids, empty tables: see `vectors`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import Scratch, durable

BLOCK = 16
EPS = 2.1
SAMPLE_ROWS = 8192
#: Lists at most, and sampled rows that each list needs: a sample of 65,536 rows at most.
MAX_LISTS, LIST_ROWS = 4096, 16
KNOWN = 2048


def rotation(length: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(length, length)))
    return q * np.sign(np.diag(r))


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(1)[None]
    return np.concatenate([(half - x[k : k + 4096] @ centres.T).argmin(1) for k in range(0, len(x), 4096)])


def k_means(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    centres = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(rounds):
        owner = nearest_centre(x, centres)
        size = np.bincount(owner, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, owner, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def probes_needed(x: np.ndarray, centres: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """How many nearest lists hold `recall` of the k true neighbours of sampled queries among the sample."""
    owner = nearest_centre(x, centres)
    asked = x[:queries]
    s = asked @ x.T
    np.fill_diagonal(s, -np.inf)
    true = np.argsort(-s, 1)[:, : min(k, len(x) - 1)]
    rank = np.argsort(np.argsort(-(asked @ centres.T), 1), 1)
    at = np.sort(np.take_along_axis(rank, owner[true], 1).reshape(-1))
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1 if len(at) else len(centres)


def scan(query_ids: np.ndarray, q: np.ndarray, q_turned: np.ndarray, ids: np.ndarray, o: np.ndarray, o_turned: np.ndarray, prefix: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, id, exact score) of up to k best per query among the list's vectors, and how many dimensions were read.

    reach: the k-th best inner product known; prefix: squared norms of the vectors' first 1, 2, ... blocks.
    """
    length = q.shape[1]
    steps = range(0, length, BLOCK)
    q_prefix = np.stack([(q_turned[:, : b + BLOCK] ** 2).sum(1) for b in steps], 1)
    limit = (q_prefix[:, -1:] + prefix[None, :, -1] - 2 * reach[:, None]).astype(np.float32)
    # More than single precision loses in any of these sums, whatever the vectors' lengths.
    tolerance = (length + 8) * np.finfo(np.float32).eps * (q_prefix[:, -1:] + prefix[None, :, -1])
    partial = np.zeros((len(q), len(ids)), np.float32)
    own, these = np.arange(len(q)), np.arange(len(ids))  # queries and candidates still in the matrix
    alive = np.ones(partial.shape, bool)
    rows, columns, read = None, None, 0
    for step, begin in enumerate(steps):
        end = min(begin + BLOCK, length)
        slack = (1 + EPS / np.sqrt(end)) ** 2 * end / length if end < length else 1 + 1e-5
        if rows is None:
            partial += q_turned[own, begin:end] @ o_turned[these, begin:end].T
            read += partial.size * (end - begin)
            alive &= q_prefix[own, step, None] + prefix[None, these, step] - 2 * partial <= slack * limit + tolerance
            if alive.mean() < 0.3 or end == length:
                rows, columns = np.nonzero(alive)
                partial, limit, tolerance = partial[rows, columns], limit[rows, columns], tolerance[rows, columns]
                rows, columns = own[rows], these[columns]
                continue
            # Candidates that every query has abandoned, and queries without candidates, leave the matrix.
            some, there = alive.any(1), alive.any(0)
            if min(some.mean(), there.mean()) < 0.9:
                left = np.ix_(some, there)
                partial, limit, tolerance, alive, own, these = partial[left], limit[left], tolerance[left], alive[left], own[some], these[there]
        else:
            partial = partial + np.einsum("ij,ij->i", q_turned[rows, begin:end], o_turned[columns, begin:end])
            read += len(rows) * (end - begin)
            still = q_prefix[rows, step] + prefix[columns, step] - 2 * partial <= slack * limit + tolerance
            rows, columns, partial, limit, tolerance = rows[still], columns[still], partial[still], limit[still], tolerance[still]
    return *k_best(query_ids, q, ids, o, rows, columns, k), read


def k_best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, o: np.ndarray, rows: np.ndarray, columns: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, exact score) of up to k best per query among pairs of a row of q and a row of o."""
    other = query_ids[rows] != ids[columns]
    rows, columns = rows[other], columns[other]
    score = np.einsum("ij,ij->i", q[rows], o[columns])
    order = np.lexsort((ids[columns], -score, rows))
    rows, columns, score = rows[order], columns[order], score[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    best = nth < k
    return query_ids[rows[best]], ids[columns[best]], score[best]


def nearest(df: DataFrame, query: str | None, k: int = 20, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `query` (SQL on vec_id) holds, the k nearest found but itself."""
    rows, n, length = vectors.taking_part(df, id_col, vector_col, non_zero=True)
    if not n:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = max(1, min(MAX_LISTS, round(n**0.5 / 3)))
    known_ids, known = vectors.sample(rows, max(sample_rows, LIST_ROWS * lists) if sample_rows >= SAMPLE_ROWS else sample_rows)
    centres = k_means(known, max(1, min(lists, len(known) // LIST_ROWS)))
    probes = probes_needed(known, centres, k, recall)
    known_ids, known = known_ids[:KNOWN], known[:KNOWN]
    turn = rotation(length)

    def place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest_centre(x, centres)
        return cell, np.zeros(len(x))  # lists have no radius

    scratch = Scratch()
    cells = vectors.in_cells(rows, length, place, scratch)
    pages, _ = vectors.page_layout(cells)

    def build(ids: np.ndarray, x: np.ndarray) -> bytes:
        turned = (x @ turn).astype(np.float32)
        prefix = np.stack([(turned[:, : b + BLOCK] ** 2).sum(1) for b in range(0, length, BLOCK)], 1)
        single = x.astype(np.float32)
        return pickle.dumps((ids, single if (single == x).all() else x, turned, prefix))

    def against_known(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores with the known rows, and the k-th best of each query."""
        s = np.where(known_ids[None] == ids[:, None], -np.inf, x @ known.T)
        return s, np.partition(s, -k, 1)[:, -k] if s.shape[1] >= k else np.full(len(s), -np.inf)

    def from_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The exact k best of the known rows."""
        for batch in batches:
            for at in range(0, batch.num_rows, 32):  # so few that all may tie with all known rows
                part = batch.slice(at, 32)
                ids, x = part.column("vec_id").to_numpy(), vectors.matrix(part.column("vec"), length)
                s, least = against_known(ids, x)
                least -= 1e-12 * ((x * x).sum(1) + (known * known).sum(1).max())  # equal vectors may differ in the last bits
                found = k_best(ids, x, known_ids, known, *np.nonzero(s >= least[:, None]), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    def send(low: int, high: int):  # noqa: ANN202
        """Sends queries to the lists from the low-th nearest to the high-th."""

        def to_pages(ids: np.ndarray, x: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, bytes]]:
            reach = np.maximum(np.maximum(reach, against_known(ids, x)[1]) - 1e-9, -1e30)
            rank = np.argsort(np.argsort(-(x @ centres.T), 1, kind="stable"), 1)
            for cell, numbers in pages.items():
                near = np.flatnonzero((rank[:, cell] >= low) & (rank[:, cell] < high))
                if len(near):
                    content = pickle.dumps((ids[near], x[near], reach[near]))
                    for number in numbers:
                        yield number, content

        return to_pages

    def search(asked: bytes, content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query_ids, q, reach = pickle.loads(asked)
        ids, o, turned, prefix = pickle.loads(content)
        return scan(query_ids, q, (q @ turn).astype(np.float32), ids, o.astype(float), turned, prefix, reach, k)[:3]

    asked = scratch(cells.select("vec_id", "vec").filter(F.expr(query) if query else F.lit(True)))
    lists = scratch(vectors.packed_pages(cells, length, pages, build))
    # The nearest lists first: their k-th best score bounds what the others need to give.
    first = max(1, probes // 8)
    near = vectors.query_tasks(asked.withColumn("reach", F.lit(float("-inf"))), length, send(0, first))
    sampled = asked.mapInArrow(from_known, "query_id long, vec_id long, score double")
    found = scratch(vectors.best(vectors.answers(near, lists, search, k, "double").drop("rank").unionByName(sampled), k))
    reach = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("reach"))
    rest = vectors.query_tasks(asked.join(reach, "vec_id", "left").select("vec_id", "vec", F.coalesce("reach", F.lit(float("-inf"))).alias("reach")), length, send(first, probes))
    more = vectors.answers(rest, lists, search, k, "double")
    out = vectors.best(found.unionByName(more).drop("rank"), k)
    if len(known) <= k and n > len(known):
        # The sample may not fill the answers: queries that are short of k rows look into all lists.
        out = scratch(out)
        short = asked.join(out.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
        last = vectors.query_tasks(short.withColumn("reach", F.lit(float("-inf"))), length, send(probes, len(centres)))
        out = vectors.best(out.unionByName(vectors.answers(last, lists, search, k, "double")).drop("rank"), k)
    # The answers are few; with them written, all else can go.
    out = durable(out)
    scratch.clear()
    return out
