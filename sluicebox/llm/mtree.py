"""Exact top-k by inner product with paged M-trees and best-first search.

Components become floor(scale * x), so scores are exact integers. Largest inner product becomes nearest neighbour in a metric
space: every object gets one more coordinate that gives all of them the norm M of the longest; a query gets 0 there. Then
d(q, o)^2 = |q|^2 + M^2 - 2 q.o.

The tree's first level is a routing object (centre) with a covering radius for each cell of vectors; a cell's vectors are in pages, and
each page holds an M-tree: nodes of at most NODE entries; an entry has its object, its distance from the node's
routing object, and, in inner nodes, the covering radius of its subtree. A search opens, for each query, the node whose
lower bound max(0, d(q, routing) - radius) is least, until no bound is within the k-th best distance. Before a distance
is computed, the stored parent distance gives |d(q, parent) - d(entry, parent)| - radius as a bound; if that is too far, the
computation is avoided. All queries of a block step through a page side by side.

Queries of like cells form a block. The first k-th best distance comes from the centres (rows of the table); a page whose bound is beyond it
for all queries of a block is not even sent. The others are dealt over GROUPS tasks, each of which gets its pages nearest first and
carries the k best from page to page, so later pages are pruned by what earlier ones gave. A task gives k rows for each query at
most: rows between search and answer grow with the queries, not with queries times pages.

Equal scores go to the smaller vec_id; bounds prune only what is strictly worse. Sums of products are exact below 2^53; if the longest
vector's squared norm reaches that, it is an error. Distances are rounded, so bounds give way by `slack`, which follows the longest norm.
What can't be pruned (vectors in many nearly independent dimensions) is compared: exact search of q queries among n such rows takes q * n
products, whatever the tree.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import Scratch, durable

NODE = 32
#: Routing objects of the first level at most: about the square root of the number of rows below that.
MAX_CENTRES = 1 << 14
#: Queries of a block, and tasks that share a block's pages.
BLOCK, GROUPS = 1024, 16


def to_integers(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Objects with the coordinate that makes their norms equal."""
    return np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None]], 1)


def slack_of(longest: float, length: int) -> float:
    """More than rounding moves a distance: square roots of sums of so many products."""
    return 4 * float(np.sqrt((length + 4) * np.finfo(float).eps * max(longest, 1.0)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between rows of a and rows of b."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


class MTree:
    """A node is (rows of its entries, their parent distances, children or None, their radii); nodes[0] is the root, whose
    routing object is row 0."""

    def __init__(self, ids: np.ndarray, objects: np.ndarray, longest: float) -> None:
        self.ids, self.objects, self.longest = ids, objects, longest
        self.slack = slack_of(longest, objects.shape[1])
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        self._build(np.arange(len(ids)), 0, lifted(objects, longest))

    def _build(self, rows: np.ndarray, routing: int, space: np.ndarray) -> int:
        number = len(self.nodes)
        self.nodes.append(None)  # type: ignore[arg-type]
        from_parent = distances(space[rows], space[routing : routing + 1])[:, 0]
        if len(rows) <= NODE:
            self.nodes[number] = (rows, from_parent, None, None)
            return number
        # Routing objects far from each other; what is left over in equal objects is cut evenly.
        chosen = [int(from_parent.argmax())]
        near = distances(space[rows], space[rows[chosen]])[:, 0]
        owner = np.zeros(len(rows), int)
        while len(chosen) < min(NODE // 2, -(-len(rows) // (NODE // 2))) and near.max() > 0:
            chosen.append(int(near.argmax()))
            new = distances(space[rows], space[rows[chosen[-1:]]])[:, 0]
            owner[new < near] = len(chosen) - 1
            near = np.minimum(near, new)
        if len(chosen) == 1:
            parts = np.array_split(np.arange(len(rows)), min(NODE, -(-len(rows) // NODE)))
        else:
            parts = [np.flatnonzero(owner == k) for k in range(len(chosen))]
        entries, children, radii = [], [], []
        for part in parts:
            if not len(part):
                continue
            own = rows[part]
            head = int(own[distances(space[own], space[own].mean(0, keepdims=True))[:, 0].argmin()])
            entries.append(head)
            radii.append(float(distances(space[own], space[head : head + 1]).max()))
            children.append(self._build(own, head, space))
        entries = np.array(entries)
        self.nodes[number] = (entries, distances(space[entries], space[routing : routing + 1])[:, 0], np.array(children), np.array(radii))
        return number

    def search(self, query_ids: np.ndarray, queries: np.ndarray, best: np.ndarray, best_id: np.ndarray, reach: np.ndarray) -> int:
        """Improves the k best scores and ids of each query, and `reach` (distances beyond which nothing counts); tells how many distances
        were computed."""
        n, count, k = len(queries), len(self.nodes), best.shape[1]
        square = (queries * queries).sum(1) + self.longest
        bound, to_routing = np.full((n, count), np.inf), np.zeros((n, count))
        score = lambda q, rows: queries[q] @ self.objects[rows].T
        far = lambda q, s: np.sqrt(np.maximum(square[q][:, None] - 2 * s, 0))
        to_routing[:, 0] = far(np.arange(n), score(np.arange(n), np.array([0])))[:, 0]
        bound[:, 0] = 0
        computed = n
        active = np.arange(n)
        while len(active):
            node = bound[active].argmin(1)
            go = np.isfinite(bound[active, node]) & (bound[active, node] <= reach[active] + self.slack)
            active, node = active[go], node[go]
            for number in np.unique(node).tolist():
                q = active[node == number]
                bound[q, number] = np.inf
                rows, from_parent, children, radii = self.nodes[number]
                known = np.abs(to_routing[q, number][:, None] - from_parent[None])
                may = known - (0 if radii is None else radii) <= reach[q][:, None] + self.slack
                some = may.any(0)
                if not some.any():
                    continue
                s = score(q, rows[some])
                may = may[:, some]
                computed += int(may.sum())
                d = far(q, s)
                if children is not None:
                    to = children[some]
                    to_routing[q[:, None], to[None]] = d
                    bound[q[:, None], to[None]] = np.where(may, np.maximum(d - radii[some], 0), np.inf)
                    continue
                ids = self.ids[rows[some]]
                may &= (ids[None] != query_ids[q][:, None]) & (d <= reach[q][:, None] + self.slack)
                better = may.any(1)
                if not better.any():
                    continue
                q, s = q[better], np.where(may, s, -np.inf)[better]
                all_s, all_id = np.concatenate([best[q], s], 1), np.concatenate([best_id[q], np.broadcast_to(ids, s.shape)], 1)
                order = np.lexsort((all_id, -all_s), axis=1)[:, :k]
                best[q], best_id[q] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_id, order, 1)
                last = best[q, k - 1]
                full = np.isfinite(last)
                reach[q[full]] = np.minimum(reach[q[full]], np.sqrt(np.maximum(square[q[full]] - 2 * last[full], 0)))
        return computed


def top_k(df: DataFrame, query: str | None, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `query` (SQL on vec_id) holds, the k rows of largest inner product but its own."""
    rows, n, length = vectors.taking_part(df, id_col, vector_col)
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("double"))
    longest = float(rows.select(F.max(F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    if longest >= 2.0**53:
        raise ValueError(f"scores up to {longest} aren't exact in double precision: lower the scale")
    slack = slack_of(longest, length)
    centre_ids, centres = vectors.sample(rows, min(MAX_CENTRES, max(1, round(n**0.5))))
    centres = to_integers(centres, scale)
    # Numbers of cells follow the direction in which centres differ most, so cells with near numbers are not far from each other.
    along = _along(centres)
    centre_ids, centres = centre_ids[along], centres[along]
    high = lifted(centres, longest)

    def place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(lifted(to_integers(x, scale), longest), high)
        return d.argmin(1), d.min(1)

    scratch = Scratch()
    cells = vectors.in_cells(rows, length, place, scratch)
    pages, spread = vectors.page_layout(cells)
    # The first level of the tree, for all tasks: a centre and a radius for each cell.
    page_of = np.array([p for numbers in pages.values() for p in numbers])
    cell_of = np.array([c for c, numbers in pages.items() for _ in numbers])
    radius = np.array([spread[c] for c in cell_of])

    def build(ids: np.ndarray, x: np.ndarray) -> bytes:
        return pickle.dumps(MTree(ids, to_integers(x, scale), longest))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries: a row with the block for each of its groups of pages, and a row for each page, nearest first."""
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, x = part.column("vec_id").to_numpy(), to_integers(vectors.matrix(part.column("vec"), length), scale)
                s = x @ centres.T
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + longest - 2 * s, 0))
                other = np.where(centre_ids[None] == ids[:, None], np.inf, d)
                reach = np.partition(other, k - 1, 1)[:, k - 1] if len(centres) >= k else np.full(len(x), np.inf)
                bound = d[:, cell_of] - radius
                wanted = np.flatnonzero((bound <= reach[:, None] + slack).any(0))
                wanted = wanted[np.argsort(np.maximum(bound[:, wanted], 0).sum(0), kind="stable")]
                asked = pickle.dumps((ids, x, reach))
                groups = min(GROUPS, len(wanted))
                order = np.arange(len(wanted))
                grp = np.concatenate([np.arange(groups), order % GROUPS])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grp), number)), pa.array(grp), pa.array(np.concatenate([np.full(groups, -1), order])), pa.array([None] * groups + page_of[wanted].tolist(), pa.int64()), pa.array([asked] * groups + [None] * len(wanted), pa.binary())],
                    ["block", "grp", "nth", "page", "asked"],
                )
                number += 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with their pages, in order; the k best are carried from page to page."""
        now = state = None

        def done() -> pa.RecordBatch:
            ids, _, best, best_id, _ = state
            found = np.isfinite(best)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, found.sum(1))), pa.array(best_id[found]), pa.array(best[found].astype(np.int64))], ["query_id", "vec_id", "score"])

        for batch in batches:
            for block, grp, content in zip(batch.column("block").to_pylist(), batch.column("grp").to_pylist(), batch.column("content"), strict=True):
                if (block, grp) != now:
                    if state:
                        yield done()
                    ids, x, reach = pickle.loads(content.as_py())
                    now, state = (block, grp), (ids, x, np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max), reach)
                    continue
                ids, x, best, best_id, reach = state
                pickle.loads(content.as_py()).search(ids, x, best, best_id, reach)
        if state:
            yield done()

    asked = cells.select("vec_id", "vec", "cell").filter(F.expr(query) if query else F.lit(True))
    # Queries of near cells come together.
    dealt = asked.repartitionByRange(max(1, -(-asked.count() // BLOCK)), "cell", F.xxhash64("vec_id"))
    # Written once: the blocks of a task and their pages must come from one run of it.
    tasks = scratch(dealt.mapInArrow(plan, "block long, grp long, nth long, page long, asked binary"))
    contents = vectors.packed_pages(cells, length, pages, build)
    heads = tasks.filter("page is null").select("block", "grp", "nth", F.col("asked").alias("content"))
    rest = tasks.filter("page is not null").select("block", "grp", "nth", "page").join(contents, "page").select("block", "grp", "nth", "content")
    together = heads.unionByName(rest).repartition("block", "grp").sortWithinPartitions("block", "grp", "nth")
    # The answers are few; with them written, all else can go.
    out = durable(vectors.best(together.mapInArrow(search, "query_id long, vec_id long, score long"), k))
    scratch.clear()
    return out


def _along(centres: np.ndarray) -> np.ndarray:
    """Centres in order along the direction from their mean to the one farthest from it."""
    middle = centres - centres.mean(0)
    return np.argsort(middle @ middle[int((middle * middle).sum(1).argmax())], kind="stable")
