"""Best-fit packing of documents into sequences by a configuration linear program.

1. Every document becomes ids and an end id; longer ones are cut into pieces of `capacity`, the first of which takes
   what is over.
2. The program has a variable per configuration (a multiset of lengths that fits into a sequence) and a row per length
   of the histogram: cover every length's count with the fewest configurations. `solve` runs multiplicative weights on the dual
   prices: each round prices the best configuration by knapsack dynamic programming over the capacity, adds some of it, and
   lowers the prices of its lengths by a factor for what they are covered now, until each length is covered exactly.
   Prices start at a length's share of a sequence (a dual solution), somewhat more for long ones, which fit badly.
3. `plan` rounds each amount down, then the fractions, the largest first, up as long as pieces are left, and solves the program anew
   for what is left, until rounding takes next to nothing. The rest, a few pieces, is placed best-fit. How many sequences come from
   where is in the plan: on documents and on lognormal lengths 90 % and more come from the rounded program, and
   their number is at most 0.1 % above the bound of all ids by the capacity (tests).
4. Pieces are sorted by length over ranges, written once, and numbered within their length from the ranges' counts. A piece's number tells its
   sequence and offset: a lookup in a plan of bounded size. So no text is moved, and no length is in one task alone.

Only the counts by range and length (as many as tasks and lengths together) reach the driver. Ids are those of the tokenizers library, by rule:
`tokenizer_files.vocabulary` only takes a byte-level .json file whose ids follow its merges, which the merging library reads as ranks.

Null texts count as empty: one piece, the end id. Repeated rows are packed each; a null doc_id stays null. An empty table gives no rows.
Other columns aren't read, whatever their names. Every piece is placed exactly once, whatever the lengths. A task holds the ids of one text at a time.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, durable, text_slices
from .tokenizer_files import encoding

Pattern = tuple[tuple[int, int], ...]
#: Of a length's count, how much a round covers at most; how much more than its share the longest length is worth at first; the weight of coverage.
#: The second is tried in turn while the plan is above the bound of all ids by the capacity.
RATE, LONGER, WEIGHT = 0.5, (0.05, 0.3, 1.0), 2.0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, text_col: str, vocabulary_file: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(vocabulary_file)
        for batch in batches:
            for rows, texts in text_slices(batch, "__text"):
                out = []
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
                    ids = np.append(codec.encode_to_numpy(text, allowed_special="all"), np.uint32(end_id)).astype("<u4")
                    end = len(ids) % capacity or capacity
                    begin = piece = 0
                    while begin < len(ids):
                        out.append((doc_id, piece, begin, end - begin, zlib.crc32(ids[begin:end].tobytes())))
                        begin, end, piece = end, end + capacity, piece + 1
                columns = list(zip(*out, strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    return kept.mapInArrow(work, PIECES)


def knapsack(prices: np.ndarray) -> Pattern:
    """The configuration of the highest total price; prices by length from 0 to the capacity, -inf for lengths that aren't there."""
    capacity = len(prices) - 1
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        values = best[room - 1 :: -1] + prices[1 : room + 1]
        length = int(values.argmax())
        if values[length] > best[room - 1]:
            best[room], last[room] = values[length], length + 1
        else:
            best[room] = best[room - 1]
    count: dict[int, int] = defaultdict(int)
    room = capacity
    while room:
        length = int(last[room])
        count[length] += 1
        room -= max(length, 1)
    count.pop(0, None)
    return tuple(sorted(count.items(), reverse=True))


def solve(histogram: dict[int, int], capacity: int, rate: float = RATE, longer: float = LONGER[0]) -> dict[Pattern, float]:
    """Multiplicative weights for: fewest configurations that cover each length's count. Amounts cover each count exactly.

    A round adds so much of a configuration that one of its lengths is covered by `rate` of its count (or by one piece) more, or in full.
    """
    counts = np.zeros(capacity + 1)
    counts[list(histogram)] = list(histogram.values())
    left = counts.copy()
    share = np.arange(capacity + 1) / capacity
    start = share * (1 + longer * share)
    amounts: dict[Pattern, float] = defaultdict(float)
    while len(live := np.flatnonzero(left)):
        prices = np.full(capacity + 1, -np.inf)
        # A factor of e^-WEIGHT for a length that is covered: worth some ids of a sequence left empty.
        prices[live] = start[live] * np.exp(-WEIGHT / capacity * (1 - left[live] / counts[live]))
        pattern = knapsack(prices)
        at, times = np.array([x for x, _ in pattern]), np.array([n for _, n in pattern], float)
        step = float((np.minimum(np.maximum(rate * counts[at], 1), left[at]) / times).min())
        amounts[pattern] += step
        left[at] -= times * step
        left[at[left[at] < 1e-9 * counts[at]]] = 0
    return amounts


class Plan(list):
    """(configuration, how many sequences) pairs that hold every piece once; `programmed`: sequences from the rounded program."""

    programmed = 0

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self)


def plan(histogram: dict[int, int], capacity: int, rate: float = RATE) -> Plan:
    """Of the plans tried, the one of fewest sequences."""
    bound = -(-sum(k * n for k, n in histogram.items()) // capacity)
    best: Plan | None = None
    for longer in LONGER:
        made = _plan(histogram, capacity, rate, longer)
        if best is None or made.sequences < best.sequences:
            best = made
        if best.sequences <= bound:
            break
    return best


def _plan(histogram: dict[int, int], capacity: int, rate: float, longer: float) -> Plan:
    left = {k: n for k, n in histogram.items() if n > 0}
    out: dict[Pattern, int] = defaultdict(int)

    def take(pattern: Pattern, most: int) -> int:
        n = min(most, *(left.get(length, 0) // times for length, times in pattern))
        if n > 0:
            out[pattern] += n
            for length, times in pattern:
                left[length] -= n * times
                if not left[length]:
                    del left[length]
        return n

    if full := left.get(capacity, 0):
        take(((capacity, 1),), full)  # nothing else fits beside them
    while left:
        amounts = solve(left, capacity, rate, longer)
        taken = sum(take(pattern, int(x)) for pattern, x in sorted(amounts.items(), key=lambda p: (-p[1], p[0])))
        taken += sum(take(pattern, 1) for pattern, x in sorted(amounts.items(), key=lambda p: (-(p[1] % 1), p[0])) if x % 1)
        if taken < 0.03 * sum(amounts.values()):
            break
    programmed = sum(out.values())
    # The rest, best fit: the longest piece into the fullest sequence that has room.
    room: dict[int, list[list[int]]] = defaultdict(list)
    bins: list[list[int]] = []
    for length in sorted(left, reverse=True):
        for _ in range(left[length]):
            free = next((r for r in range(length, capacity + 1) if room.get(r)), None)
            if free is None:
                bins.append([])
                used, free = bins[-1], capacity
            else:
                used = room[free].pop()
            used.append(length)
            room[free - length].append(used)
    for used in bins:
        count: dict[int, int] = defaultdict(int)
        for length in used:
            count[length] += 1
        out[tuple(sorted(count.items(), reverse=True))] += 1
    made = Plan(sorted(out.items()))
    made.programmed = programmed
    return made


def places(configurations: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, times in a sequence, first sequence, offset there) by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in configurations:
        offset = 0
        for length, times in pattern:
            out[length].append((rank[length], times, sequence, offset))
            rank[length] += n * times
            offset += length * times
        sequence += n
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def locate(length: int, ranks: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces of one length by their rank; rows: the length's `places`."""
    row = rows[np.searchsorted(rows[:, 0], ranks, "right") - 1]
    nth = ranks - row[:, 0]
    return row[:, 2] + nth // row[:, 1], row[:, 3] + nth % row[:, 1] * length


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, text_col: str = "text", vocabulary_file: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024, rate: float = RATE) -> DataFrame:
    """One row per piece with its sequence and offset."""
    scratch = Scratch()
    cut = scratch(pieces(docs, text_col, vocabulary_file, end_id, capacity))
    # Equal lengths are dealt over several ranges by a hash; a row's number has its task in the upper bits, its place there below.
    ranges = cut.withColumn("__hash", F.xxhash64("doc_id", "piece", "ids_crc32")).repartitionByRange("length", "__hash").sortWithinPartitions("length").drop("__hash")
    ranged = durable(ranges.withColumn("__placed", F.monotonically_increasing_id()))
    part = F.shiftright("__placed", 33).alias("__part")
    counts = ranged.groupBy("length", part).agg(F.count(F.lit(1)).alias("n"), F.min("__placed").alias("first")).orderBy("length", "__part").collect()
    scratch.clear()
    histogram: dict[int, int] = defaultdict(int)
    firsts: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for length, _, n, first in counts:
        firsts[length].append((first, histogram[length]))
        histogram[length] += n
    plan_places = places(plan(histogram, capacity, rate))
    found = cut.sparkSession.sparkContext.broadcast({length: (rows, np.array(firsts[length], np.int64)) for length, rows in plan_places.items()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, placed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__placed"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length).tolist():
                here = np.flatnonzero(length == value)
                rows, begun = found.value[value]
                at = begun[np.searchsorted(begun[:, 0], placed[here], "right") - 1]
                sequence[here], offset[here] = locate(value, at[:, 1] + placed[here] - at[:, 0], rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranged.mapInArrow(work, PACKED)
