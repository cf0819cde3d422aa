"""Jaccard self-join on word n-grams by rare-first prefix filtering, and the classes its links form.

A document's set holds the hashes of its distinct n-grams of words (ASCII letters lower-cased; with fewer words than n, the whole
sequence counts as one n-gram). Two documents link when |A & B| / |A | B| is at least `numerator` / `denominator`.

1. `frequencies`: how often n-grams occur, in a table of fixed size (a counter per hash bucket). It only serves the order,
   so buckets shared by several n-grams cost time, not links.
2. `signatures`: per document the size of its set, a digest of 128 bits, its prefix (the n-grams that are rarest by
   (bucket count, hash), as many as a link must share one of) and a sketch (set elements per hash range).
   Documents with one digest and size are one class; from here on each class is one row with a number of its own, however many copies.
3. Prefix n-grams are dealt out by hash and sorted. Classes that share one are candidates if they pass the length and the positional
   filter. Groups of up to SMALL classes list all their candidates. A larger group has a hub, the member that is in most of the larger
   groups (the original of near copies is in all of theirs), and lists its candidates with the hub alone. N-grams that
   may have a larger share of all postings than others by far (a counter of fixed size tells) aren't dealt to one task: their groups are counted by
   an aggregate that combines before it shuffles, and their members are found where they are, by a join with the few that are large.
4. The suffix filter compares sketches: the sum over hash ranges of the smaller count bounds the overlap. What is left is verified
   once per pair, on whole sets, which are computed anew for those documents only: the anchor of a pair (the hub) is sent once to each block of
   its partners, not once to each partner.
5. Larger groups whose members are then all in one component are done: more links would change nothing. In the others, taken
   together by hub, the members outside the largest component are compared with all members of other components, in pairs of blocks of bounded
   size; only candidates that pass length and suffix filter come out. So no link between two components is lost, and large groups of
   near copies, linked or just not, don't give all their pairs: one member that differs costs as many comparisons as there are others.
   (A group without any links, all of whose members pass the filters of step 3, does compare each two: m^2 / 2 sketches.)
6. Components: each node takes its smallest neighbour, chains are shortened, edges contracted, until none is left.

Defined cases: null and blank texts have size 0 and link with nothing; repeated rows are copies; ids are returned as they
are, and a null doc_id only gets a component if a copy or near copy has an id. An empty table gives no rows. Other columns aren't read,
whatever their names. 64-bit hashes stand for n-grams: two n-grams with one hash would count as one. Texts of more than LONG characters are
gone through in blocks of words; besides, work arrays take some 60 bytes per byte of a slice of texts, and a set 8 bytes per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NARROW_SLICE, Scratch, durable, sums_by_chunk, text_slices

WORDS = 5
BUCKET_BITS = 18
#: A group of up to so many classes lists all its pairs at once.
SMALL = 8
#: Members of a larger group are dealt over blocks, of which a task compares two: so many blocks times this as the square root of their
#: number, and no more members to a block than this.
SPREAD, FAMILY = 4, 1 << 16
#: An n-gram is dealt to one task only if its bucket holds no more postings than so many, or so many times the mean.
HOT, HOT_TIMES = 512, 8
#: Bits by which the documents to verify are picked without a join, for each of them, and at most (8 MB); beyond, a join picks them.
FILTER_TIMES, FILTER_BITS = 16, 26
#: Rows of a table that is sent to all tasks at most (16 bytes each); beyond, a join by shuffle takes its place.
SENT_ROWS = 1 << 20
#: Texts of more characters are gone through in blocks of so many words.
LONG, LONG_WORDS = 2 << 20, 100_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_U = np.uint64
#: Odd constants and a table of random values, the same in every process.
_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
BASE = _U(int(_random.integers(1 << 61, 1 << 62)) * 2 + 1)
INVERSE = _U(pow(int(BASE), -1, 1 << 64))
PLACES = _random.integers(1 << 61, 1 << 62, 64, dtype=np.uint64) * _U(2) + _U(1)
SEEDS = _random.integers(1, 1 << 63, 2, dtype=np.uint64)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def _forget_powers() -> None:
    """At a task's end: workers outlive their tasks."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams of all texts, how many each text has); repeats within a text are kept."""
    if max(map(len, texts), default=0) <= LONG:
        return _shingles(texts, words)
    parts = [_long_shingles(t, words) if len(t) > LONG else _shingles([t], words)[0] for t in texts]
    return np.concatenate(parts), np.array([len(p) for p in parts])


def _long_shingles(text: str, words: int) -> np.ndarray:
    """Those of one long text: a block holds the n-grams that begin with its own words."""
    begins = np.fromiter((m.start() for m in WORD.finditer(text)), np.int64)
    if len(begins) <= LONG_WORDS + words:
        return _shingles([text], words)[0]
    out = []
    for k in range(0, len(begins) - words + 1, LONG_WORDS):
        after = k + LONG_WORDS + words - 1
        out.append(_shingles([text[begins[k] : begins[after] if after < len(begins) else len(text)]], words)[0])
    return np.concatenate(out)


def _shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(" ".join(texts).encode() + b" ", np.uint8)
    ends_of = np.cumsum([len(t.encode()) + 1 for t in texts])
    blank = BLANK[data]
    change = np.flatnonzero(np.diff(blank, prepend=True))
    begins, ends = change[::2], change[1::2]
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    word = mixed((total[ends] - total[begins]) * down[begins])
    upto = np.searchsorted(begins, ends_of)
    per_text = np.diff(upto, prepend=0)
    hashes = np.zeros(len(word), np.uint64)
    for k in range(min(words, len(word))):
        hashes[: len(word) - k] += word[k:] * PLACES[k]
    hashes = mixed(hashes + _U(words))
    # An n-gram counts if its last word is in the same text.
    whole = np.arange(len(word)) + words <= np.repeat(upto, per_text)
    count = np.maximum(per_text - words + 1, 0)
    for i in np.flatnonzero((per_text > 0) & (per_text < words)).tolist():
        n, first = int(per_text[i]), int(upto[i] - per_text[i])
        hashes[first] = mixed(np.array([(word[first : first + n] * PLACES[:n]).sum(dtype=np.uint64) + _U(n)], np.uint64))[0]
        whole[first], count[i] = True, 1
    return hashes[whole], count


def sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted set of each text."""
    hashes, count = shingles(texts, words)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(count)[:-1])] if texts else []


def prefix_size(n: np.ndarray | int, numerator: int, denominator: int) -> np.ndarray | int:
    """Of the n elements in order, so many that a link must share one of them."""
    return n - (numerator * n + denominator - 1) // denominator + 1


def digests(own: np.ndarray) -> tuple[int, int]:
    """Two sums of 64 bits over a set, each of other values."""
    return tuple(int(mixed(own ^ seed).sum(dtype=np.uint64).astype(np.int64)) for seed in SEEDS)


def sketch(elements: np.ndarray) -> bytes:
    """Elements per hash range, one or two to a range, 255 meaning 255 or more."""
    bits = max(4, len(elements).bit_length() - 1)
    return np.minimum(np.bincount((elements >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def halved(counts: np.ndarray) -> np.ndarray:
    """The sketch with half as many ranges; 255 stays 255 or more."""
    return np.minimum(counts.reshape(*counts.shape[:-1], -1, 2).sum(-1, dtype=np.int64), 255).astype(np.uint8)


def overlap_bounds(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """No fewer elements than a set shares with each of others, by sketches of one length."""
    least = np.minimum(one, others)
    bound = least.sum(1, dtype=np.int64)
    # Two full ranges may share any number.
    full = (least == 255).any(1)
    return np.where(full, np.int64(1) << 40, bound)


def overlap_bound(a: bytes, b: bytes) -> int:
    """No fewer elements than two sets share, by their sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = halved(x)
    while len(y) > len(x):
        y = halved(y)
    return int(overlap_bounds(x, y[None])[0])


class JaccardJoin:
    def __init__(self, words: int = WORDS, numerator: int = 80, denominator: int = 100) -> None:
        self.words, self.num, self.den = words, numerator, denominator

    def linked(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)

    def passes(self, na: np.ndarray, nb: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> np.ndarray:
        """Length and positional filter for candidates at places pa_ and pb of their ordered sets."""
        most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_, nb - pb) - 1
        need = (self.num * (na + nb) + self.num + self.den - 1) // (self.num + self.den)
        return (self.den * np.minimum(na, nb) >= self.num * np.maximum(na, nb)) & (most >= need)

    # Steps 1 and 2.

    def frequencies(self, texts: DataFrame) -> np.ndarray:
        words = self.words

        def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(1 << BUCKET_BITS, np.int64)
            for batch in batches:
                for _, part in text_slices(batch, "__text", NARROW_SLICE):
                    hashes, _ = shingles(part, words)
                    out += np.bincount((hashes >> _U(64 - BUCKET_BITS)).astype(np.int64), minlength=len(out))
            _forget_powers()
            return out

        return sums_by_chunk(texts.select("__text"), count, 1 << BUCKET_BITS)

    def signatures(self, texts: DataFrame, frequency: np.ndarray) -> DataFrame:
        """doc_id, n, d1, d2 (the digest), prefix, sketch of each text, and what other columns the texts have."""
        shared = texts.sparkSession.sparkContext.broadcast(np.minimum(frequency, (1 << 31) - 1).astype(np.uint32))
        words, num, den = self.words, self.num, self.den
        kept = texts.select("doc_id", *(c for c in texts.columns if c not in ("doc_id", "__text")), "__text")
        others = kept.columns[1:-1]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = shared.value.astype(np.uint64)
            for batch in batches:
                for rows, part in text_slices(batch, "__text", NARROW_SLICE):
                    n, digest, prefixes, sketches = [], [], [], []
                    for own in sets(part, words):
                        n.append(len(own))
                        digest.append(digests(own))
                        key = counts[(own >> _U(64 - BUCKET_BITS)).astype(np.int64)] << _U(32) | own & _U(0xFFFFFFFF)
                        order = np.argsort(key, kind="stable")[: prefix_size(len(own), num, den)] if len(own) else []
                        prefixes.append(own[order].tobytes())
                        sketches.append(sketch(own))
                    d1, d2 = (pa.array(d, pa.int64()) for d in zip(*digest, strict=True))
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), d1, d2, pa.array(prefixes, pa.binary()), pa.array(sketches, pa.binary()), *(rows.column(c) for c in others)], ["doc_id", *KEY, "prefix", "sketch", *others])
            _forget_powers()

        return kept.mapInArrow(work, ", ".join(["doc_id long, n long, d1 long, d2 long, prefix binary, sketch binary", *(f"{c} {t}" for c, t in kept.dtypes[1:-1])]))

    # Step 3.

    @staticmethod
    def postings(classes: DataFrame, hot: np.ndarray, wanted: bool) -> DataFrame:
        """token, cls, size (n and place) for each element of each class's prefix: those in hot buckets, or the others."""
        shared = classes.sparkSession.sparkContext.broadcast(np.packbits(hot))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags = np.unpackbits(shared.value).astype(bool)
            for batch in batches:
                cls, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "n"))
                token, size = _elements(batch.column("prefix").to_pylist())
                if not len(token):
                    continue
                place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                some = flags[_bucket(token)] == wanted
                yield pa.RecordBatch.from_arrays([pa.array(token[some].view(np.int64)), pa.array(np.repeat(cls, size)[some]), pa.array((np.repeat(n, size) << 24 | np.minimum(place, (1 << 24) - 1))[some])], ["token", "cls", "size"])

        return classes.select("cls", "n", "prefix").mapInArrow(work, "token long, cls long, size long")

    @staticmethod
    def hot_buckets(classes: DataFrame) -> np.ndarray:
        """Which buckets of n-grams hold so many postings that one n-gram may be in much of them."""

        def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(1 << BUCKET_BITS, np.int64)
            for batch in batches:
                out += np.bincount(_bucket(_elements(batch.column("prefix").to_pylist())[0]), minlength=len(out))
            return out

        held = sums_by_chunk(classes.select("prefix"), count, 1 << BUCKET_BITS)
        return held > max(HOT, HOT_TIMES * held.mean())

    def groups(self, classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """(pairs a, b, size_a, size_b, flip of groups of up to SMALL classes, postings token, cls, size of larger ones)."""
        hot = self.hot_buckets(classes)
        cold, members = self.postings(classes, hot, wanted=False), None
        if hot.any():
            dealt = self.postings(classes, hot, wanted=True)
            sizes = scratch(dealt.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"))
            few, many = sizes.filter(F.col("held") <= SMALL).select("token"), sizes.filter(F.col("held") > SMALL).select("token")
            cold = cold.unionByName(dealt.join(_sent(few), "token", "left_semi"))
            members = dealt.join(_sent(many), "token", "left_semi")
        got = scratch(self.candidates(cold))
        large = got.filter("token is not null").select("token", F.col("a").alias("cls"), F.col("size_a").alias("size"))
        pairs = got.filter("token is null").select("a", "b", "size_a", "size_b", F.lit(False).alias("flip"))
        return pairs, large if members is None else scratch(large.unionByName(members))

    def _pairs(self, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Filtered pairs of columns of rows (token, cls, size), the smaller class first: a, b, n of a, n of b."""
        a, b = rows[:, left], rows[:, right]
        low = (1 << 24) - 1
        ok = (a[1] != b[1]) & self.passes(a[2] >> 24, b[2] >> 24, a[2] & low, b[2] & low)
        a, b = a[:, ok], b[:, ok]
        swap = a[1] > b[1]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return np.stack([a[1], b[1], a[2] >> 24, b[2] >> 24])

    def candidates(self, postings: DataFrame) -> DataFrame:
        """From token, cls, size: pairs of small groups (token null; a, b, size_a, size_b), members of larger ones (token, a, size_a).

        Groups pass by: of one that goes on in the next batch only up to SMALL rows are kept.
        """

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_rows, open_large = np.zeros((3, 0), np.int64), None
            for batch in _with_end(batches):
                rows = open_rows if batch is None else np.concatenate([open_rows, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "cls", "size")])], 1)
                open_rows = rows[:, :0]
                if not rows.shape[1]:
                    continue
                length, group = _lengths(rows[0])
                large = length > SMALL
                if open_large is not None and rows[0, 0] == open_large:
                    large[0] = True
                if batch is not None:
                    if large[-1]:
                        open_large = rows[0, -1]
                    else:
                        # It may go on: kept for the next batch.
                        open_large, last = None, rows.shape[1] - length[-1]
                        open_rows, rows, group = rows[:, last:], rows[:, :last], group[:last]
                out = []
                few = (length > 1) & ~large
                some, inside = rows[:, few[group]], group[few[group]]
                for gap in range(1, SMALL):
                    left = np.flatnonzero(inside[:-gap] == inside[gap:]) if len(inside) > gap else np.zeros(0, int)
                    if len(left):
                        out.append(self._pairs(some, left, left + gap))
                if out:
                    yield _pair_batch(out)
                rest = rows[:, large[group]]
                if rest.shape[1]:
                    yield _batch(rest[0], rest[1], None, rest[2], None)

        dealt = postings.repartition("token").sortWithinPartitions("token", "size", "cls")
        return dealt.select("token", "cls", "size").mapInArrow(work, PAIRS)

    def stars(self, members: DataFrame, scratch: Scratch) -> DataFrame:
        """From token, cls, size of larger groups: token, hub, hub_size, cls, size, and whether hub and cls are candidates (ok).

        The hub comes from an aggregate that combines before it shuffles. What is joined back has one row for each class or group.
        """
        fame = scratch(members.groupBy("cls").agg(F.count(F.lit(1)).alias("fame")))
        first = F.min_by(F.struct("cls", "size"), F.struct((-F.col("fame")).alias("fame"), F.xxhash64("cls").alias("hash"), "cls"))
        hubs = scratch(members.join(_sent(fame), "cls").groupBy("token").agg(first.alias("h")).select("token", F.col("h.cls").alias("hub"), F.col("h.size").alias("hub_size")))
        n, m = F.shiftright("size", 24), F.shiftright("hub_size", 24)
        place, hub_place = F.col("size").bitwiseAND(F.lit((1 << 24) - 1)), F.col("hub_size").bitwiseAND(F.lit((1 << 24) - 1))
        most = F.least(place, hub_place) + F.least(n - place, m - hub_place)
        ok = (F.col("hub") != F.col("cls")) & (self.den * F.least(n, m) >= self.num * F.greatest(n, m)) & ((self.num + self.den) * most >= self.num * (n + m))
        return scratch(members.join(_sent(hubs), "token").withColumn("ok", ok))

    def by_hub(self, members: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
        """hub, r, b, rest, cls, n, comp, sketch: the pairs of blocks to compare of the groups (token, hub, cls, size, comp) that span components.

        Block r holds members outside a family's largest component (rest), block b any members; each rest block meets each block.
        """
        spans = members.groupBy("token", "comp").agg(F.first("hub").alias("hub")).groupBy("token").agg(F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("token")
        rows = members.join(_sent(scratch(spans)), "token", "left_semi").groupBy("hub", "cls").agg(F.first("size").alias("size"), F.first("comp").alias("comp"))
        rows = scratch(rows.select("hub", "cls", F.shiftright("size", 24).alias("n"), "comp"))
        comps = rows.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("held"))
        every = F.sum("held").alias("every")
        families = comps.groupBy("hub").agg(F.max(F.struct("held", "comp")).alias("first"), every).select("hub", F.col("first.comp").alias("largest"), (F.col("every") - F.col("first.held")).alias("others"), "every", _blocks(F.col("every")).alias("blocks"))
        families = families.withColumn("rests", F.ceil(F.col("others") * F.col("blocks") / F.col("every"))).drop("others", "every")
        placed = rows.join(_sent(scratch(families)), "hub").withColumn("rest", F.col("comp") != F.col("largest")).join(classes.select("cls", "sketch"), "cls")
        upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        own = lambda c: F.pmod(F.xxhash64("cls"), F.col(c))
        columns = ["hub", "r", "b", "rest", "cls", "n", "comp", "sketch"]
        few = placed.filter("rest").withColumn("r", own("rests")).withColumn("b", upto("blocks")).select(columns)
        all_ = placed.filter("rests > 0").withColumn("rest", F.lit(False)).withColumn("b", own("blocks")).withColumn("r", upto("rests"))
        return few.unionByName(all_.select(columns))

    def families(self, members: DataFrame) -> DataFrame:
        """From `by_hub`: pairs across components that pass length and suffix filter; a pair of two rest members comes from both sides."""
        num, den = self.num, self.den

        def pairs(rest: np.ndarray, cls: np.ndarray, n: np.ndarray, comp: np.ndarray, sketches: list[bytes]) -> Iterator[pa.RecordBatch]:
            """One pair of blocks of a family, sorted by n."""
            others = np.flatnonzero(~rest)
            width = np.array([len(x) for x in sketches])
            places = {w: others[width[others] == w] for w in np.unique(width[others]).tolist()}
            shrunk = {(w, w): np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(len(at), w) for w, at in places.items()}

            def counts(w: int, to: int) -> np.ndarray:
                """Sketches of one length, halved down to another."""
                if (w, to) not in shrunk:
                    shrunk[w, to] = halved(counts(w, 2 * to))
                return shrunk[w, to]

            out, found = [], 0
            for i in np.flatnonzero(rest).tolist():
                one = np.frombuffer(sketches[i], np.uint8)
                for w, at in places.items():
                    sizes = n[at]
                    a, b = np.searchsorted(den * sizes, num * n[i], "left"), np.searchsorted(num * sizes, den * n[i], "right")
                    if a >= b:
                        continue
                    same = one
                    while len(same) > w:
                        same = halved(same)
                    bound = overlap_bounds(same, counts(w, min(w, len(one)))[a:b])
                    j = at[a:b]
                    j = j[((num + den) * bound >= num * (n[i] + n[j])) & (comp[j] != comp[i])]
                    if len(j):
                        flip = cls[i] > cls[j]
                        out.append(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), np.where(flip, n[j], n[i]), np.where(flip, n[i], n[j])]))
                        found += len(j)
                if found > 100_000:
                    yield _pair_batch(out)
                    out, found = [], 0
            if out:
                yield _pair_batch(out)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, kept = None, []
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("hub", "r", "b")])
                cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), keys.shape[1]]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if kept and now != keys[:, a].tolist():
                        yield from family(kept)
                        kept = []
                    now = keys[:, a].tolist()
                    kept.append(batch.slice(a, b - a))
            if kept:
                yield from family(kept)

        def family(kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(kept)
            yield from pairs(*(rows.column(c).to_numpy() for c in ("rest", "cls", "n", "comp")), rows.column("sketch").to_pylist())

        dealt = members.repartition("hub", "r", "b").sortWithinPartitions("hub", "r", "b", "n", "cls")
        return dealt.select("hub", "r", "b", "rest", "cls", "n", "comp", "sketch").mapInArrow(work, PAIRS)

    # Steps 4 and 5.

    def verified(self, pairs: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
        """Of distinct pairs (a, b, size_a, size_b, flip), those that link. The anchor is b where flip is true, else a."""
        num, den, words = self.num, self.den, self.words
        side = lambda name: classes.select(F.col("cls").alias(name), F.col("sketch").alias(f"sketch_{name}"))

        def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y, na, nb = (batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "size_a", "size_b"))
                ok = [(num + den) * overlap_bound(s, t) >= num * (m + n) for s, t, m, n in zip(x, y, na, nb, strict=True)]
                yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b", "flip"])

        left = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(suffix, "a long, b long, flip boolean")
        anchor = F.when(F.col("flip"), F.col("b")).otherwise(F.col("a"))
        left = scratch(left.select(anchor.alias("anchor"), F.when(F.col("flip"), F.col("a")).otherwise(F.col("b")).alias("other")))
        wanted = scratch(left.select(F.explode(F.array("anchor", "other")).alias("cls")).distinct().join(classes.select("cls", "doc_id", *KEY), "cls"))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, part in text_slices(batch, "__text", NARROW_SLICE):
                    found = sets(part, words)
                    columns = zip(*((len(own), *digests(own)) for own in found), strict=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([own.tobytes() for own in found], pa.binary())], [*KEY, "own"])
            _forget_powers()

        found = self._texts_of(wanted, texts).mapInArrow(whole, "n long, d1 long, d2 long, own binary")
        found = scratch(found.join(wanted.select("cls", *KEY), KEY).dropDuplicates(["cls"]).select("cls", "own"))
        # One copy of an anchor's set for each block of its partners.
        blocks = scratch(left.groupBy("anchor").agg(_blocks(F.count(F.lit(1))).alias("blocks")))
        heads = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(found.withColumnRenamed("cls", "anchor"), "anchor")
        heads = heads.select("anchor", "block", F.lit(None).cast("long").alias("other"), "own")
        rest = left.join(_sent(blocks), "anchor").withColumn("block", F.pmod(F.xxhash64("other"), F.col("blocks"))).join(found.withColumnRenamed("cls", "other"), "other")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y = np.zeros(0, np.uint64)
            for batch in batches:
                a, b = [], []
                for anchor, other, own in zip(*(batch.column(c).to_pylist() for c in ("anchor", "other", "own")), strict=True):
                    x = np.frombuffer(own, "<u8")
                    if other is None:
                        y = x
                        continue
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    if den * (overlap := int((y[at] == x).sum())) >= num * (len(x) + len(y) - overlap):
                        a.append(anchor)
                        b.append(other)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        together = heads.unionByName(rest.select("anchor", "block", "other", "own")).repartition("anchor", "block")
        ordered = together.sortWithinPartitions("anchor", "block", F.asc_nulls_first("other"))
        return scratch(ordered.select("anchor", "other", "own").mapInArrow(check, "a long, b long"))

    @staticmethod
    def _texts_of(wanted: DataFrame, texts: DataFrame) -> DataFrame:
        """__text of the rows whose doc_id is wanted, and perhaps of some others."""
        n = wanted.count()
        size = (1 << FILTER_BITS) >> max(0, FILTER_BITS - max(10, int(FILTER_TIMES * n).bit_length()))
        if FILTER_TIMES * n > size:
            return texts.join(wanted.select("doc_id").distinct().withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("__text")
        bit = lambda c: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
        flags = np.zeros(size, bool)
        flags[wanted.select(bit("doc_id").alias("bit")).distinct().toPandas()["bit"].to_numpy()] = True
        shared = texts.sparkSession.sparkContext.broadcast(np.packbits(flags))

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            there = np.unpackbits(shared.value).astype(bool)
            for batch in batches:
                yield batch.filter(pa.array(there[batch.column("bit").to_numpy(zero_copy_only=False)])).select(["__text"])

        return texts.select("__text", bit("doc_id").alias("bit")).mapInArrow(some, "__text string")

    @staticmethod
    def _distinct(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a", "b").agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.first("flip").alias("flip"))

    # All steps.

    def components(self, docs: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
        """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row."""
        signed, named = self.linked(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text_col).alias("__text")))
        # The component's name: its smallest doc_id.
        smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        of_class = durable(named.join(smallest, "comp").select(*KEY, "component_id"))
        # Copies are joined to their class; a class with very many copies is split as a skewed join.
        found = signed.select("doc_id", *KEY).join(of_class, KEY, "left")
        return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))

    def survivors(self, docs: DataFrame, marks: dict[str, Column], text_col: str = "text", key: str = "doc_id") -> DataFrame:
        """doc_id and marks of one row of each component: the least by doc_id, then by the marks (longs). Rows without an id don't count.

        A doc_id may repeat with other texts: each row counts in its own text's component. Texts without words are alike if their ids are.
        """
        signed, named = self.linked(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text_col).alias("__text"), *(c.alias(n) for n, c in marks.items())))
        there = signed.filter("doc_id is not null")
        least = F.min(F.struct("doc_id", *marks)).alias("least")
        # First within classes: a class has any number of copies.
        worded = there.filter("n > 0").groupBy(*KEY).agg(least).join(named.select(*KEY, "comp"), KEY).groupBy("comp").agg(F.min("least").alias("least"))
        wordless = there.filter("n = 0").groupBy("doc_id").agg(least)
        return worded.select("least.*").unionByName(wordless.select("least.*"))

    def linked(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(signatures of all rows, (n, d1, d2, doc_id, comp): each class, its smallest doc_id and the component it is in)."""
        scratch = Scratch()
        made = scratch(self.signatures(texts, self.frequencies(texts)))
        least = made.filter("n > 0").groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
        # Numbers given once, when the table is written: no two classes share one.
        classes = scratch(least.withColumn("cls", F.monotonically_increasing_id()))
        signed = durable(made.drop("prefix", "sketch"))
        pairs, large = self.groups(classes, scratch)
        grouped = not large.isEmpty()
        if grouped:
            starred = self.stars(large, scratch)
            hub, other, n, m = F.col("hub"), F.col("cls"), F.shiftright("size", 24), F.shiftright("hub_size", 24)
            star = starred.filter("ok").select(F.least(hub, other).alias("a"), F.greatest(hub, other).alias("b"), F.when(hub < other, m).otherwise(n).alias("size_a"), F.when(hub < other, n).otherwise(m).alias("size_b"), (hub > other).alias("flip"))
            pairs = pairs.unionByName(star)
        pairs = scratch(self._distinct(pairs))
        links = self.verified(pairs, classes, texts, scratch)
        label = connected(links, scratch)
        if grouped:
            members = starred.join(_sent(label).withColumnsRenamed({"id": "cls"}), "cls", "left").select("token", "hub", "cls", "size", F.coalesce("comp", "cls").alias("comp"))
            new = self.families(self.by_hub(members, classes, scratch)).withColumn("flip", F.lit(False))
            new = scratch(self._distinct(new).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
            if not new.isEmpty():
                links = links.unionByName(self.verified(new, classes, texts, scratch))
                label = connected(links, scratch)
        named = durable(classes.select(*KEY, "cls", "doc_id").join(label.withColumnsRenamed({"id": "cls"}), "cls", "left").select(*KEY, "doc_id", F.coalesce("comp", "cls").alias("comp")))
        scratch.clear()
        return signed, named


KEY = ["n", "d1", "d2"]
PAIRS = "token long, a long, b long, size_a long, size_b long"


def _batch(token, a, b, size_a, size_b) -> pa.RecordBatch:  # noqa: ANN001
    fill = lambda x: pa.nulls(len(a), pa.int64()) if x is None else pa.array(x)
    return pa.RecordBatch.from_arrays([fill(x) for x in (token, a, b, size_a, size_b)], ["token", "a", "b", "size_a", "size_b"])


def _pair_batch(out: list[np.ndarray]) -> pa.RecordBatch:
    """Pairs (a, b, n of a, n of b), each once."""
    found = np.concatenate(out, 1)
    found = found[:, np.lexsort((found[1], found[0]))]
    new = np.ones(found.shape[1], bool)
    new[1:] = (np.diff(found[0]) != 0) | (np.diff(found[1]) != 0)
    return _batch(None, *found[:, new])


def _lengths(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size of each group of equal neighbours, group of each row)."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(tokens) != 0]))
    length = np.diff(np.append(first, len(tokens)))
    return length, np.repeat(np.arange(len(length)), length)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, then None."""
    yield from (batch for batch in batches if batch.num_rows)
    yield None


def _elements(prefixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(elements of all prefixes, how many each has)."""
    return np.frombuffer(b"".join(prefixes), "<u8"), np.array([len(p) // 8 for p in prefixes], np.int64)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _U(64 - BUCKET_BITS)).astype(np.int64)


def _blocks(n: Column) -> Column:
    """How many blocks so many members are dealt over."""
    return F.ceil(F.greatest(F.sqrt(n) / SPREAD, n / FAMILY)).cast("long")


def _sent(few: DataFrame) -> DataFrame:
    """A written table, to be sent to all tasks if it is small enough; else it is joined by a shuffle, split where skewed."""
    return F.broadcast(few) if few.count() <= SENT_ROWS else few


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id and comp (the smallest id of its component) of each node of undirected edges a, b."""
    edges = scratch(edges.select("a", "b").filter("a <> b").distinct())
    label = scratch(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("comp", F.col("id")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = scratch(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("up")))
        # One row for each node still open: sent to all tasks where these are few.
        sent = F.broadcast if parent.count() <= SENT_ROWS else (lambda df: df)
        above = lambda parent, name: sent(parent.select(F.col("id").alias(name), F.col("up").alias(f"up_{name}")))  # noqa: E731, B023
        while True:
            # Each node's parent's parent, until that is no other.
            jumped = scratch(parent.join(above(parent, "up"), "up", "left").select("id", F.coalesce("up_up", "up").alias("next"), "up"))
            parent = jumped.select("id", F.col("next").alias("up"))
            if jumped.filter("next <> up").isEmpty():
                break
        label = scratch(label.join(above(parent, "comp"), "comp", "left").select("id", F.coalesce("up_comp", "comp").alias("comp")))
        edges = scratch(edges.join(above(parent, "a"), "a").join(above(parent, "b"), "b").filter("up_a <> up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
    return label
