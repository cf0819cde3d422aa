"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to `ORDER` bytes with the counts of the bytes that followed. A byte's
code length is taken at the longest context of the tree that matches, or, for a byte not seen there, from the next
shorter one after an escape (method C: with n bytes seen, d of them distinct, a byte seen c times has c / (n + d), the
escape d / (n + d); bytes seen in a longer context are excluded in the shorter ones; below order 0 all bytes left are
alike). Statistics are frozen once learned, so the exact code length of each (context, byte) in each language is a table
entry, and a text's code length is a sum of lookups. The language with the shortest code wins.

All contexts of the learned texts are kept. The table holds a row for each (context, byte) that any language has seen, and a column for
each language; what none has seen is worked out from the shorter contexts when it is met, once for a slice of texts.

Learning takes a bounded sample of labelled rows (`per_language` rows of each language in expectation, by a hash of doc_id),
whole texts. Counting runs on the executors; the distinct (context, byte) counts of the sample reach the driver. The model is sent
to all tasks, so its size is checked: more than MAX_LANGUAGES values of the language column or a model of more than MAX_BYTES is an
error that says so (clean the column, or lower `per_language`), never a cut.

Results: `und` with score 0 where the text is null or has no letter, or nothing was learned. Ties go to the language
first in order. The score is the posterior probability of the language under equal priors. Repeated rows are scored each, and count
each when learned; an empty table gives no rows; a kept column with the name of a result gives way to it. Very long texts are read
whole, in blocks; work arrays take some 40 bytes per byte of a slice of texts or of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import map_texts, text_slices

ORDER = 3
PER_LANGUAGE = 1500
MAX_LANGUAGES, MAX_BYTES = 500, 1 << 29
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
PAD = b"\n" * ORDER


class Index:
    """Places of distinct keys: a hash table with open addressing, asked for many keys at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.places = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[left[free]]  # of several for one slot the last stays
            won = free[self.keys[at[free]] == keys[left[free]]]
            self.places[at[won]] = left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for others."""
        at = self._slots(keys)
        out = self.places[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        out[open_] = -1
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.places[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


@dataclass
class Level:
    """One order's statistics: rows by (context, byte) and by context, columns by language."""

    grams: Index
    contexts: Index
    counts: np.ndarray
    #: log2(n + d) and the escape's bits, by context of the next longer order (whose bytes are excluded), then by own context.
    total: np.ndarray
    escape: np.ndarray
    longer: int

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.counts, self.total, self.escape, self.grams.keys, self.grams.places, self.contexts.keys, self.contexts.places))


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]
    #: Bits of a byte that no order has seen.
    unseen: np.ndarray
    #: Bits by language and (context, byte) of the longest order.
    bits: np.ndarray

    def costs(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of grams (three bytes and the byte after them) by language, where no longer order has seen the byte."""
        if order < 0:
            return np.broadcast_to(self.unseen, (len(grams), len(self.languages)))
        level = self.levels[order]
        own = grams & ((1 << 8 * (order + 1)) - 1)
        row = level.contexts.find(own >> 8)
        row = np.where(row >= 0, row + level.longer, -1)
        if order < ORDER:
            longer = self.levels[order + 1].contexts.find((grams >> 8) & ((1 << 8 * (order + 1)) - 1))
            row = np.where(longer >= 0, longer, row)
        known = (row >= 0)[:, None]
        at = level.grams.find(own)
        counts = np.where((at >= 0)[:, None], level.counts[at], 0)
        escaped = np.where(known, level.escape[row], 0) + self.costs(grams, order - 1)
        return np.where(counts > 0, level.total[row] - np.log2(np.maximum(counts, 1)), escaped)


def sampled(rows: DataFrame, key: str, stratum: str, most: int) -> DataFrame:
    """About `most` rows of each stratum (all, where there are fewer), chosen by a hash of the key."""
    counts = rows.groupBy(stratum).count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of the language column")
    if not counts:
        return rows
    share = F.create_map(*(F.lit(x) for value, n in counts for x in (value, min(1 << 30, round((1 << 30) * most / n)))))
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) < share[F.col(stratum)])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_slices(batch, "__text", common.NARROW_SLICE):
            languages = np.array(rows.column("__lang").to_pylist(), object)
            for language in sorted(set(languages)):
                own = [t.encode() for t, x in zip(texts, languages, strict=True) if x == language]
                data = np.frombuffer(b"".join(PAD + t for t in own), np.uint8).astype(np.int64)
                grams = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
                # A pad is read, never predicted.
                size = np.array([len(t) for t in own])
                real = np.ones(len(data), bool)
                real[(np.cumsum(size + ORDER) - size - ORDER)[:, None] + np.arange(ORDER)] = False
                grams = grams[real[ORDER:]]
                values, counts = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(values), pa.string()), pa.array(values), pa.array(counts)], ["lang", "gram", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id", use: Column | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from rows with a language and a text (and, if given, where `use` holds)."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if use is None else F.coalesce(use, F.lit(False))))
    sample = sampled(rows.select(F.col(key).alias("__key"), F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang")), "__key", "__lang", per_language)
    counts = sample.select("__text", "__lang").mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return model_of(counts)


def model_of(counts: pd.DataFrame) -> Model:
    """The trees of counts of (lang, gram: three bytes of context and the byte, n)."""
    languages = sorted(counts["lang"].unique())
    if not languages:
        return Model([], [], np.zeros(0), np.zeros((0, 0), np.float32))
    gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    which = counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    wide = len(languages)
    longest = np.unique(gram)
    if len(longest) * wide * 8 > MAX_BYTES:
        raise ValueError(f"a model of {wide} languages and {len(longest)} contexts and bytes is larger than {MAX_BYTES} bytes")

    def by(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        """Sums of rows of values by row number."""
        order = np.argsort(rows, kind="stable")
        heads = np.flatnonzero(np.diff(rows[order], prepend=-1))
        out = np.zeros((size, wide))
        out[rows[order][heads]] = np.add.reduceat(values[order], heads, axis=0)
        return out

    # Counts of all orders follow from those of the longest.
    parts = []
    for order in range(ORDER + 1):
        grams, back = np.unique(gram & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        table = np.bincount(back * wide + which, n, len(grams) * wide).reshape(-1, wide)
        contexts, of = np.unique(grams >> 8, return_inverse=True)
        parts.append((grams, table, contexts, of))
    levels: list[Level] = []
    for order, (grams, table, contexts, of) in enumerate(parts):
        seen, distinct = by(of, table, len(contexts)), by(of, (table > 0).astype(float), len(contexts))
        longer = 0
        if order < ORDER:
            # Without the bytes that the longer context has seen.
            over, over_table, over_contexts, over_of = parts[order + 1]
            longer = len(over_contexts)
            at = np.searchsorted(grams, over & ((1 << 8 * (order + 1)) - 1))
            suffix = np.searchsorted(contexts, over_contexts & ((1 << 8 * order) - 1))
            less = by(over_of, np.where(over_table > 0, table[at], 0), longer)
            fewer = by(over_of, (over_table > 0).astype(float), longer)
            seen, distinct = np.concatenate([seen[suffix] - less, seen]), np.concatenate([distinct[suffix] - fewer, distinct])
        total = np.log2(np.maximum(seen + distinct, 1))
        escape = np.where(distinct > 0, total - np.log2(np.maximum(distinct, 1)), 0)
        levels.append(Level(Index(grams), Index(contexts), table.astype(np.float32), total.astype(np.float32), escape.astype(np.float32), longer))
    unseen = np.log2(np.maximum(256 - (parts[0][1] > 0).sum(0), 1))
    model = Model(languages, levels, unseen, np.zeros((0, 0), np.float32))
    model.bits = np.ascontiguousarray(model.costs(longest).T, np.float32)
    if (size := model.bits.nbytes + sum(x.nbytes() for x in levels)) > MAX_BYTES:
        raise ValueError(f"a model of {size} bytes, more than {MAX_BYTES}")
    return model


def code_lengths(texts: list[str], model: Model) -> np.ndarray:
    """Bits of each text in each language. A long text goes in blocks, each read after the last bytes of the one before."""
    if max(map(len, texts), default=0) <= common.LONG:
        return _code_lengths([(PAD, t.encode()) for t in texts], model)
    out = np.zeros((len(model.languages), len(texts)))
    for k, text in enumerate(texts):
        data, size = PAD + text.encode(), common.NARROW_SLICE
        for at in range(ORDER, len(data), size):
            out[:, k] += _code_lengths([(data[at - ORDER : at], data[at : at + size])], model)[:, 0]
    return out


def _code_lengths(parts: list[tuple[bytes, bytes]], model: Model) -> np.ndarray:
    """Bits in each language of bytes that follow ORDER others."""
    data = np.frombuffer(b"".join(x for part in parts for x in part), np.uint8)
    lengths = np.array([len(own) for _, own in parts])
    ends = np.cumsum(lengths + ORDER)
    out = np.zeros((len(model.languages), len(parts)))
    there = np.flatnonzero(lengths)
    if not len(there):
        return out
    wide = data.astype(np.int64)
    gram = wide[:-3] << 24
    gram |= wide[1:-2] << 16
    gram |= wide[2:-1] << 8
    gram |= wide[3:]
    del wide
    # gram[i] belongs to byte i + 3; sums from a part's first byte to its end, what stands before it left out.
    borders = np.stack([ends[there] - lengths[there] - ORDER, ends[there] - ORDER], 1).reshape(-1)
    borders = borders[:-1] if borders[-1] >= len(gram) else borders
    row = model.levels[ORDER].grams.find(gram)
    new = np.flatnonzero(row < 0)
    extra, back = np.unique(gram[new], return_inverse=True)
    row[new] = model.bits.shape[1] + back
    bits = np.concatenate([model.bits, model.costs(extra).T.astype(np.float32)], 1) if len(extra) else model.bits
    for k in range(len(model.languages)):
        out[k, there] = np.add.reduceat(bits[k][row], borders, dtype=np.float64)[::2]
    return out


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all but the text, if not given), lang_pred and score."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(model)

    def function():  # noqa: ANN202
        learned = shared.value

        def worker(texts, rows):  # noqa: ANN001, ANN202, ARG001
            if not learned.languages:
                return {"lang_pred": [UNDETERMINED] * len(texts), "score": [0.0] * len(texts)}
            bits = code_lengths(texts, learned)
            best = bits.argmin(0)
            score = 1 / np.exp2(np.maximum(bits.min(0) - bits, -1000)).sum(0)
            letters = [LETTER.search(t) is not None for t in texts]
            return {"lang_pred": [learned.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)], "score": np.where(letters, score, 0.0)}

        return worker

    return map_texts(df, text_col, keep, "lang_pred string, score double", function, common.NARROW_SLICE)
