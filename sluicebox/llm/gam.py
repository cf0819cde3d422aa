"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text (see FEATURES) falls into one of some bins, and has a table with a value for each bin; some pairs of features
have a table too. The score is the logistic of the sum of the table entries: vectorised bin additions.
Every feature means the same for texts of any length; top_pair is the share of the most frequent pair of neighbouring words.

The tables are learned by boosting that goes round the features in turn: on each visit a tree of at most three leaves,
fitted to the gradients' histogram of that feature alone, is added to its table with a small rate. Then the pairs with the
largest gain over what is left get tables of their own, by trees that cut each of the two features once.

Learning takes a bounded sample of labelled rows (`max_rows` in expectation, by a hash of doc_id), whose features reach the driver.
Null texts count as empty and are scored; an empty table gives no rows. Without labels of both classes, the score is the share of 1s, or
0.5. Labels that occur twice for a document count as one, the larger; of documents that repeat an id, with whatever texts, the one
with the least features is learned from. All are scored. A kept column with the name of a result gives way to it.
A very long text is held with its words and pairs, some 40 bytes per byte.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MAX_ROWS = 20_000
BINS = 32
WINDOW = 256
FEATURES = (
    "log_bytes", "upper_share", "digit_share", "symbol_share", "space_share", "line_share", "word_length", "distinct_words", "top_word",
    "repeated_words", "bang_share", "pipe_share", "beyond_ascii", "distinct_lines", "window_upper", "window_symbols", "window_letters", "symbols_per_word", "top_pair",
)


def _kinds() -> np.ndarray:
    """Rows of flags by byte: upper case, lower case, digit, odd sign, blank, line end, !, |, beyond ASCII."""
    out = np.zeros((9, 256), bool)
    out[0, 65:91] = out[1, 97:123] = out[2, 48:58] = out[8, 128:] = True
    out[3, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"?-()"]] = True
    out[4, 32] = out[5, 10] = out[6, 33] = out[7, 124] = True
    return out


KINDS = _kinds()


def features(texts: list[str]) -> np.ndarray:
    """One row per text, columns as in FEATURES."""
    out = np.zeros((len(texts), len(FEATURES)))
    encoded = [t.encode() for t in texts]
    lengths = np.array([len(e) for e in encoded], np.int64)
    there = np.flatnonzero(lengths)
    if len(there):
        data = np.frombuffer(b"".join(encoded), np.uint8)
        begins = (np.cumsum(lengths) - lengths)[there]
        size = lengths[there].astype(float)
        # Windows of equal size from each text's beginning.
        windows = [np.arange(b, b + n, WINDOW) for b, n in zip(begins.tolist(), lengths[there].tolist(), strict=True)]
        first = np.cumsum([len(w) for w in windows]) - [len(w) for w in windows]
        windows = np.concatenate(windows)
        wide = np.diff(np.append(windows, len(data))).astype(float)
        count, worst = [], []
        for kind in KINDS:
            flags = kind[data].view(np.uint8)
            part = np.add.reduceat(flags, windows, dtype=np.int64)
            count.append(np.add.reduceat(part, first))
            worst.append(np.maximum.reduceat(np.where(wide >= WINDOW / 4, part / wide, 0), first))
        upper, lower, digit, odd, blank, line, bang, pipe, beyond = count
        letters = np.maximum(upper + lower + beyond / 2, 1)
        out[there, 0] = np.log1p(size)
        for column, value in ((1, upper / letters), (2, digit / size), (3, odd / size), (4, blank / size), (5, line / size), (10, bang / size), (11, pipe / size), (12, beyond / size), (14, worst[0]), (15, worst[3]), (16, (letters / size))):
            out[there, column] = value
        for i, k in zip(there.tolist(), odd.tolist(), strict=True):
            words = texts[i].split()
            n = max(len(words), 1)
            tally = Counter(words)
            pairs = Counter(map(hash, zip(words, words[1:], strict=False)))
            lines = texts[i].split("\n")
            out[i, 6] = lengths[i] / n
            out[i, 7] = len(tally) / n
            out[i, 8] = max(tally.values(), default=0) / n
            out[i, 9] = sum(map(eq, words, words[1:])) / n
            out[i, 13] = len(set(lines)) / len(lines)
            out[i, 17] = k / n
            out[i, 18] = max(pairs.values(), default=0) / n
    return out


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: np.ndarray  # feature, bin
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray  # pair, bin, bin

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, k], "right") for k, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(rows), 0), int)

    def score(self, rows: np.ndarray) -> np.ndarray:
        bins = self.bins(rows)
        total = np.full(len(rows), self.intercept)
        for k in range(bins.shape[1]):
            total += self.tables[k, bins[:, k]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[bins[:, a], bins[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray, begin: int, end: int) -> tuple[float, int]:
    """(gain, place) of the best cut of bins begin to end."""
    left_g, left_h = np.cumsum(g[begin:end])[:-1], np.cumsum(h[begin:end])[:-1]
    if not len(left_g):
        return 0.0, begin
    all_g, all_h = g[begin:end].sum(), h[begin:end].sum()
    gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
    k = int(gains.argmax())
    return float(gains[k]), begin + k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of at most three leaves."""
    n = len(g)
    gain, middle = _cut(g, h, 0, n)
    cuts = [0, n] if gain <= 0 else [0, middle, n]
    if gain > 0:
        more, place = max(_cut(g, h, 0, middle), _cut(g, h, middle, n))
        if more > 0:
            cuts = sorted({*cuts, place})
    out = np.zeros(n)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values by bin pair) of the best tree that cuts each of two features once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best = None
    total = 0.0
    parts = []
    for c in (cg, ch):
        a = c[:-1, :-1]
        parts.append((a, c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a))
    for pg, ph in zip(*parts, strict=True):
        total = total + _gain(pg, ph)
    i, j = np.unravel_index(int(total.argmax()), total.shape)
    best = [float(_leaf(pg[i, j], ph[i, j])) for pg, ph in zip(*parts, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = best
    return float(total[i, j] - _gain(cg[-1, -1], ch[-1, -1])), out


def train(rows: np.ndarray, labels: np.ndarray, rounds: int = 120, pair_rounds: int = 40, pairs: int = 8, rate: float = 0.15) -> Model:
    """Boosts the tables on feature rows and 0/1 labels."""
    if not len(labels) or labels.min() == labels.max():
        share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
        return Model(float(np.log(share / (1 - share))), [], np.zeros((0, BINS)), [], np.zeros((0, BINS, BINS)))
    edges = [np.unique(np.quantile(rows[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(rows.shape[1])]
    share = labels.mean()
    model = Model(float(np.log(share / (1 - share))), edges, np.zeros((rows.shape[1], BINS)), [], np.zeros((0, BINS, BINS)))
    bins = model.bins(rows)
    total = np.full(len(labels), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(bins.shape[1]):
            g, h = gradients()
            table = rate * _tree(np.bincount(bins[:, k], g, BINS), np.bincount(bins[:, k], h, BINS))
            model.tables[k] += table
            total += table[bins[:, k]]
    g, h = gradients()
    both = lambda a, b, x: np.bincount(bins[:, a] * BINS + bins[:, b], x, BINS * BINS).reshape(BINS, BINS)
    gains = sorted(((_quarters(both(a, b, g), both(a, b, h))[0], a, b) for a in range(bins.shape[1]) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:pairs] if gain > 0]
    model.pair_tables = np.zeros((len(model.pairs), BINS, BINS))
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            g, h = gradients()
            table = rate * _quarters(both(a, b, g), both(a, b, h))[1]
            model.pair_tables[k] += table
            total += table[bins[:, a], bins[:, b]]
    return model


def text_features(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` and the features of the text, an array."""

    def function():  # noqa: ANN202
        return lambda texts, rows: {"features": list(features(texts))}  # noqa: ARG005

    return map_texts(df, text_col, keep or [], "features array<double>", function)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", key: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Learns from the labelled rows of docs."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(label_col).cast("int").alias("__label"))
    n = marked.count()
    share = 1 << 30 if n <= max_rows else round((1 << 30) * max_rows / n)
    # At most about max_rows rows of two numbers: a proven bound for the broadcast.
    chosen = marked.filter(F.pmod(F.xxhash64("__key", F.lit(29)), F.lit(1 << 30)) < share)
    rows = docs.select(F.col(key).alias("__key"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__key")
    # One row of features for each key, however often it occurs: tasks combine before rows are moved.
    got = text_features(rows, "__text", ["__key", "__label"]).groupBy("__key", "__label").agg(F.min("features").alias("features")).orderBy("__key").toPandas()
    return train(np.array(got["features"].tolist(), float).reshape(len(got), len(FEATURES)), got["__label"].to_numpy(float))


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all but the text, if not given), score and predicted."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep

    def function():  # noqa: ANN202
        def worker(texts, rows):  # noqa: ANN001, ANN202, ARG001
            value = model.score(features(texts))
            return {"score": value, "predicted": (value >= threshold).astype(np.int32)}

        return worker

    return map_texts(df, text_col, keep, "score double, predicted int", function)
