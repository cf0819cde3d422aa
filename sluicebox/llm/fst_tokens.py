"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers annotate transitions with what they emit:

* `Splitter` reads code points and emits the borders between pre-tokens. Texts are laid side by side and cut
  into chunks of equal length; each chunk is run from every state at once until all runs have met (they meet
  at the first plain letter), which gives its state map. The maps are composed by a parallel prefix scan, so
  each chunk learns its true start state, and one more run emits the borders.
* `Counter` reads the bytes of a pre-token and annotates each transition with the change of the number of
  tokens that byte-pair merging gives for what was read so far. Its states are built when first met and kept,
  as lazy automata do; all pre-tokens of a slice step through it side by side.

Why `Counter` is exact: a sequence of tokens is what merging yields if and only if each two neighbours,
merged alone, stay as they are; so the tokens of a prefix are those of a shorter prefix and one more. A state
holds, for every suffix of what was read that a longer token may still cover, the last token before that suffix
and how many tokens fewer there were. Nothing else bears on what follows, and equal states are one state.

Special strings count as one token each and divide the text, as the library does by default.
Null texts count as empty: 0 bytes, 0 tokens. Repeated rows are counted each; an empty table gives no rows; a kept column with the name of a
result gives way to it. Long texts go in blocks between places that no pre-token spans; work arrays take some 60 bytes per byte of a slice or
block. The transducer holds MAX_STATES states, and those that one step of all pieces of a block adds; then it starts anew from where it is.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from . import common
from .common import map_texts
from .tokenizer_files import encoding, path, vocabulary

#: States of a Counter before it starts anew; bounds memory, not results.
MAX_STATES = 400_000
#: Pre-tokens up to so many bytes run side by side; longer ones one after the other, through the same transitions.
SIDE_BY_SIDE = 48
CHUNK = 1024

SPACE, WHITE, LETTER, SINGLE, R, V, L, E, NUMBER, QUOTE, OTHER, END = range(12)
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_QUOTE, AFTER_R, AFTER_V, AFTER_L, IN_SPACE, IN_WHITE = range(10)
STATES = 10
#: Emitted: a pre-token begins here; a pre-token begins one code point earlier.
HERE, BEFORE = 1, 2
COUNTED = 0x323B0


@functools.cache
def code_point_classes(name: str) -> np.ndarray:
    """Class of each code point as the library's own pre-tokenizer treats it; asked once, by three long probes."""
    split = Tokenizer.from_file(path(name)).pre_tokenizer.pre_tokenize_str
    points = [c for c in range(COUNTED) if not 0xD800 <= c < 0xE000]

    def joined(mark: str) -> set[int]:
        """Code points that stand in one pre-token with the mark before them."""
        probe = "".join(f"{mark}{chr(c)}\n" for c in points)
        first = {a for _, (a, b) in split(probe) if b - a >= 2 and probe[a] == mark}
        return {c for i, c in enumerate(points) if 3 * i in first}

    classes = np.full(0x110000, OTHER, np.uint8)
    letters, numbers, others = joined("a"), joined("1"), joined("!")
    for c in points:
        classes[c] = LETTER if c in letters else NUMBER if c in numbers else OTHER if c in others else WHITE
    for letter, kind in (*((x, SINGLE) for x in "stmd"), ("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE), (" ", SPACE)):
        classes[ord(letter)] = kind
    return classes


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Tables (next state, emitted) by class * 16 + state, for the pattern of byte-level vocabularies."""
    run_of = dict.fromkeys((LETTER, SINGLE, R, V, L, E), IN_LETTERS) | {NUMBER: IN_NUMBERS, OTHER: IN_OTHER, QUOTE: AFTER_QUOTE, SPACE: IN_SPACE, WHITE: IN_WHITE, END: BEGIN}
    following, emitted = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for state in range(STATES):
        for kind in range(12):
            new, out = run_of[kind], HERE
            if state in (IN_SPACE, IN_WHITE):
                if kind in (SPACE, WHITE):
                    out = 0
                elif kind != END:
                    # All but the last white space stand alone; a last space joins what follows.
                    out = BEFORE if state == IN_SPACE else BEFORE | HERE
                    if state == IN_SPACE and kind == QUOTE:
                        new = IN_OTHER
            elif (state == IN_LETTERS and new == IN_LETTERS) or (state == IN_NUMBERS and kind == NUMBER):
                out = 0
            elif state == IN_OTHER and kind in (OTHER, QUOTE):
                new, out = IN_OTHER, 0
            elif state == AFTER_QUOTE:
                if kind == SINGLE:
                    new, out = BEGIN, 0
                elif kind in (R, V, L):
                    new, out = {R: AFTER_R, V: AFTER_V, L: AFTER_L}[kind], 0
                elif kind in (OTHER, QUOTE):
                    new, out = IN_OTHER, 0
            elif (state, kind) in ((AFTER_R, E), (AFTER_V, E), (AFTER_L, L)):
                new, out = BEGIN, 0
            elif state in (AFTER_R, AFTER_V, AFTER_L):
                # No contraction after all: the letter read before begins a word.
                out = BEFORE | (0 if new == IN_LETTERS else HERE)
            following[kind * 16 + state], emitted[kind * 16 + state] = new, out
    return following, emitted


FOLLOWING, EMITTED = _splitter()


def chunk_maps(columns: np.ndarray) -> np.ndarray:
    """State map of each chunk (a column of classes): end state by start state."""
    steps, chunks = columns.shape
    out = np.repeat(np.arange(STATES, dtype=np.uint8)[None], chunks, 0)
    apart = np.arange(chunks)
    met = np.zeros(chunks, np.uint8)
    met_at = np.full(chunks, steps)
    for k in range(steps):
        if not len(apart):
            break
        now = FOLLOWING[(columns[k, apart] << 4)[:, None] | out[apart]]
        out[apart] = now
        one = (now == now[:, :1]).all(1)
        met[apart[one]], met_at[apart[one]] = now[one, 0], k + 1
        apart = apart[~one]
    one = met_at < steps
    state = met.copy()
    for k in range(int(met_at.min(initial=steps)), steps):
        state = np.where(met_at <= k, FOLLOWING[(columns[k] << 4) | state], state)
    out[one] = state[one, None]
    return out


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Map of each chunk with all before it, in log2(chunks) rounds of composition."""
    maps, gap = maps.copy(), 1
    while gap < len(maps):
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap], 1)
        gap *= 2
    return maps


def borders(classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin (END included), for a sequence of classes."""
    n = len(classes)
    chunks = -(-n // CHUNK)
    columns = np.full(chunks * CHUNK, END, np.uint8)
    columns[:n] = classes
    columns = np.ascontiguousarray(columns.reshape(chunks, CHUNK).T)
    scanned = prefix_scan(chunk_maps(columns))
    state = np.concatenate([[np.uint8(BEGIN)], scanned[:-1, BEGIN]])
    emitted = np.empty_like(columns)
    for k in range(CHUNK):
        cell = (columns[k] << 4) | state
        emitted[k], state = EMITTED[cell], FOLLOWING[cell]
    emitted = np.ascontiguousarray(emitted.T).reshape(-1)[:n]
    begins = (emitted & HERE).astype(bool)
    begins[:-1] |= (emitted[1:] & BEFORE) > 0
    return np.flatnonzero(begins)


class Counter:
    """Transducer over bytes; each transition tells how many tokens more (or fewer) the prefix now has."""

    def __init__(self, name: str) -> None:
        self.name, self.ranks = name, vocabulary(name)[0]
        self.piece = encoding(name)._encode_single_piece
        self.tokens = {v: k for k, v in self.ranks.items()}
        #: Trie of the tokens: node << 8 | byte -> node; rank of the token that a node spells; nodes that go on.
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        inner = set()
        for token, rank in self.ranks.items():
            node = 0
            for b in token:
                inner.add(node)
                node = self.child.setdefault(node << 8 | b, len(self.child) + 1)
            self.token_at[node] = rank
        self.inner = inner
        self.clear()

    def clear(self) -> None:
        #: A state: (node, token before it, tokens fewer then) for each suffix that may grow, longest first, flat.
        self.info: list[tuple[int, ...]] = [(0, -1, 0)]
        self.state_of = {self.info[0]: 0}
        self.kept: dict[int, int] = {}
        self.stable: dict[int, bool] = {}
        self.bits = 18
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)

    def restarted(self, states: np.ndarray) -> np.ndarray:
        """Forgets all states but the given ones; tells their new numbers."""
        wanted, back = np.unique(states, return_inverse=True)
        kept = [self.info[i] for i in wanted.tolist()]
        self.clear()
        return np.array([self._state(x) for x in kept], np.int64)[back]

    def _state(self, info: tuple[int, ...]) -> int:
        state = self.state_of.get(info)
        if state is None:
            state = self.state_of[info] = len(self.info)
            self.info.append(info)
        return state

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay as they are."""
        pair = left << 20 | right
        if (known := self.stable.get(pair)) is None:
            known = self.stable[pair] = self.piece(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def step(self, key: int) -> int:
        """The transition of state << 8 | byte: next state << 10 | change of the count + 512."""
        if (known := self.kept.get(key)) is not None:
            return known
        info, byte = self.info[key >> 8], key & 255
        token, grown, change = -1, [], 0
        for i in range(0, len(info), 3):
            node, before, fewer = info[i : i + 3]
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            if token < 0 and (rank := self.token_at.get(node)) is not None and (before < 0 or self.apart(before, rank)):
                token, change = rank, fewer + 1
            if node in self.inner:
                grown.append((node, before, fewer))
        new = tuple(x for node, before, fewer in grown for x in (node, before, fewer - change)) + (0, token, 0)
        state = self._state(new)
        if not -512 <= change < 512:
            raise OverflowError("a transition changes the count by more than ten bits hold")
        known = self.kept[key] = state << 10 | change + 512
        return known

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _keep(self, keys: np.ndarray, values: np.ndarray) -> None:
        if len(self.kept) * 2 > len(self.keys):
            self.bits = len(self.kept).bit_length() + 2
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
            keys, values = np.fromiter(self.kept.keys(), np.int64), np.fromiter(self.kept.values(), np.int64)
        at, mask = self._slots(keys), len(self.keys) - 1
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & mask

    def steps(self, keys: np.ndarray) -> np.ndarray:
        """Transitions for many keys; unknown ones are built."""
        at, mask = self._slots(keys), len(self.keys) - 1
        out = self.values[at]
        open_ = np.flatnonzero(self.keys[at] != keys)
        unknown = []
        while len(open_):
            there = self.keys[at[open_]]
            unknown.append(open_[there < 0])
            open_ = open_[there >= 0]
            at[open_] = (at[open_] + 1) & mask
            found = self.keys[at[open_]] == keys[open_]
            out[open_[found]] = self.values[at[open_[found]]]
            open_ = open_[~found]
        if unknown and len(new := np.concatenate(unknown)):
            wanted, back = np.unique(keys[new], return_inverse=True)
            got = np.array([self.step(k) for k in wanted.tolist()], np.int64)
            out[new] = got[back]
            self._keep(wanted, got)
        return out

    def count(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[begin : begin + length]."""
        if len(self.info) > MAX_STATES:
            self.clear()
        out = np.zeros(len(begins), np.int64)
        order = np.argsort(-lengths, kind="stable")
        many = int(np.searchsorted(-lengths[order], -SIDE_BY_SIDE, "left"))
        for i in order[:many].tolist():
            state = total = 0
            kept, step = self.kept.get, self.step
            for b in data[begins[i] : begins[i] + lengths[i]].tobytes():
                got = kept(state << 8 | b)
                if got is None:
                    if len(self.info) > MAX_STATES:
                        state = int(self.restarted(np.array([state]))[0])
                        kept = self.kept.get
                    got = step(state << 8 | b)
                state = got >> 10
                total += (got & 1023) - 512
            out[i] = total
        order = order[many:]
        state, total, at = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), begins[order]
        longest = lengths[order]
        active = len(order)
        for k in range(int(longest[0]) if active else 0):
            active = int(np.searchsorted(-longest[:active], -k, "left"))
            if len(self.info) > MAX_STATES:
                state[:active] = self.restarted(state[:active])
            got = self.steps(state[:active] << 8 | data[at[:active] + k])
            state[:active] = got >> 10
            total[:active] += (got & 1023) - 512
        out[order] = total
        return out


@functools.cache
def counter(name: str) -> Counter:
    return Counter(name)


@functools.cache
def unpacked(classes: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(classes), np.uint8)


def count_tokens(texts: list[str], name: str, classes_of: np.ndarray | None = None) -> np.ndarray:
    """Tokens of each text. classes_of: code_point_classes(name), where they are at hand."""
    if max(map(len, texts), default=0) > common.LONG:
        return np.array([sum(int(_count_tokens([b], name, classes_of)[0]) for b in common.at_blanks(t)) for t in texts], np.int64)
    return _count_tokens(texts, name, classes_of)


def _count_tokens(texts: list[str], name: str, classes_of: np.ndarray | None) -> np.ndarray:
    special = vocabulary(name)[1]
    extra = np.zeros(len(texts), np.int64)
    parts, owner = texts, None
    if special and any(s in t for s in special for t in texts):
        cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        parts, owner = [], []
        for i, text in enumerate(texts):
            pieces = cut.split(text)
            extra[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
    joined = "\n".join(parts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    classes = (code_point_classes(name) if classes_of is None else classes_of)[points]
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    classes[ends] = END
    begins = borders(classes)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offset = np.cumsum(width) - width
    del width, points
    at = offset[begins]
    lengths = np.diff(np.append(at, offset[-1] + 1))
    real = classes[begins] != END
    data = np.frombuffer(joined.encode(), np.uint8)
    counts = np.zeros(len(begins) + 1, np.int64)
    counts[1:][real] = counter(name).count(data, at[real], lengths[real])
    upto = np.cumsum(counts)[np.searchsorted(begins, ends, "right")]
    per_part = np.diff(upto, prepend=0)
    if owner is not None:
        np.add.at(extra, owner, per_part)
        return extra
    return per_part


def token_counts(df: DataFrame, text_col: str = "text", vocabulary_file: str = "byte_bpe_50k.json", limit: int = 512, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all but the text, if not given), n_bytes, n_tokens and over_limit of each text."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep

    # The driver asks the library once; a table of a byte per code point shrinks to some kilobytes.
    classes = zlib.compress(code_point_classes(vocabulary_file).tobytes())

    def function():  # noqa: ANN202
        def worker(texts, rows):  # noqa: ANN001, ANN202, ARG001
            n = count_tokens(texts, vocabulary_file, unpacked(classes))
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": n > limit}

        return worker

    return map_texts(df, text_col, keep, "n_bytes long, n_tokens long, over_limit boolean", function)
