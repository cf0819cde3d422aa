"""Byte-level BPE as a monoid: halves are encoded recursively and joined at their border; decoding joins bytes up a tree.

An element of the monoid is a string with its encoding. A text is halved until its parts have at most `leaf` characters; parts
are encoded alone, and neighbours are joined, level by level, by encoding a window around their border anew. All tokens outside
the window stay, and that is proved, not hoped for:

* Firm borders. The pattern divides a text into runs of letters, of numbers and of other signs, each with at most one space
  before it, into white space, and into contractions (an apostrophe and letters). So wherever a sign that is no white space meets
  one of another of the four classes, no match spans the place, except for an apostrophe before a letter. The matches to the left
  look no further than that place, and the pattern never looks back: tokens on either side of a firm border depend on their own
  side alone. A window that reaches from the firm border before the middle to the one after it is enough; a middle that
  is firm itself needs none.
* Growing windows. Where firm borders are far away (a long run of one class is one match), the window grows by doubling from the middle
  until each of its outer tokens stays apart from the old token beside it, that is, if the two merged alone give these two
  again. A sequence of tokens is what merging yields if and only if this holds for each two neighbours, so the old tokens
  outside, the window's, and their two seams together are the encoding of the whole run.
* A long stretch with white space or an apostrophe inside is encoded from firm border to firm border.

The classes of code points are asked of the library itself; code points it may not know have no firm border beside them.
Encodings lie in one array by byte: a token's id stands where it begins, so a join writes its window and nothing else, and all joins of a
level are written at once. The rule is the same for every text, of any length and script.

Null texts count as empty: no ids, and the digests of the empty string. Repeated rows are each encoded; an empty table gives no rows. A kept
column with the name of a result gives way to it. Work arrays take some 60 bytes per byte of a slice of texts or of a block of a long one.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from . import common
from .common import map_texts
from .tokenizer_files import encoding, vocabulary

#: Characters that one leaf encodes: some words.
LEAF = 32
#: Windows of up to so many characters are encoded whole; longer ones begin with so many bytes on each side of the middle.
WINDOW = 64
WHITE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: Code points beyond the last assigned ones of the planes asked about.
ASKED = 0x323B0


@functools.cache
def code_point_classes() -> bytes:
    """Class of each code point below ASKED as the library's pattern treats it, compressed; asked by one long probe for each class.

    In the probing vocabulary a mark and any byte after it are one token, if they stand in one match.
    """
    points = [c for c in range(ASKED) if not 0xD800 <= c < 0xE000]
    classes = np.full(ASKED, UNKNOWN, np.uint8)
    classes[points] = WHITE
    singles = {bytes([b]): b for b in range(256)}
    for mark, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
        pairs = {mark.encode() + bytes([b]): 256 + b for b in range(256)}
        probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=singles | pairs, special_tokens={})
        # Each probe: the mark, the code point, a line end. Bytes of code points never merge with each other.
        ids = np.array(probe.encode_ordinary("".join(f"{mark}{chr(c)}\n" for c in points)))
        width = np.array([len(chr(c).encode()) for c in points]) + 2
        begins = np.cumsum(width) - width
        at = np.cumsum(np.where(ids >= 256, 2, 1)) - np.where(ids >= 256, 2, 1)
        joined = np.zeros(int(width.sum()), bool)
        joined[at[ids >= 256]] = True
        classes[np.array(points)[joined[begins]]] = kind
    return zlib.compress(classes.tobytes())


@functools.cache
def class_table(classes: bytes) -> np.ndarray:
    table = np.full(0x110000, UNKNOWN, np.uint8)
    table[:ASKED] = np.frombuffer(zlib.decompress(classes), np.uint8)
    return table


def firm_borders(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether the place before each code point is a firm border (the first isn't)."""
    firm = np.zeros(len(points), bool)
    left, right = classes[:-1], classes[1:]
    firm[1:] = (left != right) & (left != WHITE) & (left != UNKNOWN) & (right != UNKNOWN) & ~((points[:-1] == ord("'")) & (right == LETTER))
    return firm


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one after the other."""
    upto = np.cumsum(sizes)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(begins - upto + sizes, sizes)


class Windows(dict):
    """Encodings of windows: most hold one word, and words come again. Emptied when it has `most`."""

    def __init__(self, encode: Callable[[str], list[int]], most: int = 1 << 16) -> None:
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, window: str) -> list[int]:
        if len(self) >= self.most:
            self.clear()
        found = self[window] = self.encode(window)
        return found


class Encoder:
    def __init__(self, codec: tiktoken.Encoding, tokens: list[bytes], classes: np.ndarray, leaf: int = LEAF, window: int = WINDOW) -> None:
        self.codec, self.tokens, self.classes, self.leaf, self.window = codec, tokens, classes, leaf, window
        self.widths = np.array([len(t) for t in tokens], np.int64)
        self.core = codec._core_bpe.encode_ordinary
        self.windows = Windows(self.core)
        self.stay: dict[tuple[int, int], bool] = {}

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay as they are."""
        if (known := self.stay.get((left, right))) is None:
            if len(self.stay) > 200_000:
                self.stay.clear()
            known = self.stay[left, right] = self.codec._encode_single_piece(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the levels of all texts' trees are gone through together. Long texts go in blocks between firm borders."""
        if max(map(len, texts), default=0) > common.LONG:
            return [np.concatenate([self._encode_all([b])[0] for b in common.at_blanks(t)]) if len(t) > common.LONG else self._encode_all([t])[0] for t in texts]
        return self._encode_all(texts)

    def _encode_all(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        n = len(points)
        ends = np.cumsum([len(t) for t in texts])
        if not n:
            return [np.zeros(0, "<u4") for _ in texts]
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.concatenate([[0], np.cumsum(width)])
        kind = self.classes[points]
        firm = np.append(firm_borders(points, kind), False)
        place = np.arange(n + 1)
        before = np.maximum.accumulate(np.where(firm, place, 0))
        after = np.minimum.accumulate(np.where(firm, place, n)[::-1])[::-1]
        leaves, levels = self._tree(ends)
        ids = np.full(int(byte_at[-1]), -1, np.int64)
        flat: list[int] = []
        for b, e in zip(leaves[0].tolist(), leaves[1].tolist(), strict=True):
            flat += self.core(whole[b:e])
        found = np.array(flat, np.int64)
        ids[np.cumsum(self.widths[found]) - self.widths[found]] = found
        for b, m, e in reversed(levels):
            f, u = np.maximum(before[m], b), np.minimum(after[m], e)
            near = (u - f <= self.window) & (u > f)
            self._write(ids, byte_at, f[near], [self.windows[whole[x:y]] for x, y in zip(f[near].tolist(), u[near].tolist(), strict=True)], u[near])
            for k in np.flatnonzero(u - f > self.window).tolist():
                self._grow(ids, byte_at, whole, kind, int(f[k]), int(m[k]), int(u[k]))
        spans = byte_at[np.concatenate([[0], ends])]
        return [(own := ids[a:b])[own >= 0].astype("<u4") for a, b in zip(spans[:-1].tolist(), spans[1:].tolist(), strict=True)]

    def _tree(self, ends: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """(begins and ends of all leaves in order, per level begins, middles and ends of the nodes that join two)."""
        b, e = np.concatenate([[0], ends[:-1]]), ends
        b, e = b[e > b], e[e > b]
        leaves, levels = [], []
        while len(b):
            small = e - b <= self.leaf
            leaves.append((b[small], e[small]))
            b, e = b[~small], e[~small]
            m = (b + e) // 2
            if len(b):
                levels.append((b, m, e))
            b, e = np.concatenate([b, m]), np.concatenate([m, e])
        begins, ends = (np.concatenate(x) for x in zip(*leaves, strict=True))
        order = np.argsort(begins)
        return (begins[order], ends[order]), levels

    def _write(self, ids: np.ndarray, byte_at: np.ndarray, f: np.ndarray, windows: list[list[int]], u: np.ndarray) -> None:
        """The tokens of windows [f, u) in place of those that were there."""
        if not len(f):
            return
        begin = byte_at[f]
        ids[_ranges(begin, byte_at[u] - begin)] = -1
        count = np.array([len(w) for w in windows])
        found = np.array([x for w in windows for x in w], np.int64)
        upto = np.cumsum(self.widths[found]) - self.widths[found]
        ids[upto - np.repeat(upto[np.cumsum(count) - count], count) + np.repeat(begin, count)] = found

    def _grow(self, ids: np.ndarray, byte_at: np.ndarray, whole: str, kind: np.ndarray, f: int, m: int, u: int) -> None:
        """Joins at the middle of a long stretch between firm borders."""
        run = f + (whole[f] == " ")
        if kind[run] in (WHITE, UNKNOWN) or (kind[run:u] != kind[run]).any():
            self._write(ids, byte_at, np.array([f]), [self.core(whole[f:u])], np.array([u]))
            return
        first, middle, last = (int(byte_at[x]) for x in (f, m, u))
        data = whole[f:u].encode()
        left = right = self.window
        while True:
            low, high = self._token_before(ids, max(first, middle - left), first), self._token_after(ids, min(last, middle + right), last)
            window = self.codec._encode_single_piece(data[low - first : high - first])
            low_ok = low == first or self.apart(int(ids[self._token_before(ids, low - 1, first)]), window[0])
            high_ok = high == last or self.apart(window[-1], int(ids[high]))
            if low_ok and high_ok:
                break
            left, right = left * (1 if low_ok else 2), right * (1 if high_ok else 2)
        ids[low:high] = -1
        found = np.array(window, np.int64)
        ids[low + np.cumsum(self.widths[found]) - self.widths[found]] = found

    @staticmethod
    def _token_before(ids: np.ndarray, at: int, least: int) -> int:
        """The last place up to `at` where a token begins."""
        while at > least and ids[at] < 0:
            at -= 1
        return at

    @staticmethod
    def _token_after(ids: np.ndarray, at: int, most: int) -> int:
        while at < most and ids[at] < 0:
            at += 1
        return at

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: each token's, neighbours joined level by level up the tree."""
        parts = [self.tokens[i] for i in ids.tolist()]
        while len(parts) > 1:
            odd = parts[-1:] if len(parts) % 2 else []
            parts = [a + b for a, b in zip(parts[::2], parts[1::2], strict=False)] + odd
        return parts[0] if parts else b""


@functools.cache
def encoder(name: str, classes: bytes) -> Encoder:
    """One per process."""
    ranks = vocabulary(name)[0]
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Encoder(encoding(name), tokens, class_table(classes))


def encode_texts(df: DataFrame, text_col: str = "text", vocabulary_file: str = "byte_bpe_multi_50k.tiktoken", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all but the text, if not given) and ids, the tokens of the text."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    classes = code_point_classes()

    def function():  # noqa: ANN202
        codec = encoder(vocabulary_file, classes)
        return lambda texts, rows: {"ids": [ids.astype(np.int32) for ids in codec.encode_all(texts)]}  # noqa: ARG005

    return map_texts(df, text_col, keep, "ids array<int>", function)


def round_trip(df: DataFrame, text_col: str = "text", vocabulary_file: str = "byte_bpe_multi_50k.tiktoken", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep`, n_tokens, and the digests of the ids and of the bytes that decoding them gives."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    classes = code_point_classes()

    def function():  # noqa: ANN202
        codec = encoder(vocabulary_file, classes)

        def worker(texts, rows):  # noqa: ANN001, ANN202, ARG001
            found = codec.encode_all(texts)
            return {
                "n_tokens": [len(ids) for ids in found],
                "ids_sha256": [hashlib.sha256(ids.tobytes()).hexdigest() for ids in found],
                "decoded_sha256": [hashlib.sha256(codec.decode(ids)).hexdigest() for ids in found],
            }

        return worker

    return map_texts(df, text_col, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", function)
