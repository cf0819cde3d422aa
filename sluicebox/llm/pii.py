"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, plus signs, digits, schemes and identifier cues.
From each anchor a deterministic local parser expands to the left and right, validates and gives a span, so the rest of the text
is never looked at. Base kinds follow their patterns exactly, leftmost and without overlap within a kind:

* email: from an at-sign, local part to the left (not into the last match), domain with a dot to the right.
* ip: from the first digit of a run; four parts of at most 255.
* card: from the first digit of a chain of digits with single blanks or hyphens; 13 to 19 digits and a right check digit.
* phone: from a plus sign; 9 to 15 digits.

Added kinds: url (a scheme and its host), iban (a country code and two digits, right by its check digits),
secret (an access key id, or the value that a cue such as `password` gets by `=` or `:`, in any case, with or without blanks and
quotes: `token = "..."`; six characters at least, in quotes up to the closing one). Added spans never remove base ones.

Null texts count as empty and have no spans. Offsets are code points, ends exclusive. Repeated rows are each scanned; an empty table gives
no rows; a kept column with the name of a result gives way to it. Each kind goes on where its last match ended, so the time
grows with the text's length, however many anchors it holds.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_texts

#: The kinds, in the order in which spans are listed.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "secret")
CUES = ("password", "passwd", "secret", "token", "api_key", "api-key", "apikey", "secret_key", "access_key")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HOST = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s<>\"']*)?")
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
VALUE = re.compile(r"[\"']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:([\"'])(?P<quoted>(?:(?!\1)[^\\\n]|\\.){6,}+)\1|[\"']?(?P<bare>[^\s,;\"'<>]{6,}))")
DIGITS = frozenset("0123456789")


@functools.cache
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ("@", "+", "://", "akia", *"0123456789", *CUES):
        found.add_word(word, word)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def lowered(text: str) -> str:
    """The text in lower case, each code point in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.replace("\u0130", "\0").lower()  # the one that would become two


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """An account number whose first check digit stands at `at`."""
    begin = at - 2
    if begin < 0 or not (text[begin].isascii() and text[begin].isupper() and text[begin + 1].isascii() and text[begin + 1].isupper()) or (begin and text[begin - 1].isalnum()):
        return None
    if not (m := ACCOUNT.match(text, begin)):
        return None
    code = m[0].replace(" ", "")
    if not 15 <= len(code) <= 34 or int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 != 1:
        return None
    return m.span()


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    end = dict.fromkeys(out, 0)  # where each kind may go on

    def add(kind: str, begin: int, upto: int) -> None:
        if begin >= end[kind]:
            out[kind].append((begin, upto))
            end[kind] = upto

    for last, word in anchors().iter(lowered(text)):
        at = last - len(word) + 1
        if word == "@":
            begin = at
            while begin > end["email"] and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < at and (m := DOMAIN.match(text, at + 1)):
                add("email", begin, m.end())
        elif word == "+":
            if at >= end["phone"] and (m := PHONE.match(text, at)):
                end["phone"] = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif word in DIGITS:
            first = not at or text[at - 1] not in DIGITS
            if at >= end["card"]:
                m = CHAIN.match(text, at)
                end["card"] = m.end() if m else at + 1
                if m and m.end() - at >= 13:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
            if first and at >= end["ip"] and (m := ADDRESS.match(text, at)):
                end["ip"] = m.end()
                if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
                    out["ip"].append(m.span())
            if first and at >= end["iban"] and (span := _iban(text, at)):
                add("iban", *span)
        elif word == "://":
            begin = at
            while begin > end["url"] and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "+-."):
                begin -= 1
            if begin < at and (m := HOST.match(text, last + 1)):
                add("url", begin, m.end())
        elif word == "akia":
            if (not at or not text[at - 1].isalnum()) and (m := KEY_ID.match(text, at)):
                add("secret", *m.span())
        elif last + 1 >= end["secret"] and (m := VALUE.match(text, last + 1)):  # cues inside a value give none of their own
            add("secret", *m.span(m.lastgroup))
    return out


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in found[kind])


def mask(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind; spans that overlap become one, under the first's name."""
    parts, at = [], 0
    for begin, end, kind in sorted((a, -b, k) for k, x in found.items() for a, b in x):
        if begin >= at:
            parts += [text[at:begin], f"[{kind.upper()}]"]
        at = max(at, -end)
    return "".join([*parts, text[at:]])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_private(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all but the text, if not given), counts of base kinds, their digest, and all spans."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep

    def function():  # noqa: ANN202
        def worker(texts, rows):  # noqa: ANN001, ANN202, ARG001
            found = [spans(t) for t in texts]
            counts = {f"n_{k}": [len(f[k]) for f in found] for k in BASE}
            return counts | {"base_sha256": [hashlib.sha256(listed(f, BASE).encode()).hexdigest() for f in found], "spans": [listed(f, (*BASE, *ADDED)) for f in found]}

        return worker

    return map_texts(df, text_col, keep, FOUND, function)


def mask_private(df: DataFrame, text_col: str = "text", out_col: str = "masked") -> DataFrame:
    """All columns, and the text with private spans replaced; a null text stays null."""

    def function():  # noqa: ANN202
        def worker(texts, rows):  # noqa: ANN001, ANN202
            there = rows.column("__text").is_valid().to_pylist()
            return {out_col: [mask(t, spans(t)) if ok else None for t, ok in zip(texts, there, strict=True)]}

        return worker

    return map_texts(df, text_col, df.columns, f"{out_col} string", function)
