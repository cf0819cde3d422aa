"""Chat formatting from an event log.

A conversation is a log of events (conv_id, turn, role, text, and, where the log has them, seq, event, message_id).
`fold` is the reducer: it reads the events of one conversation in order and yields the final messages.

* `message` (also a null or missing event): a whole message.
* `delta`: text appended to the message of that message_id, or a new one.
* `edit`: replaces the text of that message.
* `regenerate`: discards that message and all after it; deltas and messages that follow build the new answer.

Logs are partitioned by conversation and sorted within partitions, so a task streams through its conversations and
holds one at a time. Order: turn (nulls first), then seq, message_id, role and text, so ties and repeated rows come in a defined
order; repeated rows are all kept. Null text is empty, null role is ''. A null conv_id is a conversation of its own. An empty log gives no rows;
other columns aren't read, whatever their names. A conversation is one cell of the output, so texts may be long, up to 2 GB together.

Template. A turn is written as `<|ROLE|>\\n TEXT <|end|>\\n`; in roles and texts a `<|` becomes `<\\|`, and `<\\...\\|` gets one
backslash more, so a control string never occurs inside a text, and unescaping takes one off: reversible.
The loss mask covers the texts of assistant turns, without their marks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>"
TURN_END = "<|end|>\n"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
#: A turn's opening: no `<|` is left inside an escaped role or text.
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role must not end its own mark, so `|>` inside it is broken too."""
    return re.sub(r"\|(\\*)>", r"|\1\\>", escape(role))


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\|(\\*)\\>", r"|\1>", role))


def fold(events: Iterable[tuple[str, str | None, str, str]]) -> list[tuple[str, str]]:
    """Final (role, text) of a conversation from its ordered events (event, message_id, role, text)."""
    messages: list[list] = []  # role, parts, message_id
    at: dict[str, int] = {}
    for event, key, role, text in events:
        known = at.get(key) if key is not None else None
        if event == "regenerate":
            if known is not None:
                del messages[known:]
                at = {k: i for k, i in at.items() if i < known}
            continue
        if event == "delta" and known is not None:
            messages[known][1].append(text)
        elif event == "edit" and known is not None:
            messages[known][1] = [text]
        else:
            if key is not None:
                at[key] = len(messages)
            messages.append([role, [text], key])
    return [(role, "".join(parts)) for role, parts, _ in messages]


def render(messages: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """(formatted text, begins and ends of the loss mask in code points)."""
    parts, begins, ends, size = [], [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{escape_role(role)}{CLOSE}\n", escape(text)
        size += len(head)
        if role == "assistant":
            begins.append(size)
            ends.append(size + len(body))
        size += len(body) + len(TURN_END)
        parts += [head, body, TURN_END]
    return "".join(parts), begins, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """Messages read back from a formatted text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def under_mask(formatted: str, begins: list[int], ends: list[int]) -> list[str]:
    """The texts that the loss mask covers, unescaped."""
    return [unescape(formatted[a:b]) for a, b in zip(begins, ends, strict=True)]


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list]]:
    """Conversations of a partition that is sorted by them, one at a time."""
    now, events, begun = None, [], False
    for batch in batches:
        for conv, event, key, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if begun and conv != now:
                yield now, events
                events = []
            now, begun = conv, True
            events.append((event or "message", key, role or "", text or ""))
    if begun:
        yield now, events


FORMATTED = "conv_id long, n_turns long, formatted string, loss_begin array<long>, loss_end array<long>"


def format_conversations(log: DataFrame) -> DataFrame:
    """One row per conversation: its formatted text and loss mask, from a log of events."""
    # Equal names of other columns don't matter: only these are read.
    rows = log.select(
        _column(log, "conv_id", "long").alias("conv_id"),
        _column(log, "event", "string").alias("event"),
        _column(log, "message_id", "string").alias("message_id"),
        _column(log, "role", "string").alias("role"),
        _column(log, "text", "string").alias("text"),
        _column(log, "turn", "long").alias("turn"),
        _column(log, "seq", "long").alias("seq"),
    )
    order = ["conv_id", "turn", "seq", "message_id", "role", "text"]
    columns = ["conv_id", "event", "message_id", "role", "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["conv_id", "n_turns", "formatted", "loss_begin", "loss_end"])

        for conv, events in _conversations(batches):
            messages = fold(events)
            text, begins, ends = render(messages)
            out.append((conv, len(messages), text, begins, ends))
            size += len(text)
            if size > 4 << 20 or len(out) >= 5000:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return rows.repartition("conv_id").sortWithinPartitions(*order).select(*columns).mapInArrow(work, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a formatted text says once parsed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, begins, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_begin", "loss_end")), strict=True):
                turns, loss = parse(text), "".join(under_mask(text, begins, ends))
                digest = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in turns).encode()).hexdigest()
                rows.append((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if "sha" in n else pa.int64()) for k, n in enumerate(names)], names)

    return formatted.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
