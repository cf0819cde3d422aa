"""Vocabulary files of byte-level BPE tokenizers: ranks of tokens, special strings, and the exact encoding of one piece."""

from __future__ import annotations

import base64
import functools
import json

import public_tokenizers
import tiktoken


def path(name: str) -> str:
    """A file's place; a name with a slash is a path already."""
    return name if "/" in name else public_tokenizers.path(name)


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in .json vocabularies: printable Latin-1 stays, the rest follows from U+0100 on."""
    same = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(same)]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def vocabulary(name: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(rank of each token's bytes, id of each special string).

    In a .json file ids must follow the order of merges, as they do in byte-level vocabularies of this kind; another file is refused. So
    merging by rank gives the ids that merging by the file's own list gives: the rule by which `encoding` stands for the file's library.
    """
    if not name.endswith(".json"):
        with open(path(name), "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, {}
    with open(path(name), encoding="utf-8") as file:
        data = json.load(file)
    special = {x["content"]: x["id"] for x in data["added_tokens"]}
    letters = byte_letters()
    to_bytes = lambda word: bytes(letters[c] for c in word)
    ranks = {to_bytes(word): i for word, i in data["model"]["vocab"].items() if word not in special}
    last = -1
    for merge in data["model"]["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        rank = ranks[to_bytes(left) + to_bytes(right)]
        if rank <= last:
            raise ValueError(f"{name}: ids don't follow the merges")
        last = rank
    return ranks, special


@functools.cache
def encoding(name: str) -> tiktoken.Encoding:
    """The vocabulary in tiktoken; one per process."""
    ranks, special = vocabulary(name)
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
