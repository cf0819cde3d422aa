"""Text, hash and JSON expressions: columns in, columns out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The quality gate's heading pattern and its complexity pattern (case counts).
STEP_HEADER = r"(?d)第[一二三四五六七八九十\d]+步|\*\*Step\s*\d+|#{1,3}\s+.{2,}|\d+\.\s+\*\*"
COMPLEXITY = r"O\([^)]+\)|时间复杂度|空间复杂度|Time complexity"
#: Words that mark teaching prose.
TEACHING_WORDS = "因为|所以|因此|注意|关键|核心思路|观察到|我们需要|可以发现|暴力|优化|考虑|首先|然后|最后|总结|举例"
#: What a leaked reference solution is marked with.
LEAK_MARKERS = ("reference_solution", "【参考解代码】")
FENCE = "```"


def strip(text: Column) -> Column:
    """White space of any kind off both ends (trim() takes only blanks off)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_html(text: Column) -> Column:
    """Tags out, four entities decoded, ampersands first; stripped."""
    out = F.regexp_replace(text, "<[^>]+>", "")
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return strip(out)


def make_id(source: Column, text: Column) -> Column:
    return F.concat(source, F.lit("_"), F.substring(F.md5(text), 1, 10))


def ids_digest(ids: Column) -> Column:
    """sha256 of an ordered array of ids as compact JSON."""
    return F.sha2(F.concat(F.lit('["'), F.array_join(ids, '","'), F.lit('"]')), 256)


def step_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(STEP_HEADER))


def count_of(text: Column, part: str) -> Column:
    """How often a part occurs, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def unclosed_fence(text: Column) -> Column:
    """An odd number of fence marks."""
    return count_of(text, FENCE) % 2 == 1


def fences_closed(text: Column) -> Column:
    """Lines that open with a fence mark come in pairs; any line break that Python knows divides lines."""
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]")
    return F.size(F.filter(lines, lambda line: F.startswith(F.regexp_replace(line, r"^\s+", ""), F.lit(FENCE)))) % 2 == 0


def has_fence(text: Column) -> Column:
    return F.contains(text, F.lit(FENCE))


def is_truncated(text: Column) -> Column:
    return has_fence(text) & ~fences_closed(text)


def quality_points(text: Column) -> Column:
    """The structural gate in hundredths: headings 25, code 25, closed fences 20, complexity 15, sane length 15."""
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    return points(step_count(text) >= 2, 25) + points(has_fence(text), 25) + points(has_fence(text) & fences_closed(text), 20) + points(text.rlike(COMPLEXITY), 15) + points(F.length(text).between(300, 4000), 15)


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring signs once white space is out."""
    signs = F.regexp_extract_all(F.regexp_replace(text, r"\s+", ""), F.lit("(?s)."), F.lit(0))
    n = F.greatest(F.size(signs) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(signs, F.lit(1), n), F.slice(signs, F.lit(2), n), lambda a, b: F.concat(a, b)))


def overlap_ratio(left: Column, right: Column) -> Column:
    """Jaccard similarity of two arrays; 0 where either is empty."""
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right)))


def contract_complexity(text: Column) -> Column:
    return F.when(text.rlike(f"(?i){COMPLEXITY}"), F.lit(0.20)).otherwise(F.lit(0.0))


def contract_length(text: Column) -> Column:
    return F.when(F.length(text).between(150, 3000), F.lit(0.05)).otherwise(F.lit(0.0))


def contract_words(text: Column) -> Column:
    return F.least(F.regexp_count(text, F.lit(TEACHING_WORDS)) / F.lit(5.0), F.lit(1.0)) * 0.05


def shortened(text: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit(tail)))


def has_leak(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit(LEAK_MARKERS[0])) | F.contains(text, F.lit(LEAK_MARKERS[1]))


def json_or(text: Column, schema: str, default: Column) -> Column:
    """Parsed JSON, or the default for null, blank and malformed text."""
    return F.coalesce(F.from_json(F.when(strip(text) != "", text), schema, {"mode": "PERMISSIVE"}), default)


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value; a parser of values alone takes what follows it."""
    return F.coalesce(F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")) == 1, F.lit(False))


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(text, F.lit(part))
    return out


def number_lines(code: Column) -> Column:
    """`line number | line`, numbers right-aligned."""
    lines = F.split(F.regexp_replace(code, r"\n$", ""), "\n")
    width = F.length(F.size(lines).cast("string"))
    numbered = F.transform(lines, lambda line, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit(" | "), line))
    return F.array_join(numbered, "\n")


def template_complete(text: Column, sections: list[str]) -> Column:
    """All sections occur, upper or lower case alike."""
    out = F.lit(True)
    for section in sections:
        out = out & F.contains(F.lower(text), F.lit(section.lower()))
    return out


#: What ends a benchmark completion.
STOPS = ("\n```", "<|im_end|>", "<|endoftext|>", "</s>")


def cut_at_first(text: Column, markers: tuple[str, ...] = STOPS) -> Column:
    """The text before the first of the markers."""
    places = [F.when(F.instr(text, m) > 0, F.instr(text, m)) for m in markers]
    first = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.length(text) + 1)
    return F.substring(text, F.lit(1), first - 1)


def first_solution(text: Column) -> Column:
    """The first code of a benchmark completion: line ends and tabs made plain, an opening fence off, cut where it ends; '' for none."""
    plain = strip(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit("    ")))
    body = F.regexp_replace(plain, r"^```(?:python)?\n*", "")
    cut = cut_at_first(body)
    return F.when(strip(cut) == "", F.lit("")).otherwise(F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit("\n")))
