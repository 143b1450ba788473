"""Scalar text functions as Spark columns.

Each takes and returns columns (or a column and plain parameters), stays in
whole-stage code generation where Spark can, and gives null for a null text
unless it says otherwise.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of which long runs and whole lines are noise.
PUNCT = "._-~=*#•·–—─━═"
# Spaces that become U+0020.
SPACES = "  ᠎           ​  　\t"
_EDGE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
_LINE = r"[\n\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in r"\]^-[&~.*#=_" and c not in "_=" else c for c in chars) + "]"


def strip(text: Column) -> Column:
    """White space of any script removed from both ends."""
    return F.regexp_replace(text, f"^{_EDGE}+|{_EDGE}+$", "")


def limit_runs(text: Column, char: str, most: int) -> Column:
    """Runs of ``char`` longer than ``most`` cut to it; below 1 the character goes."""
    if most < 1:
        return F.replace(text, F.lit(char), F.lit(""))
    return F.regexp_replace(text, f"{re.escape(char)}{{{most + 1},}}", char * most)


def limit_punct_runs(text: Column, most: int = 3, chars: str = PUNCT) -> Column:
    """Runs of one and the same of ``chars`` cut to ``most``."""
    if most < 1 or not chars:
        return text
    return F.regexp_replace(text, f"({_class(chars)})\\1{{{most},}}", "$1" * most)


def drop_bar_lines(text: Column, least: int = 6, chars: str = PUNCT) -> Column:
    """Lines of nothing but ``least`` or more of ``chars`` (and blanks) left out."""
    if least <= 0:
        return text
    bar = f"^{_EDGE}*(?:{_class(chars)}[ \\t]*){{{least},}}{_EDGE}*$"
    return F.array_join(F.filter(F.split(text, _LINE), lambda line: ~line.rlike(bar)), "\n")


def normalize(text: Column, spaces: int = 1, newlines: int = 2, edges: bool = True, punct: int | None = 3, bars: int | None = 6, chars: str = PUNCT) -> Column:
    """White space and punctuation noise brought into one form.

    Line ends, odd spaces and tabs first, then runs of punctuation, bar lines,
    runs of spaces and newlines, and the ends. A bar that the run limit
    shortens below ``bars`` stays, as only mixed or spaced bars reach it.
    """
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.translate(out, SPACES, " " * len(SPACES))
    hug = lambda c: F.regexp_replace(F.regexp_replace(c, r"[ \t\f\x{0B}]+\n", "\n"), r"\n[ \t\f\x{0B}]+", "\n")
    out = hug(out)
    if punct:
        out = limit_punct_runs(out, punct, chars)
    if bars:
        out = drop_bar_lines(out, bars, chars)
    out = limit_runs(limit_runs(out, " ", max(1, spaces)), "\n", max(1, newlines))
    return strip(hug(out) if edges else out)


def html_to_text(text: Column) -> Column:
    """Tags, scripts and styles out, the four common entities decoded in the order nbsp, amp, lt, gt."""
    out = F.regexp_replace(text, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return strip(F.regexp_replace(out, rf"{_EDGE}{{2,}}", " "))


def tokenize(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9_]+"), F.lit(0))


def has_phrase(text: Column, query: Column) -> Column:
    """Whether the trimmed, non-empty query occurs in the text, case apart."""
    q = strip(query)
    return (q != "") & F.contains(F.lower(text), F.lower(q))


def flat(text: Column) -> Column:
    """Newlines to spaces, ends stripped."""
    return strip(F.replace(text, F.lit("\n"), F.lit(" ")))


def first_text(text: Column | None, *others: Column) -> Column:
    """``text`` if it is not null, even if empty; else the first of ``others`` that is not blank, untrimmed."""
    filled = [F.when(strip(c) != "", c) for c in others]
    return F.coalesce(*([text] if text is not None else []), *filled, F.lit(""))


def estimate_tokens(text: Column) -> Column:
    """Four tokens for three words, one at least; a null counts as one."""
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+"), F.lit(0)))
    return F.coalesce(F.greatest(F.lit(1), F.floor(words * 4 / 3)), F.lit(1)).cast("int")


def message_tokens(text: Column) -> Column:
    """A token for four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def squeeze(text: Column) -> Column:
    """Every run of white space as one space, ends stripped."""
    return F.trim(F.regexp_replace(text, f"{_EDGE}+", " "))


def strip_think(text: Column, start: str = "<|think|>", end: str = "<|endofthink|>") -> Column:
    """Marked reasoning left out; an unclosed mark cuts the rest."""
    return F.regexp_replace(text, rf"(?s){re.escape(start)}.*?(?:{re.escape(end)}|\z)", "")


def strip_special(text: Column) -> Column:
    """``<|...|>`` marks left out, ends stripped."""
    return strip(F.regexp_replace(text, r"<\|[^>]+?\|>", ""))


def stops_at(tail: Column, stops: list[str]) -> Column:
    """Whether any stop string occurs in the decoded tail."""
    return F.lit(False) if not stops else F.exists(F.array(*map(F.lit, stops)), lambda s: F.contains(tail, s))


def guard_verdict(text: Column) -> Column:
    """``struct(verdict, categories)`` of a guard's answer; anything not understood is unsafe."""
    lines = F.filter(F.transform(F.split(text, "\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"), lambda x: strip_special(x)), lambda x: x != "")
    head = F.lower(F.get(lines, F.lit(0)))
    safe = F.coalesce(head.startswith("safe"), F.lit(False))
    listed = F.coalesce(head.startswith("unsafe"), F.lit(False)) & (F.size(lines) > 1)
    names = F.filter(F.split(F.get(lines, F.lit(1)), rf"(?:,|{_EDGE})+"), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.struct(F.when(safe, "safe").otherwise("unsafe").alias("verdict"), F.when(listed & ~safe, names).otherwise(none).alias("categories"))


def suffix(path: Column) -> Column:
    """The lower-cased suffix of a file name, with its dot; empty if none."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]+)?$", 1)


def is_image(path: Column) -> Column:
    """Whether the suffix is that of a common image format."""
    return suffix(path).isin(".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff", ".gif")


class Template:
    """A prompt with ``{field}`` places, filled from columns; a missing field is an error before anything runs."""

    def __init__(self, template: str):
        if not template:
            raise ValueError("the template is empty")
        self.parts = [(text, field) for text, field, _, _ in string.Formatter().parse(template)]

    @property
    def fields(self) -> list[str]:
        return [f for _, f in self.parts if f]

    def render(self, values: dict[str, Column]) -> Column:
        missing = [f for f in self.fields if f not in values]
        if missing:
            raise KeyError(f"no value for {', '.join(missing)}")
        out = []
        for text, field in self.parts:
            if text:
                out.append(F.lit(text))
            if field:
                out.append(values[field].cast("string"))
        return F.concat(*out)
