"""Problem 6: noise in text from scanned pages.

Method: words are grouped by a confusable-glyph skeleton over the whole
corpus. Of each group a form is right where it is far more frequent than
another that it can be misread as; where it is only more frequent, the words
beside an occurrence decide: the right form must be known between them. Digits
are masked to find running heads and page numbers among the lines; SQL windows
over the lines then reflow what is left into paragraphs. A word broken at a
hyphen keeps it if the corpus has it so, or has both halves but not the whole.

Defined results: a null, empty or blank text has no noise and stays as it is;
a repeated id is judged on all its rows together; ties between forms go to the
smaller word. Empty input gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .codepoints import alnum_table, decode, mix, segment_hash, slices

# What a scanner makes of a letter or pair of letters.
CONFUSIONS = [
    ("e", "c"), ("s", "5"), ("a", "@"), ("o", "0"), ("i", "!"), ("l", "1"), ("l", "|"), ("d", "cl"), ("u", "ii"), ("ü", "ii"), ("m", "rn"),
    ("g", "9"), ("h", "b"), ("о", "0"), ("т", "m"), ("w", "vv"), ("и", "n"), ("li", "h"), ("é", "6"), ("б", "6"), ("t", "7"), ("ti", "fi"),
    ("b", "8"), ("cl", "d"), ("rn", "m"), ("т", "7"), ("в", "8"), ("з", "3"), ("z", "2"),
]
# One representative for the glyphs that are taken for one another.
_FROM, _TO = "c50о@!1|l9b8тибé27fзü", "esooaiiiighhmn66ztt3u"
_PAIRS = [("ei", "d"), ("rn", "m"), ("vv", "w"), ("ii", "u"), ("u", "h")]
TOKEN = re.compile(r"[\w!|@]{2,}")
BROKEN = re.compile(r"(?<=\w)[-‐‑\xad¬][ \t]*[\r\n\f]+[ \t]*(?=\w)")
_BREAK = re.compile(r"[-‐‑\xad¬][ \t]*[\r\n\f]+\s*\S")
_CODE = re.compile(r"(?:^|[^\W\d_])[^\W\d_][0-9]{2,}$|^[0-9]{2}")  # a name with a number
_LONE = re.compile(r"[0-9!|@](?=[^\W\d_]{2})")
STRONG = re.compile(r"[!|@]|[^\W\d_][0-9]|[0-9][^\W\d_]")
#: how much more frequent the right form is than a misreading that itself looks like a word
RATIO = 60
#: and how much where the words beside it support it
NEAR_RATIO = 8
#: a line longer than this is a page head only within NEAR lines of a page number or form feed
WIDE, NEAR = 90, 3

_N = r"[0-9lIOoSBZ]{0,3}[0-9lO][0-9lIOoSBZ]{0,3}"
_PAGE = re.compile(rf"(?:[-–—]\s*({_N})\s*[-–—]|\[\s*({_N})\s*\]|(?:[pP](?:[a@]g[ec]|\.)|S\.|Seite|стр\.)\s*({_N})(?:\s+(?:of|0f|/)\s+{_N})?|({_N}))")
_GAP = re.compile(r"\s{2,}|\t")
_NAME = re.compile(r"[^\W\d_]{3}")
_MASK = re.compile(r"[0-9]+(?![^\W\d_])")
# A row of a table; a single sign before a letter is a letter misread.
_ROW = re.compile(r"\|(?![^\W\d_])|\|.*(?:\s\||\|\s|\|\|)")
_LINES = re.compile(r"\r\n|[\n\r\f]")


@lru_cache(maxsize=1)
def _fold() -> dict:
    return str.maketrans(_FROM, _TO)


def skeleton(word: str) -> str:
    """The confusable-glyph skeleton: equal for words that a scanner takes for one another."""
    word = word.translate(_fold())
    for a, b in _PAIRS:
        word = word.replace(a, b)
    return word


def skeleton_of(text: Column) -> Column:
    """:func:`skeleton` of lower-cased text, as JVM expressions."""
    out = F.translate(F.lower(text), _FROM, _TO)
    for a, b in _PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def derives(right: str, read: str) -> bool:
    """Whether ``read`` comes from ``right`` by confusions, one at least."""
    states = {(0, 0, False)}
    while states:
        new = set()
        for i, j, n in states:
            if i == len(right) and j == len(read):
                if n:
                    return True
                continue
            if i < len(right) and j < len(read) and right[i] == read[j]:
                new.add((i + 1, j + 1, n))
            new.update((i + len(x), j + len(y), True) for x, y in CONFUSIONS if right.startswith(x, i) and read.startswith(y, j))
        states = new
    return False


def tokens(text: str) -> list[str]:
    return TOKEN.findall(unbroken(text).lower())


def unbroken(text: str) -> str:
    return BROKEN.sub("", text) if _BREAK.search(text) else text


@lru_cache(maxsize=1)
def _word_table() -> np.ndarray:
    keep = alnum_table()[0].copy()
    keep[[ord(c) for c in "_!|@"]] = True
    return keep


class Tokens:
    """The :func:`tokens` of an array of texts, found and hashed without a call for each."""

    def __init__(self, texts: list[str | None]):
        self.flat, offsets = decode(pa.array([unbroken(t).lower() if t else "" for t in texts], pa.string()))
        keep = _word_table()[self.flat]
        first = np.zeros(len(self.flat) + 1, bool)
        first[offsets] = True
        start = np.flatnonzero(keep & (~np.concatenate([[False], keep[:-1]]) | first[:-1])) if len(keep) else np.zeros(0, np.int64)
        end = np.flatnonzero(keep & (~np.concatenate([keep[1:], [False]]) | first[1:])) + 1 if len(keep) else start
        long = end - start > 1
        self.start, self.end = start[long], end[long]
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.hash = segment_hash(self.flat, self.start, self.end)

    def text(self, i: int) -> str:
        return self.flat[self.start[i] : self.end[i]].astype("<u4").tobytes().decode("utf-32-le")

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of two tokens in a row, and where the first one is."""
        at = np.flatnonzero(self.row[1:] == self.row[:-1])
        return pair_hash(self.hash[at], self.hash[at + 1]), at


def word_hash(words: list[str]) -> np.ndarray:
    flat, offsets = decode(pa.array(words, pa.string()))
    return segment_hash(flat, offsets[:-1], offsets[1:])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """``(word, n, skeleton)`` over all texts; tasks add up their own counts first."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            words = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in slices(batches, "t"):
            t = Tokens(b.column(0).to_pylist())
            _, first, count = np.unique(t.hash, return_index=True, return_counts=True)
            for i, n in zip(first.tolist(), count.tolist(), strict=True):
                seen[t.text(i)] += n
            if len(seen) > 300_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    words = df.select(F.col(text).alias("t")).filter("t is not null").mapInArrow(run, "word string, n long")
    counts = words.groupBy("word").agg(F.sum("n").alias("n")).filter(~F.col("word").rlike("^[0-9_!|@]+$"))
    return counts.withColumn("skeleton", skeleton_of(F.regexp_replace("word", "[!@]+$", "")))


def misreadings(words: DataFrame) -> DataFrame:
    """``(word, right, strong, sure, place)``: forms that more frequent forms of their skeleton explain, best first.

    ``strong`` forms carry a digit or sign among their letters, so any glyph of
    the skeleton may stand for another; others could be words, so they need a
    known confusion and ``RATIO`` times as frequent a form, or ``NEAR_RATIO``
    times and the context's support, which is what those not ``sure`` need.
    The forms of a skeleton stream by in order of frequency; only those that
    may explain rarer ones are held.
    """

    def run(batches):
        now, held = None, []
        for b in batches:
            out = []
            for skel, n, word in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if skel != now:
                    now, held = skel, []
                bare = word.rstrip("!@")
                strong = bool(STRONG.search(bare))
                mine = []
                if held and not _CODE.search(bare) and (strong or len(bare) > 3):
                    for m, right in held:
                        sure = len(bare) > 2 and m >= (n + 1 if strong else max(20, RATIO * n))
                        if m < max(20, NEAR_RATIO * n) and not sure:
                            break
                        known = derives(right, bare)
                        if not (strong and STRONG.search(right)) and (strong or known):
                            mine.append((not known, right, sure))
                out.extend((word, right, strong, sure, place) for place, (_, right, sure) in enumerate(sorted(mine, key=lambda x: x[0])))
                if n > 1:
                    held.append((n, word))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32()))], ["word", "right", "strong", "sure", "place"])

    ordered = words.select("skeleton", "n", "word").repartition("skeleton").sortWithinPartitions("skeleton", F.desc("n"), "word")
    return ordered.mapInArrow(run, "word string, right string, strong boolean, sure boolean, place int")


def bit_table(hashes: DataFrame, most_bits: int = 1 << 28) -> tuple[int, np.ndarray]:
    """Bits, at most ``most_bits``, with those of the hashes ``(h)`` set."""
    bits = min(most_bits, 1 << max(16, int(16 * hashes.count()).bit_length()))

    def fold(batches):
        filled = np.zeros(bits >> 3, np.uint8)
        for b in batches:
            at = b.column(0).to_numpy() & (bits - 1)
            np.bitwise_or.at(filled, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        if filled.any():
            size = min(len(filled), 1 << 16)
            for s in range(0, len(filled), size):
                if filled[s : s + size].any():
                    yield pa.RecordBatch.from_pydict({"s": [s], "v": [zlib.compress(filled[s : s + size].tobytes(), 1)]})

    filled = np.zeros(bits >> 3, np.uint8)
    for row in hashes.select("h").coalesce(16).mapInArrow(fold, "s long, v binary").toLocalIterator():  # bounded by most_bits
        part = np.frombuffer(zlib.decompress(bytes(row.v)), np.uint8)
        filled[row.s : row.s + len(part)] |= part
    return bits, filled


def _set_in(table: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(bits - 1)).astype(np.int64)
    return np.flatnonzero((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1)


def words_in(df: DataFrame, key: str, text: str, wanted: DataFrame, most_bits: int = 1 << 28) -> DataFrame:
    """``(key, word, before, after, right, strong, sure, place)`` of each text's words that ``wanted`` has, with the words beside them.

    A bit table of bounded size keeps nearly all other words from the join.
    """
    kind = df.schema[key].dataType.simpleString()

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(word_hash(b.column(0).to_pylist()).view(np.int64))], ["h"])

    bits, filled = bit_table(cut(wanted.select("word").distinct().mapInArrow(hashed, "h long")), most_bits)
    shared = df.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        table = shared.value
        for b in slices(batches, "t"):
            t = Tokens(b.column(1).to_pylist())
            near = lambda i, j: t.text(j) if 0 <= j < len(t.row) and t.row[j] == t.row[i] else ""
            rows = list({(int(t.row[i]), t.text(i), near(i, i - 1), near(i, i + 1)) for i in _set_in(table, bits, t.hash).tolist()})
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[j] for r in rows], pa.string()) for j in (1, 2, 3))], ["k", "word", "before", "after"])

    found = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").mapInArrow(run, f"k {kind}, word string, before string, after string")
    return found.join(wanted.hint("merge"), "word").select(F.col("k").alias(key), "word", "before", "after", "right", "strong", "sure", "place")


def supported(df: DataFrame, text: str, pairs: DataFrame, most_bits: int = 1 << 28) -> DataFrame:
    """``(a, b, n)``: how often the words of ``pairs (a, b)`` follow one another in all texts."""

    def hashed(batches):
        for x in batches:
            h = pair_hash(*(word_hash(x.column(i).to_pylist()) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(h.view(np.int64))], ["a", "b", "h"])

    known = cut(pairs.select("a", "b").distinct().mapInArrow(hashed, "a string, b string, h long"))
    bits, filled = bit_table(known, most_bits)
    shared = df.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        for b in slices(batches, "t"):
            h, _ = Tokens(b.column(0).to_pylist()).pairs()
            value, n = np.unique(h[_set_in(shared.value, bits, h)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counts = df.select(F.col(text).alias("t")).filter("t is not null").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return counts.join(known.hint("merge"), "h").select("a", "b", "n")


def decided(df: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """``(key, word, right, strong)``: the misread words of each text, each with the form that its neighbours support best.

    Both neighbours must be known beside the right form, each more often than
    once, where the form is not sure by its frequency. Tables of words grow
    with the texts, so they are joined by sorting and none is broadcast.
    """
    found = cut(words_in(df, key, text, wanted))
    several = found.groupBy("word").agg(F.max("place").alias("others")).filter("others > 0").select("word")
    open_ = found.filter("not sure").unionByName(found.filter("sure").join(several.hint("merge"), "word", "left_semi"))
    pairs = open_.select(F.col("before").alias("a"), F.col("right").alias("b")).union(open_.select("right", "after")).filter("a <> '' and b <> ''")
    known = cut(supported(df, text, pairs))
    told = found.join(known.select(F.col("a").alias("before"), F.col("b").alias("right"), F.col("n").alias("nb")).hint("merge"), ["before", "right"], "left").join(known.select(F.col("a").alias("right"), F.col("b").alias("after"), F.col("n").alias("na")).hint("merge"), ["right", "after"], "left")
    support = (F.coalesce("nb", F.lit(0)) > 1).cast("int") + (F.coalesce("na", F.lit(0)) > 1).cast("int")
    best = told.withColumn("support", support).filter("sure or support = 2").groupBy(key, "word").agg(F.max(F.struct("support", (-F.col("place")).alias("first"), "right", "strong", "sure")).alias("m"))
    return best.select(key, "word", "m.right", "m.strong")


def number_on(line: str) -> tuple[str | None, str | None]:
    """The printed page number on a stripped line, and the rest of the line, if anything."""
    if (len(line) <= 24 or len(line.split(None, 4)) <= 4) and (m := _PAGE.fullmatch(line)):  # no number has more than four words
        return next(filter(None, m.groups())), None
    if "  " in line or "\t" in line:
        parts = _GAP.split(line)
        for part, rest in ((parts[-1], parts[:-1]), (parts[0], parts[1:])):
            if m := _PAGE.fullmatch(part):
                return next(filter(None, m.groups())), " ".join(rest)
        line = " ".join(parts)
    return None, line


def head_of(line: str | None) -> str | None:
    """The skeleton of a line that could be a running head, digits masked."""
    if not line or line[-1] in ".,;:?|<>{}" or line[0] in "#<{\\*>=" or _ROW.match(line) or not _NAME.search(line):
        return None
    return skeleton(_MASK.sub("9", line).lower())


def page_ends(text: str, lines: list[str]) -> set[int]:
    """Which of the stripped ``lines`` of ``text`` stand near a page number or form feed."""
    feeds = [m.group() for m in _LINES.finditer(text)]
    ends = {j for i, x in enumerate(feeds) if x == "\f" for j in (i, i + 1)} | {i for i, x in enumerate(lines) if x and number_on(x)[0]}
    return {j for i in ends for j in range(i - NEAR, i + NEAR + 1)}


def page_marks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(k, at, kind, page, head)``: what single lines of each text could be.

    ``line`` rows carry a page number, a head or both; ``hyphen``, ``paged``
    (a form feed) and ``lone`` (a sign among letters) rows are about the text.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in slices(batches, "t"):
            rows: list[tuple] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t or "\n" not in t and "\f" not in t and "\r" not in t:
                    continue
                if any(t[m.start() - 1 : m.start()].isalnum() for m in _BREAK.finditer(t)):
                    rows.append((i, -1, "hyphen", None, None))
                if "\f" in t:
                    rows.append((i, -1, "paged", None, None))
                if any(t[m.start() - 2 : m.start()].isalpha() and m.start() > 1 for m in _LONE.finditer(t)):
                    rows.append((i, -1, "lone", None, None))
                heads: Counter = Counter()
                found = []
                lines = [x.strip() for x in _LINES.split(t)]
                paged = None
                marked = marked_lines(lines) if t[:2] == "# " or any(x in t for x in _STRUCTURE) else ()
                for at, line in enumerate(lines):
                    if line:
                        page, rest = number_on(line)
                        head = None if at in marked else head_of(rest)
                        if head and len(line) > WIDE:
                            paged = page_ends(t, lines) if paged is None else paged
                            head = head if at in paged else None
                        if head:
                            heads[head] += 1
                        if page or head:
                            found.append((i, at, "line", page, head))
                rows.extend(r for r in found if r[3] or heads[r[4]] > 1)
            at = [pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at[0]), *at[1:]], ["k", "at", "kind", "page", "head"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").mapInArrow(run, f"k {kind}, at int, kind string, page string, head string")


# Without one of these a text has no lines in a markup language.
_STRUCTURE = ("```", "</", "\\begin{", "\\section", "{|", "\n|", "[[", "'''", "](", "{{", "\n# ", "\n## ", "====")
_MARKED = re.compile(r"```|</|\\(?:begin|end)\{|\\section|\{\||\[\[|'''|\]\(|\{\{|====|^#{1,6} |^[-*+] |^<|^\|\}")


def marked_lines(lines: list[str]) -> set[int]:
    """Which of the stripped ``lines`` are markup: repeated ones are structure, not running heads.

    These are lines with markup, lines of fenced code, of tables and of LaTeX
    environments, headings over ``===``, and a line between two of them.
    """
    out: set[int] = set()
    end = -1
    for at, line in enumerate(lines):
        if at <= end:
            out.add(at)
            continue
        if line.startswith("```"):
            end = next((i for i in range(at + 1, len(lines)) if lines[i].startswith("```")), len(lines))
        elif line.startswith("{|"):
            end = next((i for i in range(at + 1, len(lines)) if not lines[i] or lines[i].startswith("|}")), len(lines))
        elif m := re.match(r"\\begin\{((?!document\})[^{}]*)\}", line):
            end = next((i for i in range(at, len(lines)) if f"\\end{{{m.group(1)}}}" in lines[i]), -1)
        if at <= end or _MARKED.search(line) or _ROW.match(line):
            out.add(at)
        if at and len(line) > 2 and not line.strip("="):
            out.update((at - 1, at))
    full = [i for i, x in enumerate(lines) if x]
    out.update([b for a, b, c in zip(full, full[1:], full[2:], strict=False) if a in out and c in out])
    return out


def _page_value(page: Column) -> Column:
    return F.translate(page, "lIOoSBZ", "1100582").cast("int")


def layout(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Running heads ``(k, head)`` on two pages or more, and page numbers ``(k, at)`` that count on."""
    heads = marks.filter("head is not null").groupBy("k", "head").agg(F.countDistinct("at").alias("n")).filter("n > 1").select("k", "head")
    order = Window.partitionBy("k").orderBy("at")
    numbers = marks.filter("page is not null").select("k", "at", _page_value(F.col("page")).alias("v"), "page").distinct()
    before, after = F.col("v") - F.lag("v").over(order), F.lead("v").over(order) - F.col("v")
    # Printed numbers go up by one from page to page; other numbers on lines of their own don't.
    next_to = F.coalesce((before == 1) | (after == 1), F.lit(False))
    share = F.avg(F.col("chain").cast("int")).over(Window.partitionBy("k"))
    pages = numbers.withColumn("chain", next_to).withColumn("share", share).filter("chain and share >= 0.5").select("k", "at", "page")
    return heads, pages


def scan_noise(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, noise)``: one row for each text and kind of scan noise in it."""
    docs = df.select(F.col(key), F.col(text).cast("string").alias("t")).filter("t is not null")
    wanted = cut(misreadings(vocabulary(docs, "t")))
    marks = cut(page_marks(docs, key, "t"))
    return _noise(marks, cut(decided(docs, key, "t", wanted)), key)


def _noise(marks: DataFrame, found: DataFrame, key: str) -> DataFrame:
    heads, pages = layout(marks)
    about = marks.filter("at < 0").select(F.col("k").alias(key), "kind")
    head = heads.select(F.col("k").alias(key), F.lit("running_head").alias("kind"))
    odd = F.col("page").rlike("[lIOoSBZ]")
    number = pages.select(F.col("k").alias(key), F.explode(F.when(odd, F.array(F.lit("page_no"), F.lit("odd"))).otherwise(F.array(F.lit("page_no")))).alias("kind"))
    word = found.select(key, F.when(F.col("strong"), "strong").otherwise("weak").alias("kind"), F.xxhash64("word").alias("w"))
    each = about.unionByName(head).unionByName(number).withColumn("w", F.lit(None).cast("long")).unionByName(word)
    has = {k: F.max(F.col("kind") == k) for k in ("hyphen", "running_head", "page_no", "paged", "lone", "odd", "strong", "weak")}
    first = F.min(F.when(F.col("kind") == "weak", F.col("w")))
    last = F.max(F.when(F.col("kind") == "weak", F.col("w")))
    by = each.groupBy(key).agg(*[c.alias(k) for k, c in has.items()], (first != last).alias("several"))
    scanned = F.expr("hyphen or running_head or page_no or paged")
    # One weak form or an unknown word with a sign in it needs other signs of a scan.
    misread = F.expr("strong or odd or coalesce(several, false)") | (scanned & F.expr("weak or lone"))
    kinds = F.array(F.when(F.col("hyphen"), "hyphen"), F.when(misread, "misread"), F.when(F.col("running_head"), "running_head"), F.when(F.col("page_no"), "page_no"))
    return by.select(key, F.explode(F.array_compact(kinds)).alias("noise"))


def repaired(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text)``: misread words put right, heads and page numbers left out, broken words joined, paragraphs reflowed.

    Texts without scan noise come out as they went in. A repeated id gets one
    result for each of its rows only if the rows are equal; keys should be unique.
    """
    docs = df.select(F.col(key), F.col(text).cast("string").alias("t"))
    some = docs.filter("t is not null")
    wanted = cut(misreadings(vocabulary(some, "t")))
    marks = cut(page_marks(some, key, "t"))
    found = cut(decided(some, key, "t", wanted))
    noisy = cut(_noise(marks, found, key).select(key).distinct())
    scans = some.join(noisy, key, "left_semi")
    fixes = found.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("word", "right"))).alias("fix"))
    heads, pages = layout(marks)
    gone = marks.join(heads, ["k", "head"], "left_semi").select("k", "at").union(pages.select("k", "at")).distinct().withColumn("drop", F.lit(True))
    lines = scans.select(F.col(key).alias("k"), F.posexplode(F.split("t", r"\r\n|[\n\r\f]")).alias("at", "line"))
    kept = lines.join(gone, ["k", "at"], "left").filter("drop is null").select("k", "at", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line"))
    order = Window.partitionBy("k").orderBy("at")
    blank = F.col("line") == ""
    kept = kept.withColumn("before", F.last(F.when(~blank, F.col("line")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("gap", F.coalesce(F.lag(blank).over(order), F.lit(True)))
    kept = kept.filter(~blank)
    # A blank line is a paragraph only after an end of sentence; within one it is a page break.
    new = F.col("gap") & F.coalesce(F.col("before").rlike(r"[.!?:…\"»”)]$") | (F.length("before") < 50) & ~F.col("before").rlike(r"[-‐‑\x{AD}¬,]$") & ~F.col("line").rlike(r"^\p{Ll}"), F.lit(True))
    # Items of a list stay on lines of their own; a number begins one only behind the end of something.
    item = F.col("line").rlike(r"^[-*•–+]\s+\S") | F.col("line").rlike(r"^(?:\d{1,3}[.)]|\p{L}\))\s+\S") & F.coalesce(F.col("before").rlike(r"[.!?:;…]$") | F.col("before").rlike(r"^(?:\d{1,3}[.)]|\p{L}\))\s+\S"), F.lit(True))
    kept = kept.withColumn("new", new).withColumn("item", item)
    kept = kept.withColumn("para", F.sum((F.col("new") | F.col("item")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    paras = kept.groupBy("k", "para").agg(F.min_by("new", "at").alias("new"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("p"))
    paras = paras.select("k", "para", F.concat(F.when(F.col("para") == 1, "").when(F.col("new"), "\n\n").otherwise("\n"), F.regexp_replace("p", "\n", "\x0b")).alias("p"))
    texts = paras.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "p"))), lambda x: x["p"]), "").alias("clean"))
    whole = texts.join(kept_hyphens(some, texts), "k", "left")
    joined = docs.join(whole.withColumnRenamed("k", key), key, "left").join(fixes, key, "left")

    def run(batches):
        for b in batches:
            cols = (b.column(i).to_pylist() for i in (1, 2, 3, 4))
            out = [put_right(t if clean is None else reflowed(clean, set(hyphens or ())), dict(fix) if fix else None) for t, clean, hyphens, fix in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["k", "t"])

    kind = df.schema[key].dataType.simpleString()
    return joined.select(F.col(key).alias("k"), "t", "clean", "hyphens", "fix").mapInArrow(run, f"k {kind}, t string").select(F.col("k").alias(key), F.col("t").alias(text))


# A word over the end of a line, which is a vertical tab by now.
_OVER = re.compile(r"(\w+)([-‐‑\xad¬])\s*\x0b\s*(\w+)")


def kept_hyphens(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(k, hyphens)``: of the words of ``texts (k, clean)`` broken at a hyphen those, as ``a-b``, to which it belongs.

    Counted are whole words and compounds of all ``docs (t)``, broken ones left out.
    """
    over = F.regexp_extract_all(F.lower("clean"), F.lit(r"([\p{L}\p{N}]+[-‐‑]\s*\x0b\s*[\p{L}\p{N}]+)"), 1)
    broken = cut(texts.select("k", F.explode(F.array_distinct(over)).alias("w")).select("k", F.split("w", r"[-‐‑]\s*\x0b\s*").alias("h")).select("k", F.col("h")[0].alias("a"), F.col("h")[1].alias("b")))
    forms = {"ab": F.concat("a", "b"), "a_b": F.concat_ws("-", "a", "b"), "a": F.col("a"), "b": F.col("b")}
    pairs = broken.select("a", "b").distinct()
    wanted = cut(pairs.select(F.explode(F.array(*forms.values())).alias("form")).distinct())
    plain = F.regexp_replace(F.lower("t"), r"[\p{L}\p{N}]+[-‐‑\x{AD}¬]\s*[\r\n\f]+\s*[\p{L}\p{N}]+", " ")
    words = docs.select(F.explode(F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*)"), 1)).alias("form"))
    counts = cut(words.join(wanted, "form", "left_semi").groupBy("form").agg(F.count("*").alias("n")))
    for name, form in forms.items():
        pairs = pairs.withColumn("form", form).join(counts.withColumnRenamed("n", f"n_{name}"), "form", "left").drop("form").fillna(0, [f"n_{name}"])
    own = pairs.filter("n_a_b > n_ab or n_a_b = n_ab and n_ab = 0 and least(n_a, n_b) >= 5").select("a", "b")
    return broken.join(own, ["a", "b"]).groupBy("k").agg(F.collect_set(F.concat_ws("-", "a", "b")).alias("hyphens"))


def reflowed(text: str, hyphens: set[str]) -> str:
    """``text`` with the lines of a paragraph as one; a word broken at a hyphen of its own, or before a capital or digit, keeps it."""

    def join(m):
        a, mark, b = m.groups()
        if mark in "\xad¬" or f"{a}-{b}".lower() not in hyphens and (b[0].islower() and a[-1].islower() or mark == "‐" and a[-1].isalpha() and b[0].isalpha()):
            return a + b
        return f"{a}{mark}{b}"

    old = None
    while old != text:  # a part of a word may be broken again
        old, text = text, _OVER.sub(join, text)
    return re.sub(r"\s*\x0b\s*", " ", re.sub(r"([-‐‑])\x0b", r"\1", text))


def put_right(text: str | None, fix: dict[str, str] | None) -> str | None:
    """``text`` with the words of ``fix`` replaced, their case kept."""
    if not text or not fix:
        return text

    def put(m):
        word = m.group()
        right = fix.get(word.lower())
        if right is None:
            return word
        tail = word[len(word.rstrip("!@")) :]
        return (right.upper() if word.isupper() and len(word) > 3 else right.capitalize() if word[:1].isupper() else right) + tail

    return TOKEN.sub(put, text)
