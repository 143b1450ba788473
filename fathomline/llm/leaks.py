"""Problem 9: passages of held-out items in the texts of a corpus.

Method: q-gram lemma filtering. Texts and items become streams of skeleton
letters, in which markup signs, line breaks, look-alikes and most misreadings
vanish. Shared character q-grams are counted in overlapping diagonal bands;
bands that meet the edit-budget bound are kept, and banded alignment of the
repaired text verifies which consecutive words of the item are there.

The bound follows from each passage: ``words`` consecutive words of ``L``
letters, of which ``u`` q-grams are indexed, keep ``u - q * e`` of them after
``e`` errors. One error in ``RATE`` letters is borne, for long passages as many
as leave ``SPARE`` q-grams of length ``Q``; passages too short for that are
indexed by q-grams of length ``SHORT``, of which every passage has some. A
passage without errors is thus a candidate whatever its words.

q-grams that more than ``common`` items share would match everywhere; a passage
is counted without them where the rest of its q-grams suffices, else with them.

The items are a stated query set. Their common opening phrases and the q-grams
that many share are counted over all of them; then they are indexed in blocks
of bounded size, each compared with all texts. Only that index is broadcast.

Defined results: null and empty texts contain nothing; items with fewer than
``words`` words beside the instruction phrase leak nowhere; a repeated id of a
text is reported once for each item; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .codepoints import alnum_table, decode, owners, segment_hash, slices
from .lookalikes import settled, skeleton
from .markup import clean
from .scans import BROKEN, head_of, number_on, page_ends

Q, SHORT = 16, 8
#: letters for each error that a passage may hold
RATE = 32
#: q-grams of length Q that errors must leave
SPARE = 4
BAND = 256
#: Items and letters of items indexed at once; a block's index is at most some tens of megabytes.
BLOCK, BLOCK_LETTERS = 20_000, 1 << 21
# Glyphs that a scanner takes for one another, one by one.
_GLYPHS = {"c": "e", "5": "s", "0": "o", "@": "a", "1": "i", "|": "i", "l": "i", "9": "g", "b": "h", "8": "h", "6": "e", "7": "t", "f": "t", "и": "n", "т": "m", "б": "e"}
_TAGGED = re.compile(r"<[!/a-zA-Z][^<>]*>|&#?\w+;")
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its skeleton letter, 0 for what is no letter.

    Accents go, so composed and decomposed letters agree without composing;
    invisible characters and marks are no letters and vanish.
    """
    keep, lower = alnum_table()
    out = np.zeros(0x110000, np.uint32)
    at = np.flatnonzero(keep)
    plain = np.array([ord(unicodedata.normalize("NFD", chr(c))[0]) for c in at], np.uint32)
    out[at] = lower[skeleton(settled(plain))]
    out[at] = np.array([ord(unicodedata.normalize("NFD", chr(c))[0]) for c in out[at]], np.uint32)
    fold = np.arange(0x110000, dtype=np.uint32)
    for a, b in _GLYPHS.items():
        fold[ord(a)] = ord(b)
    out = fold[out]
    for a in "@|":
        out[ord(a)] = ord(_GLYPHS[a])
    return out


def letter_stream(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Skeleton letters and offsets of an array of texts."""
    flat, offsets = decode(array)
    letters = _letters()[flat]
    keep = letters > 0
    return letters[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _grams(letters: np.ndarray, offsets: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place in the row of every q-gram."""
    n = len(letters) - q + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    row = owners(offsets)
    start = np.arange(n)
    ok = row[:n] == row[q - 1 :]
    start = start[ok]
    return segment_hash(letters, start, start + q), row[start], start - offsets[row[start]]


class Item:
    """One item: its letters, where each word begins and ends among them, and its passages of ``words`` words."""

    def __init__(self, text: str, words: int):
        flat, _ = decode(pa.array([text], pa.string()))
        letters = _letters()[flat]
        before = np.concatenate([[0], np.cumsum(letters > 0)])
        spans = np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)
        self.letters = letters[letters > 0]
        self.starts, self.ends = before[spans[:, 0]], before[spans[:, 1]]
        n = max(0, len(spans) - words + 1)
        self.a, self.b = self.starts[:n], self.ends[words - 1 :][:n]

    def grams(self, q: int) -> np.ndarray:
        n = max(0, len(self.letters) - q + 1)
        return segment_hash(self.letters, np.arange(n), np.arange(q, q + n))

    def passages(self, q: int, which: np.ndarray, errors: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last q-gram of the passages ``which``, and how many of those in ``use`` their ``errors`` leave."""
        a, b = self.a[which], self.b[which] - q + 1
        total = np.concatenate([[0], np.cumsum(use)])
        return a, b, total[b] - total[a] - q * errors[which]

    def index(self, common: set[int]) -> dict[str, np.ndarray]:
        """The q-grams of both lengths to index, the bound of each passage, and ``need``, its bound in q-grams of length SHORT."""
        size = self.b - self.a
        errors = np.minimum(size // RATE, (size - Q + 1 - SPARE) // Q)
        long = size >= 2 * Q - 1 + SPARE
        h = self.grams(Q)
        rare = np.array([x not in common for x in h.tolist()], bool)
        a, b, left = self.passages(Q, np.flatnonzero(long), errors, rare)
        use = rare.copy()
        for i, j in zip(a[left < 2 * SPARE], b[left < 2 * SPARE], strict=True):
            use[i:j] = True
        out = dict(zip(("a", "b", "left"), self.passages(Q, np.flatnonzero(long), errors, use), strict=True))
        inside = np.zeros(len(h) + 1, np.int64)
        np.add.at(inside, a, 1)
        np.add.at(inside, b, -1)
        at = np.flatnonzero(use & (np.cumsum(inside[:-1]) > 0))
        out |= {"h": h[at].view(np.int64), "at": at}
        errors = np.where(long, errors, size // RATE)
        g = self.grams(SHORT)
        use = np.zeros(len(g), bool)
        a, b, _ = self.passages(SHORT, np.flatnonzero(~long), errors, use)
        for i, j in zip(a, b, strict=True):
            use[i:j] = True
        out |= dict(zip(("sa", "sb", "sleft"), self.passages(SHORT, np.flatnonzero(~long), errors, use), strict=True))
        at = np.flatnonzero(use)
        out |= {"sh": g[at].view(np.int64), "sat": at}
        out["need"] = size - SHORT + 1 - SHORT * errors
        return {k: np.asarray(v, np.int64) for k, v in out.items()}


_PARTS = ("h", "at", "a", "b", "left", "sh", "sat", "sa", "sb", "sleft", "need")


class Grams:
    """One q-gram index of a block of items: sorted hashes with their places, a bit table before them, the passages' bounds."""

    def __init__(self, q: int, h: list[np.ndarray], at: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray], left: list[np.ndarray]):
        self.q = q
        row = np.repeat(np.arange(len(h), dtype=np.int32), [len(x) for x in h])
        flat = np.concatenate([np.zeros(0, np.int64), *h]).view(np.uint64)
        o = np.argsort(flat, kind="stable")
        self.h, self.row, self.at = flat[o], row[o], np.concatenate([np.zeros(0, np.int64), *at])[o].astype(np.int32)
        self.a, self.b, self.left = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, left))
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in a])]).astype(np.int64)
        self.least = np.array([x.min() if len(x) else 1 << 40 for x in left], np.int64)
        self.bits = 1 << max(20, int(len(self.h) * 32).bit_length())
        table = np.zeros(self.bits, bool)
        table[(self.h & np.uint64(self.bits - 1)).astype(np.int64)] = True
        self.table = np.packbits(table, bitorder="little")

    def candidates(self, letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """``(row, item, diagonal)`` of the overlapping diagonal bands whose shared q-grams meet the bound of some passage."""
        none = np.zeros((3, 0), np.int64)
        if not len(self.h):
            return none
        h, row, at = _grams(letters, offsets, self.q)
        low = (h & np.uint64(self.bits - 1)).astype(np.int64)
        hit = (self.table[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
        h, row, at = h[hit], row[hit], at[hit]
        first, last = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        n = last - first
        if not n.sum():
            return none
        each = np.repeat(np.arange(len(h)), n)
        which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[each]
        item, place, row = self.row[which].astype(np.int64), self.at[which].astype(np.int64), row[each]
        diagonal = at[each] - place
        out = []
        for shift in (0, BAND // 2):
            band = (diagonal + shift + (BAND << 32)) // BAND
            o = np.lexsort((place, band, item, row))
            key = np.stack([row[o], item[o], band[o]])
            start = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            count = np.diff(np.append(start, key.shape[1]))
            for s in np.flatnonzero(count >= self.least[key[1, start]]).tolist():
                r, i, v = key[:, start[s]].tolist()
                w = slice(self.first[i], self.first[i + 1])
                if meets(place[o[start[s] : start[s] + count[s]]], self.a[w], self.b[w], self.left[w]):
                    out.append((r, i, (v - (1 << 32)) * BAND - shift))
        return np.array(out, np.int64).reshape(-1, 3).T


def meets(places: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> bool:
    """Whether of the sorted ``places`` some passage ``a`` to ``b`` has the ``least`` that it needs, each place counted once."""
    places = places[np.concatenate([[True], places[1:] != places[:-1]])]
    return bool((np.searchsorted(places, b) - np.searchsorted(places, a) >= least).any())


class Items:
    """The index of one block of items."""

    def __init__(self, ids: list[int], texts: list[str], parts: list[dict[str, np.ndarray]], words: int):
        self.ids, self.words = np.array(ids, np.int64), words
        self.items = [Item(t, words) for t in texts]
        col = {k: [np.asarray(p[k], np.int64) for p in parts] for k in _PARTS}
        self.indexes = [Grams(Q, *(col[k] for k in ("h", "at", "a", "b", "left"))), Grams(SHORT, *(col[k] for k in ("sh", "sat", "sa", "sb", "sleft")))]
        self.need = col["need"]
        self.least = np.array([x.min() if len(x) else 0 for x in self.need], np.int64)
        self.sorted = []
        for x in self.items:
            g = x.grams(SHORT)
            o = np.argsort(g, kind="stable")
            self.sorted.append((g[o], o))

    def candidates(self, letters: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, item)`` of the bands that also meet the bound in the shorter q-grams of their own part of the text."""
        found = np.concatenate([g.candidates(letters, offsets) for g in self.indexes], axis=1)
        out: set[tuple[int, int]] = set()
        if found.shape[1]:
            n = max(0, len(letters) - SHORT + 1)
            grams = segment_hash(letters, np.arange(n), np.arange(SHORT, SHORT + n))
            for r, i, low in found.T.tolist():
                if (r, i) not in out:
                    y0 = offsets[r] + max(0, low)
                    y1 = min(offsets[r + 1] - SHORT + 1, offsets[r] + low + BAND + len(self.items[i].letters))
                    py, px = self.shared(i, grams[y0:y1])
                    inside = (py + y0 - offsets[r] - px >= low) & (py + y0 - offsets[r] - px < low + BAND)
                    x = self.items[i]
                    if inside.sum() >= self.least[i] and meets(np.sort(px[inside]), x.a, x.b - SHORT + 1, self.need[i]):
                        out.add((r, i))
        pairs = np.array(sorted(out), np.int64).reshape(-1, 2).T
        return pairs[0], pairs[1]

    def shared(self, item: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of equal q-grams of length SHORT in ``grams`` and in the item."""
        h, o = self.sorted[item]
        first = np.searchsorted(h, grams, "left")
        there = np.flatnonzero(h[np.minimum(first, len(h) - 1)] == grams) if len(h) else np.zeros(0, np.int64)
        first, n = first[there], np.searchsorted(h, grams[there], "right") - first[there]
        return np.repeat(there, n), o[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]


def _prefixes(text: str) -> list[int]:
    """A hash for each of the first 1, 2, ... words of ``text``."""
    h, out = hashlib.blake2b(digest_size=8), []
    for w in _WORD.finditer(text):
        h.update(w.group().lower().encode() + b" ")
        out.append(int.from_bytes(h.copy().digest(), "little", signed=True))
    return out


def phrases(texts: DataFrame, least: int = 3, share: float = 0.02) -> dict[int, bool]:
    """Openings of three words and more that many different ``texts (t)`` have in common: hash, and whether the phrase ends there.

    A phrase ends where its continuations differ. No more than ``1 / share``
    openings of one length are that frequent, so few are collected.
    """

    def plain(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(_WORD.findall(t.lower())) for t in b.column(0).to_pylist()], pa.string())], ["t"])

    def opened(batches):
        for b in batches:
            rows = [(x[k], x[k - 1]) for x in map(_prefixes, b.column(0).to_pylist()) for k in range(2, len(x) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["h", "up"])

    different = cut(texts.select("t").mapInArrow(plain, "t string").distinct())
    most = max(least, share * different.count())
    often = different.mapInArrow(opened, "h long, up long").groupBy("h", "up").agg(F.count("*").alias("n")).filter(F.col("n") >= 0.8 * most).collect()
    n = {r.h: r.n for r in often}
    longest: dict[int, int] = {}
    for r in often:
        longest[r.up] = max(longest.get(r.up, 0), r.n)
    return {h: longest.get(h, 0) < 0.8 * c for h, c in n.items() if c >= most}


def without_phrase(text: str, known: dict[int, bool]) -> str:
    """``text`` without its opening phrase; of a sentence that ends in a colon nothing stays."""
    for k, h in enumerate(_prefixes(text)[2:] if known else [], 3):
        if h not in known:
            return text
        if known[h]:
            end = [m.end() for m in _WORD.finditer(text)][k - 1]
            colon = re.match(r"[^.:\n]{0,20}[.:]", text[end:])
            return text[end + (colon.end() if colon else 0) :]
    return text


def align(x: list[np.ndarray], y: list[np.ndarray], shift: list[int], width: int) -> list[np.ndarray]:
    """Banded alignment of many pairs at once: for each letter of ``x`` whether an equal letter of ``y`` is aligned with it.

    The band of a pair runs along the diagonal ``shift``, ``width`` wide on
    either side; both ends of ``y`` are free.
    """
    b, n, w = len(x), max(map(len, x)), 2 * width + 1
    xs = np.zeros((b, n), np.uint32)
    m = max(map(len, y)) + n + 4 * width
    ys = np.zeros((b, m), np.uint32)
    for i in range(b):
        xs[i, : len(x[i])] = x[i]
        lo = width - shift[i]  # ys[j + lo] = y[j]; row r sees columns r .. r + w
        j0, j1 = max(0, -lo), min(len(y[i]), m - lo)
        if j1 > j0:
            ys[i, j0 + lo : j1 + lo] = y[i][j0:j1]
    lengths = np.array([len(v) for v in x])
    big = np.int32(1 << 20)
    d = np.zeros((b, w), np.int32)
    moves = np.zeros((n, b, w), np.uint8)
    step = np.arange(w, dtype=np.int32)[None, :]
    for r in range(n):
        same = (xs[:, r, None] == ys[:, r : r + w]) & (xs[:, r, None] > 0)
        diag = d + np.where(same, 0, 2)
        up = np.concatenate([d[:, 1:], np.full((b, 1), big, np.int32)], axis=1) + 1
        best = np.minimum(diag, up)
        left = np.minimum.accumulate(best - step, axis=1) + step
        moves[r] = np.where(left < best, 2, np.where(up < diag, 1, 0)) | (same << 2)
        past = r >= lengths  # a shorter pair keeps its last state
        moves[r, past] = 0
        d = np.where(past[:, None], d, np.minimum(best, left))
    at = d.argmin(1)
    hit = np.zeros((b, n), bool)
    rows = np.arange(b)
    for r in range(n - 1, -1, -1):
        for _ in range(w):
            back = (moves[r, rows, at] & 3) == 2
            if not back.any():
                break
            at = np.where(back, at - 1, at)
        move = moves[r, rows, at]
        hit[:, r] = ((move & 3) == 0) & (move >> 2 == 1)
        at = np.where((move & 3) == 1, np.minimum(at + 1, w - 1), at)
    return [hit[i, : lengths[i]] for i in range(b)]


def longest_run(hit: np.ndarray, item: Item) -> int:
    """The most consecutive words of which nearly all letters are aligned."""
    total = np.concatenate([[0], np.cumsum(hit)])
    good = (total[item.ends] - total[item.starts]) >= np.ceil(0.7 * (item.ends - item.starts))
    best = run = 0
    for g in good.tolist():
        run = run + 1 if g else 0
        best = max(best, run)
    return best


def verbatim(item: Item, diagonal: np.ndarray, places: np.ndarray) -> bool:
    """Whether all q-grams of length SHORT of some passage lie on one diagonal: it is there letter for letter."""
    whole = item.b - item.a - SHORT + 1
    value, which, count = np.unique(diagonal, return_inverse=True, return_counts=True)
    return any(meets(np.sort(places[which == v]), item.a, item.b - SHORT + 1, whole) for v in np.flatnonzero(count >= whole.min(initial=1 << 40)))


def put_in_order(text: str) -> str:
    """A text as it should read: markup converted, broken words joined, page heads and numbers left out.

    A line that repeats is a page head only near a page number or form feed.
    """
    text = clean(text, blocks=True)[0] or ""
    if "\n" in text or "\f" in text:
        lines = [x.strip() for x in re.split(r"\r\n|[\n\r\f]", text)]
        heads: dict[str, int] = {}
        parsed = []
        for line in lines:
            page, rest = number_on(line) if line else (None, line)
            head = head_of(rest) if rest else None
            if head:
                heads[head] = heads.get(head, 0) + 1
            parsed.append((page, rest, head))
        paged = page_ends(text, lines)
        kept = [rest or "" for i, (page, rest, head) in enumerate(parsed) if not (page and (not head or heads[head] > 1)) and not (head and heads[head] > 1 and i in paged)]
        text = re.sub(r"\n{2,}", "\n", "\n".join(kept)) if len(kept) < len(parsed) else "\n".join(kept)
        text = BROKEN.sub("", text)
    return text


def untagged(text: str) -> str:
    """A text without HTML tags and entities; a long bracket without any attribute is no tag."""
    return _TAGGED.sub(lambda m: "" if len(m.group()) <= 400 or "=" in m.group() or m.group()[1] == "!" else m.group(), text) if "<" in text or "&" in text else text


def _verify(texts: list[str], doc: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
    """Whether the text ``doc`` holds ``items.words`` consecutive words of ``item``, for each candidate.

    The repaired text is tried first, then the untagged one, from which no line
    or block is missing.
    """
    ok = _aligned(put_in_order, texts, doc, item, items)
    rest = np.flatnonzero(~ok)
    if len(rest):
        ok[rest] = _aligned(lambda t: BROKEN.sub("", untagged(t)), texts, doc[rest], item[rest], items)
    return ok


def _aligned(read, texts: list[str], doc: np.ndarray, item: np.ndarray, items: Items, width: int = 96) -> np.ndarray:
    """:func:`_verify` over the texts as ``read`` gives them."""
    own, at = np.unique(doc, return_inverse=True)
    letters, offsets = letter_stream(pa.array([read(texts[d]) for d in own], pa.string()))
    q = SHORT
    margin = 2 * width // 3
    grams = segment_hash(letters, np.arange(max(0, len(letters) - q + 1)), np.arange(q, max(q, len(letters) + 1)))
    ok = np.zeros(len(doc), bool)
    jobs: list[tuple] = []
    for k, (d, i) in enumerate(zip(at.tolist(), item.tolist(), strict=True)):
        lo, hi = offsets[d], offsets[d + 1]
        x, need = items.items[i].letters, items.least[i]
        if hi - lo < q:
            continue
        py, px = items.shared(i, grams[lo : hi - q + 1])
        diagonal = py - px
        ok[k] = verbatim(items.items[i], diagonal, px)
        if ok[k]:
            continue
        band = diagonal // width
        # A passage lies in one band or two neighbours, so one of them has half of the q-grams that it keeps.
        for v, c in zip(*np.unique(band, return_counts=True), strict=True):
            near = np.abs(band - v) <= 1
            if 2 * c < need or near.sum() < need:
                continue
            a, b = max(0, px[near].min() - margin), min(len(x), px[near].max() + q + margin)
            middle = int(np.median(diagonal[band == v])) + a
            y0, y1 = max(0, middle - 2 * width), min(hi - lo, middle + (b - a) + 2 * width)
            jobs.append((k, i, a, b, x[a:b], letters[lo + y0 : lo + y1], middle - y0))
    jobs.sort(key=lambda j: j[3] - j[2])
    for s in range(0, len(jobs), 32):
        part = [j for j in jobs[s : s + 32] if not ok[j[0]]]
        if not part:
            continue
        for (k, i, a, b, *_), hit in zip(part, align([j[4] for j in part], [j[5] for j in part], [j[6] for j in part], width), strict=True):
            if not ok[k]:
                whole = np.zeros(len(items.items[i].letters), bool)
                whole[a:b] = hit
                ok[k] = longest_run(whole, items.items[i]) >= items.words
    return ok


def indexed(rows: DataFrame, words: int, common: int) -> DataFrame:
    """``(u, i, t, ...)``: each item ``(i, t)`` without its opening phrase, with what :meth:`Item.index` gives for it."""
    known = rows.sparkSession.sparkContext.broadcast(phrases(rows))

    def bare(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([without_phrase(t, known.value) for t in b.column(1).to_pylist()], pa.string())], ["i", "t"])

    def grams(batches):
        for b in batches:
            sets = [np.unique(Item(t, words).grams(Q)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(x) for x in sets])), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["u", "h"])

    def run(batches):
        for b in batches:
            parts = [Item(t, words).index({x % (1 << 64) for x in often or ()}) for t, often in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([p[k] for p in parts], pa.list_(pa.int64())) for k in _PARTS)], ["u", "i", "t", *_PARTS])

    items = cut(rows.distinct().mapInArrow(bare, "i long, t string").withColumn("u", F.monotonically_increasing_id()).select("u", "i", "t"))
    held = cut(items.select("u", "t").mapInArrow(grams, "u long, h long"))
    shared = held.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > common).select("h")
    often = held.join(shared, "h").groupBy("u").agg(F.collect_list("h").alias("often"))  # no more than the q-grams of one item
    return cut(items.join(often, "u", "left").select("u", "i", "t", "often").mapInArrow(run, "u long, i long, t string, " + ", ".join(f"{k} array<long>" for k in _PARTS)))


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", words: int = 12, common: int = 3, block: int = BLOCK) -> DataFrame:
    """``(key, item_key)``: texts that hold at least ``words`` consecutive words of an item, beside its instruction phrase."""
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    rows = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i is not null and t is not null")
    docs = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).filter("t is not null")
    index = indexed(rows, words, common)
    size = index.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("letters")).first()
    parts = max(1, -(-size.n // block), -(-size.letters // BLOCK_LETTERS))
    out = None
    for p in range(parts):
        own = index.filter(F.pmod(F.xxhash64("u"), F.lit(parts)) == p).orderBy("i", "u").collect()  # a block of the query set
        shared = spark.sparkContext.broadcast(Items([r.i for r in own], [r.t for r in own], [{k: r[k] for k in _PARTS} for r in own], words))

        def run(batches, shared=shared):
            it = shared.value
            for b in slices(batches, "t"):
                texts = b.column(1).to_pylist()
                light = pa.array([untagged(t) for t in texts], pa.string())
                doc, item = it.candidates(*letter_stream(light))
                if len(doc):
                    ok = _verify(texts, doc, item, it)
                    doc, item = doc[ok], item[ok]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(it.ids[item])], ["k", "i"])

        found = docs.mapInArrow(run, f"k {kind}, i long")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("k").alias(key), F.col("i").alias(item_key)).distinct()
