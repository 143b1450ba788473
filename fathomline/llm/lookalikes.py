"""Problem 10: one consistent form for texts that look the same.

Method: Arrow text is copied to numpy code-point arrays; a lookup table maps
every code point (width forms, kinds of space, invisible characters, line
ends), expansion offsets make room for the few that become several, and
combining marks are composed vectorially. No Python call is made per string.

Defined results: a null text stays null and has no key; an empty text stays
empty. Repeated rows are kept. Columns other than the two named are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .codepoints import decode, encode, owners, segment_hash, slices

# Letters of other scripts drawn like a Latin letter, as Unicode's confusables have them.
LIKE = {
    "CYRILLIC": ("аеорсухіѕјһԁԛԝѵӏАВЕКМНОРСТХУІЅЈҮӀѴԌԜ", "aeopcyxisjhdqwvlABEKMHOPCTXYISJYIVGW"),
    "GREEK": ("αγικνορυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜϹϺͿ", "ayikvopucjABEZHIKMNOPTYXFCMJ"),
    "ARMENIAN": ("հոսցքօՍՏՕ", "hnugfoUSO"),
    "CHEROKEE": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᎶᏃᏔᏚᏙᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZWSVLCPKB"),
    "LISU": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "COPTIC": ("ⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ", "HIKMNOoPpCcTYX"),
}
# Latin letters drawn like another Latin letter. A dotless i is not: its dot is missing.
LATIN_LIKE = ("ɑɡᴄᴏᴠᴡᴢꜱ", "agcovwzs")
#: Invisible although their category is not Cf.
BLANK_MARKS = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
DROP = 0x110000
MANY = 255


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    to = np.arange(0x110001, dtype=np.uint32)
    many: dict[int, str] = {}
    ccc = np.zeros(0x110001, np.uint8)
    pairs: dict[tuple[int, int], int] = {}
    for c in range(0x110000):
        if 0xAC00 <= c <= 0xD7A3 or 0xD800 <= c <= 0xDFFF:
            continue
        s = chr(c)
        category = unicodedata.category(s)
        if category in ("Cn", "Co"):
            continue
        ccc[c] = unicodedata.combining(s)
        shape = unicodedata.decomposition(s)
        if category == "Zs":
            to[c] = 0x20
        elif category == "Cf":
            to[c] = DROP
        elif shape.startswith(("<wide>", "<narrow>")):
            to[c] = int(shape.split()[1], 16)
        elif shape and shape[0] != "<":
            whole = unicodedata.normalize("NFC", s)
            if whole != s:
                to[c], many[c] = ord(whole[0]), whole
            elif len(parts := shape.split()) == 2:
                pairs[int(parts[0], 16), int(parts[1], 16)] = c
    for c in BLANK_MARKS:
        to[c] = DROP
    to[[0x09, 0x0B, 0x1680, 0x180E]] = 0x20
    to[[0x85, 0x2028, 0x2029, 0x0D]] = 0x0A
    to[[*range(0, 9), *range(0x0E, 0x20), *range(0x7F, 0x85), *range(0x86, 0xA0)]] = DROP
    many = {c: s for c, s in many.items() if len(s) > 1}
    longer = np.array(sorted(many), np.uint32)
    keys = np.array(sorted((a << 21) | b for a, b in pairs), np.uint64)
    latin = np.arange(0x110001, dtype=np.uint32)
    # 1: surely Latin, 2 and more: surely of that script of LIKE, MANY: could be of several.
    script = np.zeros(0x110001, np.uint8)
    names = {"LATIN": 1} | {name: k for k, name in enumerate(LIKE, 2)}
    for c in [*range(0x600), *range(0x13A0, 0x1400), *range(0x1E00, 0x2000), *range(0x2C80, 0x2D00), *range(0xA4D0, 0xA500), *range(0xAB70, 0xABC0)]:
        if unicodedata.category(chr(c))[0] == "L":
            script[c] = names.get(unicodedata.name(chr(c), "").split(" ")[0], 0)
    for name, (one, plain) in LIKE.items():
        for a, b in zip(one, plain, strict=True):
            latin[ord(a)] = ord(b)
            if name in ("CYRILLIC", "GREEK"):
                script[ord(a)] = script[ord(b)] = MANY
    # Of other scripts a word has letters of its own, or it is taken for Latin.
    for one, plain in [LATIN_LIKE, *LIKE.values()]:
        for a, b in zip(one, plain, strict=True):
            latin[ord(a)], script[ord(a)] = ord(b), script[ord(b)]
    # Letters of mathematical fonts and numerals made of one letter, by their decompositions.
    for c in [*range(0x2100, 0x2190), *range(0x1D400, 0x1D800)]:
        shape = unicodedata.decomposition(chr(c)).split()
        if len(shape) == 2 and (shape[0] == "<font>" or shape[0] == "<compat>" and unicodedata.category(chr(c)) == "Nl"):
            latin[c] = latin[int(shape[1], 16)]
            script[c] = script[latin[c]]
    # An accent on a look-alike: the accented letters look alike too.
    for c in range(0x110000):
        if 0x370 <= c < 0x530 and len(p := unicodedata.decomposition(chr(c)).split()) == 2 and p[0][0] != "<":
            base = latin[int(p[0], 16)]
            if base != int(p[0], 16) and len(w := unicodedata.normalize("NFC", chr(base) + chr(int(p[1], 16)))) == 1:
                latin[c] = ord(w)
                script[c] = script[ord(w)] = MANY
    back = {k: np.arange(0x110001, dtype=np.uint32) for k in range(1, len(LIKE) + 2)}
    for c in range(0xA500, 0x36F, -1):
        k = names.get(unicodedata.name(chr(c), "").split(" ")[0], 0) if latin[c] != c else 0
        if k > 1:
            back[k][latin[c]] = c
    return {
        "to": to, "ccc": ccc, "longer": longer, "many": np.array([[*map(ord, many[c]), *[DROP] * (4 - len(many[c]))] for c in sorted(many)], np.uint32).reshape(-1, 4),
        "pairs": keys, "joined": np.array([pairs[int(k) >> 21, int(k) & 0x1FFFFF] for k in keys], np.uint32), "latin": latin, "script": script, "back": back,
    }


def _keep(flat: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _widths(flat: np.ndarray, offsets: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Gather through the table; code points that become several get room by expansion offsets."""
    at = np.searchsorted(t["longer"], flat)
    at[at == len(t["longer"])] = 0
    big = t["longer"][at] == flat if len(t["longer"]) else np.zeros(len(flat), bool)
    out = t["to"][flat]
    if big.any():
        size = np.where(big, (t["many"][at] != DROP).sum(1), 1)
        ends = np.concatenate([[0], np.cumsum(size)])
        grown = np.repeat(out, size)
        nth = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
        inside = np.repeat(big, size)
        grown[inside] = t["many"][np.repeat(at, size)[inside], nth[inside]]
        out, offsets = grown, ends[offsets]
    return out, offsets


def _compose(flat: np.ndarray, offsets: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of marks, then pairwise composition until nothing changes."""
    ccc = t["ccc"][flat]
    jamo = (flat >= 0x1161) & (flat <= 0x11C2)
    if not (ccc.any() or jamo.any()):
        return flat, offsets
    first = np.zeros(len(flat) + 1, bool)
    first[offsets] = True
    run = np.cumsum((ccc == 0) | first[:-1])
    if (np.diff(ccc.astype(np.int16))[(ccc[1:] > 0) & (np.diff(run) == 0)] < 0).any():
        flat = flat[np.lexsort((np.arange(len(flat)), ccc, run))]
    while len(flat) > 1:
        ccc = t["ccc"][flat]
        first = np.zeros(len(flat) + 1, bool)
        first[offsets] = True
        pos = np.arange(len(flat))
        starter = np.maximum.accumulate(np.where((ccc == 0) | first[:-1], pos, 0))
        prior = np.concatenate([[0], starter[:-1]])
        blocked = np.concatenate([[0], ccc[:-1]])
        near = prior == pos - 1
        mark = (ccc > 0) & ~first[:-1] & (ccc[prior] == 0) & (near | (blocked < ccc) & (blocked > 0))
        key = (flat[prior].astype(np.uint64) << np.uint64(21)) | flat.astype(np.uint64)
        at = np.minimum(np.searchsorted(t["pairs"], key), len(t["pairs"]) - 1)
        hit = mark & (t["pairs"][at] == key)
        to = t["joined"][at]
        before = flat[prior]
        v = near & ~first[:-1] & (before >= 0x1100) & (before <= 0x1112) & (flat >= 0x1161) & (flat <= 0x1175)
        w = near & ~first[:-1] & (before >= 0xAC00) & (before <= 0xD7A3) & ((before.astype(np.int64) - 0xAC00) % 28 == 0) & (flat >= 0x11A8) & (flat <= 0x11C2)
        to = np.where(v, 0xAC00 + ((before.astype(np.int64) - 0x1100) * 21 + flat.astype(np.int64) - 0x1161) * 28, to)
        to = np.where(w, before.astype(np.int64) + flat.astype(np.int64) - 0x11A7, to).astype(np.uint32)
        hit |= v | w
        where = np.flatnonzero(hit)
        if not len(where):
            break
        where = where[np.unique(prior[where], return_index=True)[1]]  # one mark of each letter at a time
        flat = flat.copy()
        flat[prior[where]] = to[where]
        keep = np.ones(len(flat), bool)
        keep[where] = False
        flat, offsets = _keep(flat, offsets, keep)
    return flat, offsets


def settle(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Width, space, line-end, invisible-character and composition differences removed."""
    t = _tables()
    cr = flat == 0x0D
    if cr.any():
        first = np.zeros(len(flat) + 1, bool)
        first[offsets] = True
        crlf = np.concatenate([cr[:-1] & (flat[1:] == 0x0A) & ~first[1:-1], [False]])
        flat, offsets = _keep(flat, offsets, ~crlf)
    flat, offsets = _widths(flat, offsets, t)
    flat, offsets = _keep(flat, offsets, flat != DROP)
    return _compose(flat, offsets, t)


def settled(flat: np.ndarray) -> np.ndarray:
    """Single code points in their plain width; those that would vanish stay."""
    to = _tables()["to"][flat]
    return np.where(to == DROP, flat, to)


def skeleton(flat: np.ndarray) -> np.ndarray:
    """Look-alike letters of other scripts as Latin ones: equal for texts that look the same."""
    return _tables()["latin"][flat]


def readable(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Look-alike letters put into the script of their word.

    The choice uses only letters that exist in one script; a word without any
    follows the nearest word that has some, the one after if both are as
    near. Texts with equal skeletons thus get equal results.
    """
    t = _tables()
    if not len(flat):
        return flat
    script = t["script"][flat]
    letter = script > 0
    first = np.zeros(len(flat) + 1, bool)
    first[offsets] = True
    starts = letter & ~(np.concatenate([[False], letter[:-1]]) & ~first[:-1])
    word = np.cumsum(starts) * letter
    n = int(word.max()) + 1
    kinds = [0, *(k for k in (2, 1, *range(3, len(LIKE) + 2)) if (script == k).any())]  # of equal counts the first
    sure = np.stack([np.zeros(n, np.int64), *(np.bincount(word[script == k], minlength=n) for k in kinds[1:])])
    for i, k in enumerate(kinds):
        if k > 3:
            sure[i] *= 1 << 20
    label = np.array(kinds)[sure.argmax(0)]
    label[0] = 0
    row = np.full(n, -1)
    row[1:] = owners(offsets)[starts]
    place = np.arange(n)
    before = np.maximum.accumulate(np.where(label > 0, place, 0))
    after = np.minimum.accumulate(np.where(label > 0, place, n - 1)[::-1])[::-1]
    far = 1 << 40
    back = np.where((label[before] > 0) & (row[before] == row), place - before, far)
    ahead = np.where((label[after] > 0) & (row[after] == row), after - place, far)
    near = np.where(np.minimum(back, ahead) == far, 1, np.where(back < ahead, label[before], label[after]))
    mine = np.where(label > 0, label, near)[word]
    out = np.where(letter, t["latin"][flat], flat)
    for k in kinds:
        if k > 1:
            out = np.where(letter & (mine == k), t["back"][k][out], out)
    return out.astype(np.uint32)


def canonical_text(array: pa.Array) -> pa.Array:
    """The consistent form of each text of an Arrow array."""
    flat, offsets = settle(*decode(array))
    out = encode(readable(flat, offsets), offsets)
    return pc.if_else(array.is_valid(), out, pa.scalar(None, pa.string())) if array.null_count else out


def canonicalize(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, look_hi, look_lo, exact, n_chars)``: the consistent form and hashes of the look and of the exact text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in slices(batches, "t"):
            keys, raw = b.column(0), b.column(1)
            flat, offsets = decode(raw)
            exact = segment_hash(flat, offsets[:-1], offsets[1:]).view(np.int64)
            n = np.diff(offsets)
            flat, offsets = settle(flat, offsets)
            look = skeleton(flat)
            hi, lo = (segment_hash(look, offsets[:-1], offsets[1:], k).view(np.int64) for k in (0, 1))
            null = ~raw.is_valid().to_numpy(zero_copy_only=False)
            out = encode(readable(flat, offsets), offsets)
            out = pc.if_else(raw.is_valid(), out, pa.scalar(None, pa.string())) if null.any() else out
            yield pa.RecordBatch.from_arrays([keys, out, *(pa.array(x, mask=null) for x in (hi, lo, exact, n.astype(np.int64)))], ["k", "t", "look_hi", "look_lo", "exact", "n_chars"])

    out = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, t string, look_hi long, look_lo long, exact long, n_chars long")
    return out.select(F.col("k").alias(key), F.col("t").alias(text), "look_hi", "look_lo", "exact", "n_chars")


def look_groups(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20) -> DataFrame:
    """``(key, group, forms, links)`` of the texts with an equal-looking other: the group's smallest key, its different forms, and the texts of other forms.

    One row for each text however large its group: groups and forms are counted, never paired.
    """
    seen = cut(canonicalize(df, key, text).filter(F.col("n_chars") >= least).select(F.col(key).alias("k"), "look_hi", "look_lo", "exact"))
    look = ["look_hi", "look_lo"]
    forms = seen.groupBy(*look, "exact").agg(F.min("k").alias("least"), F.count("*").alias("same"))
    groups = forms.groupBy(look).agg(F.min("least").alias("group"), F.count("*").alias("forms"), F.sum("same").alias("all")).filter("forms > 1")
    other = forms.join(groups, look).select(*look, "exact", "group", "forms", (F.col("all") - F.col("same")).alias("links"))
    return seen.join(other, [*look, "exact"]).select(F.col("k").alias(key), "group", "forms", "links")


def equal_looking(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20) -> DataFrame:
    """Pairs ``(key_a, key_b)`` of different texts of at least ``least`` characters that look the same.

    Exact copies are one class each; only classes of one look are paired, then
    expanded to their members, so a large group of copies makes no pairs of its own.
    """
    seen = cut(canonicalize(df, key, text).filter(F.col("n_chars") >= least).select(F.col(key).alias("k"), "look_hi", "look_lo", "exact"))
    look = ["look_hi", "look_lo"]
    groups = seen.groupBy(look).agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).filter("lo <> hi").select(look)
    members = cut(seen.join(groups, look))
    classes = members.select(*look, "exact").distinct()
    pairs = classes.join(classes.withColumnRenamed("exact", "other"), look).filter("exact < other")
    a = members.select(*look, "exact", F.col("k").alias("x"))
    b = members.select(*look, F.col("exact").alias("other"), F.col("k").alias("y"))
    out = pairs.join(a, [*look, "exact"]).join(b, [*look, "other"])
    return out.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
