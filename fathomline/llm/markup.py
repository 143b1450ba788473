"""Problem 2: markup residue in text, and clean text that keeps its structure.

Method: two-pass rules classify blocks. In the first pass stop-word density,
length and link density decide; in the second, ambiguous short blocks inherit
the label of the nearest decided neighbours. The raw blocks are labelled first:
what is code shows markup and carries none, so the languages are looked for in
the other blocks only. Markup is then converted block by block, and the blocks
that come of it are labelled again: menus and link lists are left out.
Headings, lists, tables, code blocks and formulas stay, in one plain notation:
``#`` headings, ``-`` items, ``a | b`` rows, fenced code, ``$`` formulas.

Defined results: a null text stays null and carries no markup; an empty text
stays empty; a text without markup and menus stays as it is; nesting and
lengths have no limit; repeated rows are converted each; other columns are
ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import slices

LANGUAGES = ("html", "markdown", "wiki", "latex")
_TAGS = "a|abbr|article|aside|b|big|blockquote|body|br|button|caption|center|cite|code|col|colgroup|dd|del|details|div|dl|dt|em|embed|figcaption|figure|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|li|link|main|mark|meta|nav|noscript|object|ol|option|p|pre|q|s|samp|script|section|select|small|span|strike|strong|style|sub|summary|sup|table|tbody|td|textarea|tfoot|th|thead|title|tr|tt|u|ul|var|video"
_CODE = re.compile(
    r"(?P<markdown>^ {0,3}(?P<f>```+|~~~+)[^\n`]*\n(?:.*?\n)??(?: {0,3}(?P=f)[ \t]*$|\Z))"
    r"|(?P<html><(?P<t>pre|code|xmp)\b[^<>]*>.*?(?:</(?P=t)\s*>|\Z))"
    r"|(?P<latex>\\begin\{(?P<e>verbatim\*?|lstlisting|minted)\}.*?(?:\\end\{(?P=e)\}|\Z))"
    r"|(?P<wiki><(?P<w>syntaxhighlight|source|nowiki)\b[^<>]*>.*?(?:</(?P=w)\s*>|\Z))",
    re.S | re.M | re.I,
)
_SIGNS = {
    "html": re.compile(
        rf"</?(?:{_TAGS})(?:\s+[a-zA-Z-]+\s*=|\s*/?>)|<!--|-->|<!DOCTYPE"
        r"|&(?:nbsp|amp|lt|gt|quot|apos|mdash|ndash|hellip|copy|[lr][sd]quo|[lr]aquo|[aeiouAEIOU](?:uml|acute|grave|circ)|[nNaAoO]tilde|szlig|ccedil|#\d+|#[xX][0-9a-fA-F]+);",
        re.I,
    ),
    "wiki": re.compile(
        r"\[\[[^\[\]\n]+\]\]|\[\[[^\W\d_]|\{\{[^{}\n]*\}\}|\{\{[A-Za-z][\w ]*(?:\||\n|:|$)"
        r"|(?<![\w'.,;:!?)}`])'{2,3}(?=[\w\[{])[^'\n]*(?:'[^'\n]+)*'{2,3}|^={2,6}[^=\n]+={2,6}\s*$|^\{\||^\|\}|^\|-\s*$"
        r"|__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION)__|<ref\b|</ref>|^#REDIRECT",
        re.M,
    ),
    "latex": re.compile(
        r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{"
        r"|\\(?:item|maketitle|begin|end|alpha|beta|gamma|frac|sqrt|sum|int|leq|geq|cdot|times|log|ldots|dots|LaTeX|noindent|newpage|tableofcontents|hline|par|it|bf|em|centering)\b(?![\\/])"
        r"|\{\\(?:it|bf|em|tt|sc)\b|\\\[|\\\]|\$\$|(?<![\w$])\$(?!\d[\d.,]*\s+[^\W\d_]{2})[^$\n]*[\\^_{][^$\n]*\$|``[^`'\n]+''|\\\\(?:\[|$)|(?<=\w)\\[%&#_]|~\\|^%\s",
        re.M,
    ),
}
# Markdown's signs, each with a string that it can't do without.
_MARKDOWN = [
    (need, re.compile(pattern, re.M))
    for need, pattern in (
        ("# ", r"^#{1,6} +[^\n]*[^\s.!?:;][ \t]*$"),
        ("*", r"(?<![\w*])\*{1,3}[^\W_](?:[^*\n]*[^\s*])?\*{1,3}(?!\w)"),
        ("__", r"(?<!\w)__(?!(?:NOTOC|TOC|FORCETOC|NOEDITSECTION)__)[^\W_](?:[^_\n]*[^\s_])?__(?!\w)"),
        ("~~", r"~~[^~\n]+~~|^~~~"),
        ("](", r"\]\("),
        ("![", r"!\["),
        ("][", r"\[[^\[\]\n]+\]\[\w+\]"),
        ("[^", r"\[\^\w+\]"),
        ("]: ", r"^\[[^\]\n]+\]:\s"),
        ("`", r"(?<!`)`[^`\n]+`(?!`)|^```"),
        ("> ", r"(?:\A|\n[ \t]*\n)>[ \t]+\S"),
        ("---", r"^\|?[ \t]*:?-{3,}:?[ \t]*\|[-| :]*$"),
        ("\n---", r"\w[^\n\w]*\n-{3,}[ \t]*$"),
        ("\n===", r"\w[^\n\w]*\n={3,}[ \t]*$"),
    )
]
# Without one of these a text carries nothing of the language.
_NEEDS = {
    "html": re.compile(r"[<&]|-->"),
    "wiki": re.compile(r"\[\[|\{\{|''|==|\{\||\|\}|\|-|__|<ref|#RED"),
    "latex": re.compile(r"[\\$%]|``"),
}
# Frequent function words of the languages of the texts.
STOP_WORDS = frozenset(
    "the a an and or but of in on at to for from by with as is are was were be it its this that each every no not if when unless after before until so both "
    "der die das den dem ein eine und oder aber von in im an am auf zu für mit als ist sind wenn nur nach vor bis bei "
    "le la les un une et ou mais de du des en au aux à pour par avec est sont quand si que ne pas sur dans "
    "el los las una y o pero del por para con es son cuando no se sin en "
    "и в во не на с со по к из у за от до что как если то для при".split()
)
# Marks of what is set aside; a text that has one of them gets it back at the end.
_LINK, _END, _ASIDE = "\x01", "\x02", "\x03"
_BLANK = re.compile(r"\n[ \t]*\n+")
_INDENTED = re.compile(r"(?:(?: {4}|\t)[^\n]*(?:\n|\Z))+\Z")
_SIGNED = re.compile(r"[;{}=<>$\\]|\*\*|\[\[|\]\(|\(\)|^\s*[#@]", re.M)
_LINKED = re.compile(r"\x01([^\x02]*)\x02|https?://\S+|www\.\S+")
TEXT, CODE, MENU = "text", "code", "menu"


def _code_out(text: str, found: set[str]) -> tuple[str, list[str]]:
    """``text`` with marks in place of its marked code blocks, and those blocks' contents."""
    kept: list[str] = []

    def take(m):
        kind = next(k for k in ("markdown", "html", "latex", "wiki") if m.group(k) is not None)
        body = m.group()
        if kind == "markdown":
            body = re.sub(r"\n? {0,3}(?:```+|~~~+)[ \t]*\Z", "", body.split("\n", 1)[1] if "\n" in body else "")
        elif kind == "html":
            body = html.unescape(re.sub(r"</?(?:%s)\b[^<>]*>" % _TAGS, "", body))
        elif kind == "latex":
            body = re.sub(r"^\\begin\{[^}]*\}(?:\[[^\]]*\])?\n?|\n?\\end\{[^}]*\}\Z", "", body)
        else:
            body = re.sub(r"</?(?:syntaxhighlight|source|nowiki)\b[^<>]*>", "", body)
        found.add(kind)
        inline = kind in ("html", "wiki") and "\n" not in body and not re.match(r"<pre", m.group(), re.I)
        kept.append(body if inline else f"```\n{body.strip(chr(10))}\n```")
        return f"{_ASIDE}{len(kept) - 1}{_ASIDE}" if inline else f"\n\n{_ASIDE}{len(kept) - 1}{_ASIDE}\n\n"

    if "```" in text or "~~~" in text or "<" in text or "\\begin" in text:
        text = _CODE.sub(take, text)
    return text, kept


def classify(blocks: list[str]) -> list[str]:
    """The label of each block, in two passes."""
    label: list[str | None] = []
    indented = [bool(_INDENTED.match(b)) for b in blocks]
    for b, inside in zip(blocks, indented, strict=True):
        words = b.lower().replace(_LINK, " ").replace(_END, " ").split()
        size = sum(map(len, words))
        linked = sum(len(x) for m in _LINKED.finditer(b) for x in (m.group(1) if m.group(1) is not None else m.group()).split()) if _LINK in b or "http" in b or "www." in b else 0
        density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0
        if inside:
            label.append(TEXT if density >= 0.3 and size >= 80 and not _SIGNED.search(b) else CODE if density < 0.1 or _SIGNED.search(b) else None)
        elif size and linked > 0.5 * size and (len(words) < 12 or density < 0.15):
            label.append(MENU)
        elif _ASIDE in b or "$$" in b or density >= 0.2 and size >= 40 or re.match(r"[^|\n]+ \| ", b):
            label.append(TEXT)
        elif size >= 140 and density >= 0.08:
            label.append(TEXT)
        else:
            label.append(None)
    out = []
    for i, b in enumerate(blocks):
        if label[i]:
            out.append(label[i])
            continue
        # Of an indented block the other indented ones are the neighbours: a listing goes on after a blank line.
        near: list[str] = []
        for j in range(1, len(blocks)):
            near = [label[k] for k in (i - j, i + j) if 0 <= k < len(blocks) and label[k] and indented[k] == indented[i]]
            if near or i - j < 0 and i + j >= len(blocks):
                break
        if indented[i]:
            out.append(TEXT if near and CODE not in near else CODE)
        else:
            out.append(MENU if near and TEXT not in near and not re.match(r"#{1,6} ", b) else TEXT)
    return out


def _labelled(text: str, found: set[str]) -> tuple[str, list[str]]:
    """``text`` with marks in place of all its code, marked or indented, and the code."""
    text, kept = _code_out(text, found)
    if "\n    " in text or "\t" in text or text[:1] == " ":
        parts = re.split(r"((?:\A|(?<=\n))[ \t]*\n)", text)  # blank lines lie between the blocks
        blocks = parts[::2]
        for i, label in enumerate(classify(blocks)):
            if label == CODE:
                lines = blocks[i].rstrip("\n").split("\n")
                kept.append("```\n" + "\n".join(x[1:] if x[:1] == "\t" else x[4:] for x in lines) + "\n```")
                parts[2 * i] = f"\n\n{_ASIDE}{len(kept) - 1}{_ASIDE}\n\n"
        text = "".join(parts)
    return text, kept


def _shows(language: str, text: str) -> bool:
    if language == "markdown":
        return any(need in text and sign.search(text) for need, sign in _MARKDOWN)
    return bool(_NEEDS[language].search(text) and _SIGNS[language].search(text))


def signs(text: str | None) -> set[str]:
    """The markup languages of which ``text`` carries any markup outside its code blocks."""
    found: set[str] = set()
    if text:
        text, _ = _labelled(text, found)
        found.update(x for x in LANGUAGES if x not in found and _shows(x, text))
    return found


def _without(s: str, opener: str, closer: str) -> str:
    """``s`` without what stands between matching brackets, however deep."""
    out, stack, cuts = [], [], []
    for m in re.finditer(f"{re.escape(opener)}|{re.escape(closer)}", s):
        if m.group() == opener:
            stack.append(m.start())
        elif stack:
            start = stack.pop()
            while cuts and cuts[-1][0] > start:
                cuts.pop()
            cuts.append((start, m.end()))
    at = 0
    for a, b in cuts:
        out.append(s[at:a])
        at = b
    return "".join([*out, s[at:]])


_WRAP = re.compile(r"\\(?:textbf|textit|emph|underline|texttt|textsc|text|mbox|uline)\*?\{|\{\\(?:it|bf|em|tt|sc)\b\s*|(?<!\\)[{}]")


def _unwrapped(s: str) -> str:
    """``s`` without the commands that only change the look of their argument, however deep."""
    stack: list[bool] = []

    def take(m):
        t = m.group()
        if t == "}":
            return "" if stack and stack.pop() else t
        stack.append(t != "{")
        return "" if stack[-1] else t

    return _WRAP.sub(take, s) if "\\" in s else s


def _footnotes(s: str, notes: list[str]) -> str:
    """``s`` without its footnotes, which go to ``notes``; their braces may nest."""
    out, at = [], 0
    for m in re.finditer(r"\\footnote\{", s):
        if m.start() < at:
            continue
        depth = 1
        for b in re.finditer(r"(?<!\\)[{}]", s[m.end() :]):
            depth += 1 if b.group() == "{" else -1
            if not depth:
                notes.append(s[m.end() : m.end() + b.start()])
                out.append(s[at : m.start()])
                at = m.end() + b.end()
                break
        else:
            break
    return "".join([*out, s[at:]])


_KNOWN = frozenset(f"{_TAGS}|h1|h2|h3|h4|h5|h6|ref|gallery".split("|"))
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)\b(?:[^<>]*>|(?:\s+[a-zA-Z-]+\s*=\s*[\"'][^\s\"'<>]*[\"']?)+)")


def _from_html(s: str) -> str:
    s = re.sub(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>?|-->", "", s, flags=re.S | re.I)
    s = re.sub(r"<(script|style|noscript|head)\b[^<>]*>(.*?)(?:</\1\s*>|\Z)", lambda m: "\n\n# " + t.group(1).strip() + "\n\n" if m.group(1).lower() == "head" and (t := re.search(r"<title[^<>]*>([^<]*)", m.group(2), re.I)) and not re.search(r"<h1\b", s, re.I) else " ", s, flags=re.S | re.I)
    s = re.sub(r"<h([1-6])\b[^<>]*>", lambda m: "\n\n" + "#" * int(m.group(1)) + " ", s, flags=re.I)
    s = re.sub(r"\s*<li\b[^<>]*>", "\n- ", s, flags=re.I)
    s = re.sub(r"</t[dh]\s*>\s*<t[dh]\b[^<>]*>", " | ", s, flags=re.I)
    s = re.sub(r"\s*<tr\b[^<>]*>|<br\s*/?>", "\n", re.sub(r"</tr\s*>", "", s, flags=re.I), flags=re.I)
    s = re.sub(r"<a\b[^<>]*>", _LINK, s, flags=re.I)
    s = re.sub(r"</a\s*>", _END, s, flags=re.I)
    s = re.sub(r"<img\b[^<>]*?alt\s*=\s*[\"']([^\"'<>]*)[\"'][^<>]*>", r"\1", s, flags=re.I)
    s = re.sub(r"<sup\b[^<>]*>\s*\d+\s*</sup\s*>", "", s, flags=re.I)
    s = re.sub(r"</?(?:p|div|ul|ol|table|blockquote|section|article|header|footer|nav|body|html|h[1-6]|pre|hr|dl|dt|dd)\b[^<>]*>", "\n\n", s, flags=re.I)
    s = _TAG.sub(lambda m: "" if m.group(1).lower() in _KNOWN else m.group(), s)
    return html.unescape(s).replace("\xa0", " ")


def _from_wiki(s: str) -> str:
    # Lines that begin with a space are shown as typed.
    s = re.sub(r"(?:^ [^\n]*\S[^\n]*(?:\n|\Z))+", lambda m: "\n```\n" + re.sub(r"^ ", "", m.group(), flags=re.M).rstrip("\n") + "\n```\n", s, flags=re.M)
    s = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?(?:</ref>|$)|</ref>", "", s, flags=re.S)
    s = re.sub(r"^\{\{\s*Infobox[^\n]*\n(.*?)^\}\}\s*$", lambda m: "\n\n" + re.sub(r"^\|\s*([^=\n]+?)\s*=\s*", r"- \1: ", m.group(1), flags=re.M) + "\n\n", s, flags=re.S | re.M)
    s = re.sub(r"\{\{\s*(?:lang|nowrap|small|big)\s*\|(?:[a-z-]{2,5}\|)?([^{}]*)\}\}", r"\1", s)
    s = _without(s, "{{", "}}")
    s = re.sub(r"\[\[(?:Category|Kategorie|Catégorie|Categoría)\s*:[^\[\]]*\]\]", "", s)
    s = re.sub(r"\[\[(?:File|Image|Datei)\s*:[^\[\]|]*(?:\|(?:thumb|right|left|frame|\d+px))*\|?([^\[\]]*)\]\]", r"\1", s)
    s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", _LINK + r"\1" + _END, s)
    s = re.sub(r"\[\[|\]\]|\{\{|\}\}|__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION)__", "", s)
    s = re.sub(r"^[*#:;]+\s*(?=[^\W_])", "- ", s, flags=re.M)
    s = re.sub(r"^(={2,6})\s*([^=\n]+?)\s*={2,6}\s*$", lambda m: "\n" + "#" * (len(m.group(1)) - 1) + " " + m.group(2) + "\n", s, flags=re.M)
    s = re.sub(r"^\{\|[^\n]*$|^\|\}[^\n]*$|^\|-[^\n]*$", "", s, flags=re.M)
    s = re.sub(r"^[|!]\s*([^\n]*)$", lambda m: re.sub(r"\s*(?:\|\||!!)\s*", " | ", m.group(1)), s, flags=re.M)
    return re.sub(r"'{2,5}", "", s)


_COMMENT = re.compile(r"^[ \t]*%[^\n]*", re.M)
# Behind a number the sign is a percentage; behind other words it is a comment in LaTeX sources, not in prose with a scrap.
_TRAILING = re.compile(r"(?<![\\\d])(?<!\d[ \xa0\u2009\u202f])%[ \t][^\n]*")
_SOURCE = re.compile(r"\\(?:documentclass|usepackage|begin|(?:sub)*section|chapter)\b")


def _from_latex(s: str) -> str:
    s = _COMMENT.sub("", s)
    if _SOURCE.search(s):
        s = _TRAILING.sub("", s)
    s = re.sub(r"\\(?:documentclass|usepackage|bibliographystyle|bibliography|pagestyle)\*?(?:\[[^\]]*\])?\{[^{}]*\}|\\(?:maketitle|tableofcontents|newpage|noindent|centering|hline|par)\b", "", s)
    notes: list[str] = []
    s = _footnotes(s, notes)
    s = re.sub(r"\\(?:title|chapter)\*?\{([^{}]*)\}", r"\n\n# \1\n\n", s)
    s = re.sub(r"\\(section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: "\n\n" + {"section": "##", "subsection": "###", "subsubsection": "####", "paragraph": "#####"}[m.group(1)] + " " + m.group(2) + "\n\n", s)
    s = re.sub(r"\s?\(\\ref\{[^{}]*\}\)|~?\\(?:cite[tp]?|ref|label|eqref|pageref|vspace|hspace|index)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", s)
    s = re.sub(r"\\begin\{(?:equation|align|displaymath)\*?\}\s*(.*?)\s*\\end\{(?:equation|align|displaymath)\*?\}", r"\n\n$$\1$$\n\n", s, flags=re.S)
    s = re.sub(r"\\\[\s*(.*?)\s*\\\]", r"\n\n$$\1$$\n\n", s, flags=re.S)

    def table(m):
        rows = [" | ".join(c.strip() for c in r.split("&")) for r in re.split(r"\\\\", m.group(1)) if r.strip()]
        return "\n\n" + "\n".join(rows) + "\n\n"

    s = re.sub(r"\\begin\{tabular\}(?:\{[^{}]*\})?(.*?)\\end\{tabular\}", table, s, flags=re.S)
    s = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "\n", s)
    s = re.sub(r"^[ \t]*\\item(?:\[([^\]]*)\])?\s*", r"- \1", s, flags=re.M)
    s = re.sub(r"\\\\(?:\[[^\]\n]*\])?", " ", s)
    parts = re.split(r"(\$\$.*?\$\$|\$(?!\d[\d.,]*\s+[^\W\d_]{2})[^$\n]*[\\^_{][^$\n]*\$)", s, flags=re.S)
    for i in range(0, len(parts), 2):
        p = _unwrapped(parts[i])
        p = re.sub(r"\\[a-zA-Z]+\*?\{([^{}]*)\}?", r"\1", p)
        p = re.sub(r"``|''", '"', p)
        parts[i] = re.sub(r"\\([%&#_${}])", r"\1", p).replace("~", " ")
    s = "".join(parts)
    return s + "".join(f"\n\n{n}" for n in notes)


def _from_markdown(s: str) -> str:
    s = re.sub(r"\A---\n.*?\n---[ \t]*$", "", s, count=1, flags=re.S | re.M)
    if "\n===" in s or "\n---" in s:
        s = re.sub(r"^([^\n|]+)\n(={3,}|-{3,})[ \t]*$", lambda m: ("# " if m.group(2)[0] == "=" else "## ") + m.group(1), s, flags=re.M)
    s = re.sub(r"^\|?\s*:?-{3,}:?\s*\|[-| :]*\n?", "", s, flags=re.M)
    s = re.sub(r"^\|[ \t]*(.*?)[ \t]*\|[ \t]*$", r"\1", s, flags=re.M)
    s = re.sub(r"^\[[^\]\n]+\]:\s[^\n]*$", "", s, flags=re.M)
    s = re.sub(r"!\[([^\[\]\n]*)\]\([^()\s]*\)", r"\1", s)
    s = re.sub(r"\[([^\[\]\n]*)\]\([^()\s]*\)|\[([^\[\]\n]+)\]\[\w+\]", lambda m: _LINK + (m.group(1) if m.group(1) is not None else m.group(2)) + _END, s)
    s = re.sub(r"\[\^\w+\]:?", "", s)
    s = re.sub(r"(?<![\w*])(\*{1,3})([^\W_](?:[^*\n]*[^\s*])?)\1(?!\w)", r"\2", s)
    s = re.sub(r"(?<!\w)(__)([^\W_](?:[^_\n]*[^\s_])?)\1(?!\w)", r"\2", s)
    s = re.sub(r"~~([^~\n]+)~~|(?<!`)`([^`\n]+)`(?!`)", lambda m: m.group(1) or m.group(2), s)
    s = re.sub(r"^>\s?", "", s, flags=re.M)
    return re.sub(r"^[ \t]*[*+][ \t]+", "- ", s, flags=re.M)


_CONVERT = {"html": _from_html, "latex": _from_latex, "wiki": _from_wiki, "markdown": _from_markdown}


def _drop_boilerplate(text: str) -> str:
    """``text`` without its blocks that are menus."""
    blocks = [b for b in _BLANK.split(text) if b.strip(" \t\n\x01\x02")]
    return "\n\n".join(b.strip("\n") for b, label in zip(blocks, classify(blocks), strict=True) if label != MENU)


def _spare(text: str) -> dict[int, int]:
    """For each mark that ``text`` has, a character that it doesn't have."""
    had = [ord(m) for m in (_LINK, _END, _ASIDE) if m in text]
    free = (c for r in (range(0xFDD0, 0xFDF0), range(0xE000, 0xF900), range(0xF0000, 0xFFFFE)) for c in r if chr(c) not in text)
    return {m: next(free) for m in had}


def clean(text: str | None, blocks: bool = False) -> tuple[str | None, set[str]]:
    """Clean text and the markup languages that it carried; with ``blocks`` no block is left out as boilerplate."""
    if not text:
        return text, set()
    spare = _spare(text)
    if spare:
        out, found = clean(text.translate(spare), blocks)
        return out.translate({b: a for a, b in spare.items()}), found
    found: set[str] = set()
    s, code = _labelled(text, found)
    found.update(x for x in LANGUAGES if x not in found and _shows(x, s))
    if not found:
        # Without a change of words the text stays as it is.
        if blocks or "http" not in text and "www." not in text:
            return text, found
        kept = _drop_boilerplate(text)
        return (text if kept.split() == text.split() else kept), found
    if "\r\n" in text:
        s, code = _labelled(text.replace("\r\n", "\n"), set())
    # inner notations last: a wiki page may hold HTML, a Markdown page LaTeX
    for language in ("latex", "html", "wiki", "markdown"):
        if language in found:
            s = _CONVERT[language](s)
    if not blocks:
        s = _drop_boilerplate(s)
    s = s.replace(_LINK, "").replace(_END, "")
    s = re.sub(r"[ \t]+(?=\n)|(?<=\S)[ \t]{2,}", lambda m: "" if m.group().strip(" \t") == "" and m.end() < len(m.string) and m.string[m.end()] == "\n" else " ", s)
    s = re.sub(r"\n{3,}", "\n\n", s).strip("\n")
    return re.sub(r"\x03(\d+)\x03", lambda m: code[int(m.group(1))], s), found


def cleaned(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, markup)``: clean text and the sorted list of markup languages found."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in slices(batches, "t"):
            rows = [clean(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in rows], pa.string()), pa.array([sorted(m) for _, m in rows], pa.list_(pa.string()))], ["k", "t", "markup"])

    out = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, t string, markup array<string>")
    return out.select(F.col("k").alias(key), F.col("t").alias(text), "markup")


def markup_found(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, markup)``: one row for each text and markup language in it."""
    return cleaned(df, key, text).select(key, F.explode("markup").alias("markup")).distinct()
