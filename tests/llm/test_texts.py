"""Problems 2, 6, 9 and 10: markup, scans, leaks, look-alikes."""

import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import codepoints, leaks, lookalikes, markup, scans

DOCS = "doc_id long, text string"
EXTRA = "doc_id long, text string, k string, t string, word string, noise string, markup string, look_hi string, at int, head string"


def settle(s):
    flat, offsets = lookalikes.settle(*codepoints.decode(pa.array([s])))
    return codepoints.encode(flat, offsets)[0].as_py()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=6))
def test_code_points_round_trip(texts):
    texts = [t if t is None else t.encode("utf-8", "replace").decode() for t in texts]
    flat, offsets = codepoints.decode(pa.array(texts, pa.string()))
    assert codepoints.encode(flat, offsets).to_pylist() == [t or "" for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(categories=["L", "M", "N"], max_codepoint=0xFFFF), max_size=20))
def test_composition_is_canonical(text):
    plain = "".join(c for c in text if int(lookalikes._tables()["to"][ord(c)]) == ord(c))
    assert settle(plain) == unicodedata.normalize("NFC", plain)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("ｆｕｌｌ １２", "full 12", True),
        ("e\u0301tat", "état", True),
        ("so\u00adft\u200b text\ufeff", "soft text", True),
        ("a\u00a0b\u2009c", "a b c", True),
        ("\u0430\u0441\u0435 \u03bf", "ace o", True),
        ("line\r\nnext", "line\nnext", True),
        ("\u03b1\u03c1\u03c5\u03ba", "apuk", True),
        ("\u04c0\u04cf \u0261 \u054d \u13aa", "Il g U A", True),
        ("\u2170 \U0001d400\U0001d4b7", "i Ab", True),
        ("\u039a\u03cc\u03c3\u03bc\u03bfς", "K\u00f3\u03c3\u03bcoς", True),
        ("\ua4e1\ua4f2\ua4e2", "LIS", True),
        ("s\u0131n", "sin", False),
        ("etat", "état", False),
        ("x²", "x2", False),
        ("1", "l", False),
        ("a b", "ab", False),
    ],
)
def test_same_look(a, b, same):
    look = lambda s: lookalikes.skeleton(lookalikes.settle(*codepoints.decode(pa.array([s])))[0]).tolist()
    assert (look(a) == look(b)) == same
    if same:
        out = lookalikes.canonical_text(pa.array([a, b])).to_pylist()
        assert out[0] == out[1]


def test_words_stay_in_their_script():
    texts = ["Проверкa зaписи", "pаge of tехt", None, ""]
    assert lookalikes.canonical_text(pa.array(texts)).to_pylist() == ["Проверка записи", "page of text", None, ""]
    own = ["Հայաստան ու Երևան", "ᎠᏂᏴᏫᏯ ᏣᎳᎩ", "σοφία και γνώση", "ⲡⲓⲥⲁⲅⲅⲉⲗⲟⲥ"]
    assert lookalikes.canonical_text(pa.array([*own, "σ\u006fφία", "ⲡⲓⲥⲁⲅⲅⲉⲗoⲥ"])).to_pylist() == [*own, "σοφία", own[3]]
    mixed = "Новые листы и THE FORMAL AT REST, но со всеми. K63"
    assert lookalikes.canonical_text(pa.array([mixed])).to_pylist() == ["Новые листы и THE FORMAL AT REST, но со всеми. К63"]


def test_equal_looking(spark):
    base = "The rotor of the pump is sealed."
    rows = [(1, base), (2, base.replace("o", "\u03bf")), (3, base), (4, base + "\u200b"), (5, None), (6, ""), (7, "short\u200b"), (8, "short"), (9, base[:-1]), (1, base)]
    df = spark.createDataFrame([(*r, *["x"] * 6, 1, "x") for r in rows], EXTRA)
    got = sorted(set(map(tuple, lookalikes.equal_looking(df).collect())))
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert {tuple(r) for r in lookalikes.look_groups(df).collect()} == {(1, 1, 3, 2), (2, 1, 3, 4), (3, 1, 3, 2), (4, 1, 3, 4)}
    assert lookalikes.look_groups(df.limit(0)).count() == 0
    assert lookalikes.equal_looking(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("plain text, 5 * 3 * 2 bytes, $46 per seat or $97, a == b, C:\\temp\\new\\x, R&D, 14%, #5 and C#, {slot}", set()),
        ("one <b>word</b>", {"html"}),
        ("a&nbsp;b", {"html"}),
        ("cut <a href=\"/x off", {"html"}),
        ("**bold** word", {"markdown"}),
        ("# Title", {"markdown"}),
        ("see [x](y.md)", {"markdown"}),
        ("note[^3] here", {"markdown"}),
        ("the [[pump|rotor]] runs", {"wiki"}),
        ("a ''word'' here", {"wiki"}),
        ("x {{citation needed}} y", {"wiki"}),
        ("x __NOTOC__ y", {"wiki"}),
        ("an \\emph{open} end", {"latex"}),
        ("so $a^2 + b$ holds", {"latex"}),
        ("a ``quoted'' word", {"latex"}),
        ("12\\% of it", {"latex"}),
        ("```\n<b> # not [[markup]] $x^2$\n```", {"markdown"}),
        ("text\n\n    <b>shown</b> **as** code\n\nmore", set()),
        ("<pre>**no** [[link]]</pre>", {"html"}),
        ("\\begin{verbatim}\n<b>x</b> **y**\n\\end{verbatim}", {"latex"}),
        ("set max_chunk_size and min_chunk_size", set()),
        ("$45 per [^2] seat or $97", {"markdown"}),
        ("only if n < 6 and m\n> 31 for it", set()),
        ("said:\n\n> quoted words", {"markdown"}),
        (None, set()),
        ("", set()),
    ],
)
def test_markup_signs(text, found):
    assert markup.signs(text) == found


def test_structure_stays():
    page = (
        "<html><head><title>T</title><style>p {}</style></head><body><div id='nav'><ul><li><a href='/'>home</a></li><li><a href='/x'>shop</a></li></ul></div>"
        "<h2>Part</h2><p>The text of the first part is here, and it is long enough to be one.</p><ul><li>one item of the list</li><li>two</li></ul>"
        "<table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table><pre>x &lt; 1\n  y</pre><!-- gone --></body></html>"
    )
    clean, found = markup.clean(page)
    assert found == {"html"}
    assert "## Part" in clean and "- one item of the list\n- two" in clean and "a | 1\nb | 2" in clean and "```\nx < 1\n  y\n```" in clean
    assert "gone" not in clean and "home" not in clean and "<" not in clean.replace("x < 1", "")
    tex = "\\documentclass{a}\n\\section{Part}\nThe \\textbf{old} pump\\footnote{Or so.} is on~\\cite{x} $x^2$ 5\\%.\n\\begin{itemize}\n\\item one\n\\end{itemize}\n\\[ a^2 \\]"
    clean, _ = markup.clean(tex)
    assert "## Part" in clean and "The old pump is on $x^2$ 5%." in clean and "- one" in clean and "$$a^2$$" in clean and "\\" not in clean
    clean, _ = markup.clean("== Part ==\nThe '''old''' [[pump|rotor]] of the {{lang|hall}} is on.{{cn}}\n* one\n{| class=x\n|-\n| a || 1\n|}")
    assert "# Part" in clean and "The old rotor of the hall is on." in clean and "- one" in clean and "a | 1" in clean
    clean, _ = markup.clean("Part\n====\n\nThe **old** [pump](x.md) is ~~not~~ `on`.[^1]\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx = 1\n```")
    assert clean == "# Part\n\nThe old pump is not on.\n\na | b\n1 | 2\n\n```\nx = 1\n```"


def test_percentages_stay_beside_latex():
    prose = "The desk keeps 60% of the stock, 5 % of it old, and the % of loss is small. The \\emph{rest} stays."
    assert markup.clean(prose)[0] == "The desk keeps 60% of the stock, 5 % of it old, and the % of loss is small. The rest stays."
    source = "\\section{Part}\nIt holds 60% of all. % aside\n% a comment\n  % another\nThe end of it."
    assert markup.clean(source)[0] == "## Part\n\nIt holds 60% of all.\n\nThe end of it."


def test_plain_text_is_untouched():
    text = "No markup here,\n  as it is.  \n"
    assert markup.clean(text) == (text, set())


def test_markup_table(spark):
    long = "The <b>same</b> words go on and on. " * 40_000
    rows = [(1, None), (2, ""), (3, long), (4, "<i>x</i> **y z**"), (4, "<i>x</i> **y z**"), (5, "plain")]
    df = spark.createDataFrame([(*r, *["x"] * 6, 1, "x") for r in rows], EXTRA)
    assert sorted(map(tuple, markup.markup_found(df).collect())) == [(3, "html"), (4, "html"), (4, "markdown")]
    out = {r.doc_id: r.text for r in markup.cleaned(df).collect()}
    assert out[1] is None and out[2] == "" and out[5] == "plain" and "<b>" not in out[3] and len(out[3]) > 1_000_000
    assert markup.markup_found(df.limit(0)).count() == 0


WORDS = "the sealed gearbox turns without losing any detail and this register confirms every single movement of that heavy furnace".split()


def corpus():
    rows = [(100 + i, " ".join(WORDS[i % 7 :] + WORDS[: i % 7])) for i in range(200)]
    scan = "HEAVY FURNACE REPORT\nthe sealed gear-\nbox turns without losing any\n- 11 -\n\fHEAVY FURNACE REPORT\ndetail and th!s registcr confirms\nevery single movement of that\n- 12 -\n\fHEAVY FURNACE REPORT\nheavy furnace."
    return [*rows, (1, scan), (2, None), (3, ""), (4, "12\n45\n12"), (5, "a line\nwith bm25 and sha256\nand more"), (6, "x " * 300_000), (1, scan)]


def test_scan_noise(spark):
    df = spark.createDataFrame([(*r, *["x"] * 6, 1, "x") for r in corpus()], EXTRA)
    assert sorted(map(tuple, scans.scan_noise(df).collect())) == [(1, k) for k in ("hyphen", "misread", "page_no", "running_head")]
    assert scans.scan_noise(df.limit(0)).count() == 0


def test_markup_in_a_scan_keeps_its_heads(spark):
    page = "Formal Report Tamir\nthe sealed gearbox turns\n{} without losing\n\fFormal Report Tamir\nany detail and every\nsingle movement."
    table = "intro\n\n| Name of it\n| a\n\n| Name of it\n| b\n\n```\nreturn value\n\nreturn value\n```\n"
    rows = [*((i, page.format(x)) for i, x in enumerate(("|ook-up", "see ](", "====", "</", "plain"))), (9, table)]
    got = {r.doc_id for r in scans.scan_noise(spark.createDataFrame(rows, DOCS)).filter("noise = 'running_head'").collect()}
    assert got == {0, 1, 2, 3, 4}
    assert scans.head_of("|ook-up Office") == scans.head_of("look-up Office") and scans.head_of("|a | office") is None


def test_repair(spark):
    rows = [r for i, r in enumerate(corpus()) if r[0] != 1 or i == 200]
    out = {r.doc_id: r.text for r in scans.repaired(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[1] == "the sealed gearbox turns without losing any detail and this register confirms every single movement of that heavy furnace."
    assert all(out[k] == v for k, v in rows if k != 1)


def test_confusions():
    assert scans.derives("modern", "rnodern") and scans.derives("quilt", "qui1t") and not scans.derives("a", "a") and not scans.derives("cat", "dog")
    assert scans.skeleton("va|ve") == scans.skeleton("valve") and scans.skeleton("biicket") == scans.skeleton("bucket") and scans.skeleton("seconcl") == scans.skeleton("second")


ITEM = "In Neldavel the answer follows the verified Kedel relay on every branch once Xasa archives the coarse furnace after Fidranaxa removes the old file and Zelwelm moves its signature"


def leaked(spark, rows, items, **how):
    d = spark.createDataFrame([(*r, *["x"] * 6, 1, "x") for r in rows], EXTRA)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, k string")
    return sorted(map(tuple, leaks.leaks(d, i, **how).collect()))


def test_leaks(spark):
    w = ITEM.split()
    filler = "Every other report names another pump of the northern depot without any loss. "
    rows = [
        (1, filler + " ".join(w[3:20]) + ". " + filler),
        (2, filler + " ".join(w[3:13]) + " nothing else here. " + filler),
        (3, filler + " ".join(w[2:18]).replace("relay", "<b>relay</b>").replace("furnace", "fur-\nnace") + filler),
        (4, filler + " ".join(w[2:20]).replace("e", "\u0435").replace("verified", "veri\u200bfied")),
        (5, filler + " ".join(w[2:20]).replace("verified", "vcrified").replace("branch", "brancb")),
        (6, None), (7, ""), (8, filler * 3000 + " ".join(w[:16]) + filler * 3000), (1, filler + " ".join(w[3:20]) + ". " + filler),
        (9, "Read the passage below and answer briefly: " + filler),
    ]
    phrase = "Read the passage below and answer briefly: "
    items = [(1, phrase + ITEM), (2, phrase + "too short"), (3, None), (4, ""), (5, phrase + " ".join(reversed(w))), (6, phrase + " ".join(sorted(w)))]
    want = [(1, 1), (3, 1), (4, 1), (5, 1), (8, 1)]
    assert leaked(spark, rows, items) == want
    assert leaked(spark, rows, items, block=2) == want
    assert leaked(spark, rows[:0], items) == [] and leaked(spark, rows, items[:0]) == []


def test_leaks_in_what_repair_leaves_out(spark):
    w = ITEM.split()
    lines = "\n".join(" ".join(w[i : i + 6]) for i in range(2, 26, 6))
    filler = "Every other report names another pump of the northern depot without any loss. "
    part = " ".join(w[2:20])
    rows = [
        (1, f"{filler}\n{lines}\n{filler}\n{lines}\n{filler}"),
        (2, filler + "{{quote|" + part + "}} " + filler),
        (3, filler + "<ref>" + part + "</ref> " + filler),
        (4, f"<p>{filler * 3}</p><noscript>{part}</noscript><p>{filler}</p>"),
        (5, f"1\n{lines}\n2\n\f{lines}\n3\n{filler}"),
        (6, f"{filler}\n{' '.join(w[2:9])}\n{filler[:40]}\n{' '.join(w[30:])}\n{filler}"),
    ]
    assert leaked(spark, rows, [(1, ITEM)]) == [(i, 1) for i in range(1, 6)]


def built(texts, words=12):
    items = [leaks.Item(t, words) for t in texts]
    return leaks.Items(list(range(len(texts))), texts, [i.index(set()) for i in items], words)


def passages_in(texts, items):
    doc, item = items.candidates(*leaks.letter_stream(pa.array([leaks.untagged(t) for t in texts])))
    ok = leaks._verify(texts, doc, item, items)
    return set(zip(doc[ok].tolist(), item[ok].tolist(), strict=True))


PARTS = st.lists(st.text(alphabet="abcdehilmnorstu", min_size=1, max_size=11), min_size=12, max_size=60)


@settings(max_examples=150, deadline=None)
@given(PARTS, st.data())
def test_every_verbatim_passage_is_found(words, data):
    at = data.draw(st.integers(0, len(words) - 12))
    filler = "Every other report names another pump of the northern depot without any loss. "
    items = built([" ".join(words), "an item of quite other words that has nothing at all to do with the one that is looked for"])
    assert (0, 0) in passages_in([filler + " ".join(words[at : at + 12]) + ". " + filler], items)


def test_short_and_long_passages(spark):
    short = "if it is so we do as he or I do it when the rest of the crew is away for good and all"
    one = "a b c d e f g h i j k l m n o p q r s t"
    filler = "Every other report names another pump of the northern depot without any loss. "
    rows = [(1, filler + " ".join(short.split()[:12]) + ". " + filler), (2, filler + " ".join(one.split()[4:16]) + ". " + filler), (3, filler), (4, " ".join(short.split()[:11]))]
    items = [(1, short), (2, one), (3, ITEM)]
    assert leaked(spark, rows, items) == [(1, 1), (2, 2)] == leaked(spark, rows, items, block=1)


def test_opening_phrases_of_any_length_count_over_all_items(spark):
    phrase = "Please read all of the following passage with great care and then answer the question below in one short sentence only without any further comment: "
    items = [(i, phrase + " ".join(f"w{i}x{k}" for k in range(20))) for i in range(6)] + [(9, ITEM)]
    rows = [(1, phrase + "and nothing else"), (2, "so " + items[2][1])]
    for block in (1, 20_000):
        assert leaked(spark, rows, items, block=block) == [(2, 2)]


def test_long_tags_and_prose_in_brackets():
    w = ITEM.split()
    tag = "<img alt='x' data-x='" + "y " * 300 + "'>"
    prose = "if n <m and " + " ".join(w[2:26]) + " and more of the same words " * 12 + "> 3"
    assert passages_in([" ".join(w[2:10]) + tag + " ".join(w[10:18]), prose], built([ITEM])) == {(0, 0), (1, 0)}


def test_alignment_marks_equal_letters():
    import numpy as np

    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in ("abcdefghij", "zzabcXdefgij"))
    hit = leaks.align([x, x[:3]], [y, y], [2, 2], 6)
    assert "".join(c for c, h in zip("abcdefghij", hit[0], strict=True) if h) == "abcdefgij" and hit[1].all()


def test_control_characters_in_marked_text():
    text = "\x0312\x03 a <b>bold</b> \x01word\x02 and <code>x</code> \x03"
    assert markup.clean(text) == ("\x0312\x03 a bold \x01word\x02 and x \x03", {"html"})
    assert markup.clean("﷐ <i>x</i> \x01")[0] == "﷐ x \x01"


def test_nesting_and_lengths_have_no_limit():
    deep = "before {{a|" * 6 + "x" + "}}" * 6 + " after"
    assert markup.clean("{{a|{{b|{{c|{{d|{{e}}}}}}}}}} rest of it")[0].strip() == "rest of it"
    assert markup.clean(deep)[0] == "before  after" or markup.clean(deep)[0] == "before after"
    assert markup.clean("\\textbf{a \\emph{b \\textit{c \\underline{d \\texttt{e}}}}} f")[0] == "a b c d e f"
    assert markup.clean("x\\footnote{a {b {c {d}}} e} y")[0].startswith("x y")
    assert markup.signs("[[" + "a" * 5000 + "]]") == {"wiki"}
    long = "Heading of many words " * 20
    assert markup.clean(f"{long.strip()}\n====\n\ntext <b>x</b>")[0].startswith("# Heading")
    assert markup.clean("{{" * 50_000 + " word <b>x</b>")[1] >= {"html"}


def test_labels_decide_what_is_markup():
    prose = "    The rest of the report is about the *old* pump and the loss of it, as the desk has it on file, and no more.\n"
    code = "    for *p* in x: q[0] = **y**\n\n    z = *w*\n"
    assert markup.signs("intro\n\n" + prose) == {"markdown"} and markup.signs("intro\n\n" + code) == set()
    blocks = ["    x = {1: 2}", "    y z", "word", "The rest of the report is about the old pump and the loss of it."]
    assert markup.classify(blocks) == ["code", "code", "text", "text"]
    assert markup.classify(["\x01home\x02 \x01shop\x02", "see", "\x01a\x02"]) == ["menu", "menu", "menu"]


def test_plain_menus_are_left_out():
    menu = "https://a.org/one https://a.org/two https://a.org/three"
    text = "The rest of the report is about the old pump and the loss of it, as https://a.org has it."
    assert markup.clean(f"{menu}\n\n{text}\n") == (text, set()) and markup.clean(text + "\n") == (text + "\n", set())


def test_lengths_of_scans_have_no_limit(spark):
    long = "antidisestablishmentarianismsandcounterrevolutionaries"
    head = "A running head of a page that is far longer than ninety characters because the printer had much room"
    page = "[ " + "1" * 3 + " ]"
    text = f"{head}\nthe first page of it goes on\n{page}\n\f{head}\nand the second ends here\n[ 112 ]\n"
    wide = "A line of prose that is repeated and that is far longer than ninety characters but stands on no page end"
    rows = [(1, text), (2, f"{wide}\na\nb\nc\nd\n{wide}\nx\n")]
    got = {tuple(r) for r in scans.scan_noise(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, "running_head"), (1, "page_no")}
    assert scans.tokens(f"a {long} b") == [long] and scans.number_on("Seite   12  of  14")[0] == "12"


def test_hyphens_of_their_own_and_lists(spark):
    clean = "the well-known pump of the long-lived desk has a gearbox. " * 6 + "an old fellow went over and about it. " * 6
    scan = "the well-\nknown pump and the gear-\nbox of the Set-\nPoint desk are of a long-\nlived kind; an old-\nfellow sepa-\nrate loss¬\nes.\n* item one of it\n* item two\ngoes on.\n1. first\n2. second"
    rows = [(1, scan), *((10 + i, clean) for i in range(3))]
    out = {r.doc_id: r.text for r in scans.repaired(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[1] == "the well-known pump and the gearbox of the Set-Point desk are of a long-lived kind; an old-fellow separate losses.\n* item one of it\n* item two goes on.\n1. first\n2. second"
    assert out[10] == clean


def test_neighbours_decide_between_forms(spark):
    # "bare" is a word of its own, one tenth as frequent as "hare"; only where its neighbours know "hare" is it misread.
    rows = [(100 + i, "then a hare runs over the old field") for i in range(300)]
    rows += [(500 + i, "with bare hands they went") for i in range(20)]
    rows += [(1, "then a bare runs over\nthe old field with\n- 1 -\n\fso the\n- 2 -\n"), (2, "with bare hands they went\nover it\n- 1 -\n\fso the\n- 2 -\n")]
    got = {tuple(r) for r in scans.scan_noise(spark.createDataFrame(rows, DOCS)).filter("noise = 'misread'").collect()}
    assert got == {(1, "misread")}


def test_planted_noise_is_repaired(spark):
    import random

    rng = random.Random(7)
    words = "pump valve gearbox furnace register movement detail signature archive relay branch harbour timber meadow lantern bridge copper window garden engine".split()
    common = "the a of and with into over under from that this every".split()
    sentence = lambda: " ".join(rng.choice(common) if i % 2 else rng.choice(words) for i in range(12)).capitalize() + "."
    texts = [" ".join(sentence() for _ in range(12)) for _ in range(160)]
    rows, want = [], {}
    for i, t in enumerate(texts):
        if i % 4:
            rows.append((i, t))
            continue
        want[i], lines, line = t, [], ""
        for w in t.split():
            bare = w.rstrip(".")
            if len(bare) > 5 and rng.random() < 0.08:
                w = w.replace("e", "c", 1) if rng.random() < 0.5 else w.replace("i", "1", 1).replace("a", "@", 1)
            if len(line) + len(w) > 50:
                if len(bare) > 6 and w.isalpha():
                    lines.append(f"{line} {w[:4]}-".strip())
                    line = w[4:]
                    continue
                lines.append(line)
                line = ""
            line = f"{line} {w}".strip()
        lines.append(line)
        pages = [lines[s : s + 8] for s in range(0, len(lines), 8)]
        rows.append((i, "\n\f".join("\n".join(["Works Report of Tamir", *p, f"- {20 + n} -"]) for n, p in enumerate(pages))))
    out = {r.doc_id: r.text for r in scans.repaired(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(out[i] == t for i, t in rows if i not in want)
    pairs = [(a, b) for i, t in want.items() for a, b in zip(t.split(), out[i].split(), strict=False)]
    assert all(len(t.split()) == len(out[i].split()) for i, t in want.items())
    wrong = [p for p in pairs if p[0] != p[1]]
    assert len(wrong) <= 0.005 * len(pairs), wrong[:40]
    assert sum(a == b for a, b in pairs) >= 0.995 * len(pairs)
