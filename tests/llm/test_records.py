"""Problems 1, 3, 5, 7 and 8: vectors, dialogs, near copies, copies, containers."""

import hashlib
import itertools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import copies, dialogs, near_copies, packing, vector_neighbours


@pytest.mark.parametrize(("axes", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_hilbert_visits_neighbours(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    key = vector_neighbours.hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    x[450:] = x[:450] + rng.normal(size=(450, 16)) * 0.1
    x[700] = x[3]
    rows = [(i, [float(v) for v in x[i]], "a", 1.0, 2) for i in range(900)]
    rows += [(1000, None, "a", 1.0, 2), (1001, [0.0] * 16, "a", 1.0, 2), (1002, [1.0], "a", 1.0, 2), (1003, [], "a", 1.0, 2), (1004, [float("nan")] * 16, "a", 1.0, 2), (5, rows[5][1], "a", 1.0, 2)]
    return x, spark.createDataFrame(rows, "chunk_id long, embedding array<float>, other string, sim double, o int")


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    return c


def test_close_pairs_match_brute_force(vectors):
    x, df = vectors
    c = cosines(x)
    want = set()
    for i in range(len(x)):
        for j in np.lexsort((np.arange(len(x)), -c[i]))[:10]:
            if c[i, j] >= 0.9:
                want.add((min(i, j), max(i, j)))
    got = {tuple(r) for r in vector_neighbours.close_pairs(df, dim=16).collect()}
    assert not got - want and len(got & want) >= 0.99 * len(want)


def test_neighbours_recall(vectors):
    x, df = vectors
    c = cosines(x)
    rows = vector_neighbours.nearest(df, "chunk_id", "embedding", dim=16, window=128).collect()
    got = {(r.id, r.other) for r in rows}
    want = [(i, j) for i in range(len(x)) for j in np.argsort(-c[i])[:10]]
    assert np.mean([p in got for p in want]) >= 0.9
    assert max(r["rank"] for r in rows) == 10 and all(abs(r.cosine - c[r.id, r.other]) < 1e-5 for r in rows)


@pytest.mark.parametrize(("bits", "dim"), [(8, 5), (10, 5), (10, 64)])
def test_packed_vectors(bits, dim):
    x = np.random.default_rng(0).normal(size=(50, dim)).astype("f4")
    y = vector_neighbours.unpack(vector_neighbours.pack(x, bits), dim, bits).astype("f8")
    assert y.shape == x.shape and np.abs(y).max() == (1 << (bits - 1)) - 1
    cos = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    assert cos.min() > 1 - 4 ** (8 - bits) * 1e-4


def test_neighbours_of_the_packed_vectors(vectors):
    x, df = vectors
    c = cosines(x)
    rows = vector_neighbours.nearest(df, "chunk_id", "embedding", exact=False).collect()
    rank = {}
    for r in rows:
        rank.setdefault(r.id, []).append((r["rank"], r.other, r.cosine))
    assert set(rank) == set(range(900)) and all(sorted(k for k, _, _ in v) == list(range(1, 11)) for v in rank.values())
    hit = [o in np.argsort(-c[i])[:10] for i, v in rank.items() for _, o, _ in v]
    assert np.mean(hit) >= 0.98 and max(abs(s - c[i, o]) for i, v in rank.items() for _, o, s in v) < 0.004
    assert (3, 1) in {(i, k) for i, v in rank.items() for k, o, _ in v if o == 700}


def test_vectors_of_other_lengths_are_searched_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=8 if i % 3 else 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    got = vector_neighbours.nearest(df, "chunk_id", "embedding", k=4, window=64).collect()
    assert len(got) == 240 and all((r.id % 3 == 0) == (r.other % 3 == 0) for r in got)


def test_crowds_of_equal_and_nearly_equal_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16))
    x[:300] = x[0]  # more than three windows
    x[300:304] = x[0] + 0.01 * rng.normal(size=(4, 16))
    x[400:440] = x[400] + 0.001 * rng.normal(size=(40, 16))  # all within the error of the bytes
    x = x[rng.permutation(len(x))].astype("f4")
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<float>")
    same = (x[:, None] == x[None]).all(2)
    c = np.round(cosines(x.astype("f8")), 12)  # equal for equal vectors
    c[same] = 1
    np.fill_diagonal(c, -2)
    got = {}
    for r in vector_neighbours.nearest(df, "chunk_id", "embedding", dim=16, window=64, least=0.9, orderings=8).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.other)
    crowd = [i for i in range(len(x)) if (c[i] >= 0.99).sum() >= 10]
    assert len(crowd) == 344
    assert {i: got[i] for i in crowd} == {i: np.lexsort((np.arange(len(x)), -c[i]))[:10].tolist() for i in crowd}


def test_no_vectors(vectors):
    _, df = vectors
    assert vector_neighbours.close_pairs(df.filter("chunk_id >= 1000"), dim=16).count() == 0
    assert vector_neighbours.close_pairs(df.filter("chunk_id in (1, 1001)"), dim=16).count() == 0


MSG = "conv_id string, branch_id string, msg_id long, role int, ts double, content string, turn int, pos int, said string"


def told(rows):
    by = {}
    for r in sorted((r for r in rows if r[2] is not None), key=lambda r: (float("inf") if r[4] is None else r[4], r[0] or "", r[1] or "", -1 if r[3] is None else r[3])):
        by.setdefault(r[2], r)
    threads = {}
    for r in by.values():
        threads.setdefault((r[0], r[1]), []).append(r)
    out = {}
    for t, rs in threads.items():
        rs.sort(key=lambda r: (float("inf") if r[4] is None else r[4], r[2]))
        spoken = [r for r in rs if r[3] in (1, 2)]
        first = next((r for r in rs if r[3] != 0), None)
        if not any(r[5] and r[5].strip() for r in spoken):
            out[t] = "empty"
        elif any(r[3] not in (0, 1, 2, 3) for r in rs) or first is None or first[3] != 1:
            out[t] = "broken"
        elif any(r[3] == 2 and not (r[5] or "").strip() for r in rs) or spoken[-1][3] == 1:
            out[t] = "no_reply"
    return threads, out


@pytest.mark.parametrize("run", [3, 512])
def test_threads(spark, run):
    rng = random.Random(5)
    rows, n = [], 0
    for t in range(60):
        for _ in range(rng.randrange(1, 14)):
            n += 1
            role = rng.choices([0, 1, 2, 3, None, 7], [1, 6, 6, 1, 0.15, 0.1])[0]
            rows.append((f"c{t % 20}" if t else None, f"b{t // 20}" if t != 5 else None, n, role, rng.choice([None, float(rng.randrange(8)), 3.0]), rng.choice(["hi", "hi", "hi", " \n", None, ""]) if rng.random() < 0.3 else "text", 1, 2, "x"))
    rows += rng.sample(rows, 20) + [("c1", "b0", None, 1, 0.0, "x", 1, 2, "x")]
    df = spark.createDataFrame(rows, MSG)
    threads, want = told(rows)
    got = {(r.conv_id, r.branch_id): r.reason for r in dialogs.dropped_threads(df, run).collect()}
    assert got == want
    whole = {}
    for r in sorted(dialogs.dialogs(df, run).collect(), key=lambda r: r.turn):
        whole.setdefault((r.conv_id, r.branch_id), []).append((r.turn, r.msg_id))
    assert whole == {t: list(enumerate(r[2] for r in rs)) for t, rs in threads.items() if t not in want}


def chained(rows):
    """``rows`` (conv, branch, id, role, ts, text) with the chain of their thread in order of arrival."""
    tip, out = {}, []
    for r in rows:
        prev = tip.get(r[:2], bytes(32))
        tip[r[:2]] = hashlib.sha256(prev + str(r).encode()).digest()
        out.append((*r, prev, tip[r[:2]]))
    return out


LOG = "conv_id string, branch_id string, msg_id long, role int, ts double, content string, chain_prev binary, chain_hash binary"


@pytest.mark.parametrize("run", [1, 7, 1 << 16])
def test_a_lost_export_is_a_gap(spark, run):
    rng = random.Random(4)
    rows = chained([(f"c{rng.randrange(6)}", f"b{rng.randrange(2)}", i, 1 + i % 2, float(i + rng.randrange(-9, 9)), "text") for i in range(300)])
    threads = {r[:2] for r in rows}
    reason = lambda rs: {(r.conv_id, r.branch_id): r.reason for r in dialogs.threads(spark.createDataFrame(rs, LOG), run).collect()}
    base = reason(rows)
    assert set(base) == threads and "gap" not in base.values()
    again = rng.sample(rows, 40)
    assert reason([*rows, *((*r[:4], r[4] + 50, *r[5:]) for r in again)]) == base
    lost = rows[120:126]
    after = {r[:2] for r in rows[126:]} & {r[:2] for r in lost}
    gaps = {r.conv_id + r.branch_id for r in dialogs.assemble(dialogs.fragments(spark.createDataFrame([r for r in rows if r not in lost], LOG), run), spark.createDataFrame([r for r in rows if r not in lost], LOG)).filter("gap").collect()}
    assert gaps == {a + b for a, b in after} and gaps


def test_starts_and_forks(spark):
    whole = chained([("c", "b", i, 1 + i % 2, float(i), "x") for i in range(8)])
    fork = [("c", "f", 20, 1, 20.0, "x", whole[3][7], b"1" * 32), ("c", "f", 21, 2, 21.0, "x", b"1" * 32, b"2" * 32)]
    stray = [("c", "s", 30, 1, 30.0, "x", b"7" * 32, b"8" * 32), ("d", "b", 31, 1, 31.0, "x", whole[3][7], b"9" * 32), ("c", "n", 32, 1, 32.0, "x", None, None)]
    twice = [("e", "b", 40, 1, 1.0, "x", bytes(32), b"3" * 32), ("e", "b", 41, 2, 2.0, "x", b"3" * 32, b"4" * 32), ("e", "b", 42, 2, 3.0, "x", b"3" * 32, b"5" * 32)]
    df = spark.createDataFrame([*whole, *fork, *stray, *twice], LOG)
    got = {(r.conv_id, r.branch_id): r.gap for r in dialogs.assemble(dialogs.fragments(df), df).collect()}
    assert got == {("c", "b"): False, ("c", "f"): False, ("c", "s"): True, ("d", "b"): True, ("c", "n"): True, ("e", "b"): True}


def test_no_messages(spark):
    df = spark.createDataFrame([], MSG)
    assert dialogs.dropped_threads(df).count() == 0 and dialogs.dialogs(df).count() == 0


REC = "id long, text string, ts double, tbl string, h1 string, n int, maybe int"


def test_copies(spark):
    body = "The sealed gearbox turns without losing any detail, and this register confirms every movement of it."
    fields = {"tool": "search", "query": body, "k": 3}
    rows = [
        (1, body), (2, body.upper().replace(" ", "\n")), (3, body.replace(",", ";")), (4, None), (5, ""), (6, "short one"), (7, "Short, one!"),
        (8, json.dumps(fields)), (9, json.dumps(dict(reversed(fields.items())), indent=1)), (10, "; ".join(f"{k.upper()} = {v}" for k, v in fields.items())),
        (11, json.dumps(fields | {"k": 4})), (12, body + "!"), (13, body[:-1] + "s."), (2, "later row, not counted"), (14, body * 20_000), (15, body.lower() * 20_000), (16, "{broken json " + body), (None, body),
    ]
    df = spark.createDataFrame([(k, t, float(i), "x", "x", 1, 1) for i, (k, t) in enumerate(rows)], REC)
    for bits in (copies.MOST_BITS, 1 << 16):
        groups, members = copies.collapse(copies.record_keys(df, "r", "id", "text", "ts"), most_bits=bits)
        assert sorted((r.first_id, r.copy_id) for r in members.collect()) == [(1, 2), (1, 3), (1, 12), (8, 9), (8, 10), (14, 15)]
        assert {r.first_id: r.copies for r in groups.collect()} == {1: 4, 6: 1, 7: 1, 8: 3, 11: 1, 13: 1, 14: 2, 16: 1}
    groups, members = copies.collapse(copies.record_keys(df.limit(0), "r", "id", "text", "ts"))
    assert groups.count() == 0 and members.count() == 0


def test_fields_of_any_name_and_depth(spark):
    body = "the sealed gearbox turns without losing any detail and this register confirms every movement"
    long = "name of the field " * 5
    deep = {"a": {"x": body, "y": [{"p": 1, "q": 2}, 3]}, "b": 1}
    turned = {"b": 1, "a": {"y": [{"q": 2, "p": 1}, 3], "x": body}}
    rows = [
        (1, f"{long}= {body}; other = 3"), (2, f"other = 3; {long} = {body}"), (3, json.dumps(deep)), (4, json.dumps(turned, indent=2)), (5, json.dumps(deep | {"b": 2})),
        (6, json.dumps({"a": {"x": body, "y": [3, {"p": 1, "q": 2}]}, "b": 1})), (7, f"just one = {body} and no other field"), (8, "; ".join(f"f{i} = {i}" for i in range(20_000))), (9, "; ".join(f"F{i} = {i}" for i in reversed(range(20_000)))),
    ]
    df = spark.createDataFrame(rows, "id long, text string")
    members = copies.collapse(copies.record_keys(df, "r", "id", "text"))[1]
    assert sorted((r.first_id, r.copy_id) for r in members.collect()) == [(1, 2), (3, 4), (8, 9)]


def test_filter_has_no_false_negatives(spark):
    rng = np.random.default_rng(0)
    once, twice = (rng.integers(-(1 << 63), (1 << 63) - 1, n) for n in (3000, 300))
    once[:2], twice[:2] = [-(1 << 63), (1 << 63) - 1], [-(1 << 62), 1 << 62]
    keys = spark.createDataFrame([(int(v),) for v in [*once, *twice, *twice]], "h1 long").repartition(7)
    for bits in (1 << 12, 1 << 20):  # eight ranges and one
        marked = copies.mark_repeats(keys, most_bits=bits)
        assert marked.count() == 3600
        maybe = {r.h1 for r in marked.filter("maybe").collect()}
        assert set(twice.tolist()) <= maybe and len(maybe) < 500
    bits, ranges = copies.hash_ranges(10**10)
    assert bits <= copies.MOST_BITS and bits * len(ranges) >= 8 * 10**10
    assert ranges[0][0] == -(1 << 63) and ranges[-1][1] == (1 << 63) - 1 and all(b + 1 == c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False))


def near(rows, n=3, threshold=0.6):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= 20:
            sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    flat = {k: "".join(c for c in (t or "").lower() if c.isalnum()) for k, t in rows}
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= threshold - 1e-12 and not (flat[a] == flat[b] and len(flat[a]) >= 80):
            out.add((a, b))
    return out


def edited(rng, words):
    w = words[:]
    for _ in range(rng.randrange(0, 4)):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], [w[i], "new"], ["other"]])
    return " ".join(w)


def test_near_copies(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(25):
        words = rng.choices(vocabulary, k=rng.randrange(20, 60))
        rows += [(base * 10 + i, edited(rng, words) if i else " ".join(words)) for i in range(8)]
    rows += [(900, None), (901, ""), (902, "only a few words"), (903, " ".join("a b c d e f g h i j k l m n o p q r s t u".split())), (904, "A b c d e f g h i j k l m n o p q r s t u!"), (905, " ".join(rng.choices(vocabulary, k=30_000)))]
    df = spark.createDataFrame([(k, t, 0.0, 1, "x", "x") for k, t in rows] + [(0, "a later row", 5.0, 1, "x", "x"), (950, rows[0][1], 0.0, 3, "x", "x")], "msg_id long, content string, ts double, role int, cls string, t string")
    want = near(rows)
    assert len(want) > 100
    got = {tuple(r) for r in near_copies.near_copies(df, "msg_id", "content", "ts", F.col("role").isin(1, 2)).collect()}
    assert got == want
    assert near_copies.near_copies(df.limit(0), "msg_id", "content", "ts").count() == 0
    assert near_copies.near_groups(df.limit(0), "msg_id", "content", "ts").count() == 0


def test_near_groups_are_those_of_the_pairs(spark):
    rng = random.Random(8)
    rows = []
    for base in range(12):
        words = rng.choices([f"w{i}" for i in range(300)], k=rng.randrange(20, 50))
        rows += [(base * 50 + i, edited(rng, words) if i % 3 else " ".join(words).upper()) for i in range(9)]
    brief = " ".join("a b c d e f g h i j k l m n o p q r s t u".split())
    rows += [(700 + i, brief + "." * i) for i in range(5)]
    fields = [f"name {i}" for i in range(12)]
    plain = " ".join(f"{f} value of it {f}" for f in fields)
    rows += [(800, plain), (801, plain.upper()), (802, "; ".join(f"{f} = value of it {f}" for f in fields)), (803, json.dumps({f: f"value of it {f}" for f in fields}))]
    df = spark.createDataFrame(rows, "msg_id long, content string")
    pairs = {tuple(r) for r in near_copies.near_copies(df, "msg_id", "content").collect()}
    assert {(800, 802), (801, 803), (700, 704)} <= pairs and not {(802, 803), (800, 801)} & pairs
    want = {r.id: (r.group, r.links) for r in near_copies.groups(spark.createDataFrame(list(pairs), "a long, b long"), "a", "b").collect()}
    assert {r.id: (r.group, r.links) for r in near_copies.near_groups(df, "msg_id", "content").collect()} == want


def test_crowded_buckets_lose_nothing(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, edited(rng, words)) for i in range(40)] + [(100 + i, " ".join(rng.sample(words, 40))) for i in range(10)]
    df = spark.createDataFrame(list({t: (i, t) for i, t in rows}.values()), "cls long, t string")
    pairs = {(r.a, r.b) for r in near_copies.similar_classes(df, 3, 0.6, 26, 3, 20, cap=4).collect()}
    assert pairs == near([tuple(r) for r in df.collect()])


def test_groups(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 51), (200, 201)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: (r.group, r.links) for r in near_copies.groups(spark.createDataFrame([*edges, edges[0]], "a long, b long"), "a", "b").collect()}
    links = {x: len({b if a == x else a for a, b in edges if x in (a, b)}) for x in label}
    assert got == {x: (label[x], links[x]) for x in label}
    assert near_copies.groups(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    h = np.concatenate([pool[:200], pool[100:300], pool[:1]])
    row = np.repeat([0, 1, 2], [200, 200, 1])
    s = near_copies.sketch(h, row, 4, 256)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.1
    assert (s[2] != 0).all() and (s[3] == 0).all()


def test_plan_fills_slots():
    rng = random.Random(3)
    for _ in range(30):
        cap = rng.choice([10, 64, 300])
        counts = {}
        for _ in range(rng.randrange(1, 200)):
            n = rng.randrange(1, cap + 1)
            counts[n] = counts.get(n, 0) + 1
        used: dict[int, int] = {}
        taken = {n: [] for n in counts}
        for n, a, b, first, each in packing.plan(counts, cap):
            for r in range(a, b):
                c = first + (r - a) // each
                used[c] = used.get(c, 0) + n
                taken[n].append(r)
        assert all(sorted(v) == list(range(counts[n])) for n, v in taken.items())
        assert max(used.values()) <= cap
        assert len(used) <= sum(n * c for n, c in counts.items()) / cap * 1.23 + 1


def test_containers(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["pump", "valve", "the", "sealed"], k=rng.randrange(1, 90)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " \u00a0\n"), (903, "pump " * 5000), (904, "x" * 30_000), (0, rows[0][1])]
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id long, text string, n int, piece int, rank int")
    got = packing.pack(df, capacity=128, salts=3).collect()
    size: dict[int, int] = {}
    for r in got:
        size[r.container] = size.get(r.container, 0) + r.n
    assert max(size.values()) <= 128 and sum(size.values()) / len(size) > 0.97 * 128
    ids = sorted(r.doc_id for r in got if r.doc_id < 900)
    assert ids == sorted([*range(300), 0])
    big = sorted((r.piece, r.start, r.n) for r in got if r.doc_id == 903)
    assert [s for _, s, _ in big] == [128 * i for i in range(len(big))] and all(n == 128 for _, _, n in big[:-1])
    assert packing.pack(df.limit(0), capacity=128).count() == 0


def test_pieces_give_back_the_tokens(spark):
    text = "Die neuen Hefte — naïve 漢字 😀 pump " * 40
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = packing.pieces(df, "doc_id", "text", 50, with_tokens=True).orderBy("piece").collect()
    assert packing.tokenizer().decode([t for r in rows for t in r.tokens]) == text
