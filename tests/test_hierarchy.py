import random

from fathomline.operators.hierarchy import descendants, hierarchy, intervals, unrooted

SCHEMA = "id long, up long, ts double"


def truth(parent):
    out = {}
    for x in parent:
        seen, at = [], x
        while True:
            if at not in parent:
                out[x] = ("orphan", None)
                break
            if at in seen:
                out[x] = ("cycle" if at == x else "below_cycle", None)
                break
            seen.append(at)
            if parent[at] is None:
                out[x] = ("ok", seen[::-1])
                break
            at = parent[at]
    return out


def compare(spark, parent, block):
    df = spark.createDataFrame([(k, v, 0.0) for k, v in parent.items()], SCHEMA)
    rows = {r.id: r for r in hierarchy(df, "id", "up", block=block).collect()}
    want = truth(parent)
    assert set(rows) == set(want)
    below = {k: 0 for k in want}
    for state, path in want.values():
        for a in (path or [])[:-1]:
            below[a] += 1
    for k, (state, path) in want.items():
        r = rows[k]
        assert (r.state, r.path) == (state, path)
        assert (r.root, r.depth) == ((path[0], len(path) - 1) if path else (None, None))
        if path:
            assert r.below == below[k]


def test_random_forests_with_cycles_and_orphans(spark):
    rng = random.Random(4)
    parent = {}
    for i in range(400):
        parent[i] = rng.choice([None, i - 1, max(0, i - rng.randrange(1, 30)), rng.randrange(400), 10_000 + i if rng.random() < 0.1 else i - 1]) if i else None
    compare(spark, parent, 16)
    compare(spark, parent, 1 << 15)


def test_long_chain_and_long_cycle(spark):
    compare(spark, {0: None, **{i: i - 1 for i in range(1, 300)}}, 8)
    compare(spark, {i: (i + 1) % 50 for i in range(50)} | {60: 3, 61: 60, 62: 62}, 4)


def test_nulls_repeats_ties_and_none_marks(spark):
    rows = [(1, -1, 0.0), (2, 1, 5.0), (2, 9, 6.0), (3, 2, None), (3, 1, 1.0), (None, 1, 0.0), (4, 1, 2.0), (4, None, 2.0), (4, None, 2.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: (r.state, r.path) for r in hierarchy(df, "id", "up", "ts").collect()}
    assert got == {1: ("ok", [1]), 2: ("ok", [1, 2]), 3: ("ok", [1, 3]), 4: ("ok", [4])}


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchy(empty, "id", "up", "ts").count() == 0
    df = spark.createDataFrame([(1, None, "a", "b", 3, "x"), (2, 1, "a", "b", 3, "x"), (5, 7, None, None, None, None)], "msg long, parent long, state string, path string, block int, n string")
    assert [(r.msg, r.state) for r in unrooted(df, "msg", "parent").collect()] == [(5, "orphan")]


def test_descendants(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, 1, 0.0), (3, 2, 0.0)], SCHEMA)
    got = sorted(tuple(r) for r in descendants(hierarchy(df, "id", "up")).collect())
    assert got == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]


def test_ids_far_apart(spark):
    big = 1 << 53
    compare(spark, {big * i: (big * (i - 1) if i else None) for i in range(60)} | {-7: big * 3, big * 59 + 1: -7}, 8)


def test_chains_across_small_blocks(spark):
    parent = {i: i - 1 if i else None for i in range(300)}
    for block in (7, 64):
        compare(spark, parent, block)


def test_tables_of_a_block_are_deleted(spark):
    from pathlib import Path

    from fathomline.session import cut, shared_folder, temporary_tables

    folder = Path(shared_folder(spark).removeprefix("file://"))
    kept = cut(spark.range(3))
    before = set(folder.iterdir())
    with temporary_tables():
        assert cut(spark.range(5)).count() == 5 and set(folder.iterdir()) > before
    assert set(folder.iterdir()) == before and kept.count() == 3


def test_intervals_hold_the_descendants(spark):
    rng = random.Random(3)
    parent = {i: rng.choice([None, rng.randrange(i)]) if i % 9 == 0 and i else (rng.randrange(max(0, i - 6), i) if i else None) for i in range(250)}
    parent |= {900: 901, 901: 900, 902: 900, 903: 5000, -7: None, 260: -7}
    df = spark.createDataFrame([(k, v, 0.0) for k, v in parent.items()], SCHEMA)
    got = {r.id: (r.first, r.last) for r in intervals(df, "id", "up", none=None, block=16).collect()}
    want = {k: path for k, (state, path) in truth(parent).items() if state == "ok"}
    assert set(got) == set(want) and sorted(a for a, _ in got.values()) == list(range(len(want)))
    for x in want:
        assert {y for y in want if got[x][0] < got[y][0] <= got[x][1]} == {y for y in want if x in want[y] and x != y}
