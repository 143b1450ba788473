import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import vectors as V
from fathomline.operators import dedup, ivf, knn, lexical, retrieval
from fathomline.plans import queries


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[7] = x[3]
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(300)] + [(900, None, 0), (901, [1.0], 0)]
    return x, spark.createDataFrame(rows, "id long, embedding array<double>, label int").cache()


def brute(metric, q, x):
    if metric == "l2":
        return ((x - q) ** 2).sum(1)
    if metric == "ip":
        return -(x @ q)
    return 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)


@pytest.mark.parametrize("metric", V.METRICS)
def test_flat_matches_brute_force(spark, points, metric):
    x, df = points
    q = df.filter("id in (3, 50, 77)").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    got = {}
    for r in knn.flat_knn(df, q, 5, metric, block=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for i in (3, 50, 77):
        d = np.round(brute(metric, x[i], x), 9)
        assert [b for _, b in sorted(got[i])] == np.lexsort((np.arange(300), d))[:5].tolist()


def test_cells_equal_flat_when_all_are_probed(spark, points):
    _, df = points
    df = df.filter("id < 300")
    q = df.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    index = ivf.build(df, 10, "l2")
    flat = {tuple(r) for r in knn.flat_knn(df, q, 4, "l2").select("query_id", "id", "rank").collect()}
    assert {tuple(r) for r in index.search(q, 4, nprobe=10).select("query_id", "id", "rank").collect()} == flat
    coded, books = ivf.product_codes(index, 4, 16)
    near = {tuple(r) for r in ivf.code_search(index, coded, books, q, 4, nprobe=10, refine=300).select("query_id", "id", "rank").collect()}
    assert near == flat


@pytest.mark.parametrize(("name", "metric"), [("ivf_knn_probed", "cosine"), ("pq_knn", "l2")])
def test_registered_searches_find_true_neighbours(spark, name, metric):
    """Recall of the registered parameters, each query's own row included."""
    d = "/root/testdata/sf0.01"
    e = queries._embeddings(spark, d)
    true = {(r.query_id, r.id) for r in knn.flat_knn(e, queries._query_vectors(e), 10, metric).collect()}
    got = {(r.query_id, r.id) for r in queries.queries()[name](spark, d).collect()}
    assert len(got) == len(true) and len(got & true) >= 0.9 * len(true)


def test_short_cells_are_filled(spark, points):
    _, df = points
    df = df.filter("id < 300")
    q = df.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    index = ivf.build(df, 10, "l2")
    coded, books = ivf.product_codes(index, 4, 16)
    for found in (index.search(q, 120, nprobe=1), ivf.code_search(index, coded, books, q, 120, nprobe=1)):
        rows = found.collect()
        assert sorted((r.query_id, r["rank"]) for r in rows) == [(i, k) for i in range(0, 300, 50) for k in range(1, 121)]
        assert len({(r.query_id, r.id) for r in rows}) == len(rows)


def test_filter_and_metric_errors(points):
    _, df = points
    assert knn.filtered(df, {"label": 1, "id": 4}).count() == 1
    assert knn.filtered(df, {"nothing": 1}).count() == 0
    with pytest.raises(ValueError):
        V.distance("hamming", F.lit(1), F.lit(2))


def test_empty_vectors(spark, points):
    _, df = points
    q = df.limit(0).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    assert knn.flat_knn(df, q, 3).count() == 0


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a"), (3, None), (4, "c")], "id long, text string")
    q = spark.createDataFrame([(1, "b b zzz"), (2, "")], "query_id long, query string")
    rows = lexical.bm25(docs, q).collect()
    idf = np.log((4 - 1 + 0.5) / 1.5 + 1)
    assert [(r.query_id, r.id) for r in rows] == [(1, 1)]
    assert rows[0].score == pytest.approx(idf * 2 * 1.9 / (2 + 0.9 * (0.6 + 0.4 * 3 / 1.25)))


def test_dedup_keeps_ties_and_missing_hashes(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 5), (1, "a", 5), (None, "x", 1), (None, "x", 1), (2, "q", 0)], "h long, doc_id string, start int")
    got = sorted((r.h or 0, r.doc_id, r.start) for r in dedup.least_of_hash(df, "h", ["doc_id", "start"]).collect())
    assert got == [(0, "x", 1), (0, "x", 1), (1, "a", 5), (1, "a", 5), (2, "q", 0)]


def test_insert_numbers_new_rows(spark):
    stored = spark.createDataFrame([(0, 5), (1, 6)], "id long, h long")
    batch = spark.createDataFrame([(10, 6), (11, 7), (12, 7), (13, None), (14, None)], "ord long, h long")
    got = sorted((r.id, r.ord) for r in dedup.insert_new(stored, batch, "h", "ord").collect())
    assert got == [(2, 11), (3, 13), (4, 14)]


def test_contexts_merge_and_truncate(spark):
    chunks = spark.createDataFrame([(i, "d", i if i < 6 else i + 1, i * 10, i * 10 + 10, f"t{i}") for i in range(12)], "id long, doc_id string, index int, start int, end int, text string")
    scores = spark.createDataFrame([(1, 1, 0.5), (1, 4, 0.9), (1, 10, 0.1)], "query_id long, id long, score double")
    got = [(r.start_node_id, r.end_node_id, r.score, r.text) for r in retrieval.merged_spans(chunks, scores, retrieval.Params(most_chars=8)).orderBy("rank").collect()]
    assert got == [(0, 6, 0.9, "t0 t1 t2…"), (8, 11, 0.1, "t8 t9 t1…")]


def test_whole_retrieval_runs(spark, points):
    x, df = points
    chunks = df.filter("id < 60").select("id", F.concat(F.lit("doc"), (F.col("id") % 6).cast("string")).alias("doc_id"), (F.col("id") / 6).cast("int").alias("index"), F.lit(0).alias("start"), F.lit(9).alias("end"), F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" common")).alias("text"), "embedding")
    q = spark.createDataFrame([(1, "word7 common", [float(v) for v in x[7]])], "query_id long, query string, q array<double>")
    rows = retrieval.retrieve(chunks, q).orderBy("rank").collect()
    assert rows[0].score > 0 and any(7 in r.node_ids for r in rows)


def test_term_index_gives_the_scores_of_one_pass(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the pump and the valve"), (2, "a valve"), (3, None), (4, "pump pump pump"), (5, "")], "id long, text string")
    asked = spark.createDataFrame([(1, "pump valve"), (2, "nothing"), (3, "Valve valve")], "query_id long, query string")
    want = {(r.query_id, r.id): round(r.score, 9) for r in lexical.bm25(docs, asked).collect()}
    lexical.index_terms(docs).save(str(tmp_path / "i"))
    index = lexical.TermIndex.load(spark, str(tmp_path / "i"))
    assert {(r.query_id, r.id): round(r.score, 9) for r in index.search(asked).collect()} == want and len(want) == 5


def test_blocked_cells():
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(500, 6)), rng.normal(size=(40, 6))
    cell, near = ivf.nearest_cell(x, c, block=64)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (cell == d.argmin(1)).all() and np.allclose(near, d.min(1))


def test_collection(spark):
    from fathomline.operators.collection import Collection, Store
    from fathomline.operators.embedding import hashed_words

    store = Store(spark, hashed_words(16))
    store.create("c", 16)
    rows = [(i, f"text number {i % 30} of the pump", "d", None if i % 10 == 0 else i % 30) for i in range(60)]
    df = spark.createDataFrame(rows, "n long, text string, doc_id string, hash64 long").withColumn("hash64", F.col("hash64").cast("decimal(20,0)"))
    assert store.insert("c", df, "n") == 33 and store.insert("c", df.filter("hash64 is not null"), "n") == 0
    held = store.collections["c"]
    assert sorted(r.id for r in held.rows.collect()) == list(range(33))
    flat = {tuple(r) for r in store.search("c", ["text number 7 of the pump", "pump"], 4).select("query_id", "id", "rank").collect()}
    assert len(flat) == 8
    for kind in ("ivf", "ivf_pq"):
        held.build_index(kind, cells=4, parts=4, codes=16)
        assert {tuple(r) for r in store.search("c", ["text number 7 of the pump", "pump"], 4, nprobe=4).select("query_id", "id", "rank").collect()} == flat
    vector = [float(v) for v in held.rows.filter("id = 5").first().embedding]
    assert store.search("c", [vector], 1).first().distance < 1e-6
    assert {r.text for r in store.search("c", "pump", 3, filters={"text": "text number 3 of the pump"}).collect()} == {"text number 3 of the pump"}
    with pytest.raises(ValueError):
        held.insert(spark.createDataFrame([("x", "d", None, [1.0], 1)], "text string, doc_id string, hash64 decimal(20,0), embedding array<float>, n int"), "n")
    with pytest.raises(RuntimeError):
        Collection(spark, 4).build_index("ivf")
    assert Collection(spark, 4).search(spark.createDataFrame([(1, [1.0] * 4)], "query_id long, q array<double>")).count() == 0


def test_retrieval_from_indexes(spark):
    d = "/root/testdata/sf0.001"
    c, q = queries._chunks(spark, d), queries._asked(spark, d)
    plain = {(r.query_id, r.start_node_id, r.end_node_id) for r in retrieval.retrieve(c, q).collect()}
    for how in ({}, {"cells": 4, "nprobe": 4}):
        got = {(r.query_id, r.start_node_id, r.end_node_id) for r in retrieval.retrieve(c, q, indexes=retrieval.Indexes.of(c, **how)).collect()}
        assert got == plain and got
