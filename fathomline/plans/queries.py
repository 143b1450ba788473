"""Every core query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text, vectors
from ..operators import chunking, collection, dedup, dialog, embedding, hierarchy, history, ivf, knn, lexical, retrieval
from ..session import spread
from .oracle import oracle_sql as oracle_sql  # noqa: PLC0414  part of this module's interface

PHRASES = [(1, "without loss of detail"), (2, "the archive room"), (3, "DIE NEUEN HEFTE")]
ROLES = {0: "system", 1: "user", 2: "assistant", 3: "tool"}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their vectors, as the retrieval operators take them."""
    rows = _table(spark, d, "doc_chunks").select(F.col("chunk_id").alias("id"), "doc_id", F.col("chunk_index").alias("index"), F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), "text")
    return rows.join(_table(spark, d, "chunk_vectors").select(F.col("chunk_id").alias("id"), "embedding"), "id")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries of the text searches: every item whose id is divisible by 20."""
    return _table(spark, d, "eval_items").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries; the vector of each is that of the chunk with its id."""
    return _questions(spark, d).join(_table(spark, d, "chunk_vectors").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q")).filter("q is not null"), "query_id")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """One row for each msg_id: that with the smallest ts."""
    rows = _table(spark, d, "messages")
    rest = [c for c in rows.columns if c not in ("msg_id", "ts")]
    first = rows.groupBy("msg_id").agg(F.min(F.struct("ts", *rest)).alias("m"))
    return first.select("msg_id", "m.*")


def _dialogs(spark: SparkSession, d: str) -> DataFrame:
    role = F.create_map(*[x for k, v in ROLES.items() for x in (F.lit(k), F.lit(v))])[F.col("role").cast("int")]
    return _messages(spark, d).select(F.concat_ws("/", "conv_id", "branch_id").alias("dialog_id"), F.col("msg_id").alias("turn"), role.alias("role"), "content").filter("role is not null")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    best = lexical.top(lexical.bm25(docs, _questions(spark, d)).withColumn("score", F.round("score", 6)), 20)
    return best.select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_stats(_docs(spark, d), "id", "text").select("term", "df", "cf", F.round("idf", 6).alias("idf"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.corpus_stats(_docs(spark, d), "text").select("n", F.round("avgdl", 6).alias("avgdl"))


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _query_vectors(rows: DataFrame) -> DataFrame:
    """Queries of a search: every row whose id is divisible by 20."""
    return rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))


def _hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


def flat_knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    return _hits(knn.flat_knn(e, _query_vectors(e), 10))


def flat_knn_l2(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    return _hits(knn.flat_knn(e, _query_vectors(e), 10, "l2", skip_self=True))


def flat_knn_ip(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    return _hits(knn.flat_knn(e, _query_vectors(e), 10, "ip"))


def filtered_knn(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    return _hits(knn.flat_knn(knn.filtered(e, {"label": 3}), _query_vectors(e), 10))


def knn_self_graph(spark: SparkSession, d: str) -> DataFrame:
    """For the stated nodes, those whose id is divisible by 20."""
    e = _embeddings(spark, d)
    found = knn.neighbour_graph(e, e.filter("id % 20 = 0").select("id"), 8)
    return found.select("src", "dst", (F.round("distance", 6) + 0.0).alias("distance"))


def partial_final_topk(spark: SparkSession, d: str) -> DataFrame:
    """Shards searched apart, their results merged."""
    e = _embeddings(spark, d)
    q = _query_vectors(e)
    parts = None
    for s in range(4):
        part = knn.flat_knn(e.filter(F.pmod("id", F.lit(4)) == s), q, 40).select("query_id", "id", "distance")
        parts = part if parts is None else parts.unionAll(part)
    return _hits(knn.merge_tops(parts, 10))


def ivf_knn(spark: SparkSession, d: str) -> DataFrame:
    """All cells probed: the flat result."""
    e = _embeddings(spark, d)
    return _hits(ivf.build(e, 32).search(_query_vectors(e), 10, nprobe=32))


def ivf_knn_probed(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    return _hits(ivf.build(e, 32).search(_query_vectors(e), 10, nprobe=24))


def pq_knn(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    index = ivf.build(e, 32, "l2")
    coded, books = ivf.product_codes(index, 16, 64)
    return _hits(ivf.code_search(index, coded, books, _query_vectors(e), 10, nprobe=24))


def vector_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against the stated queries, which are broadcast: every row whose id is divisible by 20."""
    e = _embeddings(spark, d)
    q = _query_vectors(e)
    a, b = F.col("q"), F.col("embedding")
    cols = {"cos_d": vectors.distance("cosine", a, b), "l2_d": vectors.distance("l2", a, b), "ip_d": vectors.distance("ip", a, b)}
    cols |= {"cos_s": vectors.similarity("cosine", cols["cos_d"]), "l2_s": vectors.similarity("l2", cols["l2_d"]), "ip_s": vectors.similarity("ip", cols["ip_d"]), "cos_q": vectors.query_similarity("cosine", a, b)}
    return e.crossJoin(q).select("query_id", "id", *((F.round(c, 6) + 0.0).alias(n) for n, c in cols.items()))


def normalized_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.normalized(F.col("embedding"))
    rows = _table(spark, d, "chunk_vectors").filter("embedding is not null")
    return rows.select("chunk_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"), F.round(v[0], 6).alias("first"))


def min_max_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").filter("text is not null").select("doc_id", "source", F.length("text").cast("double").alias("n"))
    return vectors.min_max(rows, "n", "source", "x").select("doc_id", F.round("x", 6).alias("scaled"))


def rank_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.least_of_hash(_table(spark, d, "doc_chunks"), "hash64", ["doc_id", "start_byte", "end_byte"]).select("chunk_id", "doc_id", "start_byte", "end_byte")


def insert_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First chunks are stored, all others come as a batch."""
    c = _table(spark, d, "doc_chunks").select("chunk_id", "chunk_index", "hash64")
    stored = c.filter("chunk_index = 0").select(F.col("chunk_id").alias("id"), "hash64")
    return dedup.insert_new(stored, c.filter("chunk_index > 0"), "hash64", "chunk_id").select("id", "chunk_id")


def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    return dedup.ingest_counts(_table(spark, d, "doc_chunks"), "text", "hash64")


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_seen(_table(spark, d, "messages"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.normalize(F.col("text")).alias("clean"))


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.html_to_text(F.col("text")).alias("plain"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("by_words"), text.message_tokens(F.col("text")).alias("by_chars"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", text.tokenize(F.col("text")).alias("tokens"))


def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame(PHRASES, "query_id long, query string")
    return _table(spark, d, "documents").crossJoin(F.broadcast(asked)).filter(text.has_phrase(F.col("text"), F.col("query"))).select("query_id", "doc_id")


def record_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of a loose record and its stored form."""
    t = text.first_text(None, F.col("text"), F.col("lang"), F.col("src_path"))
    return _table(spark, d, "documents").select("doc_id", t.alias("raw"), text.flat(t).alias("stored"))


def marked_text(spark: SparkSession, d: str) -> DataFrame:
    """Marks put round the texts as a model's answer has them, and taken out again."""
    t = F.coalesce("text", F.lit(""))
    said = F.concat(F.lit("a <|think|> b "), t, F.lit(" <|endofthink|>"), t, F.lit(" <|eot|><|think|> rest"))
    stop = text.stops_at(t, ["the archive", "</"])
    return _table(spark, d, "documents").select("doc_id", text.strip_think(said).alias("answer"), text.strip_special(said).alias("plain"), stop.alias("stops"), text.suffix(F.col("src_path")).alias("suffix"), text.stem(F.col("src_path")).alias("stem"))


def guard_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Texts as a guard's answers, behind a first line by their language."""
    head = F.when(F.lower("lang").startswith("en"), "<|x|>\nUNSAFE\n").when(F.lower("lang").startswith("de"), "Safe\n").otherwise("")
    v = text.guard_verdict(F.concat(head, F.coalesce("text", F.lit(""))))
    return _table(spark, d, "documents").select("doc_id", v["verdict"].alias("verdict"), F.array_join(v["categories"], ",").alias("categories"))


def total_bytes(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "doc_chunks").groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("chunks"))


def chunk_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "doc_chunks").filter("hash64 is not null").select("chunk_id", hashing.fnv1a64("text").cast("string").alias("hash64"))


def message_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Legacy rows have no hash stored, 0."""
    fresh = F.when(F.col("simhash_i64") != 0, hashing.blake64_signed("content")).otherwise(F.col("simhash_i64"))
    return _table(spark, d, "messages").select("msg_id", fresh.alias("simhash_i64"), hashing.sha256(F.col("content")).alias("content_hash")).distinct()


def message_uids(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "messages").select("conv_id", "branch_id", "msg_id", hashing.message_uid(F.col("conv_id"), F.col("branch_id"), F.col("msg_id")).alias("uid")).distinct()


def adjacent_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "doc_chunks").select(F.col("chunk_id").alias("id"), "doc_id", F.col("chunk_index").alias("index"))
    return retrieval.adjacency(rows)


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(spread(_table(spark, d, "documents").select("doc_key", "text")), chunking.PRESET, "doc_key")


def chunk_as_stored(spark: SparkSession, d: str) -> DataFrame:
    """Chunks cut from the documents' raw texts, as the stored ones with offsets were."""
    cut = chunking.chunks(spread(_table(spark, d, "documents").select("doc_key", "text")), replace(chunking.PRESET, normalize=False), "doc_key")
    return cut.select("doc_id", F.col("index").alias("chunk_index"), F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "text", "hash64")


def hybrid_seeds(spark: SparkSession, d: str) -> DataFrame:
    c, q = _chunks(spark, d), _asked(spark, d)
    found = retrieval.seeds(c, q, retrieval.scaled_lexical(c, q))
    return found.select("query_id", "id", F.round("score", 5).alias("score"))


def beam_traverse(spark: SparkSession, d: str) -> DataFrame:
    c, q = _chunks(spark, d), _asked(spark, d)
    lex = retrieval.scaled_lexical(c, q)
    found = retrieval.beam(c, q, retrieval.seeds(c, q, lex), lex, retrieval.adjacency(c))
    return found.select("query_id", "id", F.round("score", 5).alias("score"))


def _selected(c: DataFrame, asked: DataFrame) -> DataFrame:
    return retrieval.scaled_lexical(c, asked).select("query_id", "id", F.round("lex", 6).alias("score"))


def merge_spans(spark: SparkSession, d: str) -> DataFrame:
    c = spread(_table(spark, d, "doc_chunks").select(F.col("chunk_id").alias("id"), "doc_id", F.col("chunk_index").alias("index"), F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), "text"))
    return retrieval.merged_spans(c, _selected(c, _questions(spark, d))).drop("node_ids", "rank")


def retrieve_contexts(spark: SparkSession, d: str) -> DataFrame:
    """From an inverted index of the chunks; their vectors are searched flat, so the result is exact."""
    c = _chunks(spark, d)
    found = retrieval.retrieve(c, _asked(spark, d), indexes=retrieval.Indexes.of(c))
    return found.withColumn("score", F.round("score", 5))


def retrieve_probed(spark: SparkSession, d: str) -> DataFrame:
    """As ``retrieve_contexts``, from probed cells."""
    c = _chunks(spark, d)
    found = retrieval.retrieve(c, _asked(spark, d), indexes=retrieval.Indexes.of(c, 32, nprobe=24))
    return found.withColumn("score", F.round("score", 5))


def collection_search(spark: SparkSession, d: str) -> DataFrame:
    """Chunks inserted by their hashes, searched flat by the vectors of every chunk whose id is divisible by 20."""
    rows = _table(spark, d, "doc_chunks").join(_table(spark, d, "chunk_vectors"), "chunk_id").filter("size(embedding) = 64")
    held = collection.Collection(spark, 64)
    held.insert(rows.select("chunk_id", "text", "doc_id", "hash64", "embedding"), "chunk_id")
    q = rows.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    found = held.search(q, 5).join(held.rows.select("id", "chunk_id"), "id")
    return found.select("query_id", "chunk_id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    best = lexical.top(lexical.bm25(_docs(spark, d), _questions(spark, d)).withColumn("score", F.round("score", 6)), 5)
    return dialog.context_block(best.join(_docs(spark, d).select("id", "text"), "id"))


def role_merge(spark: SparkSession, d: str) -> DataFrame:
    return dialog.merge_roles(_dialogs(spark, d))


def guard_view(spark: SparkSession, d: str) -> DataFrame:
    return dialog.guard_view(_dialogs(spark, d))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    return dialog.transcript(_dialogs(spark, d))


def history_blocks(spark: SparkSession, d: str) -> DataFrame:
    return dialog.history_block(_dialogs(spark, d), "dialog_id")


def messages_by_key(spark: SparkSession, d: str) -> DataFrame:
    keys = _table(spark, d, "tips").select("conv_id", "branch_id", F.col("last_msg_id").alias("msg_id"))
    return history.by_keys(_messages(spark, d), keys).select("conv_id", "branch_id", "msg_id", "content")


def recency_window(spark: SparkSession, d: str) -> DataFrame:
    return history.recent(_messages(spark, d), 128).select("conv_id", "branch_id", "msg_id", "back")


def latest_messages(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(_messages(spark, d), 50).select("msg_id", "ts")


def branch_tips(spark: SparkSession, d: str) -> DataFrame:
    return history.tips(_table(spark, d, "messages"))


def duplicate_penalty(spark: SparkSession, d: str) -> DataFrame:
    return history.duplicate_penalty(_messages(spark, d)).select("msg_id", F.round("dup", 6).alias("dup"))


def budget_context(spark: SparkSession, d: str) -> DataFrame:
    scored = history.context_score(history.duplicate_penalty(_messages(spark, d)))
    chosen = history.within_budget(scored.withColumn("score", F.round("score", 6)), 1024, ["conv_id", "branch_id"])
    return chosen.select("conv_id", "branch_id", "msg_id", "score", "used")


def history_context(spark: SparkSession, d: str) -> DataFrame:
    """The whole selection, for the last message of every thread."""
    rows = _messages(spark, d)
    told = embedding.embed(rows.select("conv_id", "branch_id", "msg_id", "content"), embedding.letter_counts, "content").select("conv_id", "branch_id", "msg_id", "embedding").filter("embedding is not null")
    asked = history.tips(rows).select("conv_id", "branch_id", F.col("last_msg_id").alias("msg_id"))
    queries = asked.join(told, ["conv_id", "branch_id", "msg_id"]).select(F.col("msg_id").alias("query_id"), "conv_id", "branch_id", F.col("embedding").alias("q"))
    return history.build_context(rows, told, queries)


def hash_chain(spark: SparkSession, d: str) -> DataFrame:
    return history.chain_check(_table(spark, d, "messages"))


def chain_links(spark: SparkSession, d: str) -> DataFrame:
    return history.chain_order(_table(spark, d, "messages"))


def append_log(spark: SparkSession, d: str) -> DataFrame:
    """System messages are stored, an append of everything adds the rest; a row that can't be hashed leaves its thread's chain as it is."""
    rows = _messages(spark, d)
    return history.append(rows.filter("role = 0"), rows).drop("content", "simhash_i64")


def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 9).select(F.col("id").alias("attempt"), vectors.backoff(F.col("id")).alias("seconds"))


def embedded_documents(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of every text's vector, one to a row."""
    told = embedding.embed(_table(spark, d, "documents").select("doc_id", "text"), embedding.letter_counts)
    return told.select("doc_id", F.posexplode("embedding").alias("place", "x")).select("doc_id", "place", F.round(F.col("x").cast("double"), 5).alias("value"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    form = text.Template("Source {source}, language {lang}: {text}")
    values = {c: F.coalesce(F.col(c), F.lit("unknown")) for c in form.fields}
    return _table(spark, d, "documents").select("doc_id", form.render(values).alias("prompt"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.unrooted(_table(spark, d, "messages"), "msg_id", "parent_msg_id", "ts")


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    nodes = hierarchy.hierarchy(_table(spark, d, "messages"), "msg_id", "parent_msg_id", "ts")
    return nodes.select("id", "root", "depth", "state", "below", "path")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(_table(spark, d, "messages"), "msg_id", "parent_msg_id", "ts"))


def p4_intervals(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.intervals(_table(spark, d, "messages"), "msg_id", "parent_msg_id", "ts")


_ALL = [
    bm25_topk, term_stats, corpus_stats, flat_knn_cosine, flat_knn_l2, flat_knn_ip, filtered_knn, knn_self_graph, partial_final_topk, ivf_knn, ivf_knn_probed, pq_knn, vector_scores,
    normalized_vectors, min_max_scores, rank_dedup, insert_dedup, ingest_counters, first_seen, normalize_text, html_to_text, token_estimate, tokens, phrase_match, record_text, marked_text,
    guard_verdicts, total_bytes, chunk_hashes, message_hashes, message_uids, adjacent_chunks, chunk_documents, chunk_as_stored, hybrid_seeds, beam_traverse, merge_spans, retrieve_contexts, retrieve_probed, collection_search,
    context_blocks, role_merge, guard_view, transcripts, history_blocks, messages_by_key, recency_window, latest_messages, branch_tips, duplicate_penalty, budget_context, history_context,
    hash_chain, chain_links, append_log, retry_schedule, embedded_documents, prompts, p4_found, p4_hierarchy, p4_descendants, p4_intervals,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
