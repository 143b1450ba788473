"""The queries of the problems tagged llm, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import copies, dialogs, leaks, lookalikes, markup, near_copies, packing, scans, vector_neighbours


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(_table(spark, folder, "documents").select("doc_id", "text"))


def _chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(_table(spark, folder, "doc_chunks").select("chunk_id", "text"))


def _said(spark: SparkSession, folder: str) -> DataFrame:
    return spread(_table(spark, folder, "messages").select("msg_id", "role", "ts", "content"))


def _record_keys(spark: SparkSession, d: str) -> DataFrame:
    messages = copies.record_keys(_said(spark, d), "messages", "msg_id", "content", "ts")
    return messages.unionByName(copies.record_keys(_chunk_texts(spark, d), "doc_chunks", "chunk_id", "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return vector_neighbours.close_pairs(_table(spark, d, "chunk_vectors"))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = vector_neighbours.nearest(_table(spark, d, "chunk_vectors"), "chunk_id", "embedding", exact=False)
    return near.select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"), "cosine", "rank")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_found(_texts(spark, d))


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of the documents and of the chunks cut from them."""
    docs = markup.cleaned(_texts(spark, d)).select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("id"), "text")
    chunks = markup.cleaned(_chunk_texts(spark, d), "chunk_id").select(F.lit("doc_chunks").alias("tbl"), F.col("chunk_id").alias("id"), "text")
    return docs.unionByName(chunks)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return dialogs.dropped_threads(_table(spark, d, "messages"))


def p3_dialogs(spark: SparkSession, d: str) -> DataFrame:
    return dialogs.dialogs(_table(spark, d, "messages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.near_copies(_said(spark, d), "msg_id", "content", "ts", F.col("role").isin(1, 2))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    found = near_copies.near_groups(_said(spark, d), "msg_id", "content", "ts", F.col("role").isin(1, 2))
    return found.withColumnRenamed("id", "msg_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_noise(_texts(spark, d))


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(_texts(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(_record_keys(spark, d))[1]


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(_record_keys(spark, d))[0]


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_texts(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_texts(spark, d), _table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.equal_looking(_texts(spark, d))


def p10_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_groups(_texts(spark, d))


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonicalize(_texts(spark, d)).select("doc_id", "text", "look_hi", "look_lo")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_texts, p3_found, p3_dialogs, p5_found, p5_groups, p6_found, p6_texts, p7_found, p7_records, p8_pack, p9_found, p10_found, p10_groups, p10_texts)}


_FIRST = """first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY ts NULLS LAST, conv_id, branch_id, role) AS rn FROM messages) WHERE rn = 1)"""
_SAID = r"regexp_matches(coalesce(content, ''), '[^\s\p{Z}\p{Cc}]')"


# Canonical forms of copies: plain letters and digits, or the sorted fields of an object or of name = value parts.
_PLAIN = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_FORM = f"""CASE WHEN ltrim(t) LIKE '{{%' AND json_valid(t) THEN chr(29) || array_to_string(list_sort(list_transform(json_keys(lower(t)), lambda k: {_PLAIN.format("k")} || chr(31) || coalesce({_PLAIN.format("lower(t)::JSON ->> k")}, ''))), chr(30))
  WHEN regexp_matches(t, '=') AND len(list_filter(string_split(t, ';'), lambda p: trim(p) <> '')) > 1 AND len(list_filter(string_split(t, ';'), lambda p: trim(p) <> '' AND NOT regexp_matches(p, '^\\s*[\\w .-]+='))) = 0
  THEN chr(29) || array_to_string(list_sort(list_transform(list_filter(string_split(lower(t), ';'), lambda p: trim(p) <> ''), lambda p: {_PLAIN.format("split_part(p, '=', 1)")} || chr(31) || {_PLAIN.format("regexp_replace(p, '^[^=]*=', '')")})), chr(30))
  ELSE {_PLAIN.format("t")} END"""
_RECORDS = f"""{_FIRST}, recs AS (
  SELECT tbl, id, n, CASE WHEN n >= 80 THEN form ELSE CAST(id AS VARCHAR) END AS form FROM (
    SELECT tbl, id, length({_PLAIN.format("t")}) AS n, {_FORM} AS form FROM (
      SELECT 'messages' AS tbl, msg_id AS id, content AS t FROM first UNION ALL SELECT DISTINCT 'doc_chunks', chunk_id, text FROM doc_chunks))
  WHERE n > 0)"""

_NEAR = f"""{_FIRST}, t AS (
  SELECT msg_id, content AS t, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM first WHERE role IN (1, 2)),
m AS (SELECT msg_id, w, CASE WHEN length({_PLAIN.format("t")}) >= 80 THEN {_FORM} END AS form FROM t WHERE len(w) >= 20),
sh AS (SELECT DISTINCT msg_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS s FROM m),
size AS (SELECT msg_id, count(*) AS n FROM sh GROUP BY msg_id),
both_ AS (SELECT a.msg_id AS a, b.msg_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.msg_id < b.msg_id GROUP BY a.msg_id, b.msg_id),
near AS (SELECT a AS msg_id_a, b AS msg_id_b FROM both_ JOIN size x ON x.msg_id = a JOIN size y ON y.msg_id = b JOIN m ma ON ma.msg_id = a JOIN m mb ON mb.msg_id = b
WHERE c * 5 >= (x.n + y.n - c) * 3 AND (ma.form IS NULL OR mb.form IS NULL OR ma.form <> mb.form))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
WITH v AS (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM chunk_vectors WHERE embedding IS NOT NULL),
u AS (SELECT chunk_id, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS v FROM v WHERE list_dot_product(v, v) > 0),
s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_dot_product(a.v, b.v), 9) AS c FROM u a, u b WHERE a.chunk_id <> b.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rn FROM s WHERE c >= 0.8999)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE rn <= 10 AND c >= 0.9""",
        "p5_found": f"WITH {_NEAR} SELECT * FROM near",
        "p5_groups": f"""WITH RECURSIVE {_NEAR}, edges AS (SELECT msg_id_a AS a, msg_id_b AS b FROM near UNION SELECT msg_id_b, msg_id_a FROM near),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT r.a AS msg_id, least(r.a, min(r.b)) AS "group", any_value(links) AS links FROM reach r JOIN (SELECT a, count(*) AS links FROM edges GROUP BY a) l ON l.a = r.a GROUP BY r.a""",
        "p7_found": f"WITH {_RECORDS}, g AS (SELECT *, min(id) OVER (PARTITION BY tbl, form) AS first_id FROM recs) SELECT tbl, first_id, id AS copy_id FROM g WHERE id <> first_id",
        "p7_records": f"WITH {_RECORDS} SELECT tbl, min(id) AS first_id, count(*) AS copies FROM recs GROUP BY tbl, form",
        "p3_found": f"""
WITH {_FIRST}, t AS (
  SELECT conv_id, branch_id,
    count(*) FILTER (role IN (1, 2) AND {_SAID}) AS said,
    count(*) FILTER (role IS NULL OR role NOT BETWEEN 0 AND 3) AS odd,
    count(*) FILTER (role = 2 AND NOT {_SAID}) AS blank,
    (list(coalesce(role, -9) ORDER BY ts, msg_id) FILTER (role IS DISTINCT FROM 0))[1] AS opener,
    (list(role ORDER BY ts DESC, msg_id DESC) FILTER (role IN (1, 2)))[1] AS closer
  FROM first GROUP BY conv_id, branch_id)
SELECT conv_id, branch_id, reason FROM (
  SELECT conv_id, branch_id, CASE WHEN said = 0 THEN 'empty' WHEN odd > 0 OR opener IS DISTINCT FROM 1 THEN 'broken'
    WHEN blank > 0 OR closer = 1 THEN 'no_reply' END AS reason FROM t)
WHERE reason IS NOT NULL""",
        "p3_dialogs": f"""
WITH {_FIRST}, t AS (
  SELECT conv_id, branch_id,
    count(*) FILTER (role IN (1, 2) AND {_SAID}) AS said,
    count(*) FILTER (role IS NULL OR role NOT BETWEEN 0 AND 3) AS odd,
    count(*) FILTER (role = 2 AND NOT {_SAID}) AS blank,
    (list(coalesce(role, -9) ORDER BY ts, msg_id) FILTER (role IS DISTINCT FROM 0))[1] AS opener,
    (list(role ORDER BY ts DESC, msg_id DESC) FILTER (role IN (1, 2)))[1] AS closer
  FROM first GROUP BY conv_id, branch_id)
SELECT f.conv_id, f.branch_id, row_number() OVER (PARTITION BY f.conv_id, f.branch_id ORDER BY ts, msg_id) - 1 AS turn, msg_id, CAST(role AS INTEGER) AS role,
  CASE role WHEN 0 THEN 'system' WHEN 1 THEN 'user' WHEN 2 THEN 'assistant' ELSE 'tool' END AS speaker, content
FROM first f JOIN t USING (conv_id, branch_id)
WHERE said > 0 AND odd = 0 AND opener = 1 AND blank = 0 AND closer = 2""",
    }
