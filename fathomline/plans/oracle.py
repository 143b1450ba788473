"""The same results in DuckDB's SQL, for queries that SQL can express."""

from __future__ import annotations

_EDGE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
_BARE = r"regexp_replace(x, '<\|[^>]+?\|>', '', 'g')"
_PUNCT = "._-~=*#•·–—─━═"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_EDGE}+|{_EDGE}+$', '', 'g')"


def _normalized(x: str) -> str:
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '[\x{{A0}}\x{{1680}}\x{{180E}}\x{{2000}}-\x{{200B}}\x{{202F}}\x{{205F}}\x{{3000}}\t]', ' ', 'g')"
    hug = lambda y: rf"regexp_replace(regexp_replace({y}, '[ \t\f\x{{0B}}]+\n', chr(10), 'g'), '\n[ \t\f\x{{0B}}]+', chr(10), 'g')"
    x = hug(x)
    for c in _PUNCT:
        x = f"regexp_replace({x}, '[{chr(92) if c in '-' else ''}{c}]{{4,}}', '{c * 3}', 'g')"
    kind = "[" + _PUNCT.replace("-", r"\-") + "]"
    lines = rf"regexp_split_to_array({x}, '[\n\x{{0B}}\f\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]')"
    x = rf"array_to_string(list_filter({lines}, lambda l: NOT regexp_matches(l, '^{_EDGE}*(?:{kind}[ \t]*){{6,}}{_EDGE}*$')), chr(10))"
    x = rf"regexp_replace(regexp_replace({x}, ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip(hug(x))


_TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[A-Za-z0-9_]+')"
_ASKED = "(SELECT item_id AS query_id, text AS query FROM eval_items WHERE item_id % 20 = 0)"
_WITH_VECTOR = "(SELECT item_id AS query_id, text AS query FROM eval_items WHERE item_id % 20 = 0 AND item_id IN (SELECT chunk_id FROM chunk_vectors WHERE embedding IS NOT NULL))"


def _bm25(rows: str, asked: str = _ASKED) -> str:
    return f"""
asked AS {asked},
wanted AS (SELECT DISTINCT query_id, unnest({_TOKENS.format("query")}) AS term FROM asked),
toks AS (SELECT id, {_TOKENS.format("text")} AS t FROM {rows}),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT query_id, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 1.9 / greatest(1e-9, tf + 0.9 * (0.6 + 0.4 * dl / greatest(1, avgdl)))) AS score
  FROM post JOIN dfs USING (term) JOIN wanted USING (term), corpus GROUP BY query_id, id)"""


_DOCS = "(SELECT doc_id AS id, text FROM documents)"
_CHUNKS = "(SELECT chunk_id AS id, text FROM doc_chunks)"
_COS = "least(2, greatest(0, 1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))))"
_VEC = "(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def _knn(d: str, where: str = "true", k: int = 10) -> str:
    return f"""
WITH e AS (SELECT * FROM {_VEC}), s AS (
  SELECT q.id AS query_id, x.id AS id, {d} AS dist FROM e q, e x WHERE q.id % 20 = 0 AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM s)
SELECT query_id, id, round(dist, 6) + 0.0 AS distance, rank FROM r WHERE rank <= {k}"""


_QX = _COS.format(a="q.v", b="x.v")
_L2 = "list_sum([(a - b) * (a - b) FOR a, b IN list_zip(q.v, x.v)])"

_MSG = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY ts NULLS FIRST, conv_id, branch_id, role) AS rn FROM messages) WHERE rn = 1)"
_ROLE = "CASE role WHEN 0 THEN 'system' WHEN 1 THEN 'user' WHEN 2 THEN 'assistant' WHEN 3 THEN 'tool' END"
_DIALOG = f"WITH {_MSG}, d AS (SELECT conv_id || '/' || branch_id AS dialog_id, msg_id AS turn, {_ROLE} AS role, content FROM m WHERE role BETWEEN 0 AND 3)"

_TREE = """
WITH RECURSIVE first AS (
  SELECT msg_id AS id, CASE WHEN parent_msg_id <> -1 THEN parent_msg_id END AS up FROM (
    SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY ts NULLS LAST, parent_msg_id NULLS FIRST) AS rn FROM messages) WHERE rn = 1),
tree AS (
  SELECT id, id AS root, CAST(0 AS BIGINT) AS depth, [id] AS path FROM first WHERE up IS NULL
  UNION ALL SELECT f.id, t.root, t.depth + 1, list_append(t.path, f.id) FROM first f JOIN tree t ON f.up = t.id),
lost AS (
  SELECT id FROM first WHERE up IS NOT NULL AND up NOT IN (SELECT id FROM first)
  UNION ALL SELECT f.id FROM first f JOIN lost l ON f.up = l.id),
rest AS (SELECT id, up FROM first WHERE id NOT IN (SELECT id FROM tree) AND id NOT IN (SELECT id FROM lost)),
walk AS (
  SELECT id, up AS at FROM rest
  UNION SELECT w.id, r.up FROM walk w JOIN rest r ON w.at = r.id),
states AS (
  SELECT id, 'orphan' AS state FROM lost
  UNION ALL SELECT id, CASE WHEN EXISTS (SELECT 1 FROM walk w WHERE w.id = r.id AND w.at = r.id) THEN 'cycle' ELSE 'below_cycle' END FROM rest r)
"""

_RECENT = f"WITH {_MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, branch_id ORDER BY msg_id DESC, ts DESC) AS back FROM m)"
_DUP = (
    _RECENT
    + """, refs AS (SELECT conv_id, branch_id, simhash_i64 AS ref FROM r WHERE back <= 64),
dup AS (SELECT m.msg_id, 1 - min(bit_count(xor(m.simhash_i64, ref))) / 64 AS dup FROM m JOIN refs USING (conv_id, branch_id) GROUP BY m.msg_id)"""
)

_SEEDS = f"""
WITH {_bm25(_CHUNKS, _WITH_VECTOR)},
c AS (SELECT chunk_id AS id, doc_id, chunk_index, text, CAST(embedding AS DOUBLE[]) AS v FROM doc_chunks JOIN chunk_vectors USING (chunk_id)),
scaled AS (SELECT query_id, id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 0 ELSE round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 9) END AS lex
  FROM bm WINDOW w AS (PARTITION BY query_id)),
lexr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, id) AS rn FROM scaled),
qs AS (SELECT query_id, query, v AS q FROM asked JOIN c ON c.id = query_id),
sem AS (SELECT query_id, c.id, least(2, greatest(0, 1 - list_dot_product(q, v) / (greatest(sqrt(list_dot_product(q, q)), 1e-12) * greatest(sqrt(list_dot_product(v, v)), 1e-12)))) AS dist FROM qs, c WHERE v IS NOT NULL),
semr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS rn FROM sem),
both_ AS (SELECT query_id, id, 0.6 * (2 - dist) / 2 AS s FROM semr WHERE rn <= 64 UNION ALL SELECT query_id, id, 0.3 * lex FROM lexr WHERE rn <= 64),
seeds AS (SELECT query_id, id, round(s + CASE WHEN contains(lower(coalesce(text, '')), lower(trim(query))) THEN 0.1 ELSE 0 END, 9) AS score
  FROM (SELECT query_id, id, sum(s) AS s FROM both_ GROUP BY query_id, id) JOIN c USING (id) JOIN asked USING (query_id))
"""


def _beam(last: str | None = None) -> str:
    """The beam unrolled, level by level."""
    sql = (
        _SEEDS
        + """,
adj AS (SELECT id, lag(id) OVER w AS prv, lead(id) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index, id)),
f0 AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM seeds) WHERE rn <= 8)"""
    )
    for level in range(3):
        fade = 0.85 ** (level + 1)
        sql += f""",
n{level} AS (SELECT DISTINCT id FROM f{level}),
g{level} AS (SELECT src, dst FROM (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY least(2, greatest(0, 1 - list_dot_product(a.v, b.v) / (greatest(sqrt(list_dot_product(a.v, a.v)), 1e-12) * greatest(sqrt(list_dot_product(b.v, b.v)), 1e-12)))), b.id) AS rn
  FROM n{level} JOIN c a USING (id), c b WHERE a.v IS NOT NULL AND b.v IS NOT NULL AND a.id <> b.id) WHERE rn <= 8),
e{level} AS (SELECT src, dst, max(bonus) AS bonus FROM (
  SELECT id AS src, unnest([prv, nxt]) AS dst, 0.1 AS bonus FROM adj JOIN n{level} USING (id) UNION ALL SELECT src, dst, 0 FROM g{level}) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst),
r{level} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS row_ FROM f{level}),
s{level} AS (SELECT r.query_id, r.row_, r.score, e.dst AS id,
  round(0.6 * (list_dot_product(q, v) / (greatest(sqrt(list_dot_product(q, q)), 1e-12) * greatest(sqrt(list_dot_product(v, v)), 1e-12)) + 1) / 2 + 0.3 * coalesce(lex, 0) + bonus, 9) AS base,
  contains(lower(coalesce(c.text, '')), lower(trim(query))) AS phrase
  FROM r{level} r JOIN e{level} e ON e.src = r.id JOIN c ON c.id = e.dst JOIN qs USING (query_id) LEFT JOIN scaled ON scaled.query_id = r.query_id AND scaled.id = e.dst),
t{level} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, row_ ORDER BY base DESC, id) AS rn FROM s{level} WHERE base > 0) WHERE rn <= 8),
f{level + 1} AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, row_) AS rn FROM (
  SELECT query_id, row_, id, round(score + {fade} * base + CASE WHEN phrase THEN 0.1 * {fade} ELSE 0 END, 9) AS score FROM t{level})) WHERE rn <= 8)"""
    if last:
        return sql + f""", {last} AS (SELECT query_id, id, max(score) AS score FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3) GROUP BY query_id, id)"""
    return sql + "SELECT query_id, id, round(max(score), 5) AS score FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3) GROUP BY query_id, id"


_MERGE = f"""
WITH {_bm25(_CHUNKS)},
scaled AS (SELECT query_id, id, round(CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score
  FROM bm WINDOW w AS (PARTITION BY query_id))"""

_MERGE_OF = """,
p AS (SELECT chunk_id AS id, doc_id, chunk_index AS ix, start_byte, end_byte, text, row_number() OVER w AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM doc_chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index, chunk_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM {scores}) WHERE rn <= 24),
w AS (SELECT query_id, doc_id, greatest(1, pos - 2) AS a, least(n, pos + 2) AS b FROM best JOIN p USING (id)),
x AS (SELECT w.*, pa.ix AS ia, pb.ix AS ib FROM w JOIN p pa ON pa.doc_id = w.doc_id AND pa.pos = w.a JOIN p pb ON pb.doc_id = w.doc_id AND pb.pos = w.b),
y AS (SELECT *, CASE WHEN ia <= max(ib) OVER (PARTITION BY query_id, doc_id ORDER BY ia, ib, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM x),
z AS (SELECT *, sum(new) OVER (PARTITION BY query_id, doc_id ORDER BY ia, ib, a, b ROWS UNBOUNDED PRECEDING) AS island FROM y),
i AS (SELECT query_id, doc_id, island, min(a) AS a, max(b) AS b FROM z GROUP BY ALL)
SELECT i.query_id, i.doc_id, arg_min(p.id, pos) AS start_node_id, arg_max(p.id, pos) AS end_node_id, arg_min(ix, pos) AS start_index, arg_max(ix, pos) AS end_index,
  arg_min(start_byte, pos) AS start_char, arg_max(end_byte, pos) AS end_char, coalesce(max({scores}.score), 0) AS score,
  CASE WHEN length(string_agg(coalesce(text, ''), ' ' ORDER BY pos)) > 2000 THEN substr(string_agg(coalesce(text, ''), ' ' ORDER BY pos), 1, 2000) || '…' ELSE string_agg(coalesce(text, ''), ' ' ORDER BY pos) END AS text{extra}
FROM i JOIN p ON p.doc_id = i.doc_id AND pos BETWEEN a AND b LEFT JOIN {scores} ON {scores}.query_id = i.query_id AND {scores}.id = p.id
GROUP BY i.query_id, i.doc_id, island"""



def _link(prev: str) -> str:
    """The hash of a message that follows ``prev``; where there is none, ``prev``."""
    return f"coalesce(CASE WHEN role BETWEEN 0 AND 255 THEN unhex(sha256({prev} || unhex(printf('%02x', role)) || encode(CAST(ts AS VARCHAR)) || encode(content))) END, {prev})"


def oracle_sql() -> dict[str, str]:
    squeeze = lambda x: f"trim(regexp_replace({x}, '{_EDGE}+', ' ', 'g'))"
    return {
        "bm25_topk": f"WITH {_bm25(_DOCS)}, r AS (SELECT query_id, id AS doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bm WHERE score > 0) SELECT * FROM r WHERE rank <= 20",
        "term_stats": f"WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, round(ln(((SELECT count(*) FROM documents) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5) + 1), 6) AS idf FROM t GROUP BY term",
        "corpus_stats": f"SELECT count(*) AS n, round(avg(len({_TOKENS.format('text')})), 6) AS avgdl FROM documents",
        "flat_knn_cosine": _knn(_QX),
        "flat_knn_l2": _knn("list_dot_product(q.v, q.v) + list_dot_product(x.v, x.v) - 2 * list_dot_product(q.v, x.v)", "q.id <> x.id"),
        "flat_knn_ip": _knn("-list_dot_product(q.v, x.v)"),
        "filtered_knn": _knn(_QX, "x.label = 3"),
        "knn_self_graph": f"WITH e AS (SELECT * FROM {_VEC}), s AS (SELECT q.id AS src, x.id AS dst, {_QX} AS dist FROM e q, e x WHERE q.id <> x.id AND q.id % 20 = 0) SELECT src, dst, round(dist, 6) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM s) WHERE rn <= 8",
        "partial_final_topk": _knn(_QX),
        "ivf_knn": _knn(_QX),
        "vector_scores": f"""WITH e AS (SELECT * FROM {_VEC}), s AS (SELECT q.id AS query_id, x.id, {_QX} AS c, list_dot_product(q.v, q.v) + list_dot_product(x.v, x.v) - 2 * list_dot_product(q.v, x.v) AS l, list_dot_product(q.v, x.v) AS p FROM e q, e x WHERE q.id % 20 = 0)
SELECT query_id, id, round(c, 6) + 0.0 AS cos_d, round(abs(l), 6) + 0.0 AS l2_d, round(-p, 6) + 0.0 AS ip_d, round((2 - c) / 2, 6) + 0.0 AS cos_s, round(1 / (1 + abs(l)), 6) + 0.0 AS l2_s, round(1 / (1 + exp(-p)), 6) + 0.0 AS ip_s, round((2 - c) / 2, 6) + 0.0 AS cos_q FROM s""",
        "normalized_vectors": "WITH v AS (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM chunk_vectors WHERE embedding IS NOT NULL), n AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS n FROM v) SELECT chunk_id, round(list_dot_product(v, v) / (n * n), 6) AS length, round(v[1] / n, 6) AS first FROM n",
        "min_max_scores": "SELECT doc_id, round(CASE WHEN max(length(text)) OVER w - min(length(text)) OVER w = 0 THEN 0 ELSE (length(text) - min(length(text)) OVER w) / (max(length(text)) OVER w - min(length(text)) OVER w) END, 6) AS scaled FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY source)",
        "rank_dedup": "SELECT chunk_id, doc_id, start_byte, end_byte FROM (SELECT *, rank() OVER (PARTITION BY hash64 ORDER BY doc_id, start_byte, end_byte) AS r FROM doc_chunks) WHERE r = 1 OR hash64 IS NULL",
        "insert_dedup": """WITH s AS (SELECT * FROM doc_chunks WHERE chunk_index = 0), f AS (
  SELECT chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY hash64 ORDER BY chunk_id) AS rn FROM doc_chunks WHERE chunk_index > 0)
  WHERE hash64 IS NULL OR (rn = 1 AND hash64 NOT IN (SELECT hash64 FROM s WHERE hash64 IS NOT NULL)))
SELECT (SELECT max(chunk_id) FROM s) + row_number() OVER (ORDER BY chunk_id) AS id, chunk_id FROM f""",
        "ingest_counters": f"""WITH t AS (SELECT {_strip("replace(coalesce(text, ''), chr(10), ' ')")} AS t, hash64 FROM doc_chunks)
SELECT count(*) AS total, count(*) FILTER (t = '') AS empty_text, count(*) FILTER (t <> '') AS embedded, count(DISTINCT hash64) FILTER (t <> '') + count(*) FILTER (t <> '' AND hash64 IS NULL) AS inserted FROM t""",
        "first_seen": "SELECT conv_id, content_hash, min(msg_id) AS first_msg_id FROM messages GROUP BY conv_id, content_hash",
        "normalize_text": f"SELECT doc_id, {_normalized('text')} AS clean FROM documents",
        "html_to_text": f"""SELECT doc_id, {_strip(f"regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '{_EDGE}{{2,}}', ' ', 'g')")} AS plain FROM documents""",
        "token_estimate": r"SELECT doc_id, CAST(coalesce(greatest(1, len(regexp_extract_all(text, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+')) * 4 // 3), 1) AS INTEGER) AS by_words, CASE WHEN text IS NULL THEN 1 ELSE CAST(greatest(1, length(text) // 4) AS INTEGER) END AS by_chars FROM documents",
        "tokens": "SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9_]+') AS tokens FROM documents",
        "phrase_match": "SELECT CAST(query_id AS BIGINT) AS query_id, doc_id FROM documents, (VALUES (1, 'without loss of detail'), (2, 'the archive room'), (3, 'DIE NEUEN HEFTE')) AS p(query_id, query) WHERE contains(lower(text), lower(query))",
        "record_text": f"""WITH r AS (SELECT doc_id, coalesce(CASE WHEN {_strip("text")} <> '' THEN text END, CASE WHEN {_strip("lang")} <> '' THEN lang END, CASE WHEN {_strip("src_path")} <> '' THEN src_path END, '') AS raw FROM documents)
SELECT doc_id, raw, {_strip("replace(raw, chr(10), ' ')")} AS stored FROM r""",
        "marked_text": rf"""WITH t AS (SELECT doc_id, src_path, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '<\|[^>]+?\|>', '', 'g') AS bare FROM documents)
SELECT doc_id, 'a ' || regexp_replace(t, '(?s)<\|think\|>.*?(?:<\|endofthink\|>|\z)', '', 'g') || ' <|eot|>' AS answer, {_strip("'a  b ' || bare || ' ' || bare || '  rest'")} AS plain,
  contains(t, 'the archive') OR contains(t, '</') AS stops, CASE WHEN src_path IS NOT NULL THEN lower(regexp_extract(src_path, '[^/\\](\.[^./\\]+)$', 1)) END AS suffix, CASE WHEN src_path IS NOT NULL THEN regexp_replace(split_part(src_path, '/', -1), '\.[^.]*$', '') END AS stem FROM t""",
        "guard_verdicts": rf"""WITH t AS (SELECT doc_id, lower(lang) AS l, list_filter([{_strip(_BARE)} FOR x IN regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x{{0B}}\f\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]')], lambda x: x <> '') AS lines FROM documents),
v AS (SELECT doc_id, CASE WHEN starts_with(l, 'en') THEN 'unsafe' WHEN starts_with(l, 'de') OR starts_with(lower(lines[1]), 'safe') THEN 'safe' ELSE 'unsafe' END AS verdict,
  CASE WHEN starts_with(l, 'en') THEN lines[1] WHEN starts_with(l, 'de') THEN NULL WHEN starts_with(lower(lines[1]), 'unsafe') THEN lines[2] END AS listed FROM t)
SELECT doc_id, verdict, coalesce(array_to_string(list_filter(regexp_split_to_array(listed, '(?:,|{_EDGE})+'), lambda x: x <> ''), ','), '') AS categories FROM v""",
        "total_bytes": "SELECT doc_id, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS chunks FROM doc_chunks GROUP BY doc_id",
        "chunk_hashes": "SELECT chunk_id, CAST(hash64 AS VARCHAR) AS hash64 FROM doc_chunks WHERE hash64 IS NOT NULL",
        "message_hashes": "SELECT DISTINCT msg_id, simhash_i64, content_hash FROM messages",
        "adjacent_chunks": "SELECT chunk_id AS id, lag(chunk_id) OVER w AS prev, lead(chunk_id) OVER w AS next, row_number() OVER w AS pos FROM doc_chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index, chunk_id)",
        "hybrid_seeds": _SEEDS + "SELECT query_id, id, round(score, 5) AS score FROM seeds",
        "beam_traverse": _beam(),
        "merge_spans": _MERGE + _MERGE_OF.format(scores="scaled", extra=""),
        "context_blocks": f"""WITH {_bm25(_DOCS)}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bm WHERE score > 0)
SELECT query_id, string_agg('[doc:' || rank || '] ' || {squeeze("coalesce(text, '')")}, chr(10) ORDER BY rank) AS block FROM r JOIN documents d ON d.doc_id = r.id WHERE rank <= 5 GROUP BY query_id""",
        "role_merge": f"""{_DIALOG}, l AS (SELECT *, row_number() OVER w = 1 AND role = 'system' AS lead_ FROM d WINDOW w AS (PARTITION BY dialog_id ORDER BY turn)),
s AS (SELECT *, CASE WHEN role IN ('user', 'assistant') AND lag(CASE WHEN NOT lead_ THEN role END) OVER (PARTITION BY dialog_id ORDER BY turn) = role THEN 0 ELSE 1 END AS new FROM l),
g AS (SELECT *, sum(new) OVER (PARTITION BY dialog_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT dialog_id, min(turn) AS turn, arg_min(role, turn) AS role, CASE WHEN count(*) > 1 THEN {_strip("string_agg(coalesce(content, ''), chr(10) ORDER BY turn)")} ELSE string_agg(coalesce(content, ''), chr(10) ORDER BY turn) END AS content FROM g GROUP BY dialog_id, run""",
        "guard_view": f"{_DIALOG} SELECT dialog_id, turn, CASE role WHEN 'user' THEN 'User' ELSE 'Agent' END AS role, content FROM d WHERE role IN ('user', 'assistant')",
        "transcripts": f"{_DIALOG} SELECT dialog_id, string_agg(upper(role[1]) || role[2:] || ': ' || coalesce(content, ''), chr(10) ORDER BY turn) || chr(10) || 'Assistant:' AS text FROM d WHERE role <> 'tool' GROUP BY dialog_id",
        "history_blocks": f"{_DIALOG} SELECT dialog_id, string_agg('- ' || {squeeze('content')}, chr(10) ORDER BY turn) AS block FROM d WHERE {squeeze('content')} <> '' GROUP BY dialog_id",
        "messages_by_key": f"WITH {_MSG} SELECT m.conv_id, m.branch_id, msg_id, content FROM m JOIN tips t ON t.conv_id = m.conv_id AND t.branch_id = m.branch_id AND t.last_msg_id = m.msg_id",
        "recency_window": _RECENT + " SELECT conv_id, branch_id, msg_id, back FROM r WHERE back <= 128",
        "latest_messages": f"WITH {_MSG} SELECT msg_id, ts FROM m ORDER BY ts DESC NULLS LAST, msg_id LIMIT 50",
        "branch_tips": "SELECT conv_id, branch_id, arg_max(chain_hash, msg_id) AS tip_hash, max(msg_id) AS last_msg_id FROM messages GROUP BY conv_id, branch_id",
        "duplicate_penalty": _DUP + " SELECT msg_id, round(dup, 6) AS dup FROM dup",
        "budget_context": _DUP
        + """, s AS (SELECT m.*, round(0.3 * exp(-(max(ts) OVER (PARTITION BY conv_id, branch_id) - ts) / 3600) + 0.1 * coalesce([0.7, 1.0, 0.9, 0.6][CASE WHEN role BETWEEN 0 AND 3 THEN role + 1 END], 0) - 0.5 * dup, 6) AS score FROM m JOIN dup USING (msg_id)),
u AS (SELECT *, sum(coalesce(token_count, 0)) OVER (PARTITION BY conv_id, branch_id ORDER BY score / (coalesce(token_count, 0) + 1.1920928955078125e-07) DESC, msg_id ROWS UNBOUNDED PRECEDING) AS used FROM s)
SELECT conv_id, branch_id, msg_id, score, CAST(used AS BIGINT) AS used FROM u WHERE used <= 1024""",
        "chain_links": "SELECT DISTINCT conv_id, branch_id, msg_id, chain_prev = unhex(repeat('00', 32)) OR EXISTS (SELECT 1 FROM messages x WHERE x.conv_id = m.conv_id AND x.chain_hash = m.chain_prev) AS linked FROM messages m",
        "retry_schedule": "SELECT range AS attempt, least(0.5 * power(2, range - 1), 8) AS seconds FROM range(1, 9)",
        "prompts": "SELECT doc_id, 'Source ' || coalesce(source, 'unknown') || ', language ' || coalesce(lang, 'unknown') || ': ' || coalesce(text, 'unknown') AS prompt FROM documents",
        "p4_found": _TREE + "SELECT id AS msg_id, state FROM states",
        "history_context": f"""{_DUP},
v0 AS (SELECT msg_id, conv_id, branch_id, [CAST(length(lower(content)) - length(replace(lower(content), l, '')) AS DOUBLE) FOR l IN string_split('abcdefghijklmnopqrstuvwxyz', '')] AS c FROM m WHERE {_strip("replace(content, chr(10), ' ')")} <> ''),
v AS (SELECT msg_id, conv_id, branch_id, CAST([CAST(x / greatest(sqrt(list_dot_product(c, c)), 1e-12) AS FLOAT) FOR x IN c] AS DOUBLE[]) AS v FROM v0),
asked AS (SELECT t.msg_id AS query_id, t.conv_id, t.branch_id, v.v AS q FROM (SELECT conv_id, branch_id, max(msg_id) AS msg_id FROM m GROUP BY ALL) t JOIN v USING (msg_id)),
spoken AS (SELECT v.* FROM v JOIN m USING (msg_id) WHERE role IN (1, 2, 3)),
near AS (SELECT query_id, msg_id FROM (SELECT query_id, s.msg_id, a.conv_id = s.conv_id AND a.branch_id = s.branch_id AS own,
  row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_dot_product(q, s.v) / (greatest(sqrt(list_dot_product(q, q)), 1e-12) * greatest(sqrt(list_dot_product(s.v, s.v)), 1e-12)), s.msg_id) AS rn FROM asked a, spoken s) WHERE rn <= 96 AND own),
chosen AS (SELECT * FROM near UNION SELECT query_id, r.msg_id FROM asked JOIN r USING (conv_id, branch_id) WHERE back <= 128),
ends AS (SELECT conv_id, branch_id, max(ts) AS newest FROM m GROUP BY ALL),
rows_ AS (SELECT query_id, m.*, coalesce(list_dot_product(q, v.v) / (greatest(sqrt(list_dot_product(q, q)), 1e-12) * greatest(sqrt(list_dot_product(v.v, v.v)), 1e-12)), 0) AS sim,
  0.3 * exp(-(newest - ts) / 3600) + 0.1 * coalesce([0.7, 1.0, 0.9, 0.6][CASE WHEN role BETWEEN 0 AND 3 THEN role + 1 END], 0) - 0.5 * dup AS rest
  FROM chosen JOIN m USING (msg_id) JOIN dup USING (msg_id) JOIN ends USING (conv_id, branch_id) JOIN asked USING (query_id) LEFT JOIN v ON v.msg_id = m.msg_id),
fit AS (SELECT *, sum(coalesce(token_count, 0)) OVER (PARTITION BY query_id ORDER BY (sim + rest) / (coalesce(token_count, 0) + 1.1920928955078125e-07) DESC, msg_id ROWS UNBOUNDED PRECEDING) AS used FROM rows_),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, msg_id) AS place FROM fit WHERE used <= 256)
SELECT query_id, conv_id, branch_id, msg_id, row_number() OVER (PARTITION BY query_id ORDER BY ts, msg_id) AS turn, content FROM best WHERE place <= 64""",
        "append_log": f"""WITH RECURSIVE {_MSG}, stored AS (SELECT conv_id, branch_id, arg_max(chain_hash, msg_id) AS tip FROM m WHERE role = 0 GROUP BY ALL),
f AS (SELECT m.*, coalesce(tip, unhex(repeat('00', 32))) AS tip, row_number() OVER (PARTITION BY m.conv_id, m.branch_id ORDER BY msg_id) AS k
  FROM m LEFT JOIN stored s ON s.conv_id = m.conv_id AND s.branch_id = m.branch_id WHERE role IS DISTINCT FROM 0),
walk AS (SELECT msg_id, conv_id, branch_id, k, tip AS prev, {_link("tip")} AS hash FROM f WHERE k = 1
  UNION ALL SELECT f.msg_id, f.conv_id, f.branch_id, f.k, w.hash, {_link("w.hash")} FROM walk w JOIN f ON f.conv_id = w.conv_id AND f.branch_id = w.branch_id AND f.k = w.k + 1)
SELECT f.conv_id, f.branch_id, msg_id, role, ts, CAST(coalesce(token_count, greatest(1, length(content) // 4)) AS INTEGER) AS token_count, parent_msg_id, unhex(sha256(encode(content))) AS content_hash, prev AS chain_prev, hash AS chain_hash
FROM f JOIN walk USING (msg_id)""",
        "embedded_documents": f"""WITH c AS (SELECT doc_id, [CAST(length(lower(text)) - length(replace(lower(text), l, '')) AS DOUBLE) FOR l IN string_split('abcdefghijklmnopqrstuvwxyz', '')] AS c FROM documents WHERE {_strip("replace(text, chr(10), ' ')")} <> '')
SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, round(CAST(CAST(c[i] / greatest(sqrt(list_dot_product(c, c)), 1e-12) AS FLOAT) AS DOUBLE), 5) AS value FROM c, range(1, 27) AS r(i)""",
        "hash_chain": """SELECT conv_id, branch_id, msg_id, CASE WHEN role BETWEEN 0 AND 255 AND ts IS NOT NULL AND content IS NOT NULL THEN unhex(sha256(chain_prev || unhex(printf('%02x', role)) || encode(CAST(ts AS VARCHAR)) || encode(content))) = chain_hash END AS hash_ok, content_hash = unhex(sha256(encode(content))) AS content_ok FROM messages""",
        "retrieve_contexts": f"""SELECT * EXCLUDE (score), round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, start_node_id) AS rank
  FROM ({_beam("reached")}{_MERGE_OF.format(scores="reached", extra=", list(p.id ORDER BY pos) AS node_ids")})""",
        "collection_search": f"""WITH r AS (SELECT chunk_id, hash64, CAST(embedding AS DOUBLE[]) AS v FROM doc_chunks JOIN chunk_vectors USING (chunk_id) WHERE len(embedding) = 64),
held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash64 ORDER BY chunk_id) AS rn FROM r) WHERE rn = 1 OR hash64 IS NULL),
s AS (SELECT q.chunk_id AS query_id, x.chunk_id, least(2, greatest(0, 1 - list_dot_product(q.v, x.v) / (greatest(sqrt(list_dot_product(q.v, q.v)), 1e-12) * greatest(sqrt(list_dot_product(x.v, x.v)), 1e-12)))) AS dist FROM r q, held x WHERE q.chunk_id % 20 = 0)
SELECT query_id, chunk_id, round(dist, 6) + 0.0 AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) AS rank FROM s) WHERE rank <= 5""",
        "p4_hierarchy": _TREE
        + """, fallen AS (SELECT a, count(*) AS n FROM (SELECT unnest(path) AS a, id FROM tree) GROUP BY a)
SELECT t.id, root, depth, 'ok' AS state, n - 1 AS below, path FROM tree t JOIN fallen ON a = t.id UNION ALL SELECT id, NULL, NULL, state, NULL, NULL FROM states""",
        "p4_intervals": _TREE
        + """, fallen AS (SELECT a, count(*) AS n FROM (SELECT unnest(path) AS a FROM tree) GROUP BY a)
SELECT id, row_number() OVER (ORDER BY path) - 1 AS first, row_number() OVER (ORDER BY path) - 2 + n AS last FROM tree JOIN fallen ON a = id""",
        "p4_descendants": _TREE + "SELECT a AS id, id AS descendant, depth - (list_position(path, a) - 1) AS distance FROM (SELECT id, depth, path, unnest(path) AS a FROM tree) WHERE a <> id",
    }
