import hashlib

import pytest
from pyspark.sql import functions as F

from fathomline.operators import dialog, embedding, history
from fathomline.plans import queries
from fathomline.streaming import log

NEW = "conv_id string, branch_id string, msg_id long, role int, ts double, token_count int, parent_msg_id long, content string"
ROWS = [("c1", "main", 1, 0, 0.0, 6, None, "be brief"), ("c1", "main", 2, 1, 1.0, 6, 1, "hello"), ("c1", "main", 3, 2, 2.5, 9, 2, "hi there"), ("c1", "main", 4, 1, 3.0, None, 3, "bye now, friend")]


def chain(rows):
    tip = b"\0" * 32
    for r in rows:
        tip = hashlib.sha256(tip + bytes([r[3]]) + str(r[4]).encode() + r[7].encode()).digest()
    return tip


def test_append_is_idempotent_and_chained(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.createDataFrame(ROWS[:2], NEW)
    log.append_batch(first, path)
    log.append_batch(spark.createDataFrame(ROWS, NEW), path)
    log.append_batch(spark.createDataFrame(ROWS[1:3], NEW), path)
    rows = log.stored(spark, path)
    assert rows.count() == 4
    tip = history.tips(rows).first()
    assert bytes(tip.tip_hash) == chain(ROWS) and tip.last_msg_id == 4
    assert rows.filter("msg_id = 4").first().token_count == 3
    assert history.chain_check(rows).filter("not hash_ok or not content_ok").count() == 0
    assert history.chain_order(rows).filter("not linked").count() == 0
    assert bytes(history.fork(rows, history.tips(rows), "c1", "main", "alt", 2).first().tip_hash) == chain(ROWS[:2])
    with pytest.raises(ValueError):
        history.fork(rows, history.tips(rows), "c1", "main", "alt", 99)


def test_stream_appends_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "log")
    spark.createDataFrame(ROWS, NEW).write.parquet(str(src / "a"))
    for _ in range(2):
        stream = spark.readStream.schema(NEW).option("recursiveFileLookup", "true").parquet(str(src))
        log.run_log(stream, out, str(tmp_path / "ck")).awaitTermination()
    assert log.stored(spark, out).count() == 4


def test_budget_is_a_prefix(spark):
    df = spark.createDataFrame([("t", 1, 1.0, 10), ("t", 2, 0.9, 1), ("t", 3, 0.5, 100), ("t", 4, 0.001, 1)], "t string, msg_id long, score double, token_count int")
    got = sorted(r.msg_id for r in history.within_budget(df, 50, ["t"]).collect())
    assert got == [1, 2]


def test_context(spark, tmp_path):
    path = str(tmp_path / "log")
    log.append_batch(spark.createDataFrame(ROWS, NEW), path)
    rows = log.stored(spark, path)
    told = embedding.embed(rows.select("conv_id", "branch_id", "msg_id", "content"), embedding.hashed_words(16), "content")
    told = told.select("conv_id", "branch_id", "msg_id", "embedding")
    q = told.filter("msg_id = 2").select(F.lit(1).alias("query_id"), "conv_id", "branch_id", F.col("embedding").alias("q"))
    got = history.build_context(rows, told, q, budget=64).orderBy("turn").collect()
    assert [r.msg_id for r in got] == [1, 2, 3, 4]


def test_contexts_of_all_conversations(spark):
    d = "/root/testdata/sf0.001"
    rows = queries._messages(spark, d).filter("length(trim(content)) > 0")
    last = history.tips(queries._messages(spark, d)).select("conv_id", "branch_id", F.col("last_msg_id").alias("msg_id"))
    want = {r.msg_id for r in last.join(rows, ["conv_id", "branch_id", "msg_id"]).collect()}
    got = {(r.query_id, r.conv_id) for r in queries.queries()["history_context"](spark, d).select("query_id", "conv_id").distinct().collect()}
    assert {q for q, _ in got} <= want and len({c for _, c in got}) > 1
    # A query has no row only if its best message alone is over the budget.
    assert len(got) >= 0.8 * len(want)


def test_roles_merge(spark):
    rows = [("d", 1, "system", "s"), ("d", 2, "user", "a "), ("d", 3, "user", " b "), ("d", 4, "assistant", "x"), ("d", 5, "tool", "t"), ("d", 6, "tool", "u"), ("d", 7, "user", None)]
    df = spark.createDataFrame(rows, "dialog_id string, turn long, role string, content string")
    got = [(r.role, r.content) for r in dialog.merge_roles(df).orderBy("turn").collect()]
    assert got == [("system", "s"), ("user", "a \n b"), ("assistant", "x"), ("tool", "t"), ("tool", "u"), ("user", "")]
    text = dialog.transcript(df.filter("turn < 5")).first().text
    assert text == "System: s\nUser: a \nUser:  b \nAssistant: x\nAssistant:"
    view = dialog.guard_view(df, candidates=spark.createDataFrame([("d", "z")], "dialog_id string, content string"))
    assert [r.role for r in view.orderBy("turn").collect()] == ["User", "User", "Agent", "User", "Agent"]
    assert "S1: T. \nD" in dialog.guard_prompt(view, [("S1", "T", "D")]).first().prompt
    kept = dialog.guarded(df, spark.createDataFrame([("d", 2, "unsafe\nS1"), ("d", 3, "safe")], "dialog_id string, turn long, answer string"))
    assert kept.count() == 6


def test_activity_windows(spark, tmp_path):
    spark.createDataFrame(ROWS + [("c1", "main", 5, 1, 7300.0, 4, 4, "late")], NEW).write.parquet(str(tmp_path / "in"))
    stream = log.thread_activity(spark.readStream.schema(NEW).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("select conv_id, messages, tokens from activity order by window").collect()
    assert [tuple(r) for r in rows] == [("c1", 4, 21), ("c1", 1, 4)]


def test_reads_of_the_log(spark):
    df = spark.createDataFrame(ROWS, NEW)
    assert [r.msg_id for r in history.latest(df, 2).collect()] == [4, 3]
    assert sorted(r.msg_id for r in history.recent(df, 2).collect()) == [3, 4]
    keys = df.filter("msg_id in (1, 3)").select("conv_id", "branch_id", "msg_id")
    assert history.by_keys(df, keys.union(keys)).count() == 2


def test_scores_of_unknown_roles(spark):
    rows = [("c", "b", 1, None, 10.0, 7), ("c", "b", 2, 9, 10.0, 7), ("c", "b", 3, 1, 10.0, None)]
    df = spark.createDataFrame(rows, "conv_id string, branch_id string, msg_id long, role int, ts double, simhash_i64 long")
    got = {r.msg_id: r.score for r in history.context_score(history.duplicate_penalty(df)).collect()}
    assert got[1] == got[2] == pytest.approx(0.3 - 0.5)
    assert got[3] is None or got[3] == pytest.approx(0.4 - 0.5, abs=0.6)


def test_redelivered_rows_chain_the_same(spark, tmp_path):
    again = [(*ROWS[1][:4], 9.0, *ROWS[1][5:]), ("c2", "b", 9, 1, 1.0, 1, None, "other")]
    tips = []
    for k, rows in enumerate(([*ROWS, *again], [*again, *reversed(ROWS)])):
        log.append_batch(spark.createDataFrame(rows, NEW), str(tmp_path / str(k)))
        tips.append({r.branch_id: bytes(r.tip_hash) for r in history.tips(log.stored(spark, str(tmp_path / str(k)))).collect()})
    assert tips[0] == tips[1] and tips[0]["main"] == chain(ROWS)


def test_a_broken_log_is_an_error(spark, tmp_path):
    assert log.stored(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "log" / "bucket=3").mkdir(parents=True)
    (tmp_path / "log" / "bucket=3" / "part-0.parquet").write_bytes(b"broken")
    with pytest.raises(Exception):
        log.append_batch(spark.createDataFrame([(f"c{i}", "b", i, 1, 1.0, 1, None, "x") for i in range(2000)], NEW), str(tmp_path / "log"))


def test_upserts(spark):
    held = spark.createDataFrame([("c", "a", b"1", 5), ("c", "b", b"2", 9)], "conv_id string, branch_id string, tip_hash binary, last_msg_id long")
    new = spark.createDataFrame([("c", "a", b"3", 7), ("c", "b", b"4", 3), ("d", "a", b"5", 1)], held.schema)
    assert sorted((r.conv_id, r.branch_id, bytes(r.tip_hash)) for r in history.upsert_tips(held, new).collect()) == [("c", "a", b"3"), ("c", "b", b"2"), ("d", "a", b"5")]
    meta = history.upsert_meta(spark.createDataFrame([("k", "1"), ("l", "2")], "key string, value string"), spark.createDataFrame([("k", "3"), ("m", "4")], "key string, value string"))
    assert {r.key: r.value for r in meta.collect()} == {"k": "3", "l": "2", "m": "4"}


def test_guarded_chat(spark):
    from fathomline.operators.completion import Client

    async def guard(prompt):
        talk = prompt.split("<BEGIN CONVERSATION>")[1]
        if "fail" in talk:
            raise ValueError("down")
        return "unsafe\nS1" if ("bomb" in talk and "LAST User" in talk) or "secret" in talk else "safe"

    async def model(prompt):
        return "the secret" if "tell" in prompt else "hello"

    rows = [("a", 1, "user", "hi"), ("b", 1, "user", "a bomb"), ("c", 1, "user", "tell me"), ("d", 1, "user", "fail")]
    df = spark.createDataFrame(rows, "dialog_id string, turn long, role string, content string")
    got = {r.dialog_id: (r.answer, r.blocked) for r in dialog.guarded_chat(df, Client(guard), Client(model)).collect()}
    assert got == {"a": ("hello", None), "b": (None, "user"), "c": (None, "agent"), "d": (None, "user")}
