"""Dialogs and prompts: role runs, guard views, transcripts, context and history blocks.

Dialogs are rows ``(dialog_id, turn, role, content)``; what is joined into one
text is one dialog, so its size is that of the dialog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Template, guard_verdict, squeeze, strip
from ..session import cut
from .completion import Client, complete


def _joined(order: str, value: Column, sep: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return F.array_join(F.transform(rows, lambda x: x["v"]), sep)


def merge_roles(dialogs: DataFrame, key: str = "dialog_id") -> DataFrame:
    """Consecutive turns of a user or an assistant joined by newlines; a leading system turn stands apart."""
    order = Window.partitionBy(key).orderBy("turn")
    lead = (F.row_number().over(order) == 1) & (F.col("role") == "system")
    rows = dialogs.withColumn("lead", lead)
    before = F.lag(F.when(~F.col("lead"), F.col("role"))).over(order)
    same = F.coalesce(before == F.col("role"), F.lit(False)) & F.col("role").isin("user", "assistant")
    rows = rows.withColumn("run", F.sum((~same).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = rows.groupBy(key, "run").agg(F.min("turn").alias("turn"), F.min_by("role", "turn").alias("role"), F.count("*").alias("n"), _joined("turn", F.coalesce("content", F.lit("")), "\n").alias("content"))
    text = F.when(F.col("n") > 1, strip(F.col("content"))).otherwise(F.col("content"))
    return grouped.select(key, "turn", "role", text.alias("content"))


def guard_view(dialogs: DataFrame, key: str = "dialog_id", candidates: DataFrame | None = None) -> DataFrame:
    """Only user and assistant turns, named User and Agent; a candidate reply ``(key, content)`` comes last."""
    role = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Agent")
    rows = dialogs.select(key, "turn", role.alias("role"), "content").filter("role is not null")
    if candidates is not None:
        end = dialogs.groupBy(key).agg((F.max("turn") + 1).alias("turn"))
        rows = rows.unionByName(candidates.join(end, key).select(key, "turn", F.lit("Agent").alias("role"), "content"))
    return rows


def transcript(dialogs: DataFrame, key: str = "dialog_id") -> DataFrame:
    """``(key, text)``: ``Role: content`` lines and an open line for the assistant."""
    name = F.initcap("role")
    rows = dialogs.filter(F.col("role").isin("system", "user", "assistant"))
    return rows.groupBy(key).agg(F.concat(_joined("turn", F.concat(name, F.lit(": "), F.coalesce("content", F.lit(""))), "\n"), F.lit("\nAssistant:")).alias("text"))


def raw_transcript(dialogs: DataFrame, key: str = "dialog_id") -> DataFrame:
    """As :func:`transcript` with the roles as stored."""
    line = F.concat("role", F.lit(": "), F.coalesce("content", F.lit("")))
    return dialogs.groupBy(key).agg(F.concat(_joined("turn", line, "\n"), F.lit("\nassistant: ")).alias("text"))


def context_block(contexts: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """``(key, block)``: ``[doc:i] text`` lines by rank."""
    line = F.concat(F.lit("[doc:"), F.col("rank").cast("string"), F.lit("] "), squeeze(F.coalesce(F.col(text), F.lit(""))))
    return contexts.groupBy(key).agg(_joined("rank", line, "\n").alias("block"))


def history_block(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """``(key, block)``: ``- content`` lines in order of turns, blank ones left out."""
    said = squeeze(F.coalesce("content", F.lit("")))
    return rows.withColumn("s", said).filter("s <> ''").groupBy(key).agg(_joined("turn", F.concat(F.lit("- "), F.col("s")), "\n").alias("block"))


# The wording that a guard model was trained on; {target}, {categories} and {conversation} are filled in.
GUARD_TEMPLATE = (
    "<|begin_of_text|><|header_start|>user<|header_end|>\n\nTask: Check if there is unsafe content in '{target}' messages in conversations according to our safety policy with the below categories.\n\n"
    "<BEGIN UNSAFE CONTENT CATEGORIES>\n{categories}\n<END UNSAFE CONTENT CATEGORIES>\n\n<BEGIN CONVERSATION>\n\n{conversation}\n\n<END CONVERSATION>\n\n"
    "Provide your safety assessment for ONLY THE LAST {target} in the above conversation:\n- First line must read 'safe' or 'unsafe'.\n- If unsafe, a second line must include a comma-separated list of violated categories."
    "<|eot|><|header_start|>assistant<|header_end|>"
)


# The codes and titles of the guard's categories; descriptions are added where a guard was trained with them.
CATEGORIES = [
    ("S0", "Prompt Injection & Jailbreaks", ""), ("S1", "Violent Crimes", ""), ("S2", "Non-Violent Crimes", ""), ("S3", "Sex Crimes", ""), ("S4", "Child Exploitation", ""), ("S5", "Defamation", ""),
    ("S6", "Specialized Advice", ""), ("S7", "Privacy", ""), ("S8", "Intellectual Property", ""), ("S9", "Indiscriminate Weapons", ""), ("S10", "Hate", ""), ("S11", "Self-Harm", ""),
    ("S12", "Sexual Content", ""), ("S13", "Elections", ""), ("S14", "Code Interpreter Abuse", ""),
]


def guard_prompt(view: DataFrame, categories: list[tuple[str, str, str]], target: str = "User", key: str = "dialog_id", template: str = GUARD_TEMPLATE) -> DataFrame:
    """``(key, prompt)``: the guard's question about the last ``target`` turn, with ``categories`` of (code, title, description)."""
    listed = "\n".join(line for code, title, told in categories for line in (f"{code}: {title}. ", told))
    talk = view.groupBy(key).agg(_joined("turn", F.concat("role", F.lit(": "), strip(F.coalesce("content", F.lit("")))), "\n").alias("talk"))
    return talk.select(key, Template(template).render({"target": F.lit(target), "categories": F.lit(listed), "conversation": F.col("talk")}).alias("prompt"))


def guarded(dialogs: DataFrame, verdicts: DataFrame, key: str = "dialog_id") -> DataFrame:
    """The turns that no guard blocked; ``verdicts``: ``(key, turn, answer)``, a turn without one is kept."""
    judged = verdicts.select(key, "turn", guard_verdict(F.col("answer"))["verdict"].alias("verdict"))
    return dialogs.join(judged.filter("verdict = 'unsafe'"), [key, "turn"], "left_anti")


def guarded_chat(dialogs: DataFrame, guard: Client, model: Client, categories: list[tuple[str, str, str]] = CATEGORIES, key: str = "dialog_id") -> DataFrame:
    """``(key, answer, blocked, error)``: a reply to each dialog, judged before and after.

    ``blocked`` is ``user`` where the guard finds the last user turn unsafe (no
    reply is asked for then), ``agent`` where it finds the reply so (the reply
    is withheld), else null. A guard that fails blocks.
    """
    verdict = guard_verdict(F.coalesce("answer", F.lit("")))["verdict"] != "safe"
    asked = cut(complete(guard_prompt(guard_view(dialogs, key), categories, "User", key), guard).select(key, verdict.alias("bad")))
    fine = dialogs.join(asked.filter("not bad"), key, "left_semi")
    said = cut(complete(transcript(fine, key).withColumnRenamed("text", "prompt"), model).select(key, F.col("answer").alias("content"), "error"))
    view = guard_view(fine, key, said.filter("content is not null").select(key, "content"))
    judged = complete(guard_prompt(view, categories, "Agent", key), guard).select(key, verdict.alias("bad_reply"))
    rows = asked.join(said, key, "left").join(judged, key, "left")
    blocked = F.when(F.col("bad"), "user").when(F.col("content").isNotNull() & F.coalesce("bad_reply", F.lit(True)), "agent")
    return rows.select(key, F.when(blocked.isNull(), F.col("content")).alias("answer"), blocked.alias("blocked"), "error")
