"""Prefix-target expansion: every assistant turn becomes one example whose context is all turns before it.

One shuffle on conv_id; a conversation's turns are sorted once and the context is a running window, so the size of the
result is that of the examples themselves.

Defined results: rows whose conv_id, turn or role is null cannot be placed in a conversation and are left out; a null
text counts as empty; identical rows count once; rows that tie on turn are ordered by role, then by text; texts are taken whole,
however long (a conversation's examples must fit a task's memory one at a time). Roles other than assistant are context only. Template marks inside a text are broken up ("<|" becomes "< |"), so a text cannot
forge a turn. Extra columns are ignored and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, n_context, prompt, target, text and the half-open span train_start:train_end, the only trainable characters of text."""
    turns = conversations.select("conv_id", "turn", F.lower("role").alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("said")).dropna(subset=["conv_id", "turn", "role"])
    # Laid out by conversation once; identical rows then go, and windows run, where they lie.
    turns = turns.repartition("conv_id").distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "said")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    whole = turns.withColumn("rendered", F.concat(head, F.col("said"), F.lit(END)))
    seen = whole.select("conv_id", "turn", "role", "said", F.collect_list("rendered").over(before).alias("context"))
    prompt = F.concat(F.array_join("context", ""), F.lit("<|assistant|>\n"))
    examples = seen.where("role = 'assistant'").select("conv_id", "turn", F.size("context").cast("long").alias("n_context"), prompt.alias("prompt"), F.concat("said", F.lit(END)).alias("target"))
    start = F.length("prompt").cast("long")
    return examples.select("*", F.concat("prompt", "target").alias("text"), start.alias("train_start"), (start + F.length("target")).alias("train_end"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, lower(role) AS role, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL),
r AS (SELECT *, concat('<|', role, '|>', chr(10), said, '<|end|>', chr(10)) AS rendered FROM t),
w AS (SELECT conv_id, turn, role, said, count(*) OVER b AS n_context, coalesce(string_agg(rendered, '') OVER b, '') AS context FROM r
  WINDOW b AS (PARTITION BY conv_id ORDER BY turn, role, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT conv_id, turn, CAST(n_context AS BIGINT) AS n_context, concat(context, '<|assistant|>', chr(10)) AS prompt, concat(said, '<|end|>', chr(10)) AS target FROM w WHERE role = 'assistant')
SELECT conv_id, turn, n_context, prompt, target, concat(prompt, target) AS text, CAST(length(prompt) AS BIGINT) AS train_start,
  CAST(length(prompt) + length(target) AS BIGINT) AS train_end FROM e
"""
