"""Preference formatting: the common turns of a chosen and a rejected conversation become one prompt, the rest two
masked completions. Columns only.

Everything is kept by turn: a conversation of any length is spread over all tasks, as comparisons are grouped by
(pair, turn) and offsets are summed by blocks of turns first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veneer.llm.common import cut_lineage, table

BLOCK_TURNS = 256
TRAINED_ROLE = "assistant"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def preference_turns(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """pair_id, part ('prompt', 'chosen', 'rejected'), turn, role, rendered, starts_at, train_from, train_to.

    `turns` has pair_id, chosen (boolean), turn, role, text. `starts_at` is the turn's character offset in its part;
    [train_from, train_to) are the offsets of what a model is trained on: text and end mark of the trained role in
    completions, null elsewhere. The prompt ends before the first turn that differs or exists on one side only. It is
    taken from the chosen side. Equal conversations are all prompt. A pair with one side has no common turn.
    Rows without pair, side or turn are no part of a conversation and are left out. Null texts are empty, null roles
    "user"; of several rows for one turn the least (role, text) counts, so rows given twice count once. Other columns
    are ignored; no rows give no rows.
    """
    clean = turns.filter("pair_id IS NOT NULL AND chosen IS NOT NULL AND turn IS NOT NULL").groupBy("pair_id", "chosen", "turn").agg(
        F.min(F.struct(F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("said"))
    clean = cut_lineage(clean.select("pair_id", "chosen", "turn", "said.role", "said.text"))
    marks = clean.select("pair_id", "turn", F.sha2(F.concat_ws("\x00", "role", "text").cast("binary"), 256).alias("mark"))
    compared = marks.groupBy("pair_id", "turn").agg(F.count(F.lit(1)).alias("sides"), F.min("mark").alias("a"), F.max("mark").alias("b"))
    ends = compared.filter((F.col("sides") < 2) | (F.col("a") != F.col("b"))).groupBy("pair_id").agg(F.min("turn").alias("end"))
    joined = clean.join(ends, "pair_id", "left")
    common = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    part = F.when(common, "prompt").when(F.col("chosen"), "chosen").otherwise("rejected")
    parts = (joined.filter(~common | F.col("chosen"))
             .select("pair_id", part.alias("part"), "turn", "role", "text", render(F.col("role"), F.col("text")).alias("rendered")))
    sized = parts.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS)).withColumn("chars", F.length("rendered").cast("long"))
    blocks = sized.groupBy("pair_id", "part", "block").agg(F.sum("chars").alias("block_chars"))
    blocks = blocks.select("pair_id", "part", "block", (F.sum("block_chars").over(
        Window.partitionBy("pair_id", "part").orderBy("block")) - F.col("block_chars")).alias("before"))
    inside = F.sum("chars").over(Window.partitionBy("pair_id", "part", "block").orderBy("turn")) - F.col("chars")
    placed = sized.join(blocks, ["pair_id", "part", "block"]).withColumn("starts_at", F.col("before") + inside)
    trained = (F.col("part") != "prompt") & (F.col("role") == trained_role)
    return placed.select(
        "pair_id", "part", "turn", "role", "rendered", "starts_at",
        F.when(trained, F.col("starts_at") + F.length("role") + 5).alias("train_from"),
        F.when(trained, F.col("starts_at") + F.col("chars")).alias("train_to"))


def preference_examples(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per pair: prompt, chosen, rejected and the trained spans of both, for conversations that fit a row."""
    rows = preference_turns(turns, trained_role)
    of = lambda p: F.filter(F.array_sort(F.collect_list(F.struct("part", "turn", "rendered", "train_from", "train_to"))), lambda x: x["part"] == p)
    text = lambda p: F.array_join(F.transform(of(p), lambda x: x["rendered"]), "").alias(p)
    spans = lambda p: F.transform(F.filter(of(p), lambda x: x["train_from"].isNotNull()),
                                  lambda x: F.struct(x["train_from"].alias("start"), x["train_to"].alias("end"))).alias(f"{p}_mask")
    return rows.groupBy("pair_id").agg(text("prompt"), text("chosen"), text("rejected"), spans("chosen"), spans("rejected"))


def alternative_replies(conversations: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """pair_id, chosen, turn, role, text: conversations up to their last reply, and the same with another's reply.

    The pair of a conversation has its id. The rejected reply is the last reply of the conversation whose id is greater
    by one; without such a conversation, or without a reply, there is no pair. `conversations` has conv_id, turn, role,
    text. Null ids and turns are left out, null texts are empty; of several replies at the last turn the least counts.
    """
    turns = conversations.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    replies = turns.filter(F.col("role") == trained_role).groupBy("conv_id").agg(F.min(F.struct((-F.col("turn")).alias("back"), "text")).alias("reply"))
    own = replies.select("conv_id", (-F.col("reply.back")).alias("end"), F.col("reply.text").alias("own"))
    pairs = own.join(replies.select((F.col("conv_id") - 1).alias("conv_id"), F.col("reply.text").alias("other")), "conv_id")
    before = turns.join(pairs.select("conv_id", "end"), "conv_id").filter("turn < end").select(
        F.col("conv_id").alias("pair_id"), F.explode(F.array(F.lit(True), F.lit(False))).alias("chosen"), "turn", "role", "text")
    last = pairs.select("conv_id", "end", F.explode(F.array(F.struct(F.lit(True).alias("chosen"), F.col("own").alias("text")),
                                                          F.struct(F.lit(False).alias("chosen"), F.col("other").alias("text")))).alias("side"))
    return before.unionByName(last.select(F.col("conv_id").alias("pair_id"), "side.chosen", F.col("end").alias("turn"), F.lit(trained_role).alias("role"), "side.text"))


def query(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation against itself with the next one's last reply: their shared turns are the prompts."""
    return preference_turns(alternative_replies(table(spark, sf, "conversations")))


QUERIES = {"op5_preference_format": query}

SQL = """
WITH v AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
     a AS (SELECT conv_id, turn AS stop, min(text) AS reply FROM v WHERE role = 'assistant' GROUP BY conv_id, turn QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
     q AS (SELECT a.conv_id, a.stop, a.reply AS own, b.reply AS other FROM a JOIN a b ON b.conv_id = a.conv_id + 1),
     c AS (SELECT v.conv_id AS pair_id, s.chosen, turn, coalesce(role, 'user') AS role, text FROM v JOIN q ON v.conv_id = q.conv_id AND turn < q.stop, (VALUES (true), (false)) s(chosen)
           UNION ALL SELECT conv_id, true, stop, 'assistant', own FROM q UNION ALL SELECT conv_id, false, stop, 'assistant', other FROM q),
     t AS (SELECT pair_id, chosen, turn, role, text FROM c QUALIFY row_number() OVER (PARTITION BY pair_id, chosen, turn ORDER BY role, text) = 1),
     d AS (SELECT pair_id, turn FROM t GROUP BY ALL HAVING count(*) < 2 OR min(role || chr(1) || text) <> max(role || chr(1) || text)),
     e AS (SELECT pair_id, min(turn) AS stop FROM d GROUP BY pair_id),
     p AS (SELECT t.pair_id, CASE WHEN stop IS NULL OR turn < stop THEN 'prompt' WHEN chosen THEN 'chosen' ELSE 'rejected' END AS part, turn, role,
                  '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, chosen
           FROM t LEFT JOIN e USING (pair_id)),
     o AS (SELECT pair_id, part, turn, role, rendered, CAST(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn) - length(rendered) AS BIGINT) AS starts_at
           FROM p WHERE part <> 'prompt' OR chosen)
SELECT *, CASE WHEN part <> 'prompt' AND role = 'assistant' THEN starts_at + length(role) + 5 END AS train_from,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN starts_at + length(rendered) END AS train_to FROM o
"""
ORACLES = {"op5_preference_format": SQL}
