"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker
as the assistant and every other one as a named user; the loss mask covers what the
participant says and nothing else. System turns are context for all and no participant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joulewright.llm.common import read

START, END = "<|im_start|>", "<|im_end|>"


def clean(c: Column) -> Column:
    """Text that cannot open or close a turn itself."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def length(c: Column) -> Column:
    return F.length(c).cast("long")


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: str = "system", turns_per_part: int | None = None) -> DataFrame:
    """One row per conversation and participant: the whole dialogue from that speaker's side.

    Columns: conv_id, participant, part (0), n_turns, n_own (turns of the participant),
    rendered, masks (start:end of what carries loss, in characters of rendered,
    comma-joined: each own text with its end mark), n_loss_chars, text_sha256 (of rendered).

    Turns are ordered by turn, then speaker, then text; repeated rows are repeated turns.
    A null speaker is 'unknown', a null text empty, a null turn comes first. Rows of a null
    conversation id are one conversation. A conversation of system turns only has no
    participant and gives no row; an empty table gives none. Texts may be of any length;
    other columns are not read.

    A rendered dialogue is one value, so a conversation must fit in a task, at any number of
    turns; places are running sums, and the work is linear in the turns. Dialogues too long
    for that can be asked for in parts of `turns_per_part` turn numbers (part: turn div
    turns_per_part; null turns in part 0): each part begins with the system turns of the
    parts before it, and a participant who says nothing in a part has it with empty masks.

    Shuffle: one by (conversation, part) for the turns, and a small one of distinct speakers.
    """
    t = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"),
        clean(F.col(text)).alias("text"),
    )
    t = t.withColumn("part", F.coalesce(F.floor(F.col("turn") / turns_per_part), F.lit(0)).cast("long") if turns_per_part else F.lit(0).cast("long"))
    spoken = F.col("speaker") != system
    cast = t.where(spoken).select("conv_id", F.col("speaker").alias("participant")).distinct()
    if turns_per_part:
        parts = t.select("conv_id", "part").distinct()
        said = t.where(~spoken).withColumnRenamed("part", "first").alias("s")
        later = said.join(parts.alias("p"), F.col("s.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("p.part") > F.col("s.first")))
        t = t.unionByName(later.select("s.conv_id", "turn", "speaker", "text", "part"))
    # where a text begins if nobody is the assistant, and how often its speaker has spoken before it
    named = F.concat(F.lit("user name="), clean(F.col("speaker")))
    head = F.concat(F.lit(START), F.when(spoken, named).otherwise("system"), F.lit("\n"))
    w = Window.partitionBy("conv_id", "part").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    line = length(F.col("head")) + length(F.col("text")) + len(END) + 1
    placed = t.withColumn("head", head).withColumn("at", F.coalesce(F.sum(line).over(w), F.lit(0)) + length(F.col("head")))
    dialogue = placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", "speaker", "head", "text"))).alias("turns"))
    both = dialogue.alias("d").join(cast.alias("c"), F.col("d.conv_id").eqNullSafe(F.col("c.conv_id")))
    me = F.col("participant")
    own = F.filter("turns", lambda x: x["speaker"] == me)
    mine = F.lit(START + "assistant\n")
    # each own turn so far has the assistant's head instead of the named one
    shift = length(mine) - length(F.concat(F.lit(START + "user name="), clean(me), F.lit("\n")))

    def span(x: Column, i: Column) -> Column:
        begin = x["at"] + (i + 1) * F.col("shift")
        return F.concat_ws(":", begin.cast("string"), (begin + length(x["text"]) + len(END)).cast("string"))

    shown = F.transform("turns", lambda x: F.concat(F.when(x["speaker"] == me, mine).otherwise(x["head"]), x["text"], F.lit(END + "\n")))
    return (
        both.withColumn("own", own)
        .withColumn("shift", shift)
        .select(
            "d.conv_id",
            "participant",
            "part",
            F.size("turns").cast("long").alias("n_turns"),
            F.size("own").cast("long").alias("n_own"),
            F.array_join(shown, "").alias("rendered"),
            F.array_join(F.transform("own", span), ",").alias("masks"),
            F.aggregate("own", F.lit(0).cast("long"), lambda n, x: n + length(x["text"]) + len(END)).alias("n_loss_chars"),
        )
        .withColumn("text_sha256", F.sha2(F.col("rendered").cast("binary"), 256))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(read(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|im_', '<| im_') AS text, 0 AS part
  FROM conversations),
c AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'),
b AS (
  SELECT t.conv_id, participant, part, turn, speaker, text, speaker = participant AS own,
         '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant'
           ELSE 'user name=' || replace(speaker, '<|im_', '<| im_') END || chr(10) AS head
  FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 11) OVER (
      PARTITION BY conv_id, participant, part ORDER BY turn NULLS FIRST, speaker, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS s
  FROM b),
r AS (
  SELECT conv_id, participant, part, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
    string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY s) AS rendered,
    coalesce(string_agg(s || ':' || (s + length(text) + 10), ',' ORDER BY s) FILTER (own), '') AS masks,
    coalesce(sum(length(text) + 10) FILTER (own), 0)::BIGINT AS n_loss_chars
  FROM o GROUP BY ALL)
SELECT *, sha256(rendered) AS text_sha256 FROM r
"""
