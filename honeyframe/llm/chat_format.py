"""Operator 4: multi-party perspective rotation.

For every participant of a dialogue the whole dialogue is rendered with that speaker as assistant and the others as
named users; system turns are system turns for all. A rendering is one row per turn: its segment of the text, the place
where that segment begins in the rendered dialogue, and the range of the dialogue that is trained on. So no dialogue,
however long, has to fit into one row; ``render`` puts those that do into one row with their text and masks.

Where a segment begins is a running sum in a dialogue. It is taken in two steps, inside stretches of bounded numbers of
turns and over the stretches' totals, so that a dialogue with very many turns is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from honeyframe.llm.common import materialise, shuffle_parts

#: Marks of the format; a text's own ``<|`` is written ``< |``, so that no text can end a turn or begin another.
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
#: What a name may not show: characters that could end a header. Each is written ``_``.
NOT_IN_NAMES = r"[<>|\x00-\x1F\x7F]"


def _segment(speaker: Column, chat_role: Column, text: Column) -> tuple[Column, Column]:
    name = F.when(chat_role == "user", F.concat(F.lit(" name="), F.regexp_replace(speaker, NOT_IN_NAMES, "_"))).otherwise("")
    head = F.concat(F.lit(OPEN), chat_role, name, F.lit(CLOSE + "\n"))
    return head, F.concat(head, text, F.lit(END + "\n"))


def _rows(turns: DataFrame, conv_col: str, turn_col: str, speaker_col: str, text_col: str, system: str) -> DataFrame:
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"), F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(OPEN), F.lit("< |")).alias("text"))
    people = rows.filter(F.col("speaker") != system).select(F.col("conv").alias("of"), F.col("speaker").alias("perspective")).distinct()
    both = rows.join(people, rows.conv.eqNullSafe(people.of)).drop("of")
    role = F.when(F.col("speaker") == system, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    both = both.withColumn("chat_role", role)
    head, segment = _segment(F.col("speaker"), F.col("chat_role"), F.col("text"))
    both = both.withColumn("head", F.length(head).cast("long")).withColumn("segment", segment)
    return both.withColumn("size", F.length("segment").cast("long")).drop("text")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """Per perspective and turn: conversation, perspective, turn, speaker, chat_role, segment, start, mask_start, mask_end.

    The segments of a (conversation, perspective) in the order of ``start`` are the rendered dialogue; start and masks are
    code points of it. The mask is the assistant's text and the mark that ends it; both bounds are 0 for others' turns.
    Turns come by number (null first), then speaker, then segment; rows alike in all of them are rendered each. A null
    speaker is a participant named ``unknown``, a null text is empty, a very long one whole. Names show ``_`` for what
    could end a header. A conversation of system turns only has no participant and so no rows. Null conversation ids are
    one conversation. Only the four named columns are read, so others can't clash. An empty table gives no rows.
    """
    n = shuffle_parts(turns.sparkSession)
    # Bounds of ranges are sampled to the driver, so a segment takes part with its beginning; within a range all of it decides.
    order = ["conv", "perspective", "turn", "speaker", F.substring("segment", 1, 256)]
    both = _rows(turns, conv_col, turn_col, speaker_col, text_col, system)
    # Ranges of all rows in order; a written table, so that a row's stretch stays what it was.
    dealt = both.repartitionByRange(n, *order).withColumn("stretch", F.spark_partition_id())
    dealt = materialise(dealt, "turns")
    here = Window.partitionBy("stretch", "conv", "perspective")
    totals = dealt.groupBy("conv", "perspective", "stretch").agg(F.sum("size").alias("total"))  # at most a row for each dialogue and stretch
    before = Window.partitionBy("conv", "perspective").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("stretch").alias("s"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("size").over(here.orderBy("turn", "speaker", "segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("inside", inside)
    placed = placed.join(totals, placed.conv.eqNullSafe(totals.c) & (placed.perspective == totals.p) & (placed.stretch == totals.s))
    start, mine = F.col("base") + F.col("inside"), F.col("chat_role") == "assistant"
    mask_start = F.when(mine, start + F.col("head")).otherwise(0).cast("long")
    mask_end = F.when(mine, start + F.col("size") - 1).otherwise(0).cast("long")
    return placed.select(F.col("conv").alias(conv_col), "perspective", F.col("turn").alias(turn_col), "speaker", "chat_role", "segment", start.alias("start"), mask_start.alias("mask_start"), mask_end.alias("mask_end"))


def render(rotated: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per (conversation, perspective) with the whole text and its masks in order, for dialogues that are known to fit into a row."""
    parts = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end")))
    masks = F.transform(F.filter("parts", lambda x: x["mask_end"] > 0), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    whole = rotated.groupBy(conv_col, "perspective").agg(parts.alias("parts"))
    return whole.select(conv_col, "perspective", F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("text"), masks.alias("masks"))


ORACLE = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '{OPEN}', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
b AS (
  SELECT r.*, p.perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id
), h AS (SELECT *, '{OPEN}' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || regexp_replace(speaker, '{NOT_IN_NAMES}', '_', 'g') ELSE '' END || '{CLOSE}' || chr(10) AS head FROM b
), s AS (SELECT *, head || text || '{END}' || chr(10) AS segment FROM h
), o AS (
  SELECT *, coalesce(sum(length(segment)) OVER (
    PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s
)
SELECT conv_id, perspective, turn, speaker, chat_role, segment, CAST(start AS BIGINT) AS start,
  CAST(CASE WHEN chat_role = 'assistant' THEN start + length(head) ELSE 0 END AS BIGINT) AS mask_start,
  CAST(CASE WHEN chat_role = 'assistant' THEN start + length(segment) - 1 ELSE 0 END AS BIGINT) AS mask_end
FROM o
"""
