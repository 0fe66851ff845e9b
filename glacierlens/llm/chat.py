"""Perspective rotation: a dialogue rendered once for each participant.

In a participant's rendering that speaker is the assistant, the other speakers
are users with their names, and the mask covers what the assistant says.  The
result has a row for each turn of each rendering, with the characters it takes in
the rendering's text, so a dialogue of any length is never gathered; ``assemble``
joins the rows of dialogues that fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glacierlens.llm.tables import written

# fixed values: the chat mark-up
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
UNNAMED = "unknown"
# turns are summed in blocks of so many turn numbers
BLOCK_TURNS = 256
FIRST = -(1 << 63)


def _header(speaker: Column, perspective: Column) -> Column:
    role = F.when(speaker == SYSTEM, F.lit(SYSTEM)).when(speaker == perspective, "assistant").otherwise(F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(BEGIN), role, F.lit("\n"))


def rotate(turns: DataFrame) -> DataFrame:
    """Segments of all renderings from ``conv_id, turn, role, text``.

    ``conv_id, perspective, turn, role, segment, start, end, mask_start, mask_end``:
    code points within the rendering, ends exclusive; masks are null for turns of
    others.  Turns follow their numbers, nulls first, then role and text; repeated
    rows are repeated turns.  System turns are instructions and make no
    participant.  A null role is the speaker "unknown", a null text is empty, and
    turns without a conversation id form a conversation.  A conversation with
    system turns only has no rendering.
    """
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit(UNNAMED)).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    people = said.where(F.col("speaker") != SYSTEM).groupBy("conv_id", "speaker").agg(F.count("*").alias("turns"))
    people = written(people.select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")), "people")
    rows = said.join(people, F.col("conv_id").eqNullSafe(F.col("conv")))
    header = _header(F.col("speaker"), F.col("perspective"))
    own = F.col("speaker") == F.col("perspective")
    rows = rows.select(
        "conv_id", "perspective", "turn", "speaker", "text",
        F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user").alias("role"),
        F.concat(header, "text", F.lit(END)).alias("segment"), F.length(header).alias("n_header"),
        F.floor(F.coalesce(F.col("turn"), F.lit(FIRST)) / BLOCK_TURNS).alias("block"),
    ).withColumn("n", F.length("segment").cast("long"))
    # characters before a turn: those of earlier blocks, and those before it in its block
    sums = rows.groupBy("conv_id", "perspective", "block").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("conv_id").alias("conv"), F.col("perspective").alias("who"), F.col("block").alias("at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    before = written(before, "before")
    order = ["conv_id", "perspective", "block"]
    inside = Window.partitionBy(*order).orderBy(F.asc_nulls_first("turn"), "speaker", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("so_far", F.sum("n").over(inside))
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("perspective") == F.col("who")) & (F.col("block") == F.col("at"))
    end = F.col("before") + F.col("so_far")
    placed = placed.join(before, same).select("*", end.alias("end"), (end - F.col("n")).alias("start"))
    speaks = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "role", "segment", "start", "end",
        F.when(speaks, F.col("start") + F.col("n_header")).alias("mask_start"), F.when(speaks, F.col("end") - 1).alias("mask_end"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """One row for each rendering, ``text`` and ``masks``, for dialogues that fit one row."""
    parts = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end")))
    masks = F.transform(F.filter("parts", lambda p: p["mask_start"].isNotNull()), lambda p: F.struct(p["mask_start"].alias("start"), p["mask_end"].alias("end")))
    text = F.array_join(F.transform("parts", lambda p: p["segment"]), "")
    return segments.groupBy("conv_id", "perspective").agg(parts.alias("parts")).select("conv_id", "perspective", text.alias("text"), masks.alias("masks"))


#: DuckDB SQL for ``rotate`` on the table ``conversations``.
SQL = f"""
with said as (select conv_id, turn, coalesce(role, '{UNNAMED}') as speaker, coalesce(text, '') as text from conversations),
people as (select distinct conv_id, speaker as perspective from said where speaker <> '{SYSTEM}'),
rows as (
  select s.conv_id, p.perspective, s.turn, s.speaker, s.text,
    case when s.speaker = '{SYSTEM}' then '{SYSTEM}' when s.speaker = p.perspective then 'assistant' else 'user' end as role,
    '{BEGIN}' || case when s.speaker = '{SYSTEM}' then '{SYSTEM}' when s.speaker = p.perspective then 'assistant' else 'user name=' || s.speaker end || chr(10) as header
  from said s join people p on s.conv_id is not distinct from p.conv_id),
marked as (select *, header || text || '<|im_end|>' || chr(10) as segment from rows),
placed as (
  select *, sum(length(segment)) over (partition by conv_id, perspective order by turn nulls first, speaker, text
    rows between unbounded preceding and current row) as stop from marked)
select conv_id, perspective, turn, role, segment, cast(stop - length(segment) as bigint) as "start", cast(stop as bigint) as "end",
  cast(case when role = 'assistant' then stop - length(segment) + length(header) end as bigint) as mask_start,
  cast(case when role = 'assistant' then stop - 1 end as bigint) as mask_end
from placed
"""
