"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation (every role but ``system``) the dialogue is rendered with that participant as the
assistant and the others as users with their names, and a mask names the character ranges to learn from: the assistant's
turns with their end mark.

A conversation is rendered in parts of ``PART`` turn numbers, so a long one is never in one task or one text; the parts of a
perspective in order are the whole rendering. A part with more than ``ROWS`` rows (repeated turn numbers) is split further
into subparts of ``ROWS`` rows in the order of its turns; the subparts in order are the part.

Nulls and odd input: turns sort by number (nulls first, in a part of their own), role and text; a null text is empty; a null
role is a user named ``unknown`` without a perspective; rows with a null conv_id are one conversation; repeated turns are
rendered each. A conversation of system turns only has no perspective and no row; an empty table gives no rows. Marks inside
texts and names are broken up, so they can not pose as turns. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraygraph.llm.tables import query, read
from fraygraph.operators.ranking import number_within
from fraygraph.session import hint_small

PART = 64
ROWS = 256
END = "<|end|>\n"


def plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def name_of(role: Column) -> Column:
    return F.regexp_replace(F.coalesce(role, F.lit("unknown")), "[|<>\\s]", "_")


def render(turns: Column, speaker: Column) -> tuple[Column, Column]:
    """The text and the mask (array of start, end in characters) of ordered ``turns`` (role, text) for one perspective."""

    def head(role: Column) -> Column:
        user = F.concat(F.lit("<|user name="), name_of(role), F.lit("|>\n"))
        return F.when(role.eqNullSafe(F.lit("system")), "<|system|>\n").when(role.eqNullSafe(speaker), "<|assistant|>\n").otherwise(user)

    segments = F.transform(turns, lambda t: F.struct(head(t["role"]).alias("head"), F.concat(plain(t["text"]), F.lit(END)).alias("body"), t["role"].eqNullSafe(speaker).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(state: Column, s: Column) -> Column:
        begin = state["at"] + F.length(s["head"])
        end = begin + F.length(s["body"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["own"], F.concat(state["mask"], one)).otherwise(state["mask"]).alias("mask"))

    text = F.array_join(F.transform(segments, lambda s: F.concat(s["head"], s["body"])), "")
    return text, F.aggregate(segments, start, step)["mask"]


def rotate(conversations: DataFrame) -> DataFrame:
    """(conv_id, speaker, part, subpart, n_turns, text, mask) for every participant and part of every conversation."""
    part = F.floor(F.col("turn") / PART)
    rows = conversations.select("conv_id", "turn", "role", "text", part.alias("part"))
    crowded = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ROWS)
    crowded = hint_small(crowded.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part")))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("part").eqNullSafe(F.col("_part"))
    numbered = number_within(rows.join(crowded, same, "left_semi"), ["conv_id", "part"], ["turn", "role", "text"], "_n")
    numbered = numbered.withColumn("subpart", F.floor((F.col("_n") - 1) / ROWS).cast("int")).drop("_n")
    rows = rows.join(crowded, same, "left_anti").withColumn("subpart", F.lit(0)).unionByName(numbered)
    turn = F.struct("turn", "role", "text")
    parts = rows.groupBy("conv_id", "part", "subpart").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    several = conversations.groupBy("conv_id").agg(F.min(part).alias("a"), F.max(part).alias("b"), F.count(F.lit(1)).alias("n"), F.count("turn").alias("m"))
    several = hint_small(several.filter("a != b OR n != m OR n > %d" % ROWS).select(F.col("conv_id").alias("_conv")))
    in_several = conversations.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")))
    speakers = hint_small(in_several.filter("role != 'system'").select("_conv", F.col("role").alias("_speaker")).distinct())
    known = F.col("conv_id").eqNullSafe(F.col("_conv"))
    is_several = parts.join(several.withColumn("_several", F.lit(True)), known, "left")
    own = F.array_sort(F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r.isNotNull() & (r != "system"))))
    alone = is_several.filter("_several IS NULL").select("conv_id", "part", "subpart", "turns", F.explode(own).alias("speaker"))
    columns = ["conv_id", "part", "subpart", "turns"]
    shared = is_several.filter("_several").select(*columns).join(speakers, known).select(*columns, F.col("_speaker").alias("speaker"))
    text, mask = render(F.col("turns"), F.col("speaker"))
    return alone.unionByName(shared).select("conv_id", "speaker", "part", "subpart", F.size("turns").alias("n_turns"), text.alias("text"), mask.alias("mask"))


def whole_parts(rotated: DataFrame) -> DataFrame:
    """The rows of ``rotate`` with the subparts of a part put together in order: (conv_id, speaker, part, n_turns, text, mask)."""
    piece = F.struct("subpart", "n_turns", "text", "mask")
    found = rotated.groupBy("conv_id", "speaker", "part").agg(F.sum("n_turns").cast("int").alias("n_turns"), F.sort_array(F.collect_list(piece)).alias("_pieces"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(state: Column, p: Column) -> Column:
        moved = F.transform(p["mask"], lambda m: F.struct((m["start"] + state["at"]).alias("start"), (m["end"] + state["at"]).alias("end")))
        return F.struct((state["at"] + F.length(p["text"])).alias("at"), F.concat(state["mask"], moved).alias("mask"))

    text = F.array_join(F.transform("_pieces", lambda p: p["text"]), "")
    return found.select("conv_id", "speaker", "part", "n_turns", text.alias("text"), F.aggregate("_pieces", start, step)["mask"].alias("mask"))


@query("op6_perspective_rotation", r"""
WITH t AS (SELECT conv_id, turn // 64 AS part, role, text, row_number() OVER (PARTITION BY conv_id, turn // 64 ORDER BY turn, role, text) AS k FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
x AS (SELECT t.conv_id, speaker, part, k, coalesce(role = speaker, false) AS own, coalesce(replace(text, '<|', '< |'), '') || '<|end|>' || chr(10) AS body,
      CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>'
           ELSE '<|user name=' || regexp_replace(coalesce(role, 'unknown'), '[|<>\s]', '_', 'g') || '|>' END || chr(10) AS head FROM t JOIN s USING (conv_id)),
y AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY k) AS stop FROM x)
SELECT conv_id, speaker, part::BIGINT AS part, count(*)::INT AS n_turns, string_agg(head || body, '' ORDER BY k) AS text,
       coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY k) FILTER (own), '') AS mask
FROM y GROUP BY conv_id, speaker, part""")
def _(spark, sf):
    found = whole_parts(rotate(read(spark, sf, "conversations")))
    ranges = F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string")))
    return found.select("conv_id", "speaker", "part", "n_turns", "text", F.array_join(ranges, ",").alias("mask"))
