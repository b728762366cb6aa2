"""Chat formatting by multi-party perspective rotation, DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as
the assistant. The others appear as users with a name, and only the assistant's own turns
are trained on. ``rotate`` gives a row for each turn and perspective with its rendered text,
its place in the rendered dialogue and its mask, so a conversation of any length is never
gathered in one value; places come from two running sums, within and over blocks of turns.
``render`` joins the turns to one text with its trained spans, for conversations that fit.

The speaker ``system`` is no participant: it stays the system message of every perspective.
Turns are in order of ``turn``, then speaker and text; repeated rows are turns of their own.
A null speaker is the participant ``unknown``, a null text is empty, turns without a
conversation id are left out and a null turn number comes first. A conversation that has
only system turns, and an empty table, give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BLOCK = 256


def _segment(role: Column, name: Column, text: Column) -> Column:
    """One rendered message; the name is left out where it is null."""
    return F.concat(F.lit("<|im_start|>"), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"), text, F.lit("<|im_end|>\n"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, perspective, turn, speaker, as_role, as_name, segment, start, size, mask)``.

    ``start`` and ``size`` count characters of the rendered dialogue; ``mask`` is true where
    the segment is trained on.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    people = rows.where("speaker <> 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == "system"
    role = F.when(own, F.lit("assistant")).when(system, F.lit("system")).otherwise(F.lit("user"))
    name = F.when(~own & ~system, F.col("speaker"))
    seen = (
        rows.join(people, "conv_id")
        .select("conv_id", "perspective", "turn", "speaker", role.alias("as_role"), name.alias("as_name"), _segment(role, name, F.col("text")).alias("segment"), own.alias("mask"))
        .withColumn("size", F.char_length("segment").cast("long"))
        .withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    )
    key = ["conv_id", "perspective"]
    over = W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = seen.groupBy(*key, "block").agg(F.sum("size").alias("all")).select(*key, "block", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("before"))
    within = W.partitionBy(*key, "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "segment").rowsBetween(W.unboundedPreceding, -1)
    return (
        seen.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(blocks, [*key, "block"])
        .select(*key, "turn", "speaker", "as_role", "as_name", "segment", (F.col("before") + F.col("inner")).alias("start"), "size", "mask")
    )


def render(rotated: DataFrame) -> DataFrame:
    """``(conv_id, perspective, text, spans, n_turns)``; spans are (start, end) of trained characters."""
    parts = F.array_sort(F.collect_list(F.struct("start", "size", "mask", "segment")))
    return rotated.groupBy("conv_id", "perspective").agg(parts.alias("p")).select(
        "conv_id", "perspective", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("text"),
        F.transform(F.filter("p", lambda x: x["mask"]), lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["size"]).alias("end"))).alias("spans"),
        F.size("p").alias("n_turns"),
    )


#: DuckDB SQL of ``rotate`` over the table ``conversations``.
ROTATE_SQL = """
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (SELECT t.conv_id, p.perspective, t.turn, t.speaker,
             CASE WHEN t.speaker = p.perspective THEN 'assistant' WHEN t.speaker = 'system' THEN 'system' ELSE 'user' END AS as_role,
             CASE WHEN t.speaker <> p.perspective AND t.speaker <> 'system' THEN t.speaker END AS as_name,
             t.speaker = p.perspective AS mask, t.text
      FROM t JOIN p ON t.conv_id = p.conv_id),
r AS (SELECT *, '<|im_start|>' || as_role || coalesce(' name=' || as_name, '') || chr(10) || text || '<|im_end|>' || chr(10) AS segment FROM s)
SELECT conv_id, perspective, turn, speaker, as_role, as_name, segment,
       CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       CAST(length(segment) AS BIGINT) AS size, mask
FROM r
"""
