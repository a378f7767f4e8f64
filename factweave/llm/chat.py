"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all
others as users bearing their names; messages of a system role stay system messages and are nobody's perspective.
The mask covers what the assistant of that rendering says, with its end mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Turns in one row of the result; a longer conversation continues in further rows.
PART_TURNS = 256
SYSTEM = ("system",)


def rotate(messages: DataFrame, part_turns: int = PART_TURNS, system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """conv_id, perspective, part, n_messages, text, mask for every participant of every conversation.

    mask lists the spans of the text, "start-end" in characters, end exclusive, joined by commas, on which
    to train. Parts number runs of part_turns turns from 0 and are to be read one after the other, so that no row
    holds an unbounded conversation. Messages are ordered by turn, then role, then text. A null role is the
    speaker `unknown`, a null text is empty, a null turn comes first, in part 0; a null conv_id is a
    conversation of its own. Repeated rows are repeated messages. "<|" in a text or a role is written "< |", and a line break in a role as a
    blank where it names a user, so neither can pose as a mark. Conversations of system messages alone give no row. Other columns are not read.
    """
    own = messages.select(
        F.col("conv_id"), "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).cast("long").alias("part"),
    )
    speakers = own.where(~F.col("role").isin(*system)).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    parts = own.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    # array_sort puts nothing but null elements last; a null turn inside a struct sorts first.
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))
    mine = lambda m: m["role"] == F.col("perspective")
    name = lambda m: F.translate(F.replace(m["role"], F.lit("<|"), F.lit("< |")), "\r\n", "  ")
    head = lambda m: F.when(m["role"].isin(*system), F.lit(f"{START}system\n")).when(mine(m), F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user name="), name(m), F.lit("\n")))
    blocks = seen.withColumn("pieces", F.transform("said", lambda m: F.struct(head(m).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"), (mine(m) & ~m["role"].isin(*system)).alias("mine"))))
    walked = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"]) + 1).alias("at"),
            F.when(p["mine"], F.concat(s["spans"], F.array(F.concat((s["at"] + F.length(p["head"])).cast("string"), F.lit("-"), (s["at"] + F.length(p["head"]) + F.length(p["body"])).cast("string"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return blocks.select(
        "conv_id", "perspective", "part",
        F.size("pieces").cast("long").alias("n_messages"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.array_join(walked["spans"], ",").alias("mask"),
    )


ORACLE_SQL = """
WITH m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
         CAST(coalesce(floor(turn / 256), 0) AS BIGINT) AS part
  FROM conversations
), s AS (
  SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role <> 'system'
), p AS (
  SELECT m.conv_id, s.perspective, m.part, m.turn, m.role, m.text,
         CASE WHEN m.role = 'system' THEN '<|im_start|>system' || chr(10)
              WHEN m.role = s.perspective THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || translate(replace(m.role, '<|', '< |'), chr(13) || chr(10), '  ') || chr(10) END AS head,
         m.text || '<|im_end|>' AS body
  FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id
), w AS (
  SELECT *, row_number() OVER o AS k,
         sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(body) - 1 AS place
  FROM p WINDOW o AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, perspective, part, count(*) AS n_messages, string_agg(head || body || chr(10), '' ORDER BY k) AS text,
       coalesce(string_agg(CAST(CAST(place AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(place AS BIGINT) + length(body) AS VARCHAR), ',' ORDER BY k)
         FILTER (WHERE role = perspective), '') AS mask
FROM w GROUP BY conv_id, perspective, part
"""
