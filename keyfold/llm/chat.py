"""Multi-party perspective rotation of dialogues. DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with
that speaker as the assistant and all others as named users. A rendering is a
sequence of messages; each row is one message with its place in the rendered
text and its loss mask (only the assistant's words and end marker are learned
from). A conversation of any length is thus never gathered in one task: turns
meet their speakers by conversation and block, and places are prefix sums over
blocks of turns, then within a block. A block is ``BLOCK`` turn numbers, so only
rows of one conversation that have the same turn, or none, stay together.

Edge cases: a null text is empty and still a message; a null role is the
participant "unknown"; system turns are shown in every rendering as system
messages, are never learned from and take no perspective, and a conversation
of system turns only has no rendering; turns are ordered by turn (null first),
then role, then text, so repeated and tied rows have a fixed order up to equal
rows; a null conv_id is a conversation of its own; markers that stand in a text or
a role are left as they are, and do not move masks, which are places; extra columns
do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one block of a conversation.
BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, perspective, position, turn, message, start, end, mask_start, mask_end for each message of each rendering.

    start and end are characters of the rendering; mask_start is null where
    nothing of the message is learned.
    """
    t = turns.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    speakers = t.where("role <> 'system'").select(F.col("conv_id").alias("__c"), F.col("role").alias("perspective")).distinct()
    blocks = t.select(F.col("conv_id").alias("__d"), F.col("block").alias("__k")).distinct()
    shown = blocks.join(speakers, F.col("__d").eqNullSafe(F.col("__c"))).drop("__c")
    m = t.join(shown, F.col("conv_id").eqNullSafe(F.col("__d")) & (F.col("block") == F.col("__k"))).drop("__d", "__k")
    own = F.col("role") == F.col("perspective")
    head = F.when(own, F.lit(f"{OPEN}assistant\n")).when(F.col("role") == "system", F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), "role", F.lit("\n")))
    m = m.select("conv_id", "perspective", "turn", "role", "text", "block", F.concat(head, "text", F.lit(CLOSE)).alias("message"), F.length(head).alias("__head"), own.alias("__own")).withColumn("__n", F.length("message").cast("long"))
    sums = m.groupBy("conv_id", "perspective", "block").agg(F.sum("__n").alias("__chars"), F.count(F.lit(1)).alias("__rows"))
    past = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("__c"), F.col("perspective").alias("__p"), F.col("block").alias("__b"), F.coalesce(F.sum("__chars").over(past), F.lit(0)).alias("__from"), F.coalesce(F.sum("__rows").over(past), F.lit(0)).alias("__before"))
    here = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    m = m.withColumn("__at", F.row_number().over(here) - 1).withColumn("__till", F.sum("__n").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.join(sums, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("perspective") == F.col("__p")) & (F.col("block") == F.col("__b")))
    start = F.col("__from") + F.col("__till") - F.col("__n")
    end = F.col("__from") + F.col("__till")
    return m.select("conv_id", "perspective", (F.col("__before") + F.col("__at")).alias("position"), "turn", "message", start.alias("start"), end.alias("end"), F.when(F.col("__own"), start + F.col("__head")).alias("mask_start"), F.when(F.col("__own"), end).alias("mask_end"))


ORACLE_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
m AS (SELECT t.conv_id, perspective, turn, role, text,
      CASE WHEN role = perspective THEN '<|im_start|>assistant' || chr(10) WHEN role = 'system' THEN '<|im_start|>system' || chr(10) ELSE '<|im_start|>user name=' || role || chr(10) END AS head
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
n AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS message FROM m),
p AS (SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(message)) OVER w AS BIGINT) AS e FROM n
      WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, turn, message, e - length(message) AS start, e AS "end",
       CASE WHEN role = perspective THEN e - length(message) + length(head) END AS mask_start, CASE WHEN role = perspective THEN e END AS mask_end FROM p
"""
