"""Exact deduplication with a heavy-hitter split. DataFrame functions only.

Texts are equal when identical after lower-casing A-Z; a null text counts as
empty. Only digests and ids ever shuffle. A Misra-Gries pass names frequent
digests, their verified winners are broadcast and settle the copies map-side,
and the remaining digests take an ordinary shuffle (``group_pick``).

Edge cases: the row with the largest doc_id stays; a null doc_id is smaller
than any other; of rows equal in both doc_id and text one stays; an empty
table gives an empty table; extra columns are ignored by ``label`` and kept by
``dedup``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import cut, free_name, group_pick, small_enough

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Texts of single-byte characters take the built-in fast path."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_digest(text: Column) -> Column:
    return F.sha2(ascii_lower(text).cast("binary"), 256)


def label(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("text_sha256")).withColumn("__row", F.monotonically_increasing_id()))
    picked = group_pick(rows, "text_sha256", F.max(F.struct("doc_id", "__row")))
    return picked.select("doc_id", F.col("__pick.doc_id").alias("keep_id"), F.col("__size").alias("group_size"), (F.col("__row") == F.col("__pick.__row")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies, all columns kept; the text is not shuffled while the dropped ids are few enough to broadcast."""
    labels = cut(label(docs))
    gone = labels.where(~F.col("kept"))
    key, drop, twin = (free_name(n, docs) for n in ("key", "drop", "twin"))
    pair = F.struct(F.col("doc_id").alias("a"), F.col("text_sha256").alias("b"))
    # Rows equal in doc_id and text (or with a null doc_id) cannot be told apart by a key: one of each is taken apart from the rest.
    same = cut(gone.where("keep_id is null or keep_id = doc_id").select(pair.alias(twin)).distinct())
    other = gone.where("keep_id is not null and (doc_id is null or keep_id <> doc_id)").select(pair.alias(drop)).distinct()
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("a"), text_digest(F.col("text")).alias("b")))
    left = keyed.join(small_enough(cut(other)), F.col(key).eqNullSafe(F.col(drop)), "left_anti")
    if same.isEmpty():
        return left.drop(key)
    same = small_enough(same)
    twins = left.join(same, F.col(key).eqNullSafe(F.col(twin)), "left_semi").dropDuplicates([key])
    return left.join(same, F.col(key).eqNullSafe(F.col(twin)), "left_anti").unionByName(twins).drop(key)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
