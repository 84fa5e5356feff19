"""Benchmark decontamination by size-partitioned MinHash containment search. DataFrame functions only.

Items and documents become sets of five-word shingles (words: runs of letters
and numbers in lower case). A document contaminates if it holds at least
``threshold`` of an item's distinct shingles, wherever they stand in it.

Search. Items are partitioned by shingle count into powers of two. An item of
q shingles keeps its k = floor((1 - threshold) q) + 1 smallest shingle hashes
(a bottom-k MinHash). A document that holds the threshold share lacks at most
k - 1 of the item's shingles, so it holds one of the k: the search loses
nothing, however long the document, where signatures of whole documents would.
Each size partition has a largest sketch hash; a document long enough for the
partition posts only shingles of smaller hash, and joins them to the sketches.

Verification. Only candidates are read again; exact shingles are compared as
text, and distinct shared shingles counted per document and item.

Edge cases: an item of one to four words is one shingle of its own length, and
documents post shingles of such lengths only if an item has one; items without
words match nothing; a null text is empty; repeated rows of one doc_id count
as one document; rows with a null doc_id are searched and reported under null, and
``decontaminate`` drops those that hold an item;
equal items are each reported; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import BROADCAST_IDS, cut, drop_ids, free_name, only_ids, small_enough

WORD = "[\\p{L}\\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingles(w: Column, n: int, make) -> Column:
    """make(slice) for each run of n words of the array column ``w``."""
    steps = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: make(F.slice(w, i, n)))


def _at_most(top: Column):
    return lambda h: h <= top


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs that share at least ``threshold`` of the item: doc_id, item_id, n_shingles, n_shared, containment."""
    hashed = lambda s: F.xxhash64(s)
    joined = lambda s: F.concat_ws(" ", s)
    lone = F.when(F.size("w") >= n, F.lit(n)).otherwise(F.size("w"))
    item = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).select("item_id", "w", lone.alias("len"))
    item = cut(
        item.select("item_id", "len", F.explode(F.array_distinct(F.when(F.col("len") < n, F.array(joined(F.col("w")))).otherwise(_shingles(F.col("w"), n, joined)))).alias("shingle"))
        .select("*", F.xxhash64(F.split("shingle", " ")).alias("h"))
    )
    by_item = item.groupBy("item_id", "len").agg(F.count(F.lit(1)).alias("q"), F.sort_array(F.collect_set("h")).alias("hs"))
    sketch = by_item.select(
        "item_id", "len", "q", F.when(F.col("len") < n, F.lit(-1)).otherwise(F.floor(F.log2("q"))).alias("part"),
        F.explode(F.slice("hs", 1, (F.floor(F.col("q") * F.lit(1 - threshold) + 1e-9) + 1).cast("int"))).alias("h"),
    )
    sketch = cut(sketch)
    bounds = sketch.groupBy("len", "part").agg(F.min("q").alias("q"), F.max("h").alias("top")).collect()  # as many as there are powers of two
    if not bounds:
        return docs.select("doc_id").join(items.select("item_id"), F.lit(False)).select("doc_id", "item_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment"))
    w = docs.select("doc_id", words(F.col("text")).alias("w"))
    posts = []
    for length in sorted({b["len"] for b in bounds}):
        top = F.lit(None).cast("long")
        for b in sorted((b for b in bounds if b["len"] == length), key=lambda b: b["top"]):  # the largest bound that the size admits wins
            least = int(-(-b["q"] * threshold // 1)) if length == n else 1
            top = F.when(F.size("w") >= least, F.lit(b["top"])).otherwise(top)
        posts.append(F.filter(_shingles(F.col("w"), length, hashed), _at_most(top)))
    posted = w.select("doc_id", F.explode(posts[0] if len(posts) == 1 else F.concat(*posts)).alias("h"))
    # One row for each hash at most: a passage that many documents share cannot multiply the rows of another.
    found = posted.join(small_enough(sketch.groupBy("h").agg(F.collect_set("item_id").alias("ids"))), "h").select("doc_id", F.explode("ids").alias("item_id"))
    found = cut(found.distinct())
    sizes = by_item.select("item_id", "q")
    held = only_ids(docs.select("doc_id", "text"), found)
    if not docs.where("doc_id is null").isEmpty():
        held = held.unionByName(docs.select("doc_id", "text").where("doc_id is null"))
    held = held.select("doc_id", words(F.col("text")).alias("w"))
    made = [_shingles(F.col("w"), length, joined) for length in sorted({b["len"] for b in bounds})]
    held = held.select("doc_id", F.explode(F.array_distinct(made[0] if len(made) == 1 else F.concat(*made))).alias("shingle"))
    few = item.count() <= BROADCAST_IDS
    known = item.select("item_id", "shingle")
    shared = held.join(F.broadcast(known) if few else known, "shingle").groupBy("doc_id", "item_id").agg(F.countDistinct("shingle").alias("n_shared"))
    # Every pair that reaches the threshold is among the candidates; the join keeps the two stages tied.
    pairs = found.select(F.col("doc_id").alias("__d"), F.col("item_id").alias("__i"))
    shared = shared.join(pairs, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("item_id") == F.col("__i")), "left_semi")
    out = shared.join(F.broadcast(sizes) if few else sizes, "item_id")
    return out.where(F.col("n_shared") >= F.lit(threshold) * F.col("q") - 1e-9).select("doc_id", "item_id", F.col("q").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("q")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns kept. Rows without an id are judged by their texts."""
    known = docs.where("doc_id is not null")
    out = drop_ids(known, contaminated(known, items, n, threshold))
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return out
    key = free_name("text_digest", docs)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    bad = contaminated(nameless.select(digest.alias("doc_id"), "text").dropDuplicates(["doc_id"]), items, n, threshold)
    bad = small_enough(cut(bad.select(F.col("doc_id").alias(key)).distinct()))
    return out.unionByName(nameless.join(bad, digest == F.col(key), "left_anti"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, len(w) < 5 AS short, least(len(w), 5) AS n, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bs),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
q AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM c JOIN q USING (item_id) WHERE n_shared >= 0.8 * n_shingles
"""
