"""Fill-in-middle transformation by a two-pass streaming matcher.

A text is cut between units (code points, words, lines, or any pattern): the
prefix ends after the smaller of two ranks, the middle after the larger. The
first pass counts the units; the second advances a lazy match iterator to the
smaller rank and on to the larger one, and stops there. No unit, span or list
of either is ever kept, so a text of any length costs its own memory and a
match. Ranks come from a hash of the row's id, so a row that is worked out
again is cut at the same places.

The forms are psm (prefix, suffix, middle), spm (suffix, prefix, middle) and
plain. A text that holds a sentinel stays plain, so the pieces of the others
can always be told apart again (``restored``).

Edge cases: a null text is empty, and an empty one plain; a null doc_id hashes
as the empty string; rows of equal doc_id are cut by their own lengths at the
same ranks; a text in which no unit is found is all suffix; an empty table
gives an empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import small_batches

#: Patterns of units by name.
UNITS = {"char": r"(?s:.)", "word": r"\w+", "line": r"[^\n]*\n|[^\n]+"}
#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts, those that stay plain from this place on; of 100 others, those below this become spm.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Matches that the first pass goes on by.
STRIDE = 512
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def count_units(find: Callable[..., Iterable], text: str) -> int:
    """How many matches there are. The iterator is moved on in strides; what is left after the last whole one is counted by itself."""
    matches, n, end = iter(find(text)), 0, 0
    while last := next(islice(matches, STRIDE - 1, None), None):
        n, end = n + STRIDE, last.end()
    return n + sum(1 for _ in find(text, end))


def cut_places(find: Callable[..., Iterable], text: str, low: int, high: int) -> tuple[int, int]:
    """Where the ``low``-th and the ``high``-th match end, from one iterator that goes no further; 0 for rank 0."""
    matches = iter(find(text))
    first = next(islice(matches, low - 1, None)).end() if low else 0
    return first, next(islice(matches, high - low - 1, None)).end() if high > low else first


def hashes(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: the first groups of the SHA-256 of seed, colon and decimal id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, unit: str = "char", seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form, prefix_chars and middle_chars (code points; null if plain), output. No shuffle.

    ``unit`` names a pattern of ``UNITS`` or is one itself; it must not match the empty string.
    """
    pattern = UNITS.get(unit, unit)
    if re.compile(pattern).match(""):
        raise ValueError(f"units of the pattern {pattern} may be empty")
    p, s, m = sentinels

    def run(batches):
        find, taken = re.compile(pattern).finditer, re.compile("|".join(map(re.escape, sentinels)))
        for batch in small_batches(batches, 1):
            rows = []
            for doc_id, text, h1, h2, h3, h4 in zip(*[c.to_pylist() for c in batch.columns]):
                text = text or ""
                n = count_units(find, text)
                if not text or h3 % 100 >= plain_from or taken.search(text):
                    rows.append((doc_id, n, "plain", None, None, text))
                    continue
                a, b = cut_places(find, text, *sorted((h1 % (n + 1), h2 % (n + 1))))
                if h4 % 100 < spm_below:
                    rows.append((doc_id, n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"))
                else:
                    rows.append((doc_id, n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"))
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array(column, t) for column, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), *hashes(F.col("doc_id").cast("long"), seed)).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of. Sentinels stand in it once each, so they part it into its pieces."""
    pieces = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    return F.when(form == "psm", F.concat(pieces[1], pieces[3], pieces[2])).when(form == "spm", F.concat(pieces[2], pieces[3], pieces[1])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of output and restored text."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS r1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS r2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(r1, r2) AS a, greatest(r1, r2) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
