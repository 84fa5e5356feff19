"""Near-duplicate documents by BagMinHash, banding and exact multiset overlap.

A text is the multiset of its five-word shingles (words: runs of ASCII letters
and digits and non-ASCII characters, in lower case). Similarity is the
weighted Jaccard index, sum of minima over sum of maxima of the counts.

Signatures. Counts are discretised at the integers. The weight axis of a
shingle is cut into the dyadic intervals (0,1], (1,2], (2,4], (4,8] ..., each
with its own Poisson process of a rate equal to its length, so a count w needs
about log2 w processes instead of w. A point falls on one component of the
signature and, by halving its interval as often as its hash has bits, on one
unit of weight; it counts if that unit is at most w. A component keeps its
earliest point. Points come in rising order, so a shingle is done once its
time exceeds the document's latest component. Two components agree with
probability equal to the weighted Jaccard index, without bias.

Search. Equal multisets are one class first (heavy ones by broadcast). Class
representatives meet in the buckets of ``BANDS`` bands of ``ROWS`` components.
Within a bucket no all-pairs join takes place: members are compared with one
pivot, the member that meets most others over all its buckets. A bucket is
settled if its members are connected by links then. By the triangle inequality
of the Jaccard distance, so is a member that is near the pivot but cannot be
near any that is not.

Members left open are searched exactly, by prefixes. Their shingles (the k-th
occurrence of one counts apart) are put in one order, rare ones first. Of two
multisets at the threshold, the first ``n - ceil(0.8 n) + 1`` shingles of the
larger and the first ``n - ceil(8/9 n) + 1`` of the smaller have one in common.
Texts that share a common passage but little else have other shingles there,
so they never meet. Two that have a shingle first in common share no more than
what stands from it on; a member for which that is too little with any other
leaves. The rest are compared with pivots again, small ones first and ever
more a round, but only with pivots of another component; a shingle is settled
when one component is left, or when all members whose short prefix holds it
were pivots. So no link between members of a bucket is lost, unless
its ends are connected already.

Verification is the exact overlap of the multisets. Classes are the connected
components over verified links, found by spreading the smallest fingerprint
along links and then jumping pointers, a table per round. Links that are found
later join the components of their ends, so a link is spread along in one
search only.

Edge cases: a text of one to four words is one shingle; texts without words
are near only to equal texts; null counts as empty; rows that share a doc_id
are one document (if their texts differ, one class joins them); a row with a
null doc_id gets a null class, but ``dedup`` knows it for a copy by its text;
extra columns do not matter.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from keyfold.llm.common import cut, drop_ids, free_name, group_pick, mix64, small_batches, small_enough

WORDS, THRESHOLD = 5, 0.8
#: A pair at the threshold shares a band with probability 0.9996.
BANDS, ROWS = 26, 6
#: Members of a pivot that one salted group holds.
SALT_ROWS = 512
#: Narrow rows whose work equals that of comparing two multisets.
HEAVY = 20
#: Rows up to which a table is broadcast.
FEW = 100_000
#: Characters that a Python worker handles at once, unless one text is longer.
BLOCK = 500_000

_U = np.uint64
_BYTE_HASH = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = _U(0x5851F42D4C957F2D)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_PLACE = mix64(np.arange(11, 11 + WORDS, dtype=_U)) | _U(1)
#: Powers that are kept; those of longer blocks are worked out anew.
KEPT = 1 << 19
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of ``base`` modulo 2^64."""
    if name not in _powers or len(_powers[name]) < n:
        out = np.full(max(n, KEPT), base, _U)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > KEPT:
            return out
        _powers[name] = out
    return _powers[name][:n]


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, shingle hash) of every shingle, by array operations over all bytes at once."""
    coded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    is_word = _IS_WORD[raw]
    edge = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=np.int8(0)))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    # Polynomial hash of each word from prefix sums; an odd base has an inverse modulo 2^64.
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE_HASH[raw] * _power("up", _BASE, len(raw)), out=total[1:])
    word = mix64((total[last] - total[first]) * _power("down", _BASE_INV, len(raw))[first])
    ends = np.cumsum([len(c) + 1 for c in coded])
    doc = np.searchsorted(ends, first, side="right")
    full = np.flatnonzero(doc[WORDS - 1 :] == doc[: len(doc) - WORDS + 1]) if len(doc) >= WORDS else np.zeros(0, np.int64)
    h = np.zeros(len(full), _U)
    for k in range(WORDS):
        h += word[full + k] * _PLACE[k]
    n_words = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    if len(short):
        begin = np.searchsorted(doc, short)
        extra = np.array([sum(int(word[b + k]) * int(_PLACE[k]) for k in range(n_words[d])) + int(n_words[d]) & (1 << 64) - 1 for b, d in zip(begin, short)], _U)
        return np.concatenate([doc[full], short]), mix64(np.concatenate([h, extra]))
    return doc[full], mix64(h)


def multisets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle hash, count) of the distinct shingles, sorted by document, then hash."""
    doc, h = shingles(texts)
    order = np.lexsort((h, doc)) if len(texts) > 1 else np.argsort(h)
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash: per document m values that identify the earliest point of each component; zeros for an empty one."""
    best = np.full(n_docs * m, np.inf)
    # One process for each dyadic interval of the weight axis that lies wholly or partly below the count.
    power = np.ceil(np.log2(count)).astype(np.int64)
    row = np.repeat(np.arange(len(h)), power + 1)
    level = np.arange(len(row)) - np.repeat(np.cumsum(power + 1) - power - 1, power + 1)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    size = np.where(level > 0, low, 1)
    seed = mix64(h[row] + mix64(level.astype(_U) + _U(101)))
    owner, weight = doc[row], count[row]
    time = np.zeros(len(row))
    turn = look = 0
    while len(owner):
        seed += _U(0x9E3779B97F4A7C15)
        point = mix64(seed)
        time = time - np.log(((point >> _U(11)).astype(np.float64) + 1) * 2.0**-53) / size
        other = mix64(point + _U(7))
        unit = low + 1 + ((other >> _U(32)) & (size - 1).astype(_U)).astype(np.int64)
        slot = owner * m + ((other & _U(0xFFFFFFFF)) * _U(m) >> _U(32)).astype(np.int64)
        ok = unit <= weight
        np.minimum.at(best, slot[ok], time[ok])
        turn += 1
        if turn <= look:  # points later than the latest component change nothing, so it is looked up ever more rarely
            continue
        look = turn + turn // 4
        going = time < best.reshape(n_docs, m).max(axis=1)[owner]
        owner, weight, time, seed, low, size = owner[going], weight[going], time[going], seed[going], low[going], size[going]
    best[np.isinf(best)] = 0
    return best.view(_U).reshape(n_docs, m)


def bands(sig: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash of each band of each signature, different bands apart."""
    part = sig.reshape(len(sig), n_bands, rows)
    out = np.tile(mix64(np.arange(n_bands, dtype=_U) + _U(977)), (len(sig), 1))
    for k in range(rows):
        out = mix64(out + part[:, :, k] * _U(0xD6E8FEB86659FD93))
    return out.view(np.int64)


def fingerprints(texts: list[str | None], doc: np.ndarray, h: np.ndarray, count: np.ndarray) -> list[str]:
    """128 bits of each multiset, independent of order; of the text itself if it has no words."""
    sums = []
    for k in (3, 5):
        s = np.zeros(len(texts), _U)
        np.add.at(s, doc, mix64(h * _U(2 * k + 1) + mix64(count.astype(_U) + _U(k))))
        sums.append(s)
    has = np.bincount(doc, minlength=len(texts))
    return [f"{sums[0][i]:016x}{sums[1][i]:016x}" if has[i] else blake2b((t or "").encode("utf-8", "replace"), digest_size=15).hexdigest() for i, t in enumerate(texts)]


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and bands (null without words) of every row."""

    def run(batches):
        for batch in small_batches(batches, 1, BLOCK):
            texts = batch.column(1).to_pylist()
            doc, h, count = multisets(texts)
            keys = fingerprints(texts, doc, h, count)
            has = np.bincount(doc, minlength=len(texts)) > 0
            found = bands(signatures(doc, h, count, len(texts)))
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(has * BANDS)).astype(np.int32), pa.array(found[has].ravel()), mask=pa.array(~has))
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.string()), lists], names=["doc_id", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp string, bands array<long>")


def _elements(docs: DataFrame) -> DataFrame:
    """fingerprint, and a hash of every shingle with the number of its occurrence, of each row: overlaps of multisets become those of sets."""

    def run(batches):
        for batch in small_batches(batches, 0, BLOCK):
            texts = batch.column(0).to_pylist()
            doc, h, count = multisets(texts)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            each = mix64(np.repeat(h, count) + nth.astype(_U) * _U(0x9E3779B97F4A7C15))
            sizes = np.bincount(doc, count, minlength=len(texts)).astype(np.int64)
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(each.view(np.int64)))
            yield pa.record_batch([pa.array(fingerprints(texts, doc, h, count), pa.string()), lists], names=["fp", "elements"])

    return docs.select("text").mapInArrow(run, "fp string, elements array<long>")


def _compare(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pivot, fp and similarity of each pair; of pairs whose sizes rule the threshold out, a bound of it.

    A pivot with many members is dealt to many salted groups.
    """
    hot = cut(pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SALT_ROWS).select("pivot", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("parts")))
    hot = small_enough(hot, FEW)
    parts = F.coalesce("parts", F.lit(1))
    left = pairs.join(hot, "pivot", "left").select("pivot", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("salt"), "fp").join(sets, "fp")
    pivots = pairs.select("pivot").distinct().join(hot, "pivot", "left").select("pivot", parts.alias("parts")).join(sets.select(F.col("fp").alias("pivot"), F.col("elements").alias("others")), "pivot")
    right = pivots.select("pivot", "others", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    a, b = F.size("elements"), F.size("others")
    both = F.size(F.array_intersect("elements", "others"))
    bound = F.least(a, b) / F.greatest(a, b)
    return left.join(right, ["pivot", "salt"]).select("pivot", "fp", F.when(bound < threshold, bound).otherwise(both / (a + b - both)).alias("sim"))


def _part_of(rows: DataFrame, parts: DataFrame, column: str, part: str = "part") -> DataFrame:
    """``rows`` with the part of ``column`` in ``parts`` (fp, part) as column ``part``; what has none is its own."""
    found = parts.select(F.col("fp").alias("__end"), F.col("part").alias("__part"))
    return rows.join(found, F.col(column) == F.col("__end"), "left").withColumn(part, F.coalesce("__part", column)).drop("__end", "__part")


def _joined(parts: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``parts`` (fp, part) with further ``links`` (pivot, fp), and the changes alone: the new part of former parts and of new ends."""
    few = small_enough(parts, FEW)
    ends = _part_of(_part_of(links, few, "pivot", "pivot"), few, "fp", "fp")
    changes = components(ends.where("pivot <> fp").distinct()).select("fp", F.col("class_id").alias("part"))
    new = changes.count()
    if not new:
        return parts, changes
    known = _part_of(parts, small_enough(changes, FEW), "part")
    return cut(known.unionByName(changes.join(few, "fp", "left_anti")), parts.count() + new), changes


def _links(reps: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Components (fp, part) over verified links of representatives (fp, id, bands), enough to connect all that any bucket links."""
    parts = docs.sparkSession.createDataFrame([], "fp string, part string")
    open_ = reps.select("fp", F.explode("bands").alias("bucket"))
    sizes = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    open_ = cut(open_.join(sizes, "bucket"))
    rows = open_.count()
    if not rows:
        return parts
    # Whole multisets are read again only of representatives that share a bucket.
    members = cut(open_.groupBy("fp").agg(F.sum("n").alias("met")), rows)
    wanted = cut(reps.join(members.select("fp"), "fp", "left_semi").select(F.col("id").alias("__want")).distinct(), rows)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    texts = texts.join(small_enough(wanted, FEW), F.col("doc_id").eqNullSafe(F.col("__want")), "left_semi")
    sets = cut(_elements(texts).join(small_enough(members.select("fp"), FEW), "fp", "left_semi").dropDuplicates(["fp"]))

    # The member that meets most others over all its buckets is likeliest to be near them all.
    open_ = cut(open_.join(members, "fp").select("bucket", "fp", F.struct((-F.col("met")).alias("a"), F.col("fp").alias("b")).alias("order")), rows)
    met = open_.join(open_.groupBy("bucket").agg(F.min("order.b").alias("low"), F.min("order").alias("head")), "bucket").select("bucket", F.col("head.b").alias("pivot"), "fp")
    met = cut(met.where("fp <> pivot"), rows)
    seen = cut(_compare(cut(met.select("pivot", "fp").distinct(), rows), sets, threshold), rows * HEAVY)
    parts, _ = _joined(parts, seen.where(F.col("sim") >= threshold).select("pivot", "fp"))
    # Open: members that are not near their pivot, and near ones that may be near one of those.
    known = cut(met.join(seen, ["pivot", "fp"]), rows)
    reach = known.where(F.col("sim") < threshold).groupBy("bucket").agg(F.max("sim").alias("reach"))
    left = known.join(reach, "bucket").where((F.col("sim") < threshold) | (F.col("sim") - F.col("reach") <= 1 - threshold + 1e-9))
    left = cut(_part_of(left.select("bucket", "fp"), small_enough(parts, FEW), "fp"), rows)
    mixed = left.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    left = cut(left.join(mixed, "bucket", "left_semi").select("fp", "part").distinct(), rows)
    return parts if left.isEmpty() else _exact(cut(sets.join(small_enough(left.select("fp"), FEW), "fp", "left_semi")), parts, threshold)


def _exact(sets: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """``parts`` joined by the links between the members that ``sets`` has, which are found by shared shingles of their prefixes."""
    each = sets.select("fp", F.size("elements").alias("n"), F.explode("elements").alias("element"))
    # Shingles of one member alone come first in every order; only their number matters.
    usual = small_enough(cut(each.groupBy("element").agg(F.count(F.lit(1)).alias("df")).where("df > 1")), FEW)
    n, ordered = F.col("n"), F.sort_array(F.collect_list(F.struct("df", "element")))
    alone, share = n - F.size("list"), threshold / (1 + threshold)
    long = n - F.ceil(n * threshold - 1e-9) + 1 - alone
    short = n - F.ceil(n * 2 * share - 1e-9) + 1 - alone
    lists = each.join(usual, "element").groupBy("fp", "n").agg(ordered.alias("list")).where(long > 0)
    open_ = lists.select("fp", "n", F.size("list").alias("listed"), short.alias("short"), F.posexplode(F.slice("list", F.lit(1), long.cast("int"))))
    open_ = open_.select("fp", "n", F.col("col.element").alias("element"), (F.col("pos") < F.col("short")).alias("leads"), (F.col("listed") - F.col("pos")).alias("rest"))
    open_ = cut(_part_of(open_, small_enough(parts, FEW), "fp"))
    pivots = 1
    while True:
        live = open_.groupBy("element").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("n").alias("least"), F.min(F.when(F.col("leads"), n)).alias("least_lead"))
        # Two that have this shingle first in common share no more than what stands from it on: too little with any partner, and the row can go.
        enough = F.col("rest") >= share * (n + F.when(F.col("leads"), F.col("least")).otherwise(F.col("least_lead"))) - 1e-9
        open_ = cut(open_.join(live.where("low <> high and least_lead is not null"), "element").where(enough).select(*open_.columns))
        rows = open_.count()
        if not rows:
            return parts
        first = F.struct("n", "fp", "rest", "part")
        leads = open_.where("leads").select("element", first.alias("p"))
        if pivots == 1:
            heads = leads.groupBy("element").agg(F.min("p").alias("p"))
        else:
            heads = leads.withColumn("rank", F.row_number().over(Window.partitionBy("element").orderBy("p"))).where(F.col("rank") <= pivots)
        heads = cut(heads.select("element", *[F.col(f"p.{c}").alias(f"pivot_{c}") for c in ("n", "fp", "rest", "part")]), rows)
        near = (F.col("part") != F.col("pivot_part")) & (F.least("rest", "pivot_rest") >= share * (n + F.col("pivot_n")) - 1e-9)
        pairs = cut(open_.join(heads, "element").where(near).select(F.col("pivot_fp").alias("pivot"), "fp").distinct())
        found = _compare(pairs, sets, threshold).where(F.col("sim") >= threshold).select("pivot", "fp")
        parts, changes = _joined(parts, found)
        open_ = open_.join(heads.select("element", F.col("pivot_fp").alias("fp")), ["element", "fp"], "left_anti")
        open_ = cut(_part_of(open_, small_enough(changes, FEW), "part"))
        pivots *= 8


def components(links: DataFrame) -> DataFrame:
    """(fp, class_id) of the ends of ``links`` (pivot, fp): the smallest name of the connected component."""
    links = cut(links)
    ends = 2 * links.count()
    edges = cut(links.select(F.col("pivot").alias("a"), F.col("fp").alias("b")).union(links.select("fp", "pivot")).distinct(), ends)
    label = cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("fp"), F.col("c").alias("class_id")), ends)
    while ends:
        near = edges.join(label.select(F.col("fp").alias("b"), F.col("class_id").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        low = label.join(near, F.col("fp") == F.col("a")).select("fp", F.col("class_id").alias("was"), F.least("class_id", "c").alias("class_id"))
        up = low.select(F.col("fp").alias("class_id"), F.col("class_id").alias("up"))
        new = cut(low.join(up, "class_id", "left").select("fp", "was", F.least("class_id", F.coalesce("up", "class_id")).alias("class_id")), ends)
        label = new.select("fp", "class_id")
        if new.where("was <> class_id").isEmpty():
            break
    return label


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, fp, n_copies, class_id and class_fp (one fingerprint of the class) of every row; a written table."""
    signed = cut(_signed(docs))
    rows = cut(group_pick(signed, "fp", F.min("doc_id")).select("doc_id", "fp", F.col("__pick").alias("id"), F.col("__size").alias("n_copies"), F.when(F.col("doc_id").eqNullSafe(F.col("__pick")), F.col("bands")).alias("bands")))
    reps = cut(rows.where("bands is not null").select("fp", "id", "bands").dropDuplicates(["fp"]))
    parts = _links(reps, docs, threshold)
    # Texts that share a doc_id are linked through it.
    odd = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("pivot"), F.max("fp").alias("high")).where("pivot <> high").select("doc_id", "pivot")
    odd = rows.select("doc_id", "fp").join(small_enough(cut(odd), FEW), "doc_id").where("fp <> pivot").select("pivot", "fp")
    found, _ = _joined(parts, odd)
    # Of texts in a class of several, the smallest id of the class; all others have their own.
    member = cut(found.join(rows.groupBy("fp").agg(F.min("id").alias("id")), "fp"))
    named = member.select("fp", "part").join(small_enough(cut(member.groupBy("part").agg(F.min("id").alias("low"))), FEW), "part")
    out = rows.join(small_enough(cut(named), FEW), "fp", "left")
    return cut(out.select("doc_id", "fp", "n_copies", F.when(F.col("part").isNull(), F.col("id")).otherwise(F.col("low")).alias("class_id"), F.coalesce("part", "fp").alias("class_fp")))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id of its class), n_copies (rows of the same multiset)."""
    return _classes(docs, threshold).select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), "n_copies")


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, one of its smallest doc_id; all columns kept.

    Rows that a doc_id does not tell apart (null or repeated ids) are looked at
    again with their texts, so that of them, too, one row a class is left; of
    classes with null ids alone, one row as well.
    """
    rows = _classes(docs, threshold)
    out = drop_ids(docs, rows.where("doc_id <> class_id").select("doc_id"))
    repeated, print_of, fp, class_fp = (free_name(n, docs) for n in ("repeated", "print_of", "fp", "class_fp"))
    again = cut(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias(repeated)))
    if again.isEmpty():
        return out
    one = F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")
    again = small_enough(again, FEW)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(repeated))
    odd = out.join(again, same, "left_semi")
    named = odd.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(one).select("row.*")
    nameless = cut(rows.where("doc_id is null and class_id is null").select(F.col("fp").alias(fp), F.col("class_fp").alias(class_fp)).distinct())
    others = _with_print(odd.where("doc_id is null"), print_of).join(small_enough(nameless, FEW), F.col(print_of) == F.col(fp))
    others = others.groupBy(F.col(class_fp).alias("id")).agg(one).select("row.*")
    return out.join(again, same, "left_anti").unionByName(named).unionByName(others)


def _with_print(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the fingerprint of its text as column ``name``."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in small_batches(batches, at, BLOCK):
            texts = batch.column(at).to_pylist()
            yield batch.append_column(name, pa.array(fingerprints(texts, *multisets(texts)), pa.string()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType())]))
