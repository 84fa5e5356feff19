"""What clustered tables open, deletions by key, and bursts of transactions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keyfold.operators import records
from keyfold.sources import tables

AT = datetime(2020, 3, 1)


def keys(spark, n):
    at = F.lit(AT).cast("timestamp")
    key = F.concat(F.lit("k"), F.col("id").cast("string"))
    return spark.range(n).select(
        F.lit("app").alias("application_id"), F.lit("g").alias("group_id"), F.lit("t").alias("topic"), (F.col("id") % 8).cast("int").alias("partition"), key.alias("key"),
        records.key_segment(F.xxhash64(key), 100).alias("segment"), F.col("id").alias("offset"), at.alias("created"), at.alias("timestamp"), F.to_date(at).alias("created_date"),
        F.lit("C").alias("timestamp_type"), F.expr("map('h', 'v')").alias("headers"), F.lit("").alias("metadata"), F.col("id").cast("string").cast("binary").alias("value"),
    )


def opened(table, **equals):
    found = table.files(equals).values()
    return sum(len(f) for f, _ in found), sum(n for _, n in found)


def test_scans_open_only_files_that_can_match(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FILE_ROWS", 50)
    s = tables.Stores(spark, f"file://{tmp_path}").create()
    rows = keys(spark, 4000)
    for t in (s.keys, s.journals, s.snapshots):
        t.upsert(rows)
    place = {"application_id": "app", "group_id": "g", "topic": "t", "partition": 3}
    n, total = opened(s.keys, **place)
    assert total >= 80 and n <= total / 8 + 3  # one of eight partitions, and the files at its edges
    assert s.all_keys(*place.values()).count() == 500
    n, _ = opened(s.keys, **place, segment=17)
    assert n <= 3
    want = [r["key"] for r in rows.where("partition = 3 and segment = 17").collect()]
    assert sorted(r["key"] for r in s.all_keys(*place.values(), segment=17).collect()) == sorted(want)
    n, total = opened(s.journals, **place, key="k2003")
    assert total >= 80 and n <= 2
    assert [r["offset"] for r in s.journal(**place, key="k2003").collect()] == [2003]
    n, _ = opened(s.journals, key="k2003")  # by the Bloom filters alone: ranges of other columns do not help
    assert 1 <= n <= total / 10
    assert [bytes(r["value"]) for r in s.snapshot(key="k2003").collect()] == [b"2003"]
    assert opened(s.snapshots, **place, key="nowhere")[0] == 0 and s.snapshot(**place, key="nowhere").count() == 0
    plan = s.snapshot(**place, key="k2003")
    assert len(plan.inputFiles()) <= 4
    with pytest.raises(ValueError):
        s.snapshots.scan(metadata="x")


def test_scans_see_later_writes_and_deletions(spark, tmp_path):
    s = tables.Stores(spark, f"file://{tmp_path}").create()
    rows = keys(spark, 100)
    s.snapshots.upsert(rows)
    s.snapshots.upsert(rows.where("offset = 7").withColumn("value", F.lit(b"new")))
    s.journals.upsert(rows.unionByName(rows.withColumn("offset", F.col("offset") + 1000)))
    assert bytes(s.snapshot(key="k7").first()["value"]) == b"new"
    s.snapshots.delete(rows.where("offset in (7, 8)").select("key"))
    s.journals.delete(rows.where("offset = 9").select("topic", "partition", "key"))  # all offsets of the key
    assert s.snapshot(key="k7").count() == 0 and s.snapshots.read().count() == 98
    assert s.journal(key="k9").count() == 0 and s.journal(key="k10").count() == 2 and s.journals.read().count() == 198
    s.snapshots.upsert(rows.where("offset = 7"))  # it comes back
    assert bytes(s.snapshot(key="k7").first()["value"]) == b"7" and s.snapshots.read().count() == 99
    before = sorted(map(repr, s.snapshots.read().collect()))
    assert s.snapshots.compact(2) and s.snapshots._state()[1]["folders"][0].startswith("v-") and len(s.snapshots._state()[1]["folders"]) == 1
    assert sorted(map(repr, s.snapshots.read().collect())) == before
    assert s.snapshots.vacuum() >= 4 and s.snapshot(key="k8").count() == 0 and s.snapshot(key="k7").count() == 1


def burst(spark, n, most):
    at = F.col("id")
    return spark.range(n).select(F.lit("t").alias("topic"), (at % 2).cast("int").alias("partition"), (at % 30).cast("string").alias("key"), at.alias("offset"), F.when(at % 30 != 4, at.cast("string")).alias("value"), F.floor(at / most).alias("txn"))


def test_many_transactions_in_one_job(spark, tmp_path, monkeypatch):
    log = tables.Changelog(spark, f"file://{tmp_path}").create()
    seen = []
    inner = tables.Changelog._commit
    monkeypatch.setattr(tables.Changelog, "_commit", lambda self, *a: (inner(self, *a), seen.append((self.offsets(), self.read().count())))[0])
    assert log.commit_all(burst(spark, 100, 25), 3) == 4
    # Each pointer shows one more transaction, whole, with its offsets.
    assert [o for o, _ in seen] == [{"t-0": 25, "t-1": 24}, {"t-0": 49, "t-1": 50}, {"t-0": 75, "t-1": 74}, {"t-0": 99, "t-1": 100}]
    assert [n for _, n in seen] == [24, 29, 29, 29]  # 30 keys, of which one has no value
    got = {r["key"]: (r["offset"], r["value"]) for r in log.read().collect()}
    assert got == {str(k): (o, str(o)) for k in range(30) if k != 4 for o in [max(o for o in range(100) if o % 30 == k)]}
    with pytest.raises(tables.Fenced):
        log.commit_all(burst(spark, 100, 25), 2)
    assert {r["key"]: (r["offset"], r["value"]) for r in log.read().collect()} == got


def test_a_fenced_burst_keeps_its_first_transactions(spark, tmp_path, monkeypatch):
    log, other = (tables.Changelog(spark, f"file://{tmp_path}") for _ in range(2))
    log.create()
    inner, n = tables.Changelog._commit, []

    def overtaken(make, known):
        n.append(1)
        if len(n) == 3:
            inner(other, lambda base: other._fenced(base, 9, [], {"t-5": 1}))
        return inner(log, make, known)

    monkeypatch.setattr(log, "_commit", overtaken)
    with pytest.raises(tables.Fenced):
        log.commit_all(burst(spark, 100, 25), 3)
    assert log.offsets() == {"t-0": 49, "t-1": 50, "t-5": 1}
    assert {r["offset"] for r in log.read().collect()} == {o for o in range(20, 50) if o % 30 != 4}
