import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keyfold.functions import scalar
from keyfold.operators import callables as c
from keyfold.operators import commit, fold, records, timers
from keyfold.sources import log as logs

LOG = "topic string, partition int, offset long, key string, value long"


def log(spark, rows):
    return spark.createDataFrame([("t", 0, o, k, v) for o, k, v in rows], LOG)


def column_state(spark, f, values, init):
    df = log(spark, [(i, "k", v) for i, v in enumerate(values)]).repartition(3)
    return fold.run(df, f, init, ("value",)).first().state


def test_fold_arithmetic(spark):
    minus, times = fold.Fold(lambda s, a: s - a["value"]), fold.Fold(lambda s, a: s * a["value"])
    zero = F.lit(0).cast("long")
    assert column_state(spark, minus.then(times), [10], zero) == -100
    assert column_state(spark, times.then(minus), [10], zero) == -10
    p, t = c.Fold(lambda s, a: s - a), c.Fold(lambda s, a: s * a)
    assert p.then(t)(0, 10) == -100 and t.then(p)(0, 10) == -10


def test_combinators(spark):
    add = fold.Fold(lambda s, a: s + a["value"])
    zero = F.lit(0).cast("long")
    assert column_state(spark, add.filter(lambda s, a: s < 5), [3, 3, 3], zero) == 6
    assert column_state(spark, add.contra_collect(lambda a: a["value"] > 2, lambda a: F.struct((a["value"] * 10).alias("value"))), [1, 3, 2], zero) == 30
    assert column_state(spark, add.contramap(lambda a: F.struct((a["value"] + 1).alias("value"))), [1, 1], zero) == 4
    assert column_state(spark, fold.Fold.set(F.lit(7).cast("long")).then(fold.Fold.modify(lambda s: s + 1)), [1], zero) == 8
    pair = add.transform_state(lambda s: s["n"], lambda s, n: F.struct(n.alias("n"), s["m"].alias("m")))
    assert tuple(column_state(spark, pair, [1, 2], F.struct(zero.alias("n"), F.lit("x").alias("m")))) == (3, "x")
    plus = c.Fold(lambda s, a: s + a)
    assert plus.filter(lambda s, a: s < 5)(6, 1) == 6 and plus.contra_collect(lambda a: a * 10 if a > 2 else None)(1, 2) == 1
    assert plus.transform_state(lambda s: s["n"], lambda s, n: s | {"n": n})({"n": 1, "m": 2}, 5) == {"n": 6, "m": 2}
    assert plus.transform(lambda s, a: s, lambda s, n, a: n * a)(1, 2) == 6


def test_errors_recover_with_the_state_before():
    def bad(s, a):
        raise ValueError

    plus = c.Fold(lambda s, a: s + a)
    early = plus.then(c.Fold(bad).handle_error(lambda s, a, e: s)).then(plus)
    assert early(1, 1) == 3
    assert plus.then(c.Fold(bad)).handle_error(lambda s, a, e: s)(1, 1) == 1
    assert c.FoldOption(bad).handle_error(lambda s, a, e: 9)(None, 1) is None and c.FoldOption(bad).handle_error(lambda s, a, e: 9)(1, 1) == 9


def test_optional_states(spark):
    none = F.lit(None).cast("long")
    add = fold.FoldOption(lambda s, a: F.coalesce(s, F.lit(0)) + a["value"])
    assert column_state(spark, add.filter(lambda s, a: F.lit(False)), [5, 6], none) == 5
    assert column_state(spark, fold.FoldOption.empty("long").then(add), [5], none) is None
    assert column_state(spark, fold.FoldOption.modify(lambda s, a: s + 1), [5], none) is None
    p = c.FoldOption(lambda s, a: (s or 0) + a)
    assert p.filter(lambda s, a: False)(None, 5) == 5 and p.filter(lambda s, a: False)(5, 6) == 5
    assert c.FoldOption.empty().then(p)(1, 1) is None and c.FoldOption.set(4)(None, 0) == 4 and c.FoldOption.modify(lambda s, a: s + a)(None, 1) is None


def test_three_ways_to_run_agree(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abcdefg"), 0) for i in range(500)] + [(600, None, 1)]
    df = log(spark, rows).repartition(5)
    by_column = {r.key: (r.state.offset, r.state.n) for r in fold.run(df, fold.wait_for(3), F.lit(None).cast("struct<offset:bigint,n:int>"), ()).collect() if r.state}
    by_monoid = {r.key: (r.offset, r.n) for r in fold.wait_for_monoid(3).run(df).collect()}

    def step(s, a):
        n = (s or {"n": 0})["n"] + 1
        return {"offset": a["offset"], "n": n} if n < 3 else None

    by_stream = {r.key: (r.offset, r.n) for r in fold.run_sorted(df, step, "topic string, partition int, key string, offset long, n int", ()).collect()}
    assert by_column == by_monoid == by_stream


def test_dedup_by_offset_and_sequence(spark):
    add = c.newer(c.FoldOption(lambda s, a: (a[0], (s[1] if s else 0) + a[1])), lambda s: s[0], lambda a: a[0])
    s = add(None, (1, 100))
    assert add(s, (1, 100)) == (1, 100) and add(s, (2, 100)) == (2, 200)
    seq = c.newer_sequence(c.FoldOption(lambda s, a: {"seq": a, "n": (s or {"n": 0})["n"] + 1}), lambda s: s["seq"], lambda a: a)
    s = seq(None, None)
    assert s["n"] == 1 and seq({"seq": 100, "n": 1}, 100)["n"] == 1 and seq({"seq": 100, "n": 1}, 101)["n"] == 2 and seq({"seq": 1, "n": 1}, None)["n"] == 1


def wait3():
    return c.EnhancedFold(lambda x, s, a: (s or 0) + 1 if (s or 0) + 1 < 3 else None)


def test_delete_only_at_the_end_of_a_batch():
    m = c.KeyMemory(ever_persisted=True)
    assert not c.fold_batch(m, wait3(), [1, 2, 3], lambda r: r) and m.hold is None
    m = c.KeyMemory()
    assert c.fold_batch(m, wait3(), [1, 2, 3, 4, 5], lambda r: r) and m.state == 2 and m.journal == [1, 2, 3, 4, 5]
    assert c.tick_batch(m, c.Tick(lambda s: s + 1)) and m.state == 3 and not c.tick_batch(m, c.Tick(lambda s: None))


def test_writes_that_are_left_out():
    m = c.KeyMemory()
    assert not m.delete()
    m.remember("a")
    assert m.flush() == {"key": True, "journal": [], "snapshot": "a"}
    m.remember("a")
    assert m.flush() == {"key": False, "journal": [], "snapshot": None} and m.delete()
    m.recovered("b")
    assert m.flush()["snapshot"] is None and m.delete()


def test_additional_persist_keeps_its_cooldown():
    written = []
    ask = c.EnhancedFold(lambda x, s, a: (x.persist_now(), a)[1])
    persist = c.additional_persist(60, lambda r: r * 30, lambda out, r: written.append(r), lambda r: 100 + r)
    m = c.KeyMemory()
    c.fold_batch(m, ask, range(1, 8), lambda r: 100 + r, persist)
    assert written == [1, 4, 7] and m.hold == 108


def test_commit_scenarios(spark):
    rows = [(100, "1", 0), (101, "1", 0), (102, "2", 0), (103, "2", 0), (104, "1", 0)]
    df = log(spark, rows)
    get = lambda d: commit.committable(commit.wait_holds(d, 3), records.next_offsets(d)).first().commit_offset
    assert get(df) == 102 and get(df.unionByName(log(spark, [(105, "2", 0)]))) == 106
    kept, nexts = records.split(log(spark, [(100, "1", 0), (101, "2", 1), (102, None, 0)]), F.col("value") == 0)
    assert kept.count() == 1 and nexts.first().next_offset == 103
    keys = spark.createDataFrame([("t", 0, "1", 100, True), ("t", 0, "2", 102, False), ("t", 0, "3", 104, True)], "topic string, partition int, key string, hold long, flushed boolean")
    n = spark.createDataFrame([("t", 0, 106)], "topic string, partition int, next_offset long")
    assert commit.commit_on_revoke(keys, n).first().commit_offset == 102
    assert commit.commit_on_revoke(keys.withColumn("flushed", F.lit(True)), n).first().commit_offset == 106
    cand = spark.createDataFrame([("t", 0, b, o) for b, o in enumerate([5, 5, 4, 9, 9, 10])], "topic string, partition int, batch_id int, commit_offset long")
    assert [r.commit_offset for r in commit.advances(cand).orderBy("batch_id").collect()] == [5, 9, 10]


def test_remap_keeps_partition_and_null_keys(spark):
    out = records.remap_key(log(spark, [(1, "a", 0), (2, None, 0)]), lambda k: F.concat(k, F.lit("-derived"))).orderBy("offset").collect()
    assert [(r.key, r.partition) for r in out] == [("a-derived", 0), (None, 0)]


def test_distance_unload_is_strict(spark):
    df = log(spark, [(1000, "a", 0), (1003, "a", 0), (1007, "a", 0)])
    assert [r.offset for r in timers.distance_unloads(df, 3).collect()] == [1003]


def test_changelog_scan(spark):
    df = spark.createDataFrame([("t", 0, 1, "a", "x"), ("t", 0, 2, "a", None), ("t", 0, 3, "b", "y"), ("t", 0, 4, "b", "z"), ("t", 0, 5, None, "q"), ("t", 0, 9, "b", "late")], "topic string, partition int, offset long, key string, value string")
    assert [(r.key, r.value) for r in logs.compacted(logs.bounded(df, {("t", 0): 9}), "value").collect()] == [("b", "z")]
    assert logs.repeat(df, 3).count() == 18 and logs.high_watermarks(df).first().end == 10


def test_scalars(spark):
    words = ["", "a", "hello", "Zürich", "user-12345"]

    def java(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    df = spark.createDataFrame([(w,) for w in [*words, None]], "key string")
    got = {r.key: (r.h, r.p) for r in df.select("key", scalar.java_hash(F.col("key")).alias("h"), scalar.key_partition(F.col("key"), 4).alias("p")).collect()}
    assert all(got[w][0] == java(w) for w in words) and got[None] == (None, None)
    # Published test values of the clients' hash, as signed integers.
    for text, h in (("21", -973932308), ("foobar", -790332482), ("a-little-bit-long-string", -985981536), ("a-little-bit-longer-string", -1486304829)):
        assert scalar.murmur2(text.encode()) == h & 0xFFFFFFFF


def test_framing():
    small = scalar.Compressor()
    assert len(small.pack(b"test")) == 9 and small.unpack(small.pack(b"test")) == b"test"
    big = scalar.Compressor(threshold=1)
    assert big.unpack(big.pack(b"test" * 9)) == b"test" * 9 and big.unpack(b'{"key":"value"}') == b'{"key":"value"}'
    with pytest.raises(ValueError):
        big.unpack(b"\0\0\0\2xx")


def test_headers_and_payloads(spark):
    df = spark.createDataFrame([([("k", b"1"), ("k", b"2"), ("journal", b'{"action":"append","range":{"from":3,"to":5}}')], '{"events":[{"seqNr":1,"tags":[],"payload":{"payload":"{\\"field1\\":\\"v\\",\\"field2\\":7}"}}]}')], "headers array<struct<key:string,value:binary>>, value string")
    r = df.select(scalar.headers_to_map(F.col("headers")).alias("m"), scalar.sequence_range(F.col("headers")).alias("r"), scalar.journal_events(F.col("value")).alias("e")).first()
    assert r.m["k"] == "2" and (r.r["from"], r.r["to"]) == (3, 5) and r.e[0].seqNr == 1
    p = spark.createDataFrame([('{"field1":"v","field2":7}',)], "p string")
    assert p.select(scalar.payload_as(F.col("p"), "field1 string, field2 int").alias("x")).first().x.field2 == 7
    for bad in ('{"field1":"v","field2":"7"}', "", "no json"):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "p string").select(scalar.payload_as(F.col("p"), "field1 string, field2 int")).collect()
    for bad in ("", "no json", None):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "v string").select(scalar.journal_events(F.col("v"))).collect()
