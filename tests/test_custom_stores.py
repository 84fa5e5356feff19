"""Schemas that grow, typed states, and stores other than the library's tables."""

import pytest
from pyspark.sql import functions as F

from keyfold.operators import fold
from keyfold.sources import custom, tables
from keyfold.streaming import engine


def table(spark, path, schema):
    return tables.Table(spark, str(path), schema, ("key",))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_column_added_between_two_writes_reads_back(spark, tmp_path):
    table(spark, tmp_path, "key string, n int").upsert(spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int"))
    new = table(spark, tmp_path, "key string, n bigint, tag string")
    assert rows(new.read()) == [("a", 1, None), ("b", 2, None)]
    new.upsert(spark.createDataFrame([("b", 1 << 40, "x"), ("c", 3, None)], "key string, n bigint, tag string"))
    assert rows(new.read()) == [("a", 1, None), ("b", 1 << 40, "x"), ("c", 3, None)]


def test_an_older_program_keeps_what_others_added(spark, tmp_path):
    old = table(spark, tmp_path, "key string, n int")
    old.upsert(spark.createDataFrame([("a", 1)], "key string, n int"))
    table(spark, tmp_path, "key string, n bigint, tag string").upsert(spark.createDataFrame([("b", 1 << 40, "x")], "key string, n bigint, tag string"))
    old.upsert(spark.createDataFrame([("c", 3)], "key string, n int"))
    assert old.compact(2) and len(old._state()[1]["folders"]) == 1
    assert rows(old.read()) == [("a", 1, None), ("b", 1 << 40, "x"), ("c", 3, None)]
    old.delete(spark.createDataFrame([("b",)], "key string"))
    assert rows(old.read()) == [("a", 1, None), ("c", 3, None)]


def test_fields_of_structs_are_merged(spark, tmp_path):
    narrow, wide = "key string, s struct<a:int>", "key string, s struct<a:bigint,b:string>"
    table(spark, tmp_path, narrow).upsert(spark.createDataFrame([("k", (1,))], narrow))
    t = table(spark, tmp_path, wide)
    t.upsert(spark.createDataFrame([("l", (2, "b"))], wide))
    assert rows(t.read().select("key", "s.a", "s.b")) == [("k", 1, None), ("l", 2, "b")]


@pytest.mark.parametrize("other", ["key string, n string", "key string, n double", "key int, n int"])
def test_other_changes_are_refused_and_leave_the_table(spark, tmp_path, other):
    t = table(spark, tmp_path, "key string, n int")
    t.upsert(spark.createDataFrame([("a", 1)], "key string, n int"))
    with pytest.raises(tables.SchemaConflict):
        table(spark, tmp_path, other).replace(spark.createDataFrame([], other))
    assert rows(t.read()) == [("a", 1)]


def test_typed_snapshots_are_written_where_they_differ(spark, tmp_path):
    stores = tables.Stores(spark, str(tmp_path), value="n bigint, last string").create()
    schema = "application_id string, group_id string, topic string, partition int, key string, offset long, created timestamp, metadata string, n bigint, last string"
    one = lambda *v: spark.createDataFrame([("a", "g", "t", 0, "k", 1, None, "", *v)], schema)
    tables.save("snapshots_only", stores, None, one(1, None))
    assert tables.changed_only(one(1, None), stores.snapshots.read(), tables.KEY_COLUMNS, "n", "last").isEmpty()
    tables.save("snapshots_only", stores, None, one(1, "x"))
    assert rows(stores.snapshots.read().select("n", "last")) == [(1, "x")]


WRITES = "topic string, partition int, key string, offset long, value struct<n:bigint>"


@pytest.fixture(params=["orc", "json", "changelog"])
def store(request, spark, tmp_path):
    if request.param == "changelog":
        return tables.Changelog(spark, str(tmp_path), "struct<n:bigint>").create()
    return custom.AppendStore(spark, str(tmp_path), "struct<n:bigint>", request.param).create()


def test_a_store_keeps_the_contract(spark, store):
    write = lambda *r: spark.createDataFrame(list(r), WRITES)
    assert store.offsets() == {} and store.read().isEmpty()
    store.commit(write(("t", 0, "a", 1, (1,)), ("t", 0, "b", 2, (1,)), ("t", 0, None, 3, (1,))), 1, {"t-0": 4})
    for _ in range(2):  # a repeated commit changes nothing
        store.commit(write(("t", 0, "a", 5, (2,)), ("t", 0, "b", 6, None)), 2, {"t-0": 7})
    with pytest.raises(tables.Fenced):
        store.commit(write(("t", 0, "a", 9, (9,))), 1, {"t-0": 10})
    store.commit(write(), 2, {"t-1": 3})
    assert store.offsets() == {"t-0": 7, "t-1": 3}
    assert rows(store.read().select("key", "offset", "value.n")) == [("a", 5, 2), (None, 3, 1)]


def test_of_two_writers_of_one_number_the_younger_counts(spark, tmp_path):
    s = custom.AppendStore(spark, str(tmp_path)).create()
    rows_of = lambda v: spark.createDataFrame([(v, "t", 0, "k", 1, v)], s.schemas["states"])
    for name, generation in (("old", 1), ("new", 2), ("dead", None)):
        s._append("states", rows_of(name))
        if generation:
            s._append("commits", spark.createDataFrame([(name, 0, generation, {"t-0": generation})], s.schemas["commits"]))
    assert [r["value"] for r in s.read().collect()] == ["new"]
    assert s.offsets() == {"t-0": 2}


def test_states_of_a_store_get_more_fields(spark, tmp_path):
    old = custom.AppendStore(spark, str(tmp_path), "struct<n:bigint>").create()
    old.commit(spark.createDataFrame([("t", 0, "a", 1, (1,))], WRITES), 1, {})
    new = custom.AppendStore(spark, str(tmp_path), "struct<n:bigint,tag:string>")
    new.commit(spark.createDataFrame([("t", 0, "b", 2, (2, "x"))], WRITES.replace("n:bigint", "n:bigint,tag:string")), 1, {})
    assert rows(new.read().select("key", "value.n", "value.tag")) == [("a", 1, None), ("b", 2, "x")]


def test_routed_folds_take_one_scan(spark, tmp_path):
    log = spark.createDataFrame([("a", 0, "k", 1), ("a", 0, "k", 2), ("b", 0, "k", 3), ("c", 0, "k", 4), ("b", 0, None, 5)], "topic string, partition int, key string, offset long")
    log.write.parquet(str(tmp_path / "log"))
    count = fold.Monoid({"__n": F.count(F.lit(1))}, {"s": F.col("__n")}, F.col("__n") < 2)
    last = fold.Monoid({"__m": F.max("offset")}, {"s": F.col("__m")})
    out = fold.route_folds(spark.read.parquet(str(tmp_path / "log")), {"a": count, "b": last})
    assert rows(out) == [("b", 0, "k", 3)]
    assert out._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    with pytest.raises(ValueError):
        fold.route_folds(log, {"a": count, "b": count})


def test_a_state_that_is_not_of_its_schema_stops_the_sink(spark, tmp_path):
    loop = engine.StoredFold(tables.Changelog(spark, str(tmp_path), "struct<n:bigint>").create(), 1, "n bigint")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        loop.sink(spark.createDataFrame([("t", 0, "k", "fold", 1, None, None, '{"n": "x"}')], engine.OUTPUT), 0)
    assert loop.changelog.offsets() == {}
