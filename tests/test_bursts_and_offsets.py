"""Bursts of many transactions, and offsets committed past records that delete keys."""

import duckdb
import pytest
from pyspark.sql import functions as F

from keyfold.plans import catalog
from keyfold.sources import tables


def burst(spark, n, most, start=0):
    at = F.col("id")
    return spark.range(start, start + n).select(F.lit("a-t").alias("topic"), (at % 2).cast("int").alias("partition"), (at % 30).cast("string").alias("key"), at.alias("offset"), F.when(at % 30 != 4, at.cast("string")).alias("value"), F.floor(at / most).alias("txn"))


def test_pointers_do_not_grow_with_the_transactions_of_a_burst(spark, tmp_path):
    log = tables.Changelog(spark, f"file://{tmp_path}")  # nothing was there before
    assert log.commit_all(burst(spark, 300, 5), 1) == 60
    assert log.commit_all(burst(spark, 90, 3, 300), 1) == 30
    assert log.commit_all(burst(spark, 30, 10, 390), 1, offsets={39: {"a-t-0": 400, "a-t-1": 400}, 41: {"a-t-0": 420, "a-t-1": 420}}) == 2
    assert [len(log._content(n)["folders"]) for n in (0, 59, 60, 89, 91)] == [1, 1, 2, 2, 3]
    got = {r["key"]: (r["offset"], r["value"]) for r in log.read().collect()}
    last = lambda k: max(o for o in range(420) if o % 30 == k and o // 10 != 40)  # noqa: E731  transaction 40 is not among the last burst's
    assert got == {str(k): (o, str(o)) for k in range(30) if k != 4 for o in [last(k)]}
    rows = log.history().collect()
    assert len(rows) == 60 * 2 + 30 * 2 + 2 * 2
    assert {tuple(r) for r in rows if r["txn"] == 7 and r["committed"] < 100} == {(7, "a-t", 0, 39), (7, "a-t", 1, 40)}
    assert log._highest() == 91 and log.compact(3) and log.vacuum() == 3
    assert {r["key"]: (r["offset"], r["value"]) for r in log.read().collect()} == got


def test_highest_pointer_is_found_among_any_number(spark, tmp_path):
    log = tables.Changelog(spark, f"file://{tmp_path}")
    for n in range(20):
        assert log._highest() == n - 1 and (not n or log._pointers()[-1] == n - 1)
        log._claim(n).close()
        assert log._claim(n) is None


@pytest.mark.parametrize("name", ["custom_store", "transaction_write"])
def test_committed_offsets_where_a_partition_ends_with_an_error(spark, tmp_path, name):
    at = F.col("id")
    kind = F.when(at.isin(9, 25, 31), "error").otherwise("view")  # the last record of partition 3, the last one of a key of partition 1, and one before it
    events = spark.range(32).select(at.alias("event_id"), F.timestamp_seconds(at).alias("ts"), (at % 8).alias("user_id"), kind.alias("event_type"), at.cast("double").alias("value"), F.lit("{}").alias("props"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    rows = found.fetchall()
    assert {r[columns.index("committed")] for r in rows if r[1] == 3} == {28}
    assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect())) == sorted(rows)
