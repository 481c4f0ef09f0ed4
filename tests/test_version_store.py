"""Stored versions against versions kept as DataFrames, and what a publication exchanges and a read lists."""

import pytest
from pyspark.sql import functions as F

from larder.operators import version_store, versions as v

KEYS = ["store", "code"]


def scan(spark, revision):
    rows = [(store, code, f"c{code * (revision if code % 3 == 0 else 1) % 7}") for store in range(3) for code in range(60) if (code + revision) % 9]
    return spark.createDataFrame(rows, "store int, code int, content string")


@pytest.fixture()
def both(spark, tmp_path):
    first = scan(spark, 1).withColumn("valid_from", F.lit(1)).withColumn("valid_to", F.lit(None).cast("int")).select(*KEYS, "valid_from", "valid_to", "content")
    plain, store = first, version_store.store_versions(first, str(tmp_path / "v"), KEYS, "content", buckets=4)
    for revision in (2, 3, 4):
        plain = v.apply_delta(plain, scan(spark, revision), revision, KEYS, "content")
        store = store.publish(scan(spark, revision), revision)
    return plain, store


def rows(df):
    return sorted((tuple(r) for r in df.select(*KEYS, "valid_from", "valid_to", "content").collect()), key=str)


def test_publications_agree_with_plain_versions(spark, both):
    plain, store = both
    assert rows(store.read()) == rows(plain)
    for revision in (1, 2, 3, 4):
        assert sorted(map(tuple, store.at(revision).select(*KEYS, "content").collect())) == sorted(map(tuple, scan(spark, revision).collect()))
    snapshots = spark.createDataFrame([(s, r) for s in range(3) for r in (2, 4)], "store int, revision int")
    seen = store.as_of(snapshots).groupBy("revision").count().collect()
    assert {r.revision: r["count"] for r in seen} == {r: scan(spark, r).count() for r in (2, 4)}


def test_a_retry_closes_nothing_twice(spark, both):
    plain, store = both
    batch = scan(spark, 5)
    once, again = store.publish(batch, 5), store.publish(batch, 5)
    assert rows(once.read()) == rows(again.read()) == rows(v.apply_delta(plain, batch, 5, KEYS, "content"))


def test_only_the_batch_is_exchanged(spark, both):
    _, store = both
    live = spark.table(store.open_rows)
    batch = scan(spark, 5)
    plan = live.join(batch.withColumnRenamed("content", "new"), KEYS, "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_a_revision_lists_no_folder_closed_before_it(spark, both):
    _, store = both
    plan = store.at(3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "valid_to" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [IsNotNull(valid_from), LessThanOrEqual(valid_from,3)]" in plan
    wide = store.as_of(spark.createDataFrame([(1, 2)], "store int, revision int"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in wide and "Exchange hashpartitioning" not in wide.split("BroadcastExchange")[0]


def test_nothing_closed_and_nothing_open(spark, tmp_path):
    first = scan(spark, 1).withColumn("valid_from", F.lit(1)).withColumn("valid_to", F.lit(None).cast("int"))
    store = version_store.store_versions(first, str(tmp_path / "a"), KEYS, "content", buckets=2)
    assert store.read().count() == first.count() == store.at(1).count() and store.at(0).count() == 0
    emptied = store.publish(scan(spark, 1).limit(0), 2)
    assert emptied.at(1).count() == first.count() and emptied.at(2).count() == 0
    empty = version_store.store_versions(first.limit(0), str(tmp_path / "b"), KEYS, "content", buckets=2)
    assert empty.read().count() == 0 and empty.publish(scan(spark, 1), 1).at(1).count() == first.count()
    emptied.drop()
