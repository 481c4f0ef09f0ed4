import random

from pyspark.sql import Window, functions as F

from larder.operators import batching, quality, versions as v


def scans(spark, seed=3):
    rng = random.Random(seed)
    rows = [("s", r, f"p{i}", f"c{rng.randrange(3)}") for r in (1, 2, 4, 7) for i in range(40) if rng.random() < 0.7]
    return spark.createDataFrame(rows, "store string, revision int, code string, content string")


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_as_of_every_snapshot_returns_that_snapshot(spark):
    rows = scans(spark)
    versions = v.build_versions(rows, rows, ["store", "code"], "content")
    again = v.as_of(versions, rows).select("store", "revision", "code", "content")
    assert as_set(again) == as_set(rows)
    assert as_set(v.as_of_revision(versions, 4).select("code", "content")) == as_set(rows.filter("revision = 4").select("code", "content"))


def test_incremental_publish_equals_full_migration(spark):
    rows = scans(spark)
    state = v.build_versions(rows.filter("revision = 1"), rows.filter("revision = 1"), ["store", "code"], "content")
    for revision in (2, 4, 7):
        state = v.apply_delta(state, rows.filter(F.col("revision") == revision).drop("revision"), revision, ["store", "code"], "content")
    assert as_set(state.select("code", "valid_from", "valid_to", "content")) == as_set(
        v.build_versions(rows, rows, ["store", "code"], "content").select("code", "valid_from", "valid_to", "content"))
    repeated = v.apply_delta(state, rows.filter("revision = 7").drop("revision"), 8, ["store", "code"], "content")
    assert v.table_differences(state, repeated).count() == 0


def test_tombstones_hide_and_return(spark):
    state = spark.createDataFrame([("a", 1, None, "x", False), ("b", 1, None, "y", False)], "name string, valid_from int, valid_to int, content string, is_deleted boolean")
    gone = v.apply_delta(state, spark.createDataFrame([("a", "x")], "name string, content string"), 2, ["name"], "content", tombstones=True)
    assert as_set(v.latest_version(gone, ["name"], 2).select("name")) == {("a",)}
    assert as_set(v.latest_version(gone, ["name"], 1).select("name")) == {("a",), ("b",)}
    quiet = v.apply_delta(gone, spark.createDataFrame([("a", "x")], "name string, content string"), 3, ["name"], "content", tombstones=True)
    assert v.table_differences(gone, quiet).count() == 0
    back = v.apply_delta(quiet, spark.createDataFrame([("a", "x"), ("b", "y")], "name string, content string"), 4, ["name"], "content", tombstones=True)
    assert as_set(v.latest_version(back, ["name"], 4).select("name")) == {("a",), ("b",)}


def test_delta_kinds(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1)], "code string, content string, price int")
    new = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("d", "1", 1)], "code string, content string, price int")
    delta = v.classify_delta(old, new, ["code"], "content", "price")
    assert as_set(delta) == {("a", "unchanged", False), ("b", "updated", False), ("c", "removed", False), ("d", "added", True)}
    gates = {r.gate: r.ok for r in quality.reconciliation_gate(delta).collect()}
    assert gates["count_reconciliation"]


def test_two_level_lag_equals_window_on_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, rng.randrange(3)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, x int")
    plain = df.withColumn("prev", F.lag("x").over(Window.partitionBy("k").orderBy("t"))).select("k", "t", "prev")
    for width in (7, 1000):
        ours = v.with_previous(df, ["k"], ["t"], ["x"], F.floor(F.col("t") / width)).select("k", "t", F.col("previous.x").alias("prev"))
        assert v.table_differences(plain, ours).count() == 0


def test_retention_keeps_what_a_snapshot_reads(spark):
    rows = scans(spark)
    versions = v.build_versions(rows, rows, ["store", "code"], "content")
    kept = v.retained_versions(versions, rows.filter("revision >= 4").select("store", "revision"))
    for revision in (4, 7):
        assert as_set(v.as_of_revision(kept, revision)) == as_set(v.as_of_revision(versions, revision))
    assert kept.count() < versions.count()


def test_upsert_and_layout_union(spark):
    rows = scans(spark)
    later = rows.filter("revision > 2")
    read = v.union_layouts(rows, v.build_versions(later, later, ["store", "code"], "content"), later)
    assert as_set(read.select("store", "revision", "code", "content")) == as_set(rows)
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, c string")
    new = spark.createDataFrame([(2, "z"), (3, "d"), (1, "a")], "k int, c string")
    assert as_set(v.upsert_if_changed(old, new, ["k"], "c")) == {(1, "a", "kept"), (2, "z", "updated"), (3, "d", "inserted")}


def test_batch_gates(spark):
    rows = spark.createDataFrame([("a", "2024-01-10 10:00:00"), ("a", "2024-01-10 10:00:00"), ("b", None)], "code string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    previous = spark.createDataFrame([(5,)], "n bigint")
    gates = {r.gate: r.ok for r in quality.batch_gates(rows, ["code"], "at", F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"), previous).collect()}
    assert gates == {"non_empty": True, "unique_codes": False, "observation_time_known": False, "no_stale_observation": False, "shrink_guard": False}


def test_positions_and_parts(spark):
    df = spark.range(103).withColumn("id", F.col("id") * 3)
    order = [F.col("id").asc()]
    positions = batching.with_position(df, order).orderBy("id").collect()
    assert [r.position for r in positions] == list(range(1, 104))
    parts = {r.part: r["rows"] for r in batching.part_summary(batching.equal_parts(df, 5, order), "id").collect()}
    assert parts == {p: sum(1 for i in range(103) if min(i * 5 // 103, 4) == p) for p in range(5)}
    sized = batching.size_chunks(df.withColumn("n", F.col("id") % 10 + 1), F.col("n"), 20, order)
    per = sized.groupBy("chunk").agg(F.sum("n").alias("s"), F.max("n").alias("m")).collect()
    assert all(r.s - r.m < 20 for r in per)
    both = batching.fixed_batches(batching.compact_parts(batching.numbered(df, order), 4), 25).collect()
    assert {(r.id, r.part, r.batch) for r in both} == {(3 * i, i // 26 + 1, i // 25 + 1) for i in range(103)}
    assert batching.with_position(df.limit(0), order).count() == 0


def test_positions_run_over_many_ranges(spark):
    df = spark.range(5000).withColumn("id", F.col("id") * 7 % 5000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = batching._in_ranges(df, [F.col("id").desc()])
        assert many.select("__range").distinct().count() > 1
        assert [r.position for r in batching.with_position(df, [F.col("id").desc()]).orderBy(F.col("id").desc()).collect()] == list(range(1, 5001))
        running = {r.id: r.running for r in batching.with_running_sum(df, F.col("id"), [F.col("id").asc()]).collect()}
        assert running[4999] == sum(range(5000)) and running[10] == 55
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.position for r in batching.with_position(df, [F.col("id").desc()]).orderBy(F.col("id").desc()).collect()] == list(range(1, 5001))
    running = {r.id: r.running for r in batching.with_running_sum(df, F.col("id"), [F.col("id").asc()]).collect()}
    assert running[4999] == sum(range(5000)) and running[10] == 55
