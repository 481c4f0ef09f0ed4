import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from larder.sources import feeds, tables
from larder.streaming import jobs


def test_raw_feed_round_trip(spark, tmp_path):
    rows = [{"code": "a1", "name": "Salt", "priceValue": 12.9, "priceUnit": "kr/st", "displayVolume": "500g", "online": True, "outOfStock": False, "addToCartDisabled": False, "depositPrice": ""},
            {"code": "a2", "name": "Juice", "priceValue": 20, "comparePrice": "11,27 kr", "comparePriceUnit": "l", "online": True, "outOfStock": True, "addToCartDisabled": False, "depositPrice": "2,00",
             "potentialPromotions": [{"applied": True, "qualifyingCount": 2, "campaignType": "GENERAL", "validUntil": 1793000000000}]},
            {"code": "bad code", "name": "x"}, {"code": "a3", "name": "Off", "online": False}]
    (tmp_path / "feed.json").write_text("\n".join(json.dumps(r) for r in rows))
    raw = feeds.online_only(feeds.read_raw(spark, str(tmp_path / "feed.json")))
    got = {r.code: r for r in feeds.normalise(raw, F.lit("shelf"), F.lit("2026-10-14 10:00:00")).collect()}
    assert set(got) == {"a1", "a2"}
    assert (got["a1"].price_ore, got["a1"].deposit_ore, got["a1"].available, got["a1"].pack.quantity) == (1290, 0, True, 500.0)
    assert (got["a2"].compare_ore, got["a2"].deposit_ore, got["a2"].available) == (1127, 200, False)
    assert got["a2"].offer_ends == [dt.datetime(2026, 10, 26, 7, 33, 20)]


def test_snapshot_publish_is_atomic_and_pinned(spark, tmp_path):
    root = str(tmp_path / "cat")
    first = tables.publish_snapshot(spark.range(5), root, 1).first()
    tables.publish_snapshot(spark.range(7), root, 2)
    spark.range(99).write.parquet(f"{root}/data/revision=3")
    assert first["rows"] == 5 and tables.active_revision(spark, root) == 2
    assert tables.read_snapshot(spark, root).count() == 7 and tables.read_snapshot(spark, root, 1).count() == 5


def test_chunks_release_and_manifest(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") * 2).alias("v"))
    manifest = tables.write_chunks(df, str(tmp_path / "out"), F.lit("recipes"), F.floor(F.col("id") / 4), str(tmp_path / "manifest"))
    assert {(r.chunk, r["rows"]) for r in manifest.collect()} == {(0, 4), (1, 4), (2, 2)}
    assert spark.read.schema("id bigint, v bigint").json(str(tmp_path / "out")).count() == 10
    folder = tmp_path / "rel"
    folder.mkdir()
    with gzip.open(folder / "day-1.jsonl.gz", "wt") as f:
        f.write('{"id": 1}\n{"id": 2}\n')
    assert {r.part_file for r in tables.read_release(spark, str(folder), "id bigint").collect()} == {"day-1.jsonl.gz"}
    files = tables.release_files(spark, str(folder))
    good = files.select("file", "bytes", "sha256")
    assert tables.release_violations(files, good).count() == 0
    broken = good.withColumn("sha256", F.lit("0")).unionByName(good.withColumn("file", F.lit("day-2.jsonl.gz")))
    assert {r.violation for r in tables.release_violations(files, broken).collect()} == {"release_asset_checksum_mismatch", "release_asset_missing"}
    assert tables.archive_scan(df, str(tmp_path / "archive")).first()["rows"] == 10


def test_csv_and_readiness(spark, tmp_path):
    (tmp_path / "food.csv").write_text("fdc_id,description\n1,Honey\n")
    assert feeds.read_csv(spark, str(tmp_path / "food.csv"), "fdc_id string, description string").first().description == "Honey"
    docs = spark.createDataFrame([('{"counts": {"12": 3, "07": 1, "9": -1}}',), ('{"buildId": "x", "5": 0}',)], "d string")
    got = {(r.recipe_id, r.unresolved, r.violation) for r in feeds.readiness_counts(docs, "d").collect()}
    assert got == {(12, 3, None), (None, 1, "noncanonical_recipe_id"), (9, None, "invalid_count"), (5, 0, None)}


def test_category_cycle_is_reported(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("r", "c")], "parent string, child string")
    got = {(r.root, r.node, r.depth, r.cyclic) for r in feeds.category_closure(edges).collect()}
    assert got == {("r", "a", 1, True), ("r", "b", 2, True), ("a", "b", 1, True), ("b", "a", 1, True), ("a", "a", 2, True), ("b", "b", 2, True), ("r", "c", 1, False)}
    assert {r.node for r in feeds.leaf_nodes(edges).collect()} == {"c"}


def test_closure_holds_every_pair_once(spark):
    lattice = [(f"{i}{a}", f"{i + 1}{b}") for i in range(29) for a in "xy" for b in "xy"]
    rows = feeds.category_closure(spark.createDataFrame(lattice, "parent string, child string")).collect()
    assert len(rows) == 4 * 30 * 29 // 2 and all(r.depth == int(r.node[:-1]) - int(r.root[:-1]) and not r.cyclic for r in rows)
    chain = [(i, i + 1) for i in range(70)] + [(0, 65), (3, 3)]
    got = {(r.root, r.node): (r.depth, r.cyclic) for r in feeds.category_closure(spark.createDataFrame(chain, "parent int, child int")).collect()}
    assert got[(0, 70)] == (6, False) and got[(1, 70)] == (69, False) and got[(3, 3)] == (1, True) and len(got) == 71 * 70 // 2 + 1
    assert feeds.category_closure(spark.createDataFrame([], "parent int, child int")).count() == 0


def _write_batches(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part{i:03d}")


def test_changes_follow_keys_across_micro_batches(spark, tmp_path):
    schema = "k string, ts timestamp_ntz, n int, price int"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[("a", at(5 * i + j), 5 * i + j, (5 * i + j) // 3) for j in range(5)] + [("b", at(5 * i), 5 * i, 1)] for i in range(8)]
    batches[4].append(("a", at(1), 999, 77))
    _write_batches(spark, str(tmp_path / "in"), batches, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = jobs.price_changes(stream, str(tmp_path / "out"), ["k"], ["ts", "n"], ["price"])
    query.awaitTermination()
    history = spark.read.parquet(str(tmp_path / "out/history"))
    assert sorted((r.k, r.n) for r in history.collect()) == sorted([("a", n) for n in range(0, 40, 3)] + [("b", 0)])
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out/late")).collect()] == [999]
    assert sorted((r.k, r.n, r.price) for r in jobs.current_state(spark, str(tmp_path / "out")).collect()) == [("a", 39, 13), ("b", 35, 1)]


def test_a_repeat_needs_a_younger_kept_row(spark, tmp_path):
    schema = "k string, ts timestamp, n int"
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    # 20, 20 and 20 minutes apart: the second repeats the first, the third is 40 minutes after the last kept one
    batches = [[("a", at(0), 1), ("a", at(20), 2), ("b", at(5), 5)], [("a", at(40), 3)], [("a", at(60), 4), ("b", at(35), 6), ("c", None, 7)], [("a", at(300), 8), ("a", at(300), 9)], [("a", at(10), 10)]]
    _write_batches(spark, str(tmp_path / "in"), batches, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    kept = jobs.drop_repeats(stream, "ts", ["k"], ["n"])
    assert kept.columns == ["k", "ts", "n"]
    jobs.write_table(kept, str(tmp_path / "kept"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [1, 3, 5, 6, 8]


def test_closed_weeks_are_not_written_again(spark, tmp_path):
    schema = "k string, ts timestamp_ntz"
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    counts, out = None, str(tmp_path / "weeks")

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, per_trigger=None)
        jobs.write_weeks(jobs.weekly_counts(stream, "ts", ["k"]), out, str(tmp_path / "checkpoint")).awaitTermination()
        return {(str(r.week_end)[:10], r.k): r.observations for r in jobs.read_weeks(spark, out, ["k"]).collect()}

    def files():
        return sorted(str(p.relative_to(out)) for p in (tmp_path / "weeks").rglob("*.parquet") if "week=2024-01-07" in str(p))

    assert run([("a", day(1)), ("a", day(2))]) == {("2024-01-07", "a"): 2}
    counts = run([("a", day(3)), ("b", day(8))])
    assert counts == {("2024-01-07", "a"): 3, ("2024-01-14", "b"): 1}
    before = files()
    # the first week ended more than a day before the second one: it is closed, the second is not
    assert run([("a", day(4)), ("b", day(9))]) == {("2024-01-07", "a"): 3, ("2024-01-14", "b"): 2}
    assert files() == before


def test_two_misses_in_a_row(spark, tmp_path):
    schema = "k string, ts int, seen boolean"
    _write_batches(spark, str(tmp_path / "in"), [[("a", 1, True), ("b", 1, False)], [("a", 2, False), ("b", 2, True)], [("a", 3, False), ("b", 3, False)]], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    jobs.confirmed_misses(stream, str(tmp_path / "out"), ["k"], ["ts"]).awaitTermination()
    assert [(r.k, r.ts) for r in spark.read.parquet(str(tmp_path / "out/confirmed")).collect()] == [("a", 3)]


def test_verdicts(spark):
    now = F.lit("2026-10-14 12:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame([("2026-10-14 12:01:01",), ("2026-10-14 12:01:00",), ("2026-10-11 21:59:59",)], "t string")
    assert [r[0] for r in df.select(jobs.verdict(F.col("t").cast("timestamp_ntz"), now)).collect()] == ["future", "accepted", "previous_week"]
