"""Stored trigram postings: deltas, parity, and which folders a search reads."""

import pytest
from pyspark.sql import functions as F

from larder.operators import search

TITLES = [(1, "Red Apple Pie"), (2, "apple sauce"), (3, "Baked beans"), (4, "pi"), (5, None), (6, ""), (7, "Äpple och päron"), (8, "x" * 5000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, title string")


def found(df):
    return sorted((r.query_id, r.id) for r in df.collect())


@pytest.fixture()
def stored(spark, tmp_path):
    root = str(tmp_path / "titles")
    search.store_postings(frame(spark, TITLES), root, "id", "title")
    return root


def test_search_finds_what_contains_finds(spark, stored):
    queries = {1: "APPLE", 2: "pi", 3: "e", 4: "apple pie", 5: "nothing", 6: "  ", 7: "ppl", 8: "xxx", 9: "äpp"}
    want = sorted((i, key) for i, q in queries.items() if q.strip() for key, t in TITLES if t and q.lower() in t.lower())
    assert found(search.search(frame(spark, TITLES), stored, "id", "title", queries)) == want
    assert found(search.search(frame(spark, TITLES), stored, "id", "title", {1: " "})) == []


def test_deltas_keep_the_table_equal_to_the_titles(spark, stored, tmp_path):
    before = [(2, "apple sauce"), (3, "Baked beans")]
    after = [(2, "pear sauce"), (9, "new apple")]
    search.update_postings(frame(spark, before), frame(spark, after), stored, "id", "title", 1)
    search.update_postings(frame(spark, [(9, "new apple")]), frame(spark, [(9, "baked apple")]), stored, "id", "title", 2)
    # a retry of the same revision changes nothing
    search.update_postings(frame(spark, [(9, "new apple")]), frame(spark, [(9, "baked apple")]), stored, "id", "title", 2)
    now = [r for r in TITLES if r[0] not in (2, 3)] + [(2, "pear sauce"), (9, "baked apple")]
    titles = frame(spark, now)
    assert search.posting_differences(titles, stored, "id", "title").count() == 0
    assert found(search.search(titles, stored, "id", "title", {1: "apple", 2: "baked", 3: "sauce"})) == [(1, 1), (1, 9), (2, 9), (3, 2)]
    folded = str(tmp_path / "compacted")
    search.compact(spark, stored, folded)
    assert search.posting_differences(titles, folded, "id", "title").count() == 0
    stale = search.posting_differences(frame(spark, TITLES), folded, "id", "title")
    assert {r.surplus for r in stale.select("surplus").distinct().collect()} == {0, 1}


def test_a_search_reads_only_the_buckets_of_its_grams(spark, stored):
    rows = search.read_postings(spark, stored, [search_bucket(spark, "app")])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    everything = spark.read.parquet(f"{stored}/postings").select("bucket").distinct().count()
    scanned = rows.select("gram").distinct().collect()
    assert everything > 10 and {search_bucket(spark, r.gram) for r in scanned} == {search_bucket(spark, "app")}


def search_bucket(spark, gram):
    return spark.range(1).select(search.bucket_of(F.lit(gram)).alias("b")).first().b
