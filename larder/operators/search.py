"""Title search over a stored posting table, kept by deltas.

Layout below ``root``: ``postings/revision=N/bucket=B`` holds (gram, id, present), ``counts/revision=N/bucket=B`` holds (gram, change).  A
gram lies in one bucket, so a search reads the folders of its grams' buckets and no others; inside, files are sorted by gram, and
row groups of other grams are skipped.  A revision is written once for the titles that changed, whatever the size of
the table; ``compact`` folds revisions into one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .recipes import GRAM, grams

BUCKETS = 64


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def postings_of(titles: DataFrame, key: str, title: str) -> DataFrame:
    """(id, gram) of all titles of three or more characters, ignoring case."""
    return titles.select(F.col(key).alias("id"), F.explode(grams(F.lower(F.col(title)), GRAM)).alias("gram"))


def _write(rows: DataFrame, folder: str) -> None:
    # buckets of one size: adaptive execution splits those of common grams and joins small ones
    placed = rows.withColumn("bucket", bucket_of(F.col("gram"))).hint("rebalance", "bucket")
    placed.sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def _write_revision(changes: DataFrame, root: str, revision: int) -> None:
    """``changes`` (gram, id, present) as revision ``revision``; a retry overwrites it."""
    _write(changes, f"{root}/postings/revision={revision}")
    change = F.sum(F.when(F.col("present"), 1).otherwise(-1)).alias("change")
    _write(changes.groupBy("gram").agg(change), f"{root}/counts/revision={revision}")


def store_postings(titles: DataFrame, root: str, key: str, title: str) -> None:
    """The first revision: postings of all titles."""
    _write_revision(postings_of(titles, key, title).withColumn("present", F.lit(True)), root, 0)


def update_postings(before: DataFrame, after: DataFrame, root: str, key: str, title: str, revision: int) -> None:
    """Postings that a delta adds or takes away.

    ``before`` and ``after`` hold the changed titles only: new ones are missing from the first, removed ones from the second.
    """
    old, new = postings_of(before, key, title), postings_of(after, key, title)
    gone = old.join(new, ["id", "gram"], "left_anti").withColumn("present", F.lit(False))
    come = new.join(old, ["id", "gram"], "left_anti").withColumn("present", F.lit(True))
    _write_revision(gone.unionByName(come), root, revision)


def read_postings(spark: SparkSession, root: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """(gram, id) as of the latest revision, of all or some buckets; the filter prunes folders."""
    rows = spark.read.parquet(f"{root}/postings")
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(*buckets))
    latest = rows.groupBy("gram", "id").agg(F.max_by("present", "revision").alias("present"))
    return latest.filter("present").select("gram", "id")


def compact(spark: SparkSession, root: str, target: str) -> None:
    """All revisions as the first one of a table in ``target``."""
    _write_revision(read_postings(spark, root).withColumn("present", F.lit(True)), target, 0)


def _rarest(spark: SparkSession, root: str, asked: Mapping[int, str]) -> list[tuple[int, str, str, int]]:
    """(query, text, its rarest gram, bucket): at most one row a query, from the counts of the queries' grams."""
    parts = [(i, q, q[k : k + GRAM]) for i, q in asked.items() for k in range(len(q) - GRAM + 1)]
    probes = spark.createDataFrame(parts, "query_id int, q string, gram string").distinct().withColumn("bucket", bucket_of(F.col("gram")))
    # as many buckets as the queries have grams
    buckets = [r.bucket for r in probes.select("bucket").distinct().collect()]
    counts = spark.read.parquet(f"{root}/counts").filter(F.col("bucket").isin(*buckets) & F.col("gram").isin(*sorted({g for _, _, g in parts})))
    held = counts.groupBy("gram").agg(F.sum("change").alias("n"))
    best = probes.join(held, "gram", "left").groupBy("query_id", "q").agg(
        F.min_by(F.struct("gram", "bucket"), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("g"))
    return [(r.query_id, r.q, r.g.gram, r.g.bucket) for r in best.collect()]


def search(titles: DataFrame, root: str, key: str, title: str, queries: Mapping[int, str]) -> DataFrame:
    """(query_id, id) of titles that contain each query text, ignoring case.

    A query of three or more characters reads the postings of its rarest gram; its candidates meet the titles by id, and the exact
    test follows.  Shorter queries have no gram and read the titles.  Blank queries find nothing.
    """
    spark = titles.sparkSession
    asked = {i: q.strip().lower() for i, q in queries.items() if q.strip()}
    lowered = titles.select(F.col(key).alias("id"), F.lower(F.col(title)).alias("title"))
    short = [(i, q) for i, q in asked.items() if len(q) < GRAM]
    found = [lowered.filter(F.contains("title", F.lit(q))).select(F.lit(i).alias("query_id"), "id") for i, q in short]
    chosen = _rarest(spark, root, {i: q for i, q in asked.items() if len(q) >= GRAM}) if len(short) < len(asked) else []
    if chosen:
        probes = spark.createDataFrame([c[:3] for c in chosen], "query_id int, q string, gram string")
        rows = read_postings(spark, root, sorted({c[3] for c in chosen})).filter(F.col("gram").isin(*sorted({c[2] for c in chosen})))
        hits = rows.join(probes, "gram").select("query_id", "q", "id").join(lowered, "id")
        found.append(hits.filter(F.contains("title", "q")).select("query_id", "id"))
    if not found:
        return lowered.select(F.lit(None).cast("int").alias("query_id"), "id").limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def posting_differences(titles: DataFrame, root: str, key: str, title: str) -> DataFrame:
    """(gram, id, surplus) that only the titles (0) or only the stored table (1) hold."""
    want, held = postings_of(titles, key, title).select("gram", "id"), read_postings(titles.sparkSession, root)
    both = want.withColumn("surplus", F.lit(0)).unionByName(held.withColumn("surplus", F.lit(1)))
    return both.groupBy("gram", "id").agg(F.count(F.lit(1)).alias("n"), F.max("surplus").alias("surplus")).filter("n = 1").drop("n")

