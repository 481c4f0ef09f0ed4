"""Queries over files that a job lands and reads back: releases, reference tables, snapshot switches, archives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import feeds, tables
from .registry import Tables, query


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/landing-{uuid.uuid4().hex}"


@query("release_scan", """
SELECT 'row' AS kind, o_orderkey AS id, o_orderpriority AS priority FROM orders
UNION ALL SELECT 'release_asset_missing', NULL, NULL UNION ALL SELECT 'release_asset_checksum_mismatch', NULL, NULL""")
def release_scan(t: Tables):
    """Orders as gzip JSON lines, read back, and their files against a manifest with one altered and one absent asset."""
    folder = _folder(t)
    t.orders.select("o_orderkey", "o_orderpriority").write.option("compression", "gzip").json(folder)
    rows = tables.read_release(t.spark, folder, "o_orderkey bigint, o_orderpriority string")
    files = tables.release_files(t.spark, f"{folder}/*.json.gz")
    first = files.agg(F.min("file").alias("first"))
    altered = files.join(first, F.col("file") == F.col("first"), "left").select(
        "file", "bytes", F.when(F.col("first").isNotNull(), F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    absent = first.select(F.lit("absent.json.gz").alias("file"), F.lit(1).cast("bigint").alias("bytes"), F.lit("0").alias("sha256"))
    wrong = tables.release_violations(files, altered.unionByName(absent))
    return rows.select(F.lit("row").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority")).unionByName(
        wrong.select(F.col("violation").alias("kind"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("priority")))


@query("csv_reference_scan", """
SELECT CAST(p_partkey AS VARCHAR) AS fdc_id, p_name || ', "' || p_brand || '" ' || p_type AS description, CAST(p_size AS DOUBLE) AS grams FROM part""")
def csv_reference_scan(t: Tables):
    """Parts as a reference table with quoted texts, read back by a stated schema."""
    folder = _folder(t)
    rows = t.part.select(
        F.col("p_partkey").cast("string").alias("fdc_id"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('" '), "p_type").alias("description"), F.col("p_size").cast("double").alias("grams"))
    rows.write.option("header", True).option("escape", '"').csv(folder)
    return feeds.read_csv(t.spark, folder, "fdc_id string, description string, grams double")


@query("snapshot_switch", """
SELECT 'pinned' AS kind, s_suppkey AS id FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'active', s_suppkey FROM supplier""")
def snapshot_switch(t: Tables):
    """Two published revisions and a third whose manifest was never written: readers see the second, or the one they pin."""
    folder, rows = _folder(t), t.supplier.select(F.col("s_suppkey").alias("id"))
    tables.publish_snapshot(t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("id")), folder, 1)
    tables.publish_snapshot(rows, folder, 2)
    rows.limit(0).write.parquet(f"{folder}/data/revision=3")
    pinned, active = tables.read_snapshot(t.spark, folder, 1), tables.read_snapshot(t.spark, folder)
    return pinned.select(F.lit("pinned").alias("kind"), "id").unionByName(active.select(F.lit("active").alias("kind"), "id"))


@query("scan_archive", """
SELECT event_type, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type
UNION ALL SELECT 'digests that agree', 1, NULL""")
def scan_archive(t: Tables):
    """Events archived as gzip JSON with count and digest; the archive read back has both."""
    folder, columns = _folder(t), "event_id bigint, user_id bigint, event_type string, value double"
    noted = tables.archive_scan(t.events.select("event_id", "user_id", "event_type", "value"), folder).drop("path")
    landed = t.spark.read.schema(columns).json(folder)
    # one row each
    agree = noted.intersect(tables.content_digest(landed)).agg(F.count(F.lit(1)).alias("rows"))
    totals = landed.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))
    return totals.unionByName(agree.select(F.lit("digests that agree").alias("event_type"), "rows", F.lit(None).cast("bigint").alias("ids")))
