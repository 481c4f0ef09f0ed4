"""Exact duplicates by a tree of merges over sorted digest runs.

Every partition of the input is a *run*: its digests sorted and reduced to one row each.  In each
round the runs whose number agrees after the lowest bits are cleared merge, ``2 ** bits`` ways at
once, as along a binomial tree.  A merged run is itself dealt out by digest, so no round and no
level ends in one task, and a text with very many copies has shrunk to one row a run before
anything is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import PLACE, WHITE, keep_rows, row_name, with_place
from .registry import query, table

#: What makes two texts equal: the digest, and as proof a second hash and the length.
SAME = ["__digest", "__hash", "__length"]


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE + "+", "")


def digest_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One slim row per document: its run, row number, digest with proof, and rank among its copies."""
    lean = docs.select(
        F.col(doc_id).alias("doc_id"), F.spark_partition_id().alias("__run"), row_name(row).alias("__row"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("__chars"), normalised(F.col(text)).alias("__text"))
    return lean.select(
        "doc_id", "__run", "__row", "__chars", F.unhex(F.sha2(F.col("__text"), 256)).alias("__digest"),
        F.xxhash64("__text").alias("__hash"), F.octet_length("__text").alias("__length"))


def merge_runs(digests: DataFrame, runs: int, bits: int = 3) -> DataFrame:
    """Per distinct text the row that stays and the number of copies, merged level by level."""
    best = F.struct((-F.col("__chars")).alias("chars"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("__row").alias("row"))
    level = digests.groupBy("__run", *SAME).agg(F.min(best).alias("__best"), F.count(F.lit(1)).alias("group_size"))
    while runs > 1:
        runs = -(-runs >> bits)
        level = level.withColumn("__run", F.shiftright("__run", bits)).groupBy("__run", *SAME).agg(
            F.min("__best").alias("__best"), F.sum("group_size").alias("group_size"))
    return level.drop("__run")


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 3, row: str | None = None) -> DataFrame:
    """Per document: ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``; also ``__row``, the column ``row`` or a number of this read.

    Texts are equal when they agree without white space.  Of equal texts the longest original
    stays, then the smallest id.  Null text is empty text; empty texts are equal to one another.  A
    null id ranks last.  Of fully repeated rows exactly one is kept.  No input gives no rows, and
    columns besides the named ones are not read.
    """
    digests = cut_lineage(digest_rows(docs, doc_id, text, row))
    groups = merge_runs(digests, digests.rdd.getNumPartitions(), bits)
    return digests.join(groups, SAME).select(
        "doc_id", F.col("__best.doc_id").alias("keep_id"), "group_size", (F.col("__row") == F.col("__best.row")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"), "__row")


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with their own columns."""
    placed = with_place(docs)
    return keep_rows(placed, mark_copies(placed, doc_id, text, row=PLACE).filter("kept").select("__row"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
"""


@query("op4_exact_dedup", SQL)
def op4_exact_dedup(spark, folder):
    return mark_copies(table(spark, folder, "documents")).drop("__row")
