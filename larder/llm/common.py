"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

#: Name of a row that does not change between reads.
PLACE = "__place"

#: The ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, return.
WHITE = r"[\x20\x09-\x0D]"
NOT_WHITE = r"[^\x20\x09-\x0D]+"


def doc_key(doc_id: Column) -> Column:
    """CRC-32 of the id's decimal text, by which folds are drawn; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def with_place(docs: DataFrame) -> DataFrame:
    """Add ``__place``, which names a row the same way in every read of the result.

    Rows of a table are named by their file (a 96-bit hash of its path) and their number inside it.  Row ids that Spark
    hands out would not do: they follow the cut of files into tasks, which changes with the number of
    executors, so after a loss a second read would name other rows.  What is not a plain table, or has
    a column ``_metadata`` of its own, is written out once with such ids.
    """
    docs = docs.drop(PLACE)
    is_table = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if is_table and "_metadata" not in docs.columns:
        path = F.col("_metadata.file_path")
        return docs.withColumn(PLACE, F.struct(F.xxhash64(path).alias("file"), F.hash(path).alias("check"), F.col("_metadata.row_index").alias("row")))
    return cut_lineage(docs.withColumn(PLACE, F.monotonically_increasing_id()))


def row_name(row: str | None) -> Column:
    """The given column, or an id that holds for a single read."""
    return F.monotonically_increasing_id() if row is None else F.col(row)


def keep_rows(placed: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``with_place(docs)`` whose place is in the only column of ``kept``, with their own columns."""
    return placed.join(kept.toDF(PLACE), PLACE, "left_semi").select(*[F.col(f"`{c}`") for c in placed.columns if c != PLACE])


def global_rows(df: DataFrame, order: list[str], out: str = "row") -> tuple[DataFrame, int]:
    """Number the rows 0, 1, ... along ``order``, and count them.

    Rows are dealt out by range, numbered inside their range, and shifted by the counts of the
    ranges before; only those counts (one per range) meet in one task.  Rows that are equal in
    ``order`` are spread by a salt, so they may lie in several ranges: they are interchangeable.
    The ranges are written out first, as a second evaluation could draw other bounds.
    """
    salted = df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = cut_lineage(salted.repartitionByRange(*order, "__salt").withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), "__n")
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()["n"]
    inside = Window.partitionBy("__part").orderBy(*order, "__salt")
    # One row per range of the exchange: as many as there are shuffle partitions, hence the broadcast.
    numbered = dealt.withColumn("__i", F.row_number().over(inside)).join(F.broadcast(offsets.drop("__n")), "__part")
    return numbered.withColumn(out, F.col("__before") + F.col("__i") - 1).drop("__part", "__salt", "__i", "__before"), total
