"""Positions, equal parts and size-bounded chunks without a single-task sort.

Without keys, rows are dealt out in ranges of their order, numbered inside their range, and shifted by the counts of the ranges before: one
row per range, as many as the exchange has partitions, meets in one task.  Within keys, rows are numbered inside a
*bucket* that never decreases along the order (a price band, an id range), and only one summary row per bucket is accumulated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

#: A row number that Spark hands out is its partition times this, plus its place in the partition.
PLACES = 1 << 33


def _in_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in ranges of ``order``, with ``__range`` and their place in it, from 0.  Written down, as a second evaluation could draw other bounds."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = cut_lineage(dealt.withColumn("__id", F.monotonically_increasing_id()))
    return numbered.withColumn("__range", F.floor(F.col("__id") / PLACES)).withColumn("__place", F.col("__id") % PLACES).drop("__id")


def _range_offsets(rows: DataFrame, measure: Column) -> DataFrame:
    """Per range what lies before it, and the total: one row per partition of the exchange, hence the broadcast."""
    sums = rows.groupBy("__range").agg(measure.alias("__m"))
    whole = Window.partitionBy()
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("__range", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__offset"), F.sum("__m").over(whole).alias("__total")))


def _ordered_offsets(rows: DataFrame, keys: Sequence[str], measure: Column) -> DataFrame:
    """Per bucket: what lies before it, and the total of its key."""
    sums = rows.groupBy(*keys, "__bucket").agg(measure.alias("__m"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, "__bucket", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__offset"), F.sum("__m").over(whole).alias("__total"))


def with_position(df: DataFrame, order: Sequence[Column], bucket: Column | None = None, keys: Sequence[str] = (), out: str = "position",
                  total: str | None = None) -> DataFrame:
    """Add the 1-based position along ``order`` (per ``keys``, inside a ``bucket``), and the number of rows as ``total``."""
    if not keys:
        rows = _in_ranges(df, order)
        placed = rows.join(_range_offsets(rows, F.count(F.lit(1))), "__range").withColumn(out, F.col("__offset") + F.col("__place") + 1)
    else:
        rows = df.withColumn("__bucket", bucket)
        offsets = _ordered_offsets(rows, keys, F.count(F.lit(1)))
        inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
        numbered = rows.withColumn("__n", F.row_number().over(inside)).join(offsets, [*keys, "__bucket"])
        placed = numbered.withColumn(out, F.col("__offset") + F.col("__n"))
    if total is not None:
        placed = placed.withColumn(total, F.col("__total"))
    return placed.drop("__bucket", "__n", "__range", "__place", "__offset", "__total")


def with_running_sum(df: DataFrame, value: Column, order: Sequence[Column], bucket: Column | None = None, keys: Sequence[str] = (), out: str = "running") -> DataFrame:
    """Add the inclusive running sum of ``value`` along ``order`` (per ``keys``, inside a ``bucket``)."""
    rows = df.withColumn("__v", value)
    if not keys:
        rows = _in_ranges(rows, order)
        offsets = _range_offsets(rows, F.sum("__v"))
        inside = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
        summed = rows.withColumn("__s", F.sum("__v").over(inside)).join(offsets, "__range")
    else:
        rows = rows.withColumn("__bucket", bucket)
        offsets = _ordered_offsets(rows, keys, F.sum("__v"))
        inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        summed = rows.withColumn("__s", F.sum("__v").over(inside)).join(offsets, [*keys, "__bucket"])
    return summed.withColumn(out, F.col("__offset") + F.col("__s")).drop("__bucket", "__range", "__place", "__v", "__s", "__offset", "__total")


NUMBERED = ("__p", "__all")


def numbered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows with their position and number in ``NUMBERED``, from which several divisions follow without another exchange."""
    return with_position(df, order, out="__p", total="__all")


def _divided(df: DataFrame, order: Sequence[Column] | None, out: str, number: Column) -> DataFrame:
    rows = df if order is None else numbered(df, order)
    divided = rows.withColumn(out, number.cast("int"))
    return divided if order is None else divided.drop(*NUMBERED)


def fixed_batches(df: DataFrame, size: int, order: Sequence[Column] | None = None, out: str = "batch") -> DataFrame:
    """Batches of ``size`` rows along ``order``, numbered from 1.  Without an order, ``df`` is ``numbered``."""
    return _divided(df, order, out, F.ceil(F.col("__p") / size))


def equal_parts(df: DataFrame, parts: int, order: Sequence[Column] | None = None, out: str = "part") -> DataFrame:
    """Contiguous parts ``min(floor(index * parts / n), parts - 1)``, numbered from 0.  Without an order, ``df`` is ``numbered``."""
    return _divided(df, order, out, F.least(F.floor((F.col("__p") - 1) * parts / F.col("__all")), F.lit(parts - 1)))


def compact_parts(df: DataFrame, parts: int, order: Sequence[Column] | None = None, out: str = "part") -> DataFrame:
    """Parts of ``ceil(n / parts)`` rows, numbered from 1.  Without an order, ``df`` is ``numbered``."""
    return _divided(df, order, out, F.ceil(F.col("__p") / F.ceil(F.col("__all") / parts)))


def part_summary(parted: DataFrame, key: str, part: str = "part") -> DataFrame:
    return parted.groupBy(part).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))


def size_chunks(df: DataFrame, size: Column, cap: int, order: Sequence[Column], out: str = "chunk") -> DataFrame:
    """Chunk ids such that rows starting in the same ``cap``-byte window share a chunk.

    A chunk holds less than ``cap`` bytes before its last row starts; a single larger row
    stands alone or closes its chunk.
    """
    summed = with_running_sum(df, size, order, out="__end").withColumn("__size", size)
    return summed.withColumn(out, F.floor((F.col("__end") - F.col("__size")) / cap).cast("bigint")).drop("__end", "__size")
