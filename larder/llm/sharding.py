"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

The permutation of 0 .. n-1 is computed, not stored: a balanced Feistel network permutes the next
even power of two, and numbers that land outside are sent through again until they land inside
(cycle walking; under four rounds on average).  Shard and slot follow from the permuted
number, so any row can be found, or fetched, without a look at the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import global_rows
from .registry import query, table

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser with a key: the round function."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    base = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [int(k) for k in _mix(base, seed % 2**64)]


def _half(n: int) -> np.uint64:
    return np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where each of the row numbers 0 .. n-1 goes."""
    half, keys = _half(n), _keys(seed)
    low = np.uint64((1 << int(half)) - 1)

    def network(x):
        left, right = x >> half, x & low
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & low)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = network(rows.astype(np.uint64))
        while (outside := np.flatnonzero(out >= np.uint64(n))).size:
            out[outside] = network(out[outside])
    return out.astype(np.int64)


def unpermute(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row number that sits at each place."""
    half, keys = _half(n), _keys(seed)
    low = np.uint64((1 << int(half)) - 1)

    def network(x):
        left, right = x >> half, x & low
        for k in reversed(keys):
            left, right = right ^ (_mix(left, k) & low), left
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = network(places.astype(np.uint64))
        while (outside := np.flatnonzero(out >= np.uint64(n))).size:
            out[outside] = network(out[outside])
    return out.astype(np.int64)


def assign_shards(rows: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Add ``row`` (global number along ``order``), ``shard`` and ``slot``.

    Shards hold equally many rows, give or take one, whatever the keys and sizes are; slots run
    from 0 without a gap.  Nulls in ``order`` come first; rows equal in ``order`` are
    interchangeable.  No input gives no rows.  Columns other than ``row``, ``shard`` and ``slot`` pass through.
    """
    numbered, total = global_rows(rows.drop("row", "shard", "slot"), order)
    schema = numbered.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = permute(batch.column("row").to_numpy(zero_copy_only=False), total, seed)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((to % shards).astype(np.int32)), pa.array(to // shards)], names=[*batch.schema.names, "shard", "slot"])

    return numbered.mapInArrow(place, schema)


def write_shards(docs: DataFrame, path: str, order: list[str], shards: int, seed: int = 0) -> None:
    """Write whole documents as ``shard=N`` folders, each sorted by slot."""
    placed = assign_shards(docs, order, shards, seed)
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


@query("op9_feistel_shards")
def op9_feistel_shards(spark, folder):
    """All documents into 24 shards; the row count of shards is what holds, so ``grown_shard`` is null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = assign_shards(slim, ["doc_id", "size", "text_crc32"], 24, seed=2024)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
