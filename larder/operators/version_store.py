"""Versions as stored tables: open rows bucketed by key, closed rows in folders by the revision that closed them.

A publication joins one batch to the open rows.  These are bucketed and written one file a bucket, so only the batch is
exchanged.  The next generation of open rows keeps the buckets; rows that the batch closes go to the folder
``valid_to=revision``, which a retry overwrites, and no closed row is ever read or moved.  Reading a revision skips
the folders of rows closed before it, and ``valid_from`` reaches the scan of the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import versions as v

BUCKETS = 32
#: Snapshot rows that are broadcast at most: two short columns, some ten megabytes.
SMALL_SNAPSHOTS = 500_000


@dataclass(frozen=True)
class VersionStore:
    """Tables of one catalogue.  ``open_rows`` names the current generation; publishing gives a store that names the next one."""

    spark: SparkSession
    folder: str
    open_rows: str
    keys: tuple[str, ...]
    content: str
    payload: tuple[str, ...]
    buckets: int = BUCKETS

    @property
    def columns(self) -> list[str]:
        return [*self.keys, "valid_from", "valid_to", self.content, *self.payload]

    def _save_open(self, rows: DataFrame) -> str:
        name = f"open_rows_{uuid.uuid4().hex}"
        placed = rows.drop("valid_to").repartition(self.buckets, *self.keys)
        placed.write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _save_closed(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("valid_to").parquet(f"{self.folder}/closed")

    def read_open(self) -> DataFrame:
        return self.spark.table(self.open_rows).withColumn("valid_to", F.lit(None).cast("int")).select(self.columns)

    def read_closed(self) -> DataFrame:
        # nothing may have been closed yet
        kinds = StructType([*self.spark.table(self.open_rows).schema.fields, StructField("valid_to", IntegerType())])
        return self.spark.read.schema(kinds).parquet(f"{self.folder}/closed").select(self.columns)

    def read(self) -> DataFrame:
        return self.read_closed().unionByName(self.read_open())

    def publish(self, batch: DataFrame, revision: int) -> VersionStore:
        """One full batch (keys, content, payload): changed and removed rows close, changed and added ones open."""
        live = self.spark.table(self.open_rows).withColumn("__old", F.lit(True))
        rest = [self.content, *self.payload]
        new = batch.select(*self.keys, *[F.col(c).alias(f"__n_{c}") for c in rest], F.lit(True).alias("__new"))
        pairs = live.join(new, list(self.keys), "full_outer")
        was, now = F.col("__old").isNotNull(), F.col("__new").isNotNull()
        same = was & now & F.col(self.content).eqNullSafe(F.col(f"__n_{self.content}"))
        closed = pairs.filter(was & ~same).select(*self.keys, "valid_from", *rest, F.lit(revision).alias("valid_to"))
        stays = pairs.filter(same | now).select(
            *self.keys, F.when(same, F.col("valid_from")).otherwise(F.lit(revision)).alias("valid_from"),
            *[F.when(same, F.col(c)).otherwise(F.col(f"__n_{c}")).alias(c) for c in rest])
        self._save_closed(closed)
        return replace(self, open_rows=self._save_open(stays.withColumn("valid_to", F.lit(None).cast("int"))))

    def at(self, revision: int) -> DataFrame:
        """Rows of one revision: folders of rows closed up to it are not listed, later rows are skipped by their statistics."""
        return self.read().filter((F.col("valid_from") <= revision) & (F.col("valid_to").isNull() | (F.col("valid_to") > revision)))

    def as_of(self, snapshots: DataFrame, scope: Sequence[str] = ("store",)) -> DataFrame:
        """Every row visible in every given snapshot; versions stay where they lie while the snapshots are few.

        Snapshots are one row a scan and are counted first.  Beyond ``SMALL_SNAPSHOTS`` the join on the scope decides by itself.
        """
        side = snapshots.select(*scope, "revision").distinct()
        if side.count() <= SMALL_SNAPSHOTS:
            side = F.broadcast(side)
        return self.read().join(side, list(scope)).filter(v.holds_at(F.col("revision")))

    def drop(self) -> None:
        """Forget the tables' names; their files belong to the folder's owner."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.open_rows}")


def store_versions(versions: DataFrame, folder: str, keys: Sequence[str], content: str, payload: Sequence[str] = (), buckets: int = BUCKETS) -> VersionStore:
    """Write intervals (keys, valid_from, valid_to, content, payload) as a store."""
    empty = VersionStore(versions.sparkSession, folder, "", tuple(keys), content, tuple(payload), buckets)
    rows = versions.select(empty.columns)
    empty._save_closed(rows.filter("valid_to IS NOT NULL"))
    return replace(empty, open_rows=empty._save_open(rows.filter("valid_to IS NULL")))
