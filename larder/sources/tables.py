"""Published tables: atomic snapshot switch, chunked JSON with a manifest, archives, release scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import table_digest

CHUNK_BYTES = 700_000


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row's columns in name order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)


def content_digest(df: DataFrame) -> DataFrame:
    """Order-free digest and count of a whole table, from mergeable sums."""
    return df.select(row_digest(df).alias("__h")).agg(table_digest(F.col("__h")).alias("digest"), F.count(F.lit(1)).alias("rows"))


def publish_snapshot(df: DataFrame, root: str, revision: int) -> DataFrame:
    """Write the partition of one revision, then the manifest row that makes it visible.

    Readers resolve the manifest, so a failed write is never seen and a retry overwrites only its
    own revision.
    """
    target = f"{root}/data/revision={revision}"
    df.write.mode("overwrite").parquet(target)
    written = df.sparkSession.read.parquet(target)
    manifest = content_digest(written).withColumn("revision", F.lit(revision))
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/manifest/revision={revision}")
    return manifest


def active_revision(spark: SparkSession, root: str) -> int:
    listed = spark.read.schema("digest string, rows bigint, revision int").json(f"{root}/manifest")
    return listed.agg(F.max("revision")).first()[0]


def read_snapshot(spark: SparkSession, root: str, revision: int | None = None) -> DataFrame:
    """The active or a pinned revision; only its partition is listed."""
    chosen = active_revision(spark, root) if revision is None else revision
    return spark.read.parquet(f"{root}/data/revision={chosen}")


def write_chunks(df: DataFrame, root: str, kind: Column, chunk: Column, manifest: str) -> DataFrame:
    """Gzip JSON partitioned by (kind, chunk) plus a manifest row per chunk."""
    columns = df.columns
    rows = df.withColumn("kind", kind).withColumn("chunk", chunk)
    rows.repartition("kind", "chunk").write.mode("overwrite").partitionBy("kind", "chunk").option("compression", "gzip").json(root)
    listed = chunk_manifest(rows, columns)
    listed.write.mode("overwrite").json(manifest)
    return listed


def chunk_manifest(rows: DataFrame, columns: list[str]) -> DataFrame:
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    digested = rows.select("kind", "chunk", F.sha2(body, 256).alias("__h"), F.octet_length(body).alias("__n"))
    return digested.groupBy("kind", "chunk").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("__n").cast("bigint").alias("bytes"), table_digest(F.col("__h")).alias("digest"))


def archive_scan(df: DataFrame, path: str) -> DataFrame:
    """Scan archive: gzip JSON and its count and digest."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)
    return content_digest(df).withColumn("path", F.lit(path))


def read_release(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Gzip JSON-lines parts of a release, with the file each row came from."""
    return spark.read.schema(schema).json(path).withColumn("part_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def release_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of landed release assets, hashed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def release_violations(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Assets whose size or checksum differs from the manifest, and missing ones."""
    landed = files.select("file", F.col("bytes").alias("__b"), F.col("sha256").alias("__s"))
    joined = manifest.join(landed, "file", "left")
    reason = F.when(F.col("__s").isNull(), "release_asset_missing").when(
        (F.col("__b") != F.col("bytes")) | (F.col("__s") != F.col("sha256")), "release_asset_checksum_mismatch")
    return joined.select("file", reason.alias("violation")).filter("violation IS NOT NULL")


def pending_parts(manifest: DataFrame, loaded: DataFrame) -> DataFrame:
    """Parts still to load, and loaded parts whose checksum no longer matches."""
    done = loaded.select("part", F.col("sha256").alias("__s"))
    joined = manifest.join(done, "part", "left")
    state = F.when(F.col("__s").isNull(), "pending").when(F.col("__s") != F.col("sha256"), "conflict").otherwise("loaded")
    return joined.select("part", state.alias("state"))


def load_progress(parts: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows loaded: finished parts by their declared count, open parts by the rows inside their own key ranges.

    parts (part, rows, first_id, last_id, finished): a manifest of a few rows, which the range join broadcasts.
    """
    finished = parts.filter("finished").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("done"))
    open_parts = parts.filter(~F.col("finished")).select("first_id", "last_id")
    counted = rows.select(F.col(key).alias("__k")).join(open_parts, F.col("__k").between(F.col("first_id"), F.col("last_id")), "left_semi")
    from ..operators.quality import side_by_side

    both = side_by_side(finished, counted.agg(F.count(F.lit(1)).alias("open_rows")))
    return both.select((F.col("done") + F.col("open_rows")).alias("loaded"))
