"""Versioned catalogue tables: deltas, SCD-2 intervals, as-of reads, histories, retention.

Layouts
    snapshots   (store, revision)                                    one row per published scan
    entries     (store, revision, code, content, ...)                full scans
    versions    (store, code, valid_from, valid_to, content, ...)    half-open intervals, NULL = open
Every key holds at most one row per revision, so windows over a key are bounded by the
number of retained revisions, whatever share of the raw observations the key had.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F



def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key.  An aggregate, not a window: partial rows combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*")


def classify_delta(before: DataFrame, after: DataFrame, keys: Sequence[str], content: str, price: str) -> DataFrame:
    """added / updated / removed / unchanged per key, and whether the price part changed."""
    old = before.select(*keys, F.col(content).alias("__old"), F.col(price).alias("__old_price"), F.lit(True).alias("__was"))
    new = after.select(*keys, F.col(content).alias("__new"), F.col(price).alias("__new_price"), F.lit(True).alias("__is"))
    was, now = F.col("__was").isNotNull(), F.col("__is").isNotNull()
    change = (
        F.when(~was, "added").when(~now, "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("updated")
    )
    moved = now & (~was | (~F.col("__old").eqNullSafe(F.col("__new")) & ~F.col("__old_price").eqNullSafe(F.col("__new_price"))))
    return old.join(new, list(keys), "full_outer").select(*keys, change.alias("change"), moved.alias("price_changed"))


def build_versions(entries: DataFrame, snapshots: DataFrame, keys: Sequence[str], content: str,
                   payload: Sequence[str] = (), scope: Sequence[str] = ("store",)) -> DataFrame:
    """Intervals from ordered full snapshots; an absence closes an interval, a return opens one.

    ``snapshots`` numbers the scans of each scope, so a missing revision of a key is told
    apart from a scan that never ran.
    """
    over_scans = Window.partitionBy(*scope).orderBy("revision")
    scans = snapshots.select(*scope, "revision").distinct().select(
        *scope, "revision", F.row_number().over(over_scans).alias("__rank"), F.lead("revision").over(over_scans).alias("__next_scan"))
    rows = entries.join(scans, [*scope, "revision"])
    by_key = Window.partitionBy(*keys).orderBy("__rank")
    before = F.lag(F.struct("__rank", content)).over(by_key)
    starts = before.isNull() | (before["__rank"] != F.col("__rank") - 1) | ~before[content].eqNullSafe(F.col(content))
    runs = rows.withColumn("__start", starts).withColumn("__run", F.sum(F.col("__start").cast("int")).over(by_key))
    return runs.groupBy(*keys, "__run").agg(
        F.min("revision").alias("valid_from"),
        F.max_by("__next_scan", "__rank").alias("valid_to"),
        *[F.min_by(c, "__rank").alias(c) for c in (content, *payload)],
    ).drop("__run")


def apply_delta(versions: DataFrame, batch: DataFrame, revision: int, keys: Sequence[str], content: str,
                tombstones: bool = False) -> DataFrame:
    """Publish one full batch: close changed and removed intervals, open new ones, keep the rest.

    With ``tombstones`` a removed key also gets an open row with ``is_deleted``.
    """
    payload = [c for c in versions.columns if c not in (*keys, "valid_from", "valid_to", "is_deleted")]
    is_open = F.col("valid_to").isNull()
    deleted = F.coalesce(F.col("is_deleted"), F.lit(False)) if tombstones else F.lit(False)
    closed = versions.filter(~is_open)
    live = versions.filter(is_open).withColumn("__deleted", deleted)
    new = batch.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in payload], F.lit(True).alias("__new"))
    pairs = live.withColumn("__old", F.lit(True)).join(new, list(keys), "full_outer")
    was, now = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    gone_before = F.coalesce(F.col("__deleted"), F.lit(False))
    same = was & now & ~gone_before & F.col(content).eqNullSafe(F.col(f"__n_{content}"))
    stays = same | (was & ~now & gone_before)
    flag = [F.col("__deleted").alias("is_deleted")] if tombstones else []
    kept = pairs.filter(was).select(
        *keys, "valid_from", F.when(stays, F.col("valid_to")).otherwise(F.lit(revision)).alias("valid_to"), *payload, *flag)
    opened = pairs.filter(now & ~same).select(
        *keys, F.lit(revision).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"),
        *[F.col(f"__n_{c}").alias(c) for c in payload], *([F.lit(False).alias("is_deleted")] if tombstones else []))
    parts = closed.unionByName(kept.select(closed.columns)).unionByName(opened.select(closed.columns))
    if tombstones:
        buried = pairs.filter(was & ~now & ~gone_before).select(
            *keys, F.lit(revision).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"),
            *[F.lit(None).cast(versions.schema[c].dataType).alias(c) for c in payload], F.lit(True).alias("is_deleted"))
        parts = parts.unionByName(buried.select(closed.columns))
    return parts


def holds_at(revision: Column) -> Column:
    return (F.col("valid_from") <= revision) & (F.col("valid_to").isNull() | (F.col("valid_to") > revision))


def as_of(versions: DataFrame, snapshots: DataFrame, scope: Sequence[str] = ("store",)) -> DataFrame:
    """Every version visible in every given snapshot.

    The join is an equi-join on the scope with the interval as its residual.  The snapshot
    side is one row per scan, so adaptive execution turns it into a hash join once its
    measured size allows, and versions do not move.
    """
    side = snapshots.select(*scope, "revision").distinct()
    return versions.join(side, list(scope)).filter(holds_at(F.col("revision")))


def as_of_revision(versions: DataFrame, revision: int) -> DataFrame:
    """One pinned revision: a plain filter that reaches the parquet scan."""
    return versions.filter(holds_at(F.lit(revision)))


def latest_version(versions: DataFrame, keys: Sequence[str], revision: int) -> DataFrame:
    """Newest version per key at a revision, tombstones hidden."""
    seen = versions.filter(holds_at(F.lit(revision)))
    return latest_per_key(seen, keys, ["valid_from"]).filter(~F.coalesce(F.col("is_deleted"), F.lit(False)))


def union_layouts(full_copy: DataFrame, versions: DataFrame, snapshots: DataFrame, scope: Sequence[str] = ("store",)) -> DataFrame:
    """Snapshots kept as full copies and snapshots kept as intervals, read as one table.

    ``snapshots`` lists the interval-backed scans; full copies of those are ignored.
    """
    stored = snapshots.select(*scope, "revision").distinct()
    legacy = full_copy.join(stored, [*scope, "revision"], "left_anti")
    pinned = as_of(versions, stored, scope).drop("valid_from", "valid_to")
    return legacy.unionByName(pinned, allowMissingColumns=True)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], bucket: Column) -> DataFrame:
    """Add ``previous`` = struct of ``values`` of the preceding row of the key (NULL for the first).

    Two levels, so that no task holds a whole key: rows are ordered inside (key, bucket),
    and only one summary row per (key, bucket) is ordered over the key.  ``bucket`` must
    not decrease along ``order`` (a day or week of the event time).
    """
    rows = df.withColumn("__bucket", bucket)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    value = F.struct(*values)
    local = rows.withColumn("__local", F.lag(value).over(inside)).withColumn("__n", F.row_number().over(inside))
    summary = rows.groupBy(*keys, "__bucket").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    carried = summary.select(
        *keys, "__bucket", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__bucket")).alias("__carry"))
    joined = local.join(carried, [*keys, "__bucket"])
    previous = F.when(F.col("__n") == 1, F.col("__carry")).otherwise(F.col("__local"))
    return joined.withColumn("previous", previous).drop("__bucket", "__local", "__n", "__carry")


def changes_only(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], bucket: Column) -> DataFrame:
    """Rows whose ``values`` differ from the preceding row; a first sighting counts as a change."""
    return with_previous(df, keys, order, values, bucket).filter(~F.col("previous").eqNullSafe(F.struct(*values)))


def most_recent(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 100) -> DataFrame:
    """Newest ``n`` rows per key.  The rank filter lets Spark cut each key to ``n`` before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("recency", rank).filter(F.col("recency") <= n)


def upsert_if_changed(target: DataFrame, source: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """New state with ``action`` inserted / updated / kept; rows absent from the source stay."""
    columns = [c for c in target.columns if c not in keys]
    old = target.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in columns], F.lit(True).alias("__old"))
    new = source.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in columns], F.lit(True).alias("__new"))
    was, now = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    differs = ~F.col(f"__o_{content}").eqNullSafe(F.col(f"__n_{content}"))
    takes = now & (~was | differs)
    action = F.when(now & ~was, "inserted").when(now & differs, "updated").otherwise("kept")
    return old.join(new, list(keys), "full_outer").select(
        *keys, *[F.when(takes, F.col(f"__n_{c}")).otherwise(F.col(f"__o_{c}")).alias(c) for c in columns], action.alias("action"))


def insert_once(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the source whose key the target does not hold yet."""
    return source.join(target.select(*keys), list(keys), "left_anti")


def sync_set(current: DataFrame, desired: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Plan to turn ``current`` into ``desired``: insert / update / delete per key."""
    delta = classify_delta(current, desired, keys, content, content)
    action = F.when(F.col("change") == "added", "insert").when(F.col("change") == "removed", "delete").when(
        F.col("change") == "updated", "update")
    return delta.select(*keys, action.alias("action")).filter(F.col("action").isNotNull())


def retained_history(history: DataFrame, observed: str, now: Column, days: int = 90) -> DataFrame:
    return history.filter(F.col(observed) >= now - F.make_interval(days=F.lit(days)))


def retained_versions(versions: DataFrame, snapshots: DataFrame, scope: Sequence[str] = ("store",)) -> DataFrame:
    """Intervals some retained snapshot can still read.

    Only the oldest retained revision of a scope matters for closed intervals, so the
    range semi-join shrinks to an equi-join with one row per scope.
    """
    oldest = snapshots.groupBy(*scope).agg(F.min("revision").alias("__oldest"))
    kept = versions.join(oldest, list(scope), "left").filter(
        F.col("valid_to").isNull() | (F.col("valid_to") > F.coalesce(F.col("__oldest"), F.lit(0))))
    return kept.drop("__oldest")


def table_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row-for-row proof: rows only on one side with their multiplicity; empty means equal."""
    right = right.select(*left.columns)
    signed = left.withColumn("__side", F.lit(1)).unionByName(right.withColumn("__side", F.lit(-1)))
    counted = signed.groupBy(*left.columns).agg(F.sum("__side").alias("surplus"))
    return counted.filter("surplus <> 0")


def changed_rows(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of ``after`` that are new or differ from ``before`` in any value, NULL-safe."""
    old = before.select(*keys, F.struct(*values).alias("__old"))
    joined = after.join(old, list(keys), "left")
    return joined.filter(~F.struct(*values).eqNullSafe(F.col("__old"))).drop("__old")


def active_snapshots(snapshots: DataFrame, scope: Sequence[str] = ("store",)) -> DataFrame:
    """The newest complete snapshot of each scope: one pointer row per scope."""
    return snapshots.groupBy(*scope).agg(F.max("revision").alias("revision"))


def price_links(links: DataFrame, versions: DataFrame, pointer: DataFrame, scope: Sequence[str] = ("store",)) -> DataFrame:
    """Links with the product version that the pinned snapshot of their scope shows; missing products keep a NULL.

    links (store, name, code).
    """
    live = as_of(versions, pointer, scope)
    return links.join(live, [*scope, "code"], "left")


def freshness(entries: DataFrame, observed: str, now: Column, keys: Sequence[str] = ("store",)) -> DataFrame:
    """Oldest observation, whether it is still current, and when it stops being so."""
    from ..functions import calendar as cal

    oldest = entries.groupBy(*keys).agg(F.min(observed).alias("oldest"), F.count(F.lit(1)).alias("products"))
    return oldest.withColumn("fresh", cal.scan_is_current(F.col("oldest"), now)).withColumn("expires_at", cal.week_end(F.col("oldest")))
