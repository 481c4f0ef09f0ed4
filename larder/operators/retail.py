"""Store-scoped observations: connections, health, availability, tracked refreshes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import calendar as cal
from ..functions.policy import POLICY_VERSION
from ..operators.versions import latest_per_key, upsert_if_changed
from ..session import exchanged
from .linking import TAP_WATER

LOCAL_TTL_MINUTES = 30
MAX_APPROVED = 3


def approved_observations(connections: DataFrame, observations: DataFrame, usable: Column, policy_reason: Column) -> DataFrame:
    """Observed products a reviewed connection approves: same id, unchanged identity, usable, permitted.

    connections (ingredient_id, name, status, policy_version, approved array<struct<product_id, identity>>).
    """
    live = connections.filter((F.col("status") == "matched") & (F.col("policy_version") == POLICY_VERSION))
    wanted = live.select("ingredient_id", "name", "main_product_id", F.explode("approved").alias("__a")).select(
        "ingredient_id", "name", "main_product_id", F.col("__a.product_id").alias("product_id"), F.col("__a.identity").alias("approved_identity"))
    return wanted.join(exchanged(observations), "product_id").filter((F.col("approved_identity") == F.col("identity")) & usable & policy_reason.isNull())


def map_local_ids(approved: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approved rows with local ids, violations).

    approved (ingredient_id, product_id, identity); mappings (reference_product_id,
    reference_identity, local_id, local_ean, local_identity, identity_under_reference_id, checked_at).
    A mapping holds only for the very same package with an EAN.
    """
    side = mappings.withColumnRenamed("reference_product_id", "product_id").withColumn("__mapped", F.lit(True))
    joined = approved.join(side, "product_id", "left")
    good = (
        F.coalesce(F.col("local_id").rlike("^[a-zA-Z0-9_-]{1,100}$"), F.lit(False)) & (F.coalesce(F.col("local_ean"), F.lit("")) != "")
        & F.col("reference_identity").eqNullSafe(F.col("identity")) & F.col("identity_under_reference_id").eqNullSafe(F.col("identity"))
        & F.col("checked_at").isNotNull())
    mapped = F.coalesce("__mapped", F.lit(False))
    keep = joined.filter(~mapped | good).select(
        "ingredient_id", F.when(mapped, F.col("local_id")).otherwise(F.col("product_id")).alias("product_id"),
        F.when(mapped, F.col("local_identity")).otherwise(F.col("identity")).alias("identity"), mapped.alias("mapped"))
    bad = joined.filter(mapped & ~good).select("ingredient_id", "product_id", F.lit("unverified_local_mapping").alias("violation"))
    return keep, bad


def connection_health(connections: DataFrame, usable: DataFrame, identity_changes: DataFrame) -> DataFrame:
    """One status per connection (ingredient_id, name, status, main_product_id).

    usable (ingredient_id, product_id, unit, unit_cost): approved and priced options, ``unit_cost``
    NULL when no comparable cost exists; identity_changes (ingredient_id).  When every usable option
    shares one unit the cheapest wins, otherwise the main product first.  Both picks are
    aggregates; the unit count decides between them afterwards, so no window is needed.
    """
    main = connections.select("ingredient_id", "main_product_id")
    rows = usable.join(exchanged(main), "ingredient_id")
    costed = F.col("unit_cost").isNotNull()
    is_main = (F.col("product_id") == F.col("main_product_id")).cast("int")
    unit = F.coalesce("unit", F.lit("unknown"))
    picks = rows.groupBy("ingredient_id").agg(
        F.min(unit).alias("__u"), F.max(unit).alias("__v"),
        F.min(F.when(costed, F.struct("unit_cost", "product_id"))).alias("__cheap"),
        F.min(F.when(costed, F.struct((-is_main).alias("m"), F.col("product_id")))).alias("__main"))
    joined = connections.join(exchanged(picks), "ingredient_id", "left").join(
        exchanged(identity_changes.select("ingredient_id").distinct().withColumn("__changed", F.lit(True))), "ingredient_id", "left")
    chosen = F.when(F.col("__u") == F.col("__v"), F.col("__cheap.product_id")).otherwise(F.col("__main.product_id"))
    reviewed, changed = F.col("status") == "matched", F.coalesce("__changed", F.lit(False))
    status = F.when(~reviewed, F.col("status")).when(chosen.isNotNull(), "matched").when(changed, "needs_review").otherwise("unavailable")
    reason = (
        F.when(~reviewed, "review_status")
        .when(chosen.isNotNull(), F.when(chosen == F.col("main_product_id"), "approved_main_available").otherwise("approved_alternative_available"))
        .when(changed, "product_identity_changed_review_required").otherwise("no_fresh_public_price_for_approved_product"))
    return joined.select("ingredient_id", "name", status.alias("health"), F.when(reviewed, chosen).alias("product_id"), reason.alias("reason"))


def availability_rows(links: DataFrame, products: DataFrame, now: Column) -> DataFrame:
    """Per name: whether it is broken now and when that answer may change next.

    links (name, status, code); products (code, available, observed_at, offer_ends).
    """
    at, week = cal.utc(now), cal.week_end(now)
    rows = links.join(products.withColumn("__has", F.lit(True)), "code", "left")
    observed = cal.utc(F.col("observed_at"))
    priced = F.col("status") == "matched"
    usable = F.coalesce(F.col("__has") & F.col("available"), F.lit(False)) & observed.isNotNull()
    ends = F.filter(F.coalesce("offer_ends", F.array().cast("array<timestamp_ntz>")), lambda e: e > F.date_trunc("SECOND", observed).cast("timestamp_ntz"))
    stale, settled = cal.week_end(observed), observed - F.expr(f"INTERVAL {cal.FUTURE_TOLERANCE_SECONDS} SECONDS")
    current = cal.scan_is_current(observed, now)
    broken = (
        F.when(~F.col("status").isin("matched", "non_purchased"), True).when(~priced, False).when(~usable, True)
        .otherwise((stale <= at) | (settled > at) | ~current | F.exists(ends, lambda e: e <= at)))
    boundaries = F.concat(
        F.array(F.when(stale > at, stale), F.when(settled > at, settled), F.when(~current & (stale > week), week)),
        F.transform(ends, lambda e: F.when(e > at, e)))
    nearest = F.when(priced & usable, F.array_min(F.filter(boundaries, lambda b: b.isNotNull())))
    return rows.select("name", F.coalesce(broken, F.lit(True)).alias("broken"), nearest.alias("next_change"))


def availability_summary(rows: DataFrame) -> DataFrame:
    """Counts and the next change over all names; the broken names stay a table."""
    return rows.agg(F.count(F.lit(1)).alias("names"), F.count_if("broken").alias("broken"), F.min("next_change").alias("next_change"))


def run_summary(changes: DataFrame, health: DataFrame, boundaries: Sequence[Column], now: Column) -> DataFrame:
    """Report of one refresh: changed / unchanged / price changes, statuses, earliest price boundary."""
    at = cal.utc(now)
    first = F.min(F.array_min(F.filter(F.array(*boundaries), lambda b: b > at)))
    counts = changes.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("action") != "kept").alias("changed"),
                         F.count_if("price_changed").alias("price_changes"), first.alias("earliest_price_boundary"))
    states = health.agg(*[F.count_if(F.col("health") == s).alias(s) for s in ("matched", "needs_review", "unavailable", "non_purchased")])
    from .quality import side_by_side

    return side_by_side(counts, states)


def publish_observations(state: DataFrame, batch: DataFrame, keys: Sequence[str], content: str, price: str) -> tuple[DataFrame, DataFrame]:
    """(new state, history rows): upsert only changed content, append history on a changed price."""
    merged = upsert_if_changed(state, batch, keys, content)
    old = state.select(*keys, F.col(price).alias("__old_price"), F.lit(True).alias("__old"))
    history = batch.join(old, list(keys), "left").filter(F.col("__old").isNull() | ~F.col(price).eqNullSafe(F.col("__old_price"))).drop("__old_price", "__old")
    return merged, history


def refresh_plan(wanted: DataFrame, cached: DataFrame, now: Column) -> DataFrame:
    """Split tracked keys into ``reuse`` (observation younger than 30 minutes) and ``lookup``.

    wanted (scope, product_id) ; cached (scope, product_id, checked_at, expires_at).
    """
    at, checked = cal.utc(now), cal.utc(F.col("checked_at"))
    fresh = (cal.utc(F.col("expires_at")) > at) & (checked <= cal.tolerated(now)) & (checked > at - F.expr(f"INTERVAL {LOCAL_TTL_MINUTES} MINUTES"))
    kept = latest_per_key(cached.filter(fresh), ["scope", "product_id"], ["checked_at"]).select(
        "scope", "product_id", F.lit("reuse").alias("action"))
    missing = wanted.select("scope", "product_id").distinct().join(kept, ["scope", "product_id"], "left_anti").withColumn("action", F.lit("lookup"))
    return kept.join(wanted.select("scope", "product_id").distinct(), ["scope", "product_id"], "left_semi").unionByName(missing)


def confirm_disappearances(tracked: DataFrame, first: DataFrame, second: DataFrame, prior: DataFrame, now: Column) -> DataFrame:
    """Tracked products after two reads: seen, or confirmed missing with the prior identity kept.

    A product missing twice becomes ``unknown`` without a price; without prior evidence it is a violation.
    """
    seen = first.unionByName(second.join(first.select("product_id"), "product_id", "left_anti"))
    lost = tracked.select("product_id").distinct().join(seen.select("product_id"), "product_id", "left_anti")
    before = prior.select("product_id", "name", F.coalesce("last_verified_at", "checked_at").alias("last_verified_at"), F.lit(True).alias("__prior"))
    kept = lost.join(before, "product_id", "left")
    gone = kept.select(
        "product_id", "name", F.lit(None).cast("bigint").alias("price_ore"), F.lit("unknown").alias("availability"),
        cal.utc(now).alias("checked_at"), "last_verified_at",
        F.when(F.col("__prior").isNull(), "confirmed_missing_product_without_prior_identity").alias("violation"))
    found = seen.select("product_id", "name", "price_ore", "availability", "checked_at",
                        F.lit(None).cast("timestamp_ntz").alias("last_verified_at"), F.lit(None).cast("string").alias("violation"))
    return found.unionByName(gone)


def tracked_report(requested: DataFrame, observations: DataFrame, usable: Column, now: Column) -> DataFrame:
    """Stored observation per requested product with ``fresh`` and ``usable`` flags, or ``missing``."""
    rows = requested.select("product_id").distinct().join(observations.withColumn("__has", F.lit(True)), "product_id", "left")
    fresh = F.coalesce((cal.utc(F.col("expires_at")) > cal.utc(now)), F.lit(False)) & cal.scan_is_current(F.col("checked_at"), now)
    has = F.col("__has").isNotNull()
    return rows.withColumn("fresh", has & fresh).withColumn("usable", has & usable).withColumn("missing", ~has).drop("__has")


def connection_violations(connections: DataFrame, products: DataFrame, name_reason: Column) -> DataFrame:
    """Reasons a reviewed connection set is invalid, one row per (ingredient_id, violation).

    products (product_id, identity, policy_reason).
    """
    repeats = connections.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name", F.lit(True).alias("__twice"))
    rows = connections.join(repeats, "name", "left")
    ids = F.transform("approved", lambda a: a["product_id"])
    matched = F.col("status") == "matched"
    bad_set = matched & (
        F.col("main_product_id").isNull() | ~F.size(ids).between(1, MAX_APPROVED)
        | ~F.coalesce(F.array_contains(ids, F.col("main_product_id")), F.lit(False)) | (F.size(F.array_distinct(ids)) != F.size(ids)))
    checks = [
        ("invalid_connection_inventory", F.col("__twice").isNotNull()),
        ("invalid_connection_review", (F.col("policy_version") != POLICY_VERSION) | F.col("reviewed_at").isNull()
         | ~F.col("status").isin("matched", "needs_review", "unavailable", "non_purchased") | name_reason.isNotNull()),
        ("non_purchased_requires_water", (F.col("status") == "non_purchased") & ~F.lower("name").rlike(TAP_WATER)),
        ("unmatched_connection_has_products", ~matched & (F.col("main_product_id").isNotNull() | (F.size(ids) > 0))),
        ("invalid_approved_products", bad_set),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in checks]), lambda v: v.isNotNull())
    own = rows.select("ingredient_id", F.explode(found).alias("violation"))
    links = connections.select("ingredient_id", F.explode("approved").alias("__a")).select(
        "ingredient_id", F.col("__a.product_id").alias("product_id"), F.col("__a.identity").alias("approved_identity"))
    joined = links.join(products, "product_id", "left").filter(
        F.col("identity").isNull() | (F.col("identity") != F.col("approved_identity")) | F.col("policy_reason").isNotNull())
    return own.unionByName(joined.select("ingredient_id", F.lit("connection_product_not_permitted").alias("violation")).distinct())
