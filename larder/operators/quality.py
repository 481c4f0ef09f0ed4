"""Publication gates: every gate is a row (gate, ok, observed, expected).

Each table is read once: all of its metrics come from a single aggregate that is then
unpivoted into gate rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import calendar as cal

SHRINK_LIMIT_PERCENT = 80


def gate(name: str, ok: Column, observed: Column, expected: Column | None) -> Column:
    return F.struct(
        F.lit(name).alias("gate"), F.coalesce(ok, F.lit(False)).alias("ok"),
        observed.cast("string").alias("observed"),
        (expected if expected is not None else F.lit(None)).cast("string").alias("expected"),
    )


def unpivot(metrics: DataFrame, gates: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    return metrics.select(*keep, F.explode(F.array(*gates)).alias("__g")).select(*keep, "__g.*")


def side_by_side(*one_row_tables: DataFrame) -> DataFrame:
    """Columns of several one-row tables in one row."""
    stacked = one_row_tables[0]
    for table in one_row_tables[1:]:
        stacked = stacked.unionByName(table, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and distinct keys.  Counting per key first keeps the distinct count combinable."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"))


def batch_gates(batch: DataFrame, keys: Sequence[str], observed: str, now: Column | None = None,
                previous_count: DataFrame | None = None) -> DataFrame:
    """J1 non-empty / unique / dated, J2 shrink guard, J5 no stale observation."""
    stale = F.count_if(~cal.scan_is_current(F.col(observed), now)) if now is not None else F.lit(0)
    per_key = batch.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(observed).isNull()).alias("undated"), stale.alias("stale"))
    metrics = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum("undated"), F.lit(0)).alias("undated"), F.coalesce(F.sum("stale"), F.lit(0)).alias("stale"))
    gates = [
        gate("non_empty", F.col("rows") > 0, F.col("rows"), None),
        gate("unique_codes", F.col("rows") == F.col("keys"), F.col("keys"), F.col("rows")),
        gate("observation_time_known", F.col("undated") == 0, F.col("undated"), F.lit(0)),
    ]
    if now is not None:
        gates.append(gate("no_stale_observation", F.col("stale") == 0, F.col("stale"), F.lit(0)))
    if previous_count is not None:
        metrics = side_by_side(metrics, previous_count.select(F.col("n").alias("previous")))
        gates.append(gate("shrink_guard", F.col("rows") * 100 >= F.col("previous") * SHRINK_LIMIT_PERCENT, F.col("rows"), F.col("previous")))
    return unpivot(metrics, gates)


def reconciliation_gate(delta: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Previous + added - removed == new, from a classified delta."""
    counted = delta.groupBy(*keep) if keep else delta.groupBy()
    metrics = counted.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "updated", "removed", "unchanged")],
                          F.count_if(F.col("price_changed")).alias("price_changes"))
    before = F.col("updated") + F.col("removed") + F.col("unchanged")
    after = F.col("updated") + F.col("added") + F.col("unchanged")
    return unpivot(metrics, [
        gate("count_reconciliation", before + F.col("added") - F.col("removed") == after, after, before + F.col("added") - F.col("removed")),
        gate("changed_rows", F.lit(True), F.col("added") + F.col("updated"), None),
        gate("price_changes", F.col("price_changes") <= F.col("added") + F.col("updated"), F.col("price_changes"), None),
    ], keep)


def inventory_gates(inventory: DataFrame, declared: DataFrame, policy_reason: Column) -> DataFrame:
    """Occurrences, distinct names, positive counts and policy of a weighted inventory.

    ``declared`` is one row (occurrences, names).
    """
    per_name = inventory.groupBy("name").agg(F.sum("occurrences").alias("occ"), F.count(F.lit(1)).alias("n"),
                                             F.count_if(policy_reason.isNotNull()).alias("blocked"),
                                             F.count_if(F.coalesce(F.col("occurrences") < 1, F.lit(True))).alias("bad"))
    metrics = per_name.agg(F.sum("occ").alias("occ"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("names"),
                           F.sum("blocked").alias("blocked"), F.sum("bad").alias("bad"))
    metrics = side_by_side(metrics, declared.select(F.col("occurrences").alias("d_occ"), F.col("names").alias("d_names")))
    return unpivot(metrics, [
        gate("inventory_occurrences", F.col("occ") == F.col("d_occ"), F.col("occ"), F.col("d_occ")),
        gate("inventory_names", F.col("names") == F.col("d_names"), F.col("names"), F.col("d_names")),
        gate("inventory_unique", F.col("rows") == F.col("names"), F.col("rows"), F.col("names")),
        gate("inventory_positive", F.col("bad") == 0, F.col("bad"), F.lit(0)),
        gate("inventory_policy", F.col("blocked") == 0, F.col("blocked"), F.lit(0)),
    ])


def same_keys_gate(name: str, left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sides hold exactly the same keys."""
    sides = left.select(*keys, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(
        right.select(*keys, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    per_key = sides.groupBy(*keys).agg(F.max("__l").alias("l"), F.max("__r").alias("r"))
    metrics = per_key.agg(F.count_if(F.col("r") == 0).alias("missing"), F.count_if(F.col("l") == 0).alias("extra"))
    return unpivot(metrics, [gate(name, F.col("missing") + F.col("extra") == 0, F.col("missing") + F.col("extra"), F.lit(0))])


def orphan_gate(name: str, references: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """References that do not exist in the target."""
    lost = references.filter(F.col(key).isNotNull()).join(target.select(key), key, "left_anti")
    return unpivot(lost.agg(F.count(F.lit(1)).alias("n")), [gate(name, F.col("n") == 0, F.col("n"), F.lit(0))])


def page_set_gates(pages: DataFrame) -> DataFrame:
    """A14 / J12 on landed pages (category, page, page_size, declared_total, code): one row per violation.

    A page without rows is a row with NULL code.
    """
    per_page = pages.groupBy("category", "page").agg(
        F.count("code").alias("n"), F.min("declared_total").alias("lo"), F.max("declared_total").alias("hi"),
        F.min("page_size").alias("slo"), F.max("page_size").alias("shi"))
    per_category = per_page.groupBy("category").agg(
        F.sum("n").alias("collected"), F.count(F.lit(1)).alias("pages"), F.min("page").alias("first"), F.max("page").alias("last"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("slo").alias("slo"), F.max("shi").alias("shi"),
        F.count_if(F.col("n") != F.least(F.col("shi"), F.greatest(F.lit(0), F.col("hi") - F.col("page") * F.col("shi")))).alias("short"))
    codes = pages.filter(F.col("code").isNotNull()).groupBy("category", "code").agg(F.count(F.lit(1)).alias("n"))
    repeats = codes.groupBy("category").agg(F.sum(F.col("n") - 1).alias("repeats"))
    row = per_category.join(repeats, "category", "left").na.fill(0, ["repeats"])
    checks = [
        ("category_total_changed", F.col("lo") != F.col("hi")),
        ("page_size_changed", F.col("slo") != F.col("shi")),
        ("page_numbers_not_contiguous", (F.col("first") != 0) | (F.col("pages") != F.col("last") - F.col("first") + 1)),
        ("missing_results", F.col("short") > 0),
        ("duplicate_product_in_category", F.col("repeats") > 0),
        ("incomplete_category", F.col("collected") - F.col("repeats") != F.col("hi")),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks]), lambda v: v.isNotNull())
    return row.select("category", "collected", F.col("hi").alias("declared"), F.explode_outer(found).alias("violation"))


def observation_violation(scope_ok: Column, verified: Column, prior_identity: Column, product_id: Column, name: Column,
                          availability: Column, checked: Column, expires: Column, has_price: Column, amount: Column,
                          basis: Column, deposit: Column, minimum: Column, pack: Column, last_verified: Column) -> Column:
    """First reason an observation is invalid, or NULL."""
    retained = prior_identity & ~has_price & (availability == "unknown")
    longest = F.greatest(cal.week_end(checked), cal.utc(checked) + F.expr("INTERVAL 1 DAY"))
    bad_row = (
        ~scope_ok | (~verified & ~retained) | ~F.coalesce(product_id.rlike("^[a-zA-Z0-9_-]{1,100}$"), F.lit(False))
        | F.coalesce(F.trim(name) == "", F.lit(True)) | ~availability.isin("available", "unavailable", "unknown")
        | checked.isNull() | expires.isNull() | (cal.utc(expires) <= cal.utc(checked)) | (cal.utc(expires) > longest)
    )
    bad_prior = prior_identity & (~retained | last_verified.isNull() | (cal.utc(last_verified) > cal.tolerated(checked)))
    bad_price = has_price & (
        ~F.coalesce(amount >= 0, F.lit(False)) | ~F.coalesce(basis.isin("pack", "kg", "l"), F.lit(False))
        | F.coalesce(deposit < 0, F.lit(False)) | F.coalesce(minimum < 1, F.lit(False)))
    bad_pack = pack.isNotNull() & (
        ~F.coalesce(pack["quantity"] > 0, F.lit(False)) | ~F.coalesce(pack["unit"].isin("g", "ml", "piece"), F.lit(False))
        | F.coalesce(pack["drained_grams"] <= 0, F.lit(False)))
    return F.coalesce(
        F.when(F.coalesce(bad_row, F.lit(True)), F.lit("invalid_product_observation")),
        F.when(F.coalesce(bad_prior, F.lit(False)), F.lit("invalid_prior_product_identity_evidence")),
        F.when(F.coalesce(bad_price, F.lit(False)), F.lit("invalid_product_price")),
        F.when(F.coalesce(bad_pack, F.lit(False)), F.lit("invalid_product_pack")),
    )


def quarantine(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reason)."""
    tagged = df.withColumn("violation", reason)
    return tagged.filter(F.col("violation").isNull()).drop("violation"), tagged.filter(F.col("violation").isNotNull())
