"""Unit prices, exclusion reasons, line costs and pack options as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import calendar as cal
from .money import MAPPED_PACKAGE_PRICE_UNITS, PACKAGE_PRICE_UNITS, exact_cost, ore, price_unit_key

GENERAL_CAMPAIGN = "GENERAL"


def basis_unit(basis: Column) -> Column:
    return F.when(basis == "kg", "g").when(basis == "l", "ml").otherwise("piece")


def comparable_unit_price(price_ore: Column, price_unit: Column, compare_ore: Column, compare_unit: Column, pack: Column,
                          basis: Column) -> Column:
    """Price per kg / l / piece from the list price, the pack, or the compare price."""
    unit = price_unit_key(price_unit)
    compare = F.regexp_replace(F.regexp_replace(F.lower(compare_unit), "^kr/", ""), r"\s", "")
    per = F.when(basis == "piece", 1.0).otherwise(1000.0)
    packed = (pack["unit"] == basis_unit(basis)) & (pack["quantity"] > 0) & ~pack["approximate"]
    from_package = F.when(packed, price_ore / pack["quantity"] * per).when(
        compare == F.when(basis == "piece", "st").otherwise(basis), compare_ore.cast("double"))
    return F.when(
        price_ore.isNotNull(),
        F.when(unit == F.concat(F.lit("kr/"), basis), price_ore.cast("double")).when(unit.isin(*PACKAGE_PRICE_UNITS), from_package),
    )


def conditional_offer(offers: Column) -> Column:
    """An applied offer that needs more than one item or a special campaign."""
    return F.exists(
        F.coalesce(offers, F.array().cast("array<struct<applied:boolean,qualifying_count:int,campaign_type:string>>")),
        lambda o: F.coalesce(o["applied"], F.lit(False))
        & (F.coalesce(o["qualifying_count"] > 1, F.lit(False)) | F.coalesce((o["campaign_type"] != GENERAL_CAMPAIGN) & (o["campaign_type"] != ""), F.lit(False))),
    )


def candidate_exclusion(policy_reason: Column, available: Column, price_ore: Column, deposit_ore: Column, unit_price: Column,
                        observed: Column, expires: Column, now: Column, conditional: Column) -> Column:
    """Ordered reason a candidate cannot be bought now, or NULL."""
    return F.coalesce(
        policy_reason,
        F.when(~F.coalesce(available, F.lit(False)), F.lit("unavailable")),
        F.when(price_ore.isNull() | deposit_ore.isNull() | unit_price.isNull(), F.lit("price_or_comparison_basis_unknown")),
        F.when((expires <= cal.utc(now)) | ~cal.scan_is_current(observed, now), F.lit("stale_price")),
        F.when(conditional, F.lit("conditional_price")),
    )


def is_available(online: Column, out_of_stock: Column, cart_disabled: Column, price_ore: Column) -> Column:
    return F.coalesce(online & ~out_of_stock & ~cart_disabled, F.lit(False)) & price_ore.isNotNull()


def mapped_pack_price(price_ore: Column, price_unit: Column, deposit_ore: Column, quantity: Column, unit: Column) -> Column:
    """Hundredths for one mapped pack; NULL when the listed basis cannot price it."""
    key = price_unit_key(price_unit)
    measured = (quantity > 0) & (quantity <= 1_000_000) & (((key == "kr/kg") & (unit == "g")) | ((key == "kr/l") & (unit == "ml")))
    return F.when(
        price_ore.isNotNull() & deposit_ore.isNotNull(),
        F.when(key.isin(*MAPPED_PACKAGE_PRICE_UNITS), price_ore).when(measured, ore(price_ore * quantity / 1000)),
    )


def public_promotion(regular_ore: Column, offers: Column, now: Column) -> Column:
    """Cheapest public fixed-price single-item offer valid now, else the regular price.

    Offers are struct(amount_ore, type, member_only, minimum, starts, ends).
    Returns struct(amount_ore, minimum, starts, ends), NULL when the regular price is unknown.
    """
    at = cal.utc(now)
    fit = F.filter(
        F.coalesce(offers, F.array()),
        lambda o: F.coalesce(
            ~o["member_only"] & (o["type"] == "FIXED_PRICE") & o["amount_ore"].isNotNull()
            & (o["minimum"].isNull() | (o["minimum"] == 1)) & (o["starts"] <= at) & (o["ends"] >= at),
            F.lit(False),
        ),
    )
    best = F.array_min(F.transform(fit, lambda o: F.struct(o["amount_ore"].alias("amount_ore"), o["starts"].alias("starts"), o["ends"].alias("ends"))))
    return F.when(
        regular_ore.isNotNull(),
        F.struct(
            F.coalesce(best["amount_ore"], regular_ore).alias("amount_ore"),
            F.when(best.isNotNull(), 1).alias("minimum"),
            best["starts"].alias("starts"),
            best["ends"].alias("ends"),
        ),
    )


def observation_usable(verified: Column, availability: Column, checked: Column, expires: Column, amount_ore: Column,
                       member_only: Column, minimum: Column, valid_from: Column, valid_until: Column, now: Column) -> Column:
    at = cal.utc(now)
    test = (
        verified & (availability == "available") & cal.scan_is_current(checked, now) & (cal.utc(expires) > at)
        & (cal.week_end(checked) > at) & (amount_ore >= 0) & ~F.coalesce(member_only, F.lit(False))
        & F.coalesce(minimum <= 1, F.lit(True)) & F.coalesce(cal.utc(valid_from) <= at, F.lit(True))
        & F.coalesce(cal.utc(valid_until) > at, F.lit(True))
    )
    return F.coalesce(test, F.lit(False))


#: Failure reasons of an option, most informative first (fixed order).
OPTION_REASON_PRIORITY = (
    "dietary_policy_excluded", "conditional_price_excluded", "price_or_deposit_unknown", "price_unknown",
    "drained_weight_basis_requires_review", "package_quantity_or_unit_unknown", "price_outside_validity_window",
    "product_unavailable_stale_or_wrong_store", "approved_product_not_observed",
)
NO_OPTION = "no_approved_compatible_product"


def option_failure(current: Column, has_price: Column, member_only: Column, minimum: Column, amount_ore: Column,
                   deposit_ore: Column, valid_from: Column, valid_until: Column, policy_reason: Column, basis: Column,
                   pack: Column, unit: Column, now: Column) -> Column:
    """Ordered reason an observed product cannot serve a need in ``unit``, or NULL."""
    at = cal.utc(now)
    by_measure = basis.isin("kg", "l")
    wrong_basis = by_measure & (unit != basis_unit(basis))
    pack_bad = pack.isNull() | pack["approximate"] | (pack["unit"] != unit) | ~(pack["quantity"] > 0)
    return F.coalesce(
        F.when(~current, F.lit("product_unavailable_stale_or_wrong_store")),
        F.when(~has_price, F.lit("price_unknown")),
        F.when(F.coalesce(member_only, F.lit(False)) | F.coalesce(minimum > 1, F.lit(False)), F.lit("conditional_price_excluded")),
        F.when(~F.coalesce((amount_ore >= 0) & (deposit_ore >= 0), F.lit(False)), F.lit("price_or_deposit_unknown")),
        F.when(F.coalesce(cal.utc(valid_from) > at, F.lit(False)) | F.coalesce(cal.utc(valid_until) <= at, F.lit(False)),
               F.lit("price_outside_validity_window")),
        F.when(policy_reason.isNotNull(), F.lit("dietary_policy_excluded")),
        F.when(wrong_basis, F.lit("price_basis_unit_mismatch")),
        F.when(by_measure & F.coalesce(pack["approximate"], F.lit(False)), F.lit("approximate_variable_weight")),
        F.when(by_measure & (deposit_ore != 0), F.lit("variable_weight_deposit_basis_unknown")),
        F.when(~by_measure & (unit == "g") & pack["drained_grams"].isNotNull(), F.lit("drained_weight_basis_requires_review")),
        F.when(~by_measure & F.coalesce(pack_bad, F.lit(True)), F.lit("package_quantity_or_unit_unknown")),
    )


def pack_option(quantity: Column, basis: Column, amount_ore: Column, deposit_ore: Column, pack_quantity: Column) -> Column:
    """Packs, capacity, consumed, deposit, purchase and leftover of covering ``quantity`` with one product."""
    weighed = basis.isin("kg", "l")
    packs = F.when(~weighed, F.ceil(quantity / pack_quantity).cast("bigint"))
    capacity = F.when(weighed, quantity).otherwise(packs * pack_quantity)
    consumed = exact_cost(F.when(weighed, amount_ore * quantity / 1000).otherwise(amount_ore * quantity / pack_quantity))
    deposit = F.when(weighed, deposit_ore).otherwise(packs * deposit_ore)
    return F.struct(
        packs.alias("packs"),
        capacity.alias("capacity"),
        consumed.alias("consumed"),
        deposit.alias("deposit_ore"),
        F.when(weighed, consumed + deposit).otherwise(exact_cost(packs * (amount_ore + deposit_ore))).alias("purchase"),
        (capacity - quantity).alias("leftover"),
    )
