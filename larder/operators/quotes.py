"""Menu quotes: lines, per-recipe cost, shopping list, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import calendar as cal
from ..functions.money import COST_TYPE, PACKAGE_PRICE_UNITS, exact_cost, ore, price_unit_key, round_cost
from ..functions.packs import quantity_text
from ..functions.text import name_key
from ..functions.units import measure_unit, unit_factor, unit_kind


def with_overrides(lines: DataFrame, overrides: DataFrame, keys: tuple[str, ...] = ("menu_id", "recipe_id", "ingredient_index")) -> DataFrame:
    """Attach replacement amounts (quantity, unit) by position."""
    side = overrides.select(*keys, F.struct(F.col("quantity").cast("double").alias("quantity"), F.col("unit").alias("unit")).alias("override"))
    return lines.join(side, list(keys), "left")


def override_violations(lines: DataFrame, overrides: DataFrame, keys: tuple[str, ...] = ("menu_id", "recipe_id", "ingredient_index")) -> DataFrame:
    """Overrides that point at no line or carry no usable amount."""
    bad = ~F.coalesce(F.col("unit").isin("g", "ml", "piece") & (F.col("quantity") > 0) & (F.col("quantity") <= 10_000_000), F.lit(False))
    lost = overrides.join(lines.select(*keys), list(keys), "left_anti").withColumn("violation", F.lit("ingredient_index_out_of_range"))
    return lost.unionByName(overrides.join(lines.select(*keys).distinct(), list(keys), "left_semi").filter(bad).withColumn(
        "violation", F.lit("invalid_amount_override")))


def reference_amounts(lines: DataFrame, aliases: DataFrame, measures: DataFrame) -> DataFrame:
    """Add ``grams_per_unit`` from the conversion tables; NULL when the food or unit is not covered.

    lines (name, unit, ...); aliases (alias, food_id); measures (food_id, unit, size, grams_per_unit),
    where ``size`` is NULL except for counts, which need an explicit size in the name.
    Both dimensions are curated; whether they are broadcast is left to their measured size.
    """
    keyed = lines.withColumn("__key", name_key(F.col("name"))).withColumn("__unit", measure_unit(F.col("unit")))
    size = F.nullif(F.regexp_extract("__key", r"\b(small|medium|large)\b", 1), F.lit(""))
    keyed = keyed.withColumn("__size", F.when(F.col("__unit") == "count", F.coalesce(size, F.lit("?"))).otherwise(""))
    foods = aliases.select(F.col("alias").alias("__key"), "food_id")
    table = measures.select(
        "food_id", F.col("unit").alias("__unit"), F.coalesce("size", F.lit("")).alias("__size"), "grams_per_unit")
    return keyed.join(foods, "__key", "left").join(table, ["food_id", "__unit", "__size"], "left").drop("__key", "__unit", "__size")


def cost_lines(lines: DataFrame, links: DataFrame, products: DataFrame, now: Column, overrides: bool = False) -> DataFrame:
    """Price every recipe line of every menu.

    lines (name, unit, measured_quantity, quantity_conflict, servings, requested_servings[, override,
    grams_per_unit]); links (name, status, code); products (code, price_ore, price_unit,
    deposit_ore, available, observed_at, expires_at, pack).  The lines are joined to links and
    products by equality only; both joins keep every line.  Intermediate values are plain
    columns, so each is computed once and the whole chain stays in generated code.
    """
    linked = lines.join(links.select("name", F.col("status").alias("link_status"), "code"), "name", "left")
    rows = linked.join(products.withColumn("__has", F.lit(True)), "code", "left")
    replaced = F.col("override") if overrides else F.lit(None).cast("struct<quantity:double,unit:string>")
    grams = F.col("grams_per_unit") if "grams_per_unit" in lines.columns else F.lit(None).cast("double")
    pack = {f: F.col(f"pack.{f}") for f in ("quantity", "unit", "drained_grams", "approximate")}
    yes = lambda test: F.coalesce(test, F.lit(False))
    c = F.col

    rows = rows.withColumns({
        "__text": quantity_text(c("measured_quantity")), "__sold": price_unit_key(c("price_unit")),
        "__unit": F.lower(F.trim(F.coalesce(replaced["unit"], c("unit")))), "__over": replaced.isNotNull(),
        "__scale": F.when(c("requested_servings").isNull(), F.lit(1.0)).when(c("servings") > 0, c("requested_servings") / c("servings")),
        "__fresh": yes(c("available") & (c("expires_at") > cal.utc(now))) & cal.scan_is_current(c("observed_at"), now),
        "__by_mass": yes(pack["unit"] == "g"), "__clash": yes(c("quantity_conflict"))})
    rows = rows.withColumns({"__kind": unit_kind(c("__unit")), "__factor": unit_factor(c("__unit")), "__q": F.coalesce(replaced["quantity"], c("__text"))})
    rows = rows.withColumns({
        "__why": F.when(c("__q").isNull(), "quantity_unknown_or_qualitative").when(~c("__over") & c("__clash"), "conflicting_source_quantity").when(
            c("__kind").isNull(), "unit_conversion_unknown"),
        "__grams": F.when(~c("__over") & ~c("__clash"), c("__text") * c("__scale") * grams)})
    rows = rows.withColumn("__sourced", yes(
        c("__why").isNull() & (c("__kind") != "g") & (c("__by_mass") | (c("__sold") == "kr/kg")) & c("__grams").isNotNull()))
    rows = rows.withColumns({
        "amount": F.when(c("__sourced"), c("__grams")).when(c("__why").isNull(), c("__q") * c("__scale") * c("__factor")),
        "amount_unit": F.when(c("__sourced"), "g").when(c("__why").isNull(), c("__kind"))})
    rows = rows.withColumn("__boxed", yes(
        c("__sold").isin(*PACKAGE_PRICE_UNITS) & (pack["quantity"] > 0) & (pack["unit"] == c("amount_unit")) & ~pack["approximate"]))
    drained = c("__boxed") & pack["drained_grams"].isNotNull() & (c("amount_unit") == "g")
    measured = ((c("__sold") == "kr/kg") & (c("amount_unit") == "g")) | ((c("__sold") == "kr/l") & (c("amount_unit") == "ml"))
    rows = rows.withColumn("__cost", F.when(measured, c("price_ore") * c("amount") / 1000).when(
        c("__boxed") & ~drained, c("price_ore") * c("amount") / pack["quantity"]))
    skipped = yes(c("link_status") == "non_purchased")
    rows = rows.withColumn("reason", F.when(c("__scale").isNull(), "source_servings_unknown").when(~skipped, F.coalesce(
        F.when(~yes((c("link_status") == "matched") & c("__has")), F.lit("ingredient_connection_unavailable")),
        F.when(~c("__fresh"), F.lit("product_unavailable_or_stale")),
        F.when(c("price_ore").isNull() | (c("price_ore") < 0) | c("deposit_ore").isNull(), F.lit("price_unknown")),
        c("__why"),
        F.when(c("__cost").isNull(), F.when(yes(drained), "drained_weight_basis_requires_review")
               .when((c("amount_unit") == "ml") & c("__by_mass"), "density_required")
               .when((c("amount_unit") == "piece") & c("__by_mass"), "piece_weight_required")
               .otherwise("package_or_unit_conversion_unknown")))))
    status = F.when(c("reason").isNotNull(), "unresolved").when(skipped, "not_purchased").otherwise("priced")
    return rows.select(
        *lines.columns, "code", status.alias("status"),
        F.when(c("reason").isNull(), exact_cost(F.when(skipped, F.lit(0.0)).otherwise(c("__cost")))).alias("cost"),
        F.when(~skipped, c("amount")).alias("amount"), F.when(~skipped, c("amount_unit")).alias("amount_unit"), "reason",
        (c("reason").isNull() & ~skipped & c("__sourced")).alias("amount_approximate"))


def line_groups(lines: DataFrame, keys: tuple[str, ...] = ("menu_id",)) -> DataFrame:
    """Costed lines summed per (menu, product, unit): the input of the shopping list and of the totals.
    """
    priced = F.col("status") == "priced"
    return lines.groupBy(*keys, "code", "amount_unit").agg(
        F.sum(F.when(priced, F.col("amount"))).alias("amount"), F.sum(F.when(priced, F.col("cost"))).alias("cost"),
        F.max(priced & F.col("amount_approximate")).alias("amount_approximate"),
        F.count_if(priced).alias("priced"), F.count_if(F.col("status") == "unresolved").alias("unresolved"))


def recipe_costs(lines: DataFrame, keys: tuple[str, ...] = ("menu_id", "recipe_id")) -> DataFrame:
    """Cost per recipe; NULL unless every line resolved, the known part separately."""
    grouped = lines.groupBy(*keys).agg(
        F.sum(F.coalesce("cost", F.lit(0).cast(COST_TYPE))).alias("__cost"), F.count_if(F.col("status") == "unresolved").alias("unresolved"),
        F.count(F.lit(1)).alias("lines"))
    known = round_cost(F.col("__cost"))
    return grouped.select(*keys, "lines", "unresolved", F.when(F.col("unresolved") == 0, known).alias("consumed_ore"), known.alias("known_consumed_ore"))


def _bought(groups: DataFrame, products: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Every line group with its packs, purchase and deposit; groups without a priced line keep NULLs."""
    rows = groups.join(products, "code", "left")
    unit, priced = price_unit_key(F.col("price_unit")), F.col("priced") > 0
    weighed = priced & unit.isin("kr/kg", "kr/l")
    boxed = priced & ~weighed & (F.col("pack.unit") == F.col("amount_unit")) & (F.col("pack.quantity") > 0) & ~F.col("pack.approximate")
    packs = F.when(F.coalesce(boxed, F.lit(False)), F.ceil(F.col("amount") / F.col("pack.quantity")).cast("bigint"))
    rows = rows.withColumn("packs", packs).withColumn("consumed_ore", round_cost(F.col("cost")))
    return rows.select(
        *keys, "code", "amount_unit", "amount", "packs", "consumed_ore",
        F.when(F.col("packs").isNotNull(), F.col("packs") * F.col("price_ore")).when(weighed, F.col("consumed_ore")).alias("purchase_ore"),
        F.when(F.col("packs").isNotNull(), F.col("packs") * F.col("deposit_ore")).when(weighed & (F.col("deposit_ore") == 0), F.lit(0).cast("bigint")).alias("deposit_ore"),
        "amount_approximate", "expires_at", "cost", "unresolved", "priced")


def shopping_list(groups: DataFrame, products: DataFrame, keys: tuple[str, ...] = ("menu_id",)) -> DataFrame:
    """Whole packs per (menu, product, unit), rounded once per group.

    ``groups`` come from ``line_groups``; product attributes join after the sums, so wide product
    rows are not shuffled per line.
    """
    return _bought(groups, products, keys).filter("priced > 0").drop("cost", "unresolved", "priced")


def quote_totals(groups: DataFrame, products: DataFrame, keys: tuple[str, ...] = ("menu_id",)) -> DataFrame:
    """Menu totals with completeness: NULL when anything is unresolved, known parts separately.

    Consumption and purchase come from one pass over the line groups.
    """
    priced = F.col("priced") > 0
    sums = _bought(groups, products, keys).groupBy(*keys).agg(
        F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(38,9)").alias("__cost"), F.sum("unresolved").alias("unresolved"),
        F.coalesce(F.sum(F.coalesce("purchase_ore", F.lit(0)) + F.coalesce("deposit_ore", F.lit(0))), F.lit(0)).alias("__total"),
        F.count_if(priced & (F.col("purchase_ore").isNull() | F.col("deposit_ore").isNull())).alias("__open"),
        F.min(F.when(priced, F.col("expires_at"))).alias("earliest_expiry"))
    complete = F.col("unresolved") == 0
    whole = complete & (F.col("__open") == 0)
    known = round_cost(F.col("__cost"))
    return sums.select(
        *keys, "unresolved", complete.alias("complete"), whole.alias("purchase_complete"),
        F.when(complete, known).alias("consumed_ore"), known.alias("known_consumed_ore"),
        F.when(whole, F.col("__total")).alias("purchase_ore"), F.col("__total").alias("known_purchase_ore"), "earliest_expiry")


def price_query(requests: DataFrame, products: DataFrame, now: Column) -> DataFrame:
    """Bulk mapped prices.  requests (product_id, code, unit, pack_quantity) -> price or reason."""
    from ..functions.pricing import mapped_pack_price

    rows = requests.join(products.withColumn("__has", F.lit(True)), "code", "left")
    price = mapped_pack_price(F.col("price_ore"), F.col("price_unit"), F.col("deposit_ore"), F.col("pack_quantity"), F.col("unit"))
    stale = ~F.coalesce(F.col("expires_at") > cal.utc(now), F.lit(False)) | ~cal.scan_is_current(F.col("observed_at"), now)
    reason = F.when(F.col("__has").isNull(), "unknown_code").when(price.isNull(), "pack_price_unresolved").when(stale, "stale")
    return rows.select("product_id", "code", F.when(reason.isNull(), price).alias("price_ore"),
                       F.when(reason.isNull(), F.col("deposit_ore")).alias("deposit_ore"), reason.alias("reason"))


def earliest_boundary(rows: DataFrame, keys: list[str], boundaries: list[Column], now: Column) -> DataFrame:
    """Next instant at which a priced result may change: the least future boundary, or the week end."""
    at = cal.utc(now)
    future = F.array_min(F.filter(F.array(*[cal.utc(b) for b in boundaries]), lambda b: b > at))
    return rows.groupBy(*keys).agg(F.min(future).alias("__b")).select(*keys, F.least(F.col("__b"), cal.week_end(now)).alias("valid_until"))


def weighed_purchase(quantity: Column, amount_ore: Column) -> Column:
    return ore(amount_ore * quantity / 1000)


