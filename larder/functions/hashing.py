"""Content, price and identity hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Source keys that carry pricing (fixed value).
PRICE_KEY_PATTERN = "(?i)price|promotion|savings|discount|deposit"
_LANES = 4
_LANE_DIGITS = 15


def sorted_map(values: Column) -> Column:
    return F.array_sort(F.map_entries(values))


def content_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON in name order; NULL fields are left out."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def pricing_map(source: Column) -> Column:
    """The price-like part of an open source record."""
    return F.map_filter(source, lambda k, _: k.rlike(PRICE_KEY_PATTERN))


def price_hash(price_ore: Column, price_unit: Column, compare_ore: Column, compare_unit: Column, deposit_ore: Column,
               offers: Column, source: Column) -> Column:
    """Hash of everything that makes a price; stock and observation time are not part of it."""
    return content_hash(
        price_ore=price_ore, price_unit=price_unit, compare_ore=compare_ore, compare_unit=compare_unit,
        deposit_ore=deposit_ore, offers=F.array_sort(F.transform(offers, lambda o: F.to_json(o))),
        pricing=sorted_map(pricing_map(source)),
    )


def ingredient_id(name: Column) -> Column:
    return F.concat(F.lit("ing_"), F.substring(F.sha2(name, 256), 1, 24))


def name_brand_identity(folded_name: Column, folded_brand: Column) -> Column:
    return F.concat_ws("\n", folded_name, F.coalesce(folded_brand, F.lit("")))


def package_identity(product_id: Column, ean: Column, name: Column, brand: Column, categories: Column, pack: Column,
                     ingredients_text: Column) -> Column:
    """Identity of a reviewed package: seven fields, categories order-free."""
    keep = {"ignoreNullFields": "false"}
    size = F.when(pack.isNotNull(), F.to_json(F.struct(pack["quantity"], pack["unit"], pack["approximate"], pack["drained_grams"]), keep))
    return F.to_json(
        F.struct(product_id.alias("id"), ean.alias("ean"), name.alias("name"), brand.alias("brand"),
                 F.array_sort(categories).alias("categories"), size.alias("pack"), ingredients_text.alias("ingredients")),
        keep,
    )


def digest_lanes(row_hash: Column) -> list[Column]:
    """Four 60-bit numbers cut from a hex hash."""
    return [
        F.conv(F.substring(row_hash, 1 + i * _LANE_DIGITS, _LANE_DIGITS), 16, 10).cast("decimal(20,0)") for i in range(_LANES)
    ]


def table_digest(row_hash: Column) -> Column:
    """Aggregate: order-free digest of a multiset of row hashes.

    The lanes are summed, so each task contributes one partial row: no sort, and no
    list of the whole table in one place.
    """
    sums = [F.sum(lane).cast("string") for lane in digest_lanes(row_hash)]
    return F.sha2(F.concat_ws(":", F.count(row_hash).cast("string"), *[F.coalesce(s, F.lit("0")) for s in sums]), 256)
