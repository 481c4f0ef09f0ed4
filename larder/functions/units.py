"""Recipe units: exact factors to g / ml / piece."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .packs import lookup, quantity_text
from .text import let

#: US customary and metric factors (fixed values).
GRAMS = {
    "g": 1.0, "gram": 1.0, "grams": 1.0, "kg": 1000.0, "kilogram": 1000.0, "kilograms": 1000.0, "mg": 0.001,
    "oz": 28.349523125, "ounce": 28.349523125, "ounces": 28.349523125,
    "lb": 453.59237, "lbs": 453.59237, "pound": 453.59237, "pounds": 453.59237,
}
MILLILITRES = {
    "ml": 1.0, "milliliter": 1.0, "milliliters": 1.0, "l": 1000.0, "liter": 1000.0, "liters": 1000.0, "dl": 100.0, "cl": 10.0,
    "teaspoon": 4.92892159375, "teaspoons": 4.92892159375, "tsp": 4.92892159375,
    "tablespoon": 14.78676478125, "tablespoons": 14.78676478125, "tbsp": 14.78676478125,
    "cup": 236.5882365, "cups": 236.5882365,
    "fluid ounce": 29.5735295625, "fluid ounces": 29.5735295625, "fl oz": 29.5735295625, "fluid_ounce": 29.5735295625,
    "pint": 473.176473, "quart": 946.352946, "gallon": 3785.411784,
}
PIECES = {"count": 1.0, "piece": 1.0, "pieces": 1.0, "each": 1.0, "item": 1.0, "items": 1.0, "egg": 1.0, "eggs": 1.0, "dozen": 12.0}

#: Spellings of the units that reference measures are kept in (fixed values).
MEASURE_SPELLINGS = {
    "cup": ("cup", "cups", "c"),
    "tablespoon": ("tablespoon", "tablespoons", "tbsp", "tbs", "tbl", "tblsp"),
    "teaspoon": ("teaspoon", "teaspoons", "tsp", "ts", "tspn"),
    "count": ("count", "piece", "pieces", "pc", "pcs", "each", "item", "items"),
}


def unit_kind(unit: Column) -> Column:
    key = F.lower(F.trim(unit))
    return (
        F.when(key.isin(*PIECES), "piece").when(key.isin(*GRAMS), "g").when(key.isin(*MILLILITRES), "ml")
    )


def unit_factor(unit: Column) -> Column:
    return lookup(F.lower(F.trim(unit)), {**GRAMS, **MILLILITRES, **PIECES})


def canonical_amount(
    quantity: Column, unit: Column, conflict: Column, scale: Column, override: Column | None = None
) -> Column:
    """struct(quantity, unit, reason) of a recipe line in g / ml / piece.

    ``quantity`` is text; ``override`` is NULL or struct(quantity, unit), wins over
    the source and hides a quantity conflict, and is scaled like the source.
    """
    none = F.lit(None).cast("struct<quantity:double,unit:string>")
    replaced = override if override is not None else none
    staged = F.struct(
        F.coalesce(replaced["quantity"], quantity_text(quantity)).alias("q"),
        F.lower(F.trim(F.coalesce(replaced["unit"], unit))).alias("unit"),
        (replaced.isNull() & F.coalesce(conflict, F.lit(False))).alias("clash"), scale.alias("scale"))

    def convert(a: Column) -> Column:
        kind = unit_kind(a["unit"])
        reason = (
            F.when(a["q"].isNull(), "quantity_unknown_or_qualitative")
            .when(a["clash"], "conflicting_source_quantity")
            .when(kind.isNull(), "unit_conversion_unknown")
        )
        return let(reason, lambda why: F.struct(
            F.when(why.isNull(), a["q"] * a["scale"] * unit_factor(a["unit"])).alias("quantity"),
            F.when(why.isNull(), kind).alias("unit"),
            why.alias("reason")))

    return let(staged, convert)


def measure_unit(unit: Column) -> Column:
    """cup / tablespoon / teaspoon / count, or NULL.  A single ``T`` and ``t`` differ by case."""
    raw = F.trim(unit)
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), "[.]", ""), r"\s+", " "))
    picked = F.when(raw == "T", "tablespoon").when(raw == "t", "teaspoon")
    for name, spellings in MEASURE_SPELLINGS.items():
        picked = picked.when(key.isin(*spellings), name)
    return picked


def serving_scale(requested: Column, source: Column) -> Column:
    """struct(scale, reason): 1 when servings are not requested, unknown source servings are an error."""
    bad = requested.isNotNull() & ~(F.coalesce(source, F.lit(0.0)) > 0)
    return F.struct(
        F.when(requested.isNull(), F.lit(1.0)).when(~bad, requested / source).alias("scale"),
        F.when(bad, "source_servings_unknown").alias("reason"),
    )
