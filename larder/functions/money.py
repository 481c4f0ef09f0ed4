"""Money text and amounts.  Money is BIGINT hundredths; unknown stays NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Exact arithmetic for costs that are summed before they are rounded.
COST_TYPE = "decimal(28,9)"


def ore(amount: Column) -> Column:
    """Round a non-negative amount in hundredths to an integer, halves up."""
    return F.floor(amount + F.lit(0.5)).cast("bigint")


def exact_cost(amount: Column) -> Column:
    """Fix an amount to nine decimals so that sums do not depend on row order."""
    return amount.cast(COST_TYPE)


def round_cost(total: Column) -> Column:
    return F.floor(total + F.lit("0.5").cast(COST_TYPE)).cast("bigint")


def _hundredths(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), (F.round(text.try_cast("decimal(20,2)") * 100, 0)).cast("bigint"))


def money_ore(text: Column) -> Column:
    """``'11,27 kr/kg'`` -> 1127; anything that is not a plain non-negative price -> NULL."""
    compact = F.regexp_replace(F.regexp_replace(text, r"[\s ]", ""), r"(?i)kr(?:/(?:st|kg|l))?$", "")
    return _hundredths(F.regexp_replace(compact, ",", "."), r"^\d+(?:\.\d{1,2})?$")


def money_number_ore(amount: Column) -> Column:
    return F.when(amount >= 0, ore(amount * 100))


def nested_money_ore(*alternatives: Column) -> Column:
    """First present alternative (value, amount, formatted value), ``kr`` allowed anywhere."""
    value = F.coalesce(*alternatives)
    compact = F.regexp_replace(F.regexp_replace(value, r"(?i)kr", ""), r"[\s ]", "")
    return _hundredths(F.regexp_replace(compact, ",", "."), r"^\d+(?:\.\d{1,2})?$")


def price_unit_key(unit: Column) -> Column:
    return F.regexp_replace(F.lower(unit), r"\s", "")


#: Price units that quote a whole package (fixed values).
PACKAGE_PRICE_UNITS = ("kr/st", "kr/styck", "kr/forp", "kr/förp", "kr/fp")
#: The same list without the unaccented spelling, as used for mapped bulk prices.
MAPPED_PACKAGE_PRICE_UNITS = ("kr/st", "kr/styck", "kr/förp", "kr/fp")
