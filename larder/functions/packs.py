"""Package labels and quantity text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PACK_TYPE = "struct<quantity:double,unit:string,drained_grams:double,approximate:boolean>"

#: Factors of label units to g / ml / piece (fixed values).
LABEL_SCALE = {"kg": 1000.0, "g": 1.0, "l": 1000.0, "dl": 100.0, "cl": 10.0, "ml": 1.0, "p": 1.0, "st": 1.0, "pack": 1.0}
WEIGHT_UNITS = ("kg", "g")
VOLUME_UNITS = ("ml", "cl", "dl", "l")

_NUM = r"\d+(?:\.\d+)?"
_DRAINED = rf"^({_NUM})/({_NUM})(kg|g)$"
_PIECES_IN_VOLUME = rf"^(\d+)(?:p|st)/{_NUM}l$"
_PLAIN = rf"^(?:(\d+)x)?({_NUM})(kg|g|ml|cl|dl|l|p|st|pack)$"


def lookup(key: Column, table: dict[str, float]) -> Column:
    """Small fixed dictionary as a literal map."""
    cells = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*cells), key)


def _num(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("double")


def pack_label(label: Column, price_unit: Column) -> Column:
    """Parse ``'400/240g'``, ``'6p/0.5l'``, ``'2x1,5l'``, ``'ca: 1kg'`` into a pack struct."""
    text = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), ",", ".")
    text = F.regexp_replace(F.regexp_replace(text, r"\s", ""), "^ca:?", "")
    drained, cubes, plain = text.rlike(_DRAINED), text.rlike(_PIECES_IN_VOLUME), text.rlike(_PLAIN)
    unit = F.regexp_extract(text, _PLAIN, 3)
    scale = F.when(F.regexp_extract(text, _DRAINED, 3) == "kg", 1000.0).otherwise(1.0)
    quantity = (
        F.when(cubes, _num(text, _PIECES_IN_VOLUME, 1))
        .when(drained, _num(text, _DRAINED, 1) * scale)
        .when(plain, F.coalesce(_num(text, _PLAIN, 1), F.lit(1.0)) * _num(text, _PLAIN, 2) * lookup(unit, LABEL_SCALE))
    )
    kind = (
        F.when(cubes, "piece")
        .when(drained, "g")
        .when(plain, F.when(unit.isin(*WEIGHT_UNITS), "g").when(unit.isin(*VOLUME_UNITS), "ml").otherwise("piece"))
    )
    approximate = F.coalesce(label, F.lit("")).rlike("(?i)^ca") | F.coalesce(price_unit, F.lit("")).rlike("(?i)kr/kg")
    return F.struct(
        quantity.alias("quantity"),
        kind.alias("unit"),
        F.when(drained & ~cubes, _num(text, _DRAINED, 2) * scale).alias("drained_grams"),
        approximate.alias("approximate"),
    )


#: Feed units to (canonical unit, factor) (fixed values).
FEED_UNITS = {
    "kg": ("g", 1000.0), "kilogram": ("g", 1000.0), "kilograms": ("g", 1000.0),
    "g": ("g", 1.0), "gram": ("g", 1.0), "grams": ("g", 1.0), "mg": ("g", 0.001),
    "l": ("ml", 1000.0), "liter": ("ml", 1000.0), "litre": ("ml", 1000.0), "liters": ("ml", 1000.0), "litres": ("ml", 1000.0),
    "ml": ("ml", 1.0), "milliliter": ("ml", 1.0), "millilitre": ("ml", 1.0), "milliliters": ("ml", 1.0), "millilitres": ("ml", 1.0),
    "cl": ("ml", 10.0),
    "st": ("piece", 1.0), "styck": ("piece", 1.0), "pc": ("piece", 1.0), "pcs": ("piece", 1.0), "piece": ("piece", 1.0), "pieces": ("piece", 1.0),
}
_FEED = r"(?i)^\s*(\d+(?:[.,]\d+)?)\s*(" + "|".join(sorted(FEED_UNITS, key=len, reverse=True)) + r")?\s*$"


def feed_quantity(text: Column) -> Column:
    """``'1,5 kg'`` -> struct(quantity=1500, unit='g'); unknown text or a zero amount -> NULL."""
    amount = F.regexp_replace(F.regexp_extract(text, _FEED, 1), ",", ".").try_cast("double")
    unit = F.lower(F.coalesce(F.nullif(F.regexp_extract(text, _FEED, 2), F.lit("")), F.lit("st")))
    kinds = F.create_map(*[F.lit(x) for k, v in FEED_UNITS.items() for x in (k, v[0])])
    scale = lookup(unit, {k: v[1] for k, v in FEED_UNITS.items()})
    return F.when(
        text.rlike(_FEED) & (amount > 0),
        F.struct((amount * scale).alias("quantity"), F.try_element_at(kinds, unit).alias("unit")),
    )


def feed_pack(*candidates: Column, unit_text: Column | None = None, info_text: Column | None = None) -> Column:
    """First package candidate that parses; a bare number takes ``unit_text`` as its unit."""
    note = r"\s*(?:ungefärlig\s+vikt|approx(?:imate)?\s+weight)\s*"
    unit = F.lower(F.regexp_replace(F.coalesce(unit_text, F.lit("")), "(?i)" + note, "")) if unit_text is not None else F.lit("")
    vague = F.lit(False)
    for source in (unit_text, info_text):
        if source is not None:
            vague = vague | F.coalesce(source, F.lit("")).rlike("(?i)ungefärlig|approx")
    parsed = []
    for candidate in candidates:
        bare = candidate.rlike(r"^\d+(?:\.\d+)?$") & (unit != "")
        amount = feed_quantity(F.when(bare, F.concat_ws(" ", candidate, unit)).otherwise(candidate))
        parsed.append(
            F.when(
                amount.isNotNull(),
                F.struct(
                    amount["quantity"].alias("quantity"),
                    amount["unit"].alias("unit"),
                    F.lit(None).cast("double").alias("drained_grams"),
                    (bare & vague).alias("approximate"),
                ),
            )
        )
    return F.coalesce(*parsed)


_DECIMAL = r"^[0-9]+(?:\.[0-9]+)?$"
_FRACTION = r"^(?:(\d+)\s+)?(\d+)/(\d+)$"


def quantity_text(text: Column) -> Column:
    """``'3'``, ``'1/2'`` or ``'1 1/2'`` as a positive number; anything else is unknown."""
    value = F.trim(text)
    mixed = F.coalesce(_num(value, _FRACTION, 1), F.lit(0.0)) + F.try_divide(_num(value, _FRACTION, 2), _num(value, _FRACTION, 3))
    number = F.when(value.rlike(_DECIMAL), value.try_cast("double")).when(value.rlike(_FRACTION), mixed)
    return F.when(number > 0, number)
