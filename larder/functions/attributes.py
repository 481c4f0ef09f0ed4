"""Requested attributes that a product must prove.

``CLAIMS`` is read top down; the reason of the first claim that is requested but not
shown is the result.  A claim is shown by a title pattern or by a small check over
the product's folded title, folded categories and pack.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Shown:
    """Folded product facts a claim can look at."""

    title: Column
    categories: Column
    drained: Column

    def says(self, pattern: str) -> Column:
        return self.title.rlike(pattern)

    def in_aisle(self, prefix: str) -> Column:
        return F.exists(self.categories, lambda c: c.startswith(prefix))

    def frozen(self) -> Column:
        return self.says(FROZEN_TITLE) | self.in_aisle("fryst")


@dataclass(frozen=True)
class Claim:
    reason: str
    request: str
    title: str | None = None
    check: Callable[[Shown], Column] | None = None
    also: str | None = None


# Request patterns, title evidence and reasons, in the order they are tried.
FROZEN_TITLE = "fryst|frysta"
PRESERVED_TITLE = "konserv|kokt|fardigkokt"
LIGHT_FOODS = (
    "mayonnaise|mayo|cream cheese|cream|sour cream|yogurt|yoghurt|butter|margarine|cheddar|ricotta|milk|coconut milk"
)
CLAIMS: tuple[Claim, ...] = (
    Claim("organic_not_verified", r"\borganic\b", r"\beko\b|ekologisk"),
    Claim("gluten_free_not_verified", r"\bgluten free\b|\bglutenfree\b",
          check=lambda p: p.says("glutenfri") | F.exists(p.categories, lambda c: c.rlike("glutenfri"))),
    Claim("lactose_free_not_verified", r"\blactose free\b|\blactosefree\b", "laktosfri"),
    Claim("unsalted_not_verified", r"\bunsalted\b", "osalt|utan salt"),
    Claim("unsweetened_not_verified", r"\bunsweetened\b", "osotad|utan (?:tillsatt )?socker"),
    Claim("sugar_free_not_verified", r"\b(?:sugar free|sugarfree)\b", "sockerfri|sugar free|0%.*socker"),
    Claim("fat_free_not_verified", r"\b(?:fat free|nonfat|non fat)\b", "fettfri|fat free|(?:^| )0%(?: |$)"),
    Claim("reduced_fat_not_verified", rf"\b(?:low fat|reduced fat)\b|\blight (?:{LIGHT_FOODS})\b",
          r"\blatt\w*\b|\blight\b|lag.*fett|fettreducer"),
    Claim("reduced_salt_not_verified", r"\b(?:low sodium|low salt|reduced sodium|reduced salt)\b",
          "saltreducer|lag.*salt|mindre salt|low sodium"),
    Claim("no_added_salt_not_verified", r"\b(?:no salt added|no added salt|salt free)\b", "utan (?:tillsatt )?salt|saltfri"),
    Claim("extra_virgin_not_verified", r"\bextra virgin\b", "extra virgin|extra vergine|extra jungfru"),
    Claim("frozen_not_verified", r"\bfrozen\b", check=lambda p: p.frozen()),
    Claim("dry_form_incompatible", r"\b(?:dry|dried)\b",
          check=lambda p: ~p.frozen() & (p.says("torkad|dried") | ~(p.says("farsk") | p.in_aisle("frukt")))),
    Claim("fresh_incompatible", r"\bfresh\b", check=lambda p: ~(p.frozen() | p.says("torkad"))),
    Claim("cooked_form_not_verified", r"\bcooked\b", "kokt|fardigkokt|tillagad|grillad|stekt"),
    Claim("non_hydrogenated_not_verified", r"\bnon hydrogenated\b", "icke hardad|non hydrogenated|ohardad"),
    Claim("water_packed_not_verified", r"\bwater packed\b|\bin water\b", "i vatten|i lake|water packed"),
    Claim("salt_packed_not_verified", r"\bcapers? packed in salt\b", "i salt|saltpack|packed in salt"),
    Claim("artichoke_bottom_not_verified", r"\bartichoke bottoms?\b", "kronartskocksbottn|artichoke bottom"),
    Claim("soy_margarine_not_verified", r"\b(?:soy|soya) margarine\b", "soja|soy"),
    Claim("stick_form_not_verified", r"\bstick margarine\b", "stick|stav"),
    Claim("cut_okra_not_verified", r"\bfrozen cut okra\b", "hackad|bitar|skivad|cut"),
    Claim("plant_based_margarine_not_verified", r"\b(?:vegan|vegetable) margarine\b", "vaxtbas|vegan"),
    Claim("preserved_beans_not_verified", r"\bcanned\b", also=r"\b(?:beans?|cannellini)\b",
          check=lambda p: p.drained.isNotNull() | p.says(PRESERVED_TITLE)),
    Claim("dry_beans_incompatible", r"\b(?:dry|dried)\b", also=r"\bbeans?\b",
          check=lambda p: p.drained.isNull() & ~p.says(PRESERVED_TITLE)),
    Claim("tea_bag_form_not_verified", r"\bteabags?\b", "tepase|tepasar|tea bags?"),
    Claim("flour_identity_not_verified", r"\bflour\b", "mjol|flour|starkelse"),
    Claim("medium_salsa_not_verified", r"\bmedium(?: hot)? salsa\b", r"\bmedium\b"),
    Claim("dry_roasting_not_verified", r"\bdry roasted\b", "torrrost|dry roasted"),
)
PERCENT_IN_REQUEST = r"(\d+(?:\.\d+)?)%"
PERCENT_IN_TITLE = r"(\d+(?:[,.]\d+)?)%"
PLUM_COLOURS = {"red": "rod(?:a)?", "yellow": "gul(?:a)?", "blue": "bla"}
NAMED_BRANDS = (
    "philadelphia", "velveeta", "cool whip", "splenda", "miracle whip", "bisquick", "betty crocker", "jell o", "jello",
    "nutella", "kikkoman", "tabasco", "grey poupon", "heinz", "weetabix", "classico", "nestle", "mccormick", "lea perrins",
)


def percent(text: Column, pattern: str) -> Column:
    return F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", ".").try_cast("double")


def attribute_exclusion(request: Column, raw_title: Column, title: Column, brand: Column, categories: Column,
                        drained: Column) -> Column:
    """First requested attribute the product does not show, or NULL.

    ``raw_title`` keeps its punctuation for percentages; the rest is folded.  Pass columns, not
    long expressions: every claim reads them.
    """
    shown = Shown(title, categories, drained)
    tests = []
    for claim in CLAIMS:
        asked = request.rlike(claim.request)
        if claim.also:
            asked = asked & request.rlike(claim.also)
        proof = claim.check(shown) if claim.check else shown.says(claim.title)
        tests.append(F.when(asked & ~proof, F.lit(claim.reason)))
    wanted = percent(request, PERCENT_IN_REQUEST)
    tests.append(F.when(wanted.isNotNull() & ~wanted.eqNullSafe(percent(raw_title, PERCENT_IN_TITLE)), F.lit("percentage_not_verified")))
    plum = request.rlike(r"\bplums?\b")
    for english, swedish in PLUM_COLOURS.items():
        tests.append(F.when(plum & request.rlike(rf"\b{english}\b") & ~title.rlike(rf"\b{swedish}\b"), F.lit("plum_colour_not_verified")))
    label = F.concat_ws(" ", F.coalesce(brand, F.lit("")), title)
    padded = F.concat(F.lit(" "), request, F.lit(" "))
    for name in NAMED_BRANDS:
        tests.append(F.when(F.contains(padded, F.lit(f" {name} ")) & ~F.contains(label, F.lit(name)), F.lit("requested_brand_not_verified")))
    return F.coalesce(*tests)
