"""Dietary policy of named foods as an ordered rule table.

A rule is data: an outcome, a pattern that must match, a pattern that must not, and
whether plant-based names escape it.  The table compiles to one CASE expression
(``coalesce(when ...)``) on Spark and to the same CASE text for the SQL check, so a
classification is a narrow, codegen-only projection.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .text import accent_table, fold_text, let

POLICY_VERSION = "owner-halal-brands-strict-2"

# Brands, word lists and patterns that decide a classification.
MEAT_BRANDS = ("affco", "qibbla halal", "agadeer", "aladin", "jack links")
CHICKEN_BRANDS = MEAT_BRANDS + ("eldorado",)
MEAT_CATEGORY_PREFIX = "kott"
PLANT = (
    r"\b(?:vegan|vegetarian|veggie|meatless|plant based|quorn|tempeh)\b"
    r"|\b(?:soy|soya|imitation|coconut) (?:bacon|beef|chicken|meat|sausage)"
)
SPIRITS = r"\b(?:anisette|ricard|herbsaint|cachaca|pisco|eau de vie)\b|\bcreme de (?:cacao|menthe|cassis)\b"
ALCOHOL = (
    r"\b(?:wine|beer|lager|ale|stout|porter|rum|brandy|vodka|bourbon|liqueur|liquor|sherry|whiskey|whisky|tequila|sake|"
    r"marsala|vermouth|champagne|cognac|armagnac|calvados|amaretto|cointreau|kahlua|baileys|drambuie|grand marnier|"
    r"triple sec|sambuca|ouzo|limoncello|kirsch|kirschwasser|curacao|frangelico|pernod|pastis|absinthe|aquavit|schnapps|"
    r"schnaps|grappa|mirin|madeira|benedictine|galliano|campari|chartreuse|alcohol|alcoholic|alkohol|vin|ol|rom|konjak|"
    r"irish cream|jack daniels|buttershots)\b"
    r"|\b(?:hard|dry) (?:apple )?cider\b"
    r"|^(?:gin|port|grenache|merlot|cabernet sauvignon|chardonnay|riesling|zinfandel|sauternes|shaoxing)(?:\b|$)"
)
VINEGARS = r"\b(?:wine|sherry|champagne|malt|vin) (?:vinegar|vinager|vinagre|vinager)\b"
SOFT_DRINKS_AND_YEASTS = (
    r"\b(?:root beer|ginger beer|ginger ale|birch beer|beer yeast|brewers yeast|champagne yeast|champagne grapes)\b"
)
ALCOHOL_FREE = (
    r"\b(?:non alcoholic|nonalcoholic|alcohol free|alkoholfri|0 0%) (?:beer|wine|lager|ale|rum|vodka)\b"
)
BLOOD = r"\b(?:blood|blod|blodpudding|blodkorv)\b"
BARE_VANILLA = r"^(?:(?:real|pure|white|imitation|homemade) )?vanilla$|^vanilla bean paste$"
EXTRACTS = r"\b(?:extract|extracts|\w*extrakt|essence|vanilla flavoring|vanilla flavouring|vaniljarom)\b"
SAFE_EXTRACTS = (
    r"\b(?:alcohol free|non alcoholic|nonalcoholic|alcoholfree|alkoholfri)\b"
    r"|\b(?:yeast|malt) extract\b|\b(?:emeril\w*|creole|bayou)\b"
)
PORK = (
    r"\b(?:pork|porcine|pig|swine|hog|boar|pancetta|prosciutto|lard|lardons|fatback|guanciale|speck|flask\w*|gris\w*|"
    r"svin\w*|parmaskinka|cottage roll|jamon)\b"
)
CURED = r"\b(?:bacon|ham|skinka)\b"
OTHER_CURED = r"\b(?:beef|chicken|turkey|not|kyckling|kalkon)\b"
ANIMAL_SETTING = r"\b(?:gelatin|gelatine|gelatinblad|marshmallows?|rennet|animal fat|suet|tallow|jell o|jello)\b"
CHICKEN = r"\b(?:chicken|chickens|hen|hens|poultry)\b|\b(?:kyckling\w*|hons\w*)\b"
NOT_CHICKEN = r"\b(?:chicken spice|chicken seasoning|poultry seasoning|hen of the woods)\b"
RED_MEAT = (
    r"\b(?:beef|veal|lamb|mutton|venison|bison|buffalo meat|elk|deer|rabbit|ox|oxtail|steak|steaks|sirloin|tenderloin|"
    r"brisket|chuck|roast beef|hamburger|hamburgers|ground round|ground chuck|rump roast|round roast|round tip roast|"
    r"tri tip roast|ribeye|bresaola)\b"
    r"|\b(?:notfars|oxfile|lamm\w*|farfars|kalv\w*|ryggbiff|hogrev|biff|kottbuljong)\b"
)
OTHER_BIRDS = (
    r"\b(?:turkeys?|ducks?|ducklings?|goose|geese|quails?|pheasants?|partridges?|pigeons?|giblets?|foie gras|"
    r"alligators?|crocodiles?|kangaroos?)\b|\b(?:kalkon\w*|anka|gaslever)\b"
)
MIXED_MEAT = (
    r"\b(?:meat|meatballs?|meatloaf|sausage|sausages|salami|pepperoni|chorizo|mortadella|bologna|pastrami|jerky|franks|"
    r"frankfurters?|hot ?dogs?|wieners?|kielbasa|liver|kidneys?|tripe|sweetbreads|blood sausage|blood pudding)\b"
    r"|\b(?:\w*wurst|korv|kottbullar|blodpudding|blodkorv|lever)\b"
)
NOT_MEAT = (
    r"\b(?:lobster|crab|crabmeat|fish|clam|clams|oyster|oysters|mussel|mussels|shrimp|prawn|scallop|coconut|nut|nuts|"
    r"kidney bean|kidney beans|meat tenderizer)\b"
)
BROTH = r"\b(?:broth|stock|bouillon|consomme|dripping|drippings|bone broth)\b"
NAMED_BROTH = (
    r"\b(?:vegetable|veggie|mushroom|fish|seafood|clam|clams|lobster|shrimp|prawn|bonito|herb|garlic|onion|dashi)\b"
)


@dataclass(frozen=True)
class Rule:
    match: str
    reason: str | None = None
    meat: str | None = None
    unless: str | None = None
    spares_plants: bool = False
    ignores_soft_drinks: bool = False


RULES: tuple[Rule, ...] = (
    Rule(SPIRITS, "alcohol"),
    Rule(r"\bdrunken cherries\b", "uncertain_alcohol_source"),
    Rule(r"^thai burgers$", "uncertain_animal_source"),
    Rule(ALCOHOL, "alcohol", ignores_soft_drinks=True),
    Rule(BLOOD, "animal_blood", unless=r"\bblood oranges?\b"),
    Rule(r"^(?:cider|pear cider)$", "uncertain_alcohol_source"),
    Rule(BARE_VANILLA, "uncertain_extract"),
    Rule(EXTRACTS, "uncertain_extract", unless=SAFE_EXTRACTS),
    Rule(PORK, "pork", spares_plants=True),
    Rule(CURED, "pork", unless=OTHER_CURED, spares_plants=True),
    Rule(ANIMAL_SETTING, "uncertain_animal_source", unless=r"\b(?:jello|jell o) .*pudding\b", spares_plants=True),
    Rule(r"\bshortening\b", "uncertain_animal_source", unless=r"\b(?:vegetable|vegetarian|vegan|crisco|trex|flora|oil)\b"),
    Rule(PLANT),
    Rule(CHICKEN, meat="chicken", unless=NOT_CHICKEN),
    Rule(RED_MEAT, meat="red_meat", unless=r"\bhamburger (?:bun|buns|roll|rolls)\b"),
    Rule(r"\bgoat\b", meat="red_meat", unless=r"\b(?:cheese|milk|yogurt|yoghurt|butter)\b"),
    Rule(OTHER_BIRDS, meat="other_meat"),
    Rule(MIXED_MEAT, meat="other_meat", unless=NOT_MEAT),
    Rule(BROTH, "uncertain_animal_source", unless=NAMED_BROTH),
)


def factored(pattern: str, at_least: int = 6) -> str:
    """The same test with long word lists grouped by first letter.

    Java tries the alternatives of a list one after the other at every word, so a list of
    seventy words costs seventy comparisons there; grouped, it costs one per letter.
    """
    def group(found: re.Match) -> str:
        words = found.group(1).split("|")
        if len(words) < at_least:
            return found.group(0)
        letters, rest = defaultdict(list), []
        for word in words:
            (letters[word[0]] if word[:1].isalnum() else rest).append(word[1:] if word[:1].isalnum() else word)
        return "(?:" + "|".join([f"{c}(?:{'|'.join(tails)})" for c, tails in letters.items()] + rest) + ")"

    return re.sub(r"\(\?:([^()]*)\)", group, pattern)


def _without_soft_drinks(folded: Column) -> Column:
    text = F.regexp_replace(folded, VINEGARS, "vinegar")
    for pattern in (SOFT_DRINKS_AND_YEASTS, ALCOHOL_FREE):
        text = F.regexp_replace(text, pattern, "food")
    return text


def classify(folded: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(reason, meat) of the first rule that holds for a folded name."""
    def first_rule(name: Column) -> Column:
        chain = []
        for rule in rules:
            hit = (name["sober"] if rule.ignores_soft_drinks else name["text"]).rlike(factored(rule.match))
            if rule.unless:
                hit = hit & ~name["text"].rlike(factored(rule.unless))
            if rule.spares_plants:
                hit = hit & ~name["plant"]
            outcome = F.struct(F.lit(rule.reason).cast("string").alias("reason"), F.lit(rule.meat).cast("string").alias("meat"))
            chain.append(F.when(hit, outcome))
        nothing = F.struct(F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("meat"))
        return F.coalesce(*chain, nothing)

    return let(folded, lambda text: let(
        F.struct(text.alias("text"), _without_soft_drinks(text).alias("sober"), text.rlike(PLANT).alias("plant")), first_rule))


def classify_names(df: DataFrame, column: str, out: str = "policy") -> DataFrame:
    """Classify each distinct text once and join the result back."""
    distinct = df.select(column).distinct().withColumn(out, classify(fold_text(F.col(column))))
    return df.join(distinct, column, "left")


def _permitted(kind: Column, brand: Column) -> Column:
    return F.when(kind == "chicken", brand.isin(*CHICKEN_BRANDS)).otherwise(brand.isin(*MEAT_BRANDS))


def meat_kind(title: Column, categories: Column, own: Column) -> Column:
    """Kind of meat a product holds: by its title, else by its aisle; NULL for none."""
    in_meat_aisle = F.exists(categories, lambda c: c.startswith(MEAT_CATEGORY_PREFIX)) & ~title.rlike(PLANT)
    return F.coalesce(own["meat"], F.when(in_meat_aisle, F.lit("other_meat")))


def product_policy(title: Column, brand: Column, categories: Column, own: Column, requested: Column | None = None) -> Column:
    """Reason a product is not permitted, or NULL.

    ``title``, ``brand`` and ``categories`` are folded; ``own`` and ``requested`` are
    ``classify`` structs of the product title and of the requested ingredient.
    """
    kind = meat_kind(title, categories, own)
    brand = F.coalesce(brand, F.lit(""))
    reasons = []
    if requested is not None:
        reasons.append(F.when(requested["reason"].isNotNull(), F.concat(F.lit("ingredient_excluded_"), requested["reason"])))
    reasons += [
        F.when(own["reason"].isNotNull(), F.concat(F.lit("product_excluded_"), own["reason"])),
        F.when(kind.isNotNull() & ~_permitted(kind, brand), F.lit("meat_brand_not_permitted")),
    ]
    if requested is not None:
        want = requested["meat"]
        mismatch = kind.isNull() | ((want == "chicken") != (kind == "chicken"))
        reasons += [
            F.when(want.isNotNull() & mismatch, F.lit("meat_identity_not_compatible")),
            F.when(want.isNotNull() & ~_permitted(want, brand), F.lit("meat_brand_not_permitted")),
        ]
    return F.coalesce(*reasons)


# Wording of disclosed ingredient lists.
EGG_WORDS = r"\b(?:egg|eggs|egg yolk|agg|aggula|aeg)\b"
HEN_MEAT_WORDS = r"\b(?:chicken|kyckling\w*|poultry|hon(?:s)?kott)\b"
HEN_WORDS = r"\b(?:hons|hens?)\b"
RENNET_WORDS = r"\b(?:ystenzym|lope|rennet)\b"
PLANT_RENNET_WORDS = r"\b(?:mikrobiell\w*|microbial\w*|vegetabilisk\w*|vegetable\s+rennet)\b"


def disclosed_policy(title_reason: Column, ingredients_text: Column, brand: Column, requested: Column | None = None) -> Column:
    """Policy reason from the title, then from the disclosed ingredient list."""
    nothing = F.array().cast("array<string>")

    def disclosed(plain: Column) -> Column:
        egg_only = plain.rlike(EGG_WORDS) & ~plain.rlike(HEN_MEAT_WORDS)
        text = fold_text(F.when(egg_only, F.regexp_replace(plain, HEN_WORDS, " ")).otherwise(plain))
        return let(text, lambda folded: let(classify(folded), lambda listed: F.coalesce(
            F.when(listed["reason"].isNotNull(), F.concat(F.lit("product_excluded_ingredient_"), listed["reason"])),
            F.when(plain.rlike(RENNET_WORDS) & ~plain.rlike(PLANT_RENNET_WORDS), F.lit("product_excluded_uncertain_animal_source")),
            F.when(F.contains(product_policy(folded, brand, nothing, listed, requested), F.lit("meat_brand_not_permitted")),
                   F.lit("product_excluded_ingredient_meat_brand_not_permitted")))))

    plain = F.lower(F.translate(ingredients_text, *accent_table()))
    return F.coalesce(title_reason, F.when(F.trim(ingredients_text) != "", let(plain, disclosed)))


def classify_sql(folded: str, field: str) -> str:
    """The same rule table as a SQL CASE (``field`` is ``reason`` or ``meat``)."""
    def hit(text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{pattern}')"

    sober = f"regexp_replace({folded}, '{VINEGARS}', 'vinegar', 'g')"
    for pattern in (SOFT_DRINKS_AND_YEASTS, ALCOHOL_FREE):
        sober = f"regexp_replace({sober}, '{pattern}', 'food', 'g')"
    arms = []
    for rule in RULES:
        test = hit(sober if rule.ignores_soft_drinks else folded, rule.match)
        if rule.unless:
            test += f" AND NOT {hit(folded, rule.unless)}"
        if rule.spares_plants:
            test += f" AND NOT {hit(folded, PLANT)}"
        value = getattr(rule, field)
        arms.append(f"WHEN {test} THEN " + (f"'{value}'" if value else "NULL"))
    return "CASE " + " ".join(arms) + " ELSE NULL END"
