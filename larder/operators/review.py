"""Review queue and decisions over name-product candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import calendar as cal
from ..functions.text import accent_table
from .batching import NUMBERED, compact_parts, fixed_batches, numbered
from .linking import CANDIDATES_KEPT, rank_candidates
from .versions import classify_delta, latest_per_key

BATCH_SIZE = 25

#: Store category labels to matcher families (fixed values).
CATEGORY_FAMILIES = (
    (r"\b(?:fryst|frysta|frozen|frys|glass|isglass)\b", "fryst"),
    (r"\b(?:kyckling|fagel|not|kalv|lamm|kott|korv|bacon|skinka|flask|vilt|kottbullar)\b", "kott"),
    (r"\b(?:fisk|lax|tonfisk|torsk|sill|ansjovis|rakor|skaldjur|kraftor|caviar)\b", "fisk"),
    (r"\b(?:mjolk|mjol|ost|cheddar|brie|feta|gouda|yoghurt|fil|gradde|smor|margarin|agg|jaste? ost|dessertost|kvarg|keso)\b", "mejeri"),
    (r"\b(?:juice|dryck|dricka|must|soda|läsk|kaffe|te|vin|ol|water)\b", "dryck"),
    (r"\b(?:frukt|bar|ananas|banan|citrus|druvor|kiwi|mango|melon|p[aä]ron|[aä]pple|avokado|blomk[aå]l|broccoli|b[oö]nor|gr[oö]nsaker|gurka|k[aå]l|l[oö]k|mor[oö]tter|paprika|potatis|sallad|svamp|tomat|zucchini|aubergine|sparris|selleri|rotfrukt|groddar|[oö]rter|kryddor|oliver|citron|lime|ingef[aä]ra)\b", "frukt"),
    (r"\b(?:m[jy]ol|socker|pasta|ris|gryner|baljv[aä]xter|konserv|senap|s[aå]s|krydda|bakning|baking|mj[oö]l|olja|vin[aä]ger|ketchup|sylt|honung|sirap|choklad|kakao|n[oö]tter|fr[oö]|br[oö]d|spannm[aå]l|skafferi|kex|kn[aä]ckebr[oö]d|nudlar|buljong)\b", "skafferi"),
)
#: A shared parent of meat and fish cans, whose first word must not make fish meat (fixed values).
SHARED_CANS, SHARED_CANS_LABEL = r"\bkott\s*(?:&|och)\s*fiskkonserver\b", r"(?i)kött\s*(?:&|och)\s*fiskkonserver"


def category_families(label: Column) -> Column:
    """Matcher families of a store category label as written (several may apply), then the label itself; empty if none applies."""
    lowered = F.regexp_replace(F.lower(F.translate(label, *accent_table())), SHARED_CANS, " ")
    hits = F.filter(F.array(*[F.when(lowered.rlike(pattern), F.lit(family)) for pattern, family in CATEGORY_FAMILIES]), lambda x: x.isNotNull())
    safe = F.array(F.regexp_replace(label, SHARED_CANS_LABEL, "fiskkonserver"))
    return F.when(F.size(hits) > 0, F.array_distinct(F.concat(hits, safe))).otherwise(F.array().cast("array<string>"))


def matcher_rows(observations: DataFrame) -> DataFrame:
    """Retail observations in the matcher's product shape.

    observations (product_id, name, brand, families array<array<string>>, amount_ore, basis, deposit_ore,
    member_only, minimum, valid_until, availability, checked_at, pack).
    """
    priced = F.col("amount_ore").isNotNull()
    unit = F.when(F.col("basis") == "kg", "kr/kg").when(F.col("basis") == "l", "kr/l").otherwise("kr/förp")
    offer = F.struct(
        F.lit(True).alias("applied"), F.coalesce("minimum", F.lit(1)).cast("int").alias("qualifying_count"),
        F.when(F.col("member_only"), "MEMBER").otherwise("GENERAL").alias("campaign_type"))
    return observations.select(
        F.col("product_id").alias("code"), "name", "brand", F.flatten("families").alias("categories"),
        F.col("amount_ore").alias("price_ore"), F.when(priced, unit).otherwise("").alias("price_unit"), "deposit_ore",
        (F.col("availability") == "available").alias("available"), F.col("checked_at").alias("observed_at"),
        F.when(priced, F.array(offer)).otherwise(F.array().cast("array<struct<applied:boolean,qualifying_count:int,campaign_type:string>>")).alias("offers"),
        F.array_compact(F.array(cal.utc(F.col("valid_until")))).alias("offer_ends"), "pack")


def union_candidates(matcher: DataFrame, prior: DataFrame, nominated: DataFrame) -> DataFrame:
    """One row per (name, code) with the label of the sources that proposed it.

    The three inputs carry (name, code, eligible, unit_price).
    """
    def tag(df: DataFrame, source: str) -> DataFrame:
        return df.select("name", "code", "eligible", "unit_price", *[F.lit(s == source).alias(s) for s in ("matcher", "prior", "nominated")])

    rows = tag(matcher, "matcher").unionByName(tag(prior, "prior")).unionByName(tag(nominated, "nominated"))
    merged = rows.groupBy("name", "code").agg(
        F.max("eligible").alias("eligible"), F.min("unit_price").alias("unit_price"),
        *[F.max(s).alias(s) for s in ("matcher", "prior", "nominated")])
    m, p, n = F.col("matcher"), F.col("prior"), F.col("nominated")
    label = (
        F.when(m & p & n, "all_sources").when(m & p, "both").when(m & n, "matcher_and_manual_nomination")
        .when(p & n, "prior_review_and_manual_nomination").when(n, "manual_nomination").when(p, "prior_review_same_name_brand").otherwise("matcher"))
    return merged.withColumn("source", label).drop("matcher", "prior", "nominated")


def review_candidates(union: DataFrame) -> DataFrame:
    """Top candidates per name: eligible, reviewed sources before the plain matcher, price, code."""
    return rank_candidates(union, CANDIDATES_KEPT, [(F.col("source") == "matcher").cast("int").asc()])


def review_queue(items: DataFrame, parts: int = 3) -> DataFrame:
    """Batches of 25 names and the compact part each name belongs to."""
    rows = numbered(items, [F.col("name").asc()])
    return compact_parts(fixed_batches(rows, BATCH_SIZE), parts).drop(*NUMBERED)


def merge_fragments(fragments: Sequence[DataFrame], key: str = "name", snapshot: str = "snapshot") -> tuple[DataFrame, DataFrame]:
    """(merged rows, violations): one snapshot across all fragments and no repeated key."""
    merged = fragments[0]
    for other in fragments[1:]:
        merged = merged.unionByName(other)
    per_key = merged.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit("name_repeated").alias("violation"))
    mixed = merged.agg(F.min(snapshot).alias("a"), F.max(snapshot).alias("b")).filter("a <> b").select(
        F.lit(None).cast(merged.schema[key].dataType).alias(key), F.lit("snapshot_mismatch").alias("violation"))
    return merged, per_key.unionByName(mixed)


def fold_decisions(events: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Current approve / reject set per (name, code) after the name's last ``clear``.

    Two mergeable aggregates: the last clear per name, then the last action per (name, code).
    """
    stamp = F.struct(*order)
    cleared = events.filter(F.col("action") == "clear").groupBy("name").agg(F.max(stamp).alias("__cleared"))
    last = latest_per_key(events.filter(F.col("action") != "clear").select("name", "code", "action", *order), ["name", "code"], list(order))
    alive = last.join(cleared, "name", "left").filter(F.col("__cleared").isNull() | (stamp > F.col("__cleared")))
    return alive.select("name", "code", "action", *order)


def decision_violations(decisions: DataFrame, inventory: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per (name, violation).

    decisions (name, part, status, approved array); inventory (name, part); candidates (name, code,
    eligible, violation) where ``violation`` is the policy or attribute reason.
    """
    delta = classify_delta(inventory.withColumn("__c", F.lit(1)), decisions.groupBy("name").agg(F.count(F.lit(1)).alias("__c")), ["name"], "__c", "__c")
    missing = delta.filter("change = 'removed'").select("name", F.lit("decision_missing").alias("violation"))
    foreign = delta.filter("change = 'added'").select("name", F.lit("decision_for_unknown_name").alias("violation"))
    repeated = delta.filter("change = 'updated'").select("name", F.lit("decision_repeated").alias("violation"))
    moved = decisions.join(inventory.select("name", F.col("part").alias("__part")), "name").filter(
        F.col("part") != F.col("__part")).select("name", F.lit("decision_in_wrong_part").alias("violation"))
    matched, n = F.col("status") == "matched", F.size("approved")
    shape = F.when(~F.col("status").isin("matched", "needs_review", "unavailable", "non_purchased") | (F.size(F.array_distinct("approved")) != n),
                   "decision_invalid").when(~matched & (n > 0), "unmatched_has_products").when(matched & ~n.between(1, 3), "match_requires_products")
    shaped = decisions.select("name", shape.alias("violation")).filter("violation IS NOT NULL")
    picks = decisions.select("name", F.explode("approved").alias("code")).join(candidates.withColumn("__seen", F.lit(True)), ["name", "code"], "left")
    wrong = F.when(F.col("__seen").isNull(), "product_not_emitted").when(F.col("violation").isNotNull(), F.col("violation")).when(
        ~F.col("eligible"), "product_not_eligible")
    picked = picks.select("name", wrong.alias("violation")).filter("violation IS NOT NULL")
    out = missing
    for part in (foreign, repeated, moved, shaped, picked):
        out = out.unionByName(part)
    return out.distinct()


def expand_decisions(decisions: DataFrame, products: DataFrame) -> DataFrame:
    """Reviewed connections with the full product identity restored, order of approval kept.

    At most three products per name, so the nested list stays tiny.
    """
    long = decisions.select("name", "status", F.posexplode_outer("approved").alias("pos", "code")).join(products.select("code", "identity"), "code", "left")
    kept = F.filter(F.array_sort(F.collect_list(F.struct("pos", "code", "identity"))), lambda x: x["code"].isNotNull())
    rows = long.groupBy("name", "status").agg(kept.alias("__p"))
    return rows.select("name", "status", F.when(F.col("status") == "matched", F.get("__p", F.lit(0))["code"]).alias("main_product_id"),
                       F.transform("__p", lambda x: F.struct(x["code"].alias("product_id"), x["identity"].alias("identity"))).alias("approved"))
