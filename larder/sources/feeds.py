"""Feed scans: raw product JSON, nested retailer JSON, category trees, store lists, CSV reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import calendar as cal
from ..functions.hashing import price_hash
from ..functions.money import money_number_ore, money_ore, nested_money_ore
from ..functions.packs import feed_pack, pack_label
from ..functions.pricing import is_available, public_promotion
from ..functions.text import first_text
from ..session import cut_lineage

PROMOTION = "struct<applied:boolean,qualifyingCount:int,campaignType:string,validUntil:bigint>"
RAW_PRODUCT = (
    "code string, name string, manufacturer string, priceValue double, priceUnit string, comparePrice string, "
    "comparePriceUnit string, depositPrice string, displayVolume string, online boolean, outOfStock boolean, "
    f"addToCartDisabled boolean, potentialPromotions array<{PROMOTION}>"
)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw product records, one JSON object per line, kept as text next to the parsed fields."""
    return parse_raw(spark.read.text(path).withColumnRenamed("value", "raw"), "raw")


def parse_raw(df: DataFrame, column: str) -> DataFrame:
    parsed = df.withColumn("product", F.from_json(column, RAW_PRODUCT))
    return parsed.withColumn("fields", F.from_json(column, "map<string,string>"))


def normalise(raw: DataFrame, category: Column, observed_at: Column) -> DataFrame:
    """Typed products with integer money, pack, availability and price hash.

    ``raw`` has ``product`` and ``fields`` from ``parse_raw``.  Records without a valid code or a name are
    left to ``invalid_identity``.
    """
    p = {f: F.col(f"product.{f}") for f in (
        "code", "name", "manufacturer", "priceValue", "priceUnit", "comparePrice", "comparePriceUnit", "depositPrice",
        "displayVolume", "online", "outOfStock", "addToCartDisabled", "potentialPromotions")}
    price = money_number_ore(p["priceValue"])
    deposit = F.when(F.coalesce(p["depositPrice"], F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(money_ore(p["depositPrice"]))
    unit, compare_unit = F.coalesce(p["priceUnit"], F.lit("")), F.coalesce(p["comparePriceUnit"], F.lit(""))
    offers = F.coalesce(p["potentialPromotions"], F.array().cast(f"array<{PROMOTION}>"))
    ends = F.transform(F.filter(offers, lambda o: o["validUntil"].isNotNull()),
                       lambda o: F.timestamp_add("MILLISECOND", o["validUntil"], F.lit("1970-01-01").cast("timestamp_ntz")))
    flat = F.transform(offers, lambda o: F.struct(
        o["applied"].alias("applied"), o["qualifyingCount"].alias("qualifying_count"), o["campaignType"].alias("campaign_type")))
    compare = money_ore(p["comparePrice"])
    return raw.filter(~invalid_identity()).select(
        p["code"].alias("code"), p["name"].alias("name"), p["manufacturer"].alias("brand"), F.array(category).alias("categories"),
        price.alias("price_ore"), unit.alias("price_unit"), compare.alias("compare_ore"), compare_unit.alias("compare_unit"),
        deposit.alias("deposit_ore"), is_available(p["online"], p["outOfStock"], p["addToCartDisabled"], price).alias("available"),
        flat.alias("offers"), ends.alias("offer_ends"), pack_label(p["displayVolume"], unit).alias("pack"),
        price_hash(price, unit, compare, compare_unit, deposit, offers, F.col("fields")).alias("price_hash"),
        cal.utc(observed_at).alias("observed_at"))


def invalid_identity() -> Column:
    return ~F.coalesce(F.col("product.code").rlike("^[a-zA-Z0-9_-]{1,100}$") & (F.trim(F.col("product.name")) != ""), F.lit(False))


def online_only(raw: DataFrame) -> DataFrame:
    """Drop items that say they are offline; out-of-stock items stay."""
    return raw.filter(F.col("product.online").isNull() | F.col("product.online"))


RETAIL_PRICE = "struct<b2cPrice:string>"
RETAIL_PROMOTION = (
    f"struct<type:string,medMeraRequired:boolean,minimumQuantity:int,startDate:string,endDate:string,priceData:{RETAIL_PRICE},piecePriceData:{RETAIL_PRICE}>"
)
RETAIL_PRODUCT = (
    "code string, id string, ean string, gtin string, name string, displayName string, manufacturerName string, brand string, "
    "packageSize string, packageSizeUnit string, packageSizeInformation string, size string, netContent string, salesUnit string, "
    f"drainedWeight string, drainedWeightGrams double, listOfIngredients string, ingredientsText string, availableOnline boolean, "
    f"piecePriceData {RETAIL_PRICE}, salesPriceData {RETAIL_PRICE}, depositData {RETAIL_PRICE}, onlinePromotions array<{RETAIL_PROMOTION}>, "
    "navCategories array<struct<code:string,superCategories:array<struct<code:string,superCategories:array<struct<code:string>>>>>>"
)


def _instant(text: Column) -> Column:
    """ISO text to its UTC instant, whatever the session zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(text).cast("timestamp_ntz"))


def category_path(nav: Column) -> Column:
    """Category codes with all their ancestors, first occurrence order, depth three."""
    def up(level: Column) -> Column:
        return F.coalesce(level, F.array())

    def chain(c: Column) -> Column:
        parents = F.transform(up(c["superCategories"]), lambda p: F.concat(
            F.array(p["code"]), F.transform(up(p["superCategories"]), lambda g: g["code"])))
        return F.concat(F.array(c["code"]), F.flatten(parents))

    return F.array_distinct(F.array_compact(F.flatten(F.transform(up(nav), chain))))


def retail_observations(df: DataFrame, column: str, scope: str, checked_at: Column, verified: Column) -> DataFrame:
    """Nested retailer payloads to observations.  A price counts only for a verified store scope."""
    raw = df.withColumn("__p", F.from_json(column, RETAIL_PRODUCT))
    p = lambda f: F.col(f"__p.{f}")
    product_id = first_text(p("code"), p("id"), p("ean"))
    ean = first_text(p("ean"), p("gtin"), F.when(product_id.rlike(r"^\d{8,14}$"), product_id))
    weighed = F.lower(F.coalesce(p("salesUnit"), F.lit(""))).isin("vikt", "kg")
    regular = F.when(weighed, nested_money_ore(p("salesPriceData.b2cPrice"))).otherwise(nested_money_ore(p("piecePriceData.b2cPrice")))
    offers = F.transform(p("onlinePromotions"), lambda o: F.struct(
        F.when(weighed, nested_money_ore(o["priceData"]["b2cPrice"])).otherwise(nested_money_ore(o["piecePriceData"]["b2cPrice"])).alias("amount_ore"),
        o["type"].alias("type"), o["medMeraRequired"].alias("member_only"), o["minimumQuantity"].alias("minimum"),
        _instant(o["startDate"]).alias("starts"), _instant(o["endDate"]).alias("ends")))
    promo = F.when(verified, public_promotion(regular, offers, checked_at))
    pack = feed_pack(p("packageSize"), p("size"), p("netContent"), unit_text=p("packageSizeUnit"), info_text=p("packageSizeInformation"))
    from ..functions.packs import feed_quantity

    drained = F.coalesce(p("drainedWeightGrams"), F.when(feed_quantity(p("drainedWeight"))["unit"] == "g", feed_quantity(p("drainedWeight"))["quantity"]))
    staged = raw.withColumn("__promo", promo).withColumn("__pack", pack)
    availability = F.when(~verified | p("availableOnline").isNull(), "unknown").when(p("availableOnline"), "available").otherwise("unavailable")
    return staged.select(
        F.col(scope).alias("scope"), product_id.alias("product_id"), F.when(ean.rlike(r"^\d{8,14}$"), ean).alias("ean"),
        first_text(p("name"), p("displayName")).alias("name"), first_text(p("manufacturerName"), p("brand")).alias("brand"),
        category_path(p("navCategories")).alias("categories"),
        F.when(F.col("__pack").isNotNull(), F.struct(F.col("__pack.quantity"), F.col("__pack.unit"), drained.alias("drained_grams"), F.col("__pack.approximate"))).alias("pack"),
        first_text(p("listOfIngredients"), p("ingredientsText")).alias("ingredients_text"),
        F.col("__promo.amount_ore").alias("amount_ore"), F.when(F.col("__promo").isNotNull(), F.when(weighed, "kg").otherwise("pack")).alias("basis"),
        F.when(F.col("__promo").isNotNull(), nested_money_ore(p("depositData.b2cPrice"))).alias("deposit_ore"),
        F.col("__promo.minimum").alias("minimum"), F.col("__promo.starts").alias("valid_from"), F.col("__promo.ends").alias("valid_until"),
        availability.alias("availability"), cal.utc(checked_at).alias("checked_at"),
        cal.reference_expiry(checked_at, F.col("__promo.ends")).alias("expires_at"), verified.alias("store_scope_verified"))


def category_closure(edges: DataFrame) -> DataFrame:
    """(root, node, depth, cyclic): every ancestor pair of an edge table (parent, child) once, at its least depth.

    Depths double: a shortest way longer than d and no longer than 2 d starts with one of exactly d, so only pairs of that depth are
    joined to what is known, and the rounds grow with the logarithm of the depth.  ``cyclic`` tells nodes that reach themselves.
    """
    known = cut_lineage(edges.select(F.col("parent").alias("root"), F.col("child").alias("node")).distinct().withColumn("depth", F.lit(1)))
    reach = 1
    while True:
        onward = known.select(F.col("root").alias("__mid"), "node", F.col("depth").alias("__more"))
        ends = known.filter(F.col("depth") == reach).select("root", F.col("node").alias("__mid"))
        longer = ends.join(onward, "__mid").groupBy("root", "node").agg((F.min("__more") + reach).alias("depth"))
        new = cut_lineage(longer.join(known, ["root", "node"], "left_anti"))
        if new.isEmpty():
            break
        known, reach = cut_lineage(known.unionByName(new)), 2 * reach
    loops = known.filter("root = node").select("node", F.lit(True).alias("cyclic"))
    return known.join(loops, "node", "left").select("root", "node", "depth", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def leaf_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).distinct().join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def tree_conflicts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node ids listed with different names.  nodes (node, name)."""
    return nodes.groupBy("node").agg(F.min("name").alias("a"), F.max("name").alias("b")).filter("a <> b").select("node")


def store_directory(lists: list[DataFrame]) -> DataFrame:
    """One row per store from per-channel lists (store_id, name, channel, postal_code, address, seq).

    Channels are united; each attribute takes its first known value in list order.
    """
    rows = lists[0]
    for other in lists[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("store_id").agg(
        F.array_sort(F.collect_set("channel")).alias("channels"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("name", "postal_code", "address")])


def scope_key(retailer: Column, store_id: Column, channel: Column, slot: Column) -> Column:
    return F.to_json(F.array(retailer, store_id, channel, slot), {"ignoreNullFields": "false"})


def scope_valid(store_id: Column, channel: Column, slot: Column) -> Column:
    return F.coalesce(store_id.rlike("^[a-zA-Z0-9_-]{1,100}$") & channel.isin("pickup", "delivery")
                      & (slot.isNull() | F.length(slot).between(1, 100)), F.lit(False))


def postal_code(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{3}\s?\d{2}$"), F.regexp_replace(text, r"\s", ""))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with a header; a quote inside a quoted text is doubled."""
    return spark.read.csv(path, header=True, schema=schema, escape=chr(34))


#: Envelope keys a readiness map may sit under, and metadata keys beside bare counts (fixed values).
READINESS_ENVELOPES = ("recipeUnresolvedCounts", "recipeIdToUnresolvedCount", "unresolvedPriceReadinessByRecipeId", "counts")
READINESS_METADATA = ("readinessBuildId", "buildId", "sourceSha256", "inputSha256s", "schemaVersion", "builtAt", "source", "summary")


def readiness_counts(df: DataFrame, column: str) -> DataFrame:
    """``{recipeId: count}`` documents to rows (recipe_id, unresolved, violation)."""
    whole = F.from_json(column, "map<string,string>")
    inner = F.coalesce(*[F.from_json(F.get_json_object(column, f"$.{k}"), "map<string,string>") for k in READINESS_ENVELOPES])
    cells = F.coalesce(inner, F.map_filter(whole, lambda k, _: ~k.isin(*READINESS_METADATA)))
    rows = df.select(F.explode(cells).alias("key", "value"))
    good_id = F.col("key").rlike("^(?:0|[1-9][0-9]*)$")
    good = F.coalesce(F.col("value").rlike("^[0-9]+$"), F.lit(False))
    return rows.select(
        F.when(good_id, F.col("key").try_cast("bigint")).alias("recipe_id"), F.when(good, F.col("value").try_cast("bigint")).alias("unresolved"),
        F.when(~good_id, "noncanonical_recipe_id").when(~good, "invalid_count").alias("violation"))


def merge_category_hits(rows: DataFrame, key: str, categories: str, seq: str) -> DataFrame:
    """One row per product over categories: categories united and sorted, the later row wins.

    The union works on exploded pairs, so a product listed very often is reduced map-side.
    """
    rest = [c for c in rows.columns if c not in (key, categories)]
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__row"))
    united = rows.select(key, F.explode(categories).alias("__c")).groupBy(key).agg(F.array_sort(F.collect_set("__c")).alias(categories))
    return latest.join(united, key).select(key, categories, "__row.*").drop(seq)


def merge_scanned(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Cross-category dedupe that also tells products that changed during the scan."""
    return rows.groupBy(key).agg(
        F.min("checked_at").alias("checked_at"), F.min("expires_at").alias("expires_at"),
        F.min(content).alias("__a"), F.max(content).alias("__b"), F.count(F.lit(1)).alias("hits")).select(
        key, "checked_at", "expires_at", "hits",
        F.when(F.col("__a") != F.col("__b"), F.lit("product_changed_during_scan")).alias("violation"))
