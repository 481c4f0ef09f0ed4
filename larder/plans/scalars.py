"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attributes, calendar as cal, hashing, money, packs, policy, pricing, text, units
from ..sources import feeds
from . import mapping as m
from .registry import Tables, query


@query("money_text_to_ore", """
WITH raw AS (
  SELECT p_partkey, CASE p_partkey % 5
    WHEN 0 THEN replace(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',') || ' kr'
    WHEN 1 THEN CAST(p_size AS VARCHAR) || ' 000,5kr/kg'
    WHEN 2 THEN '-' || CAST(p_size AS VARCHAR)
    WHEN 3 THEN CAST(p_size AS VARCHAR) || '.125'
    ELSE CAST(p_size AS VARCHAR) || ' kr/st' END AS raw_text FROM part),
clean AS (SELECT *, replace(regexp_replace(regexp_replace(raw_text, '\\s', '', 'g'), '(?i)kr(?:/(?:st|kg|l))?$', ''), ',', '.') AS c FROM raw)
SELECT p_partkey, raw_text,
  CASE WHEN regexp_matches(c, '^\\d+(?:\\.\\d{1,2})?$') THEN CAST(CAST(c AS DECIMAL(20,2)) * 100 AS BIGINT) END AS price_ore,
  CASE WHEN regexp_matches(c, '^\\d+(?:\\.\\d{1,2})?$') THEN CAST(CAST(c AS DECIMAL(20,2)) * 100 AS BIGINT) END AS nested_ore
FROM clean""")
def money_text_to_ore(t: Tables):
    kind = F.col("p_partkey") % 5
    size = F.col("p_size").cast("string")
    raw = (
        F.when(kind == 0, F.concat(F.replace(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" kr")))
        .when(kind == 1, F.concat(size, F.lit(" 000,5kr/kg"))).when(kind == 2, F.concat(F.lit("-"), size))
        .when(kind == 3, F.concat(size, F.lit(".125"))).otherwise(F.concat(size, F.lit(" kr/st"))))
    rows = t.part.select("p_partkey", raw.alias("raw_text"))
    nested = money.nested_money_ore(F.lit(None).cast("string"), F.regexp_replace("raw_text", "/(?:st|kg)$", ""))
    return rows.select("p_partkey", "raw_text", money.money_ore(F.col("raw_text")).alias("price_ore"), nested.alias("nested_ore"))


@query("pack_label_parse", """
WITH raw AS (
  SELECT p_partkey, CASE p_partkey % 7
    WHEN 0 THEN p_size || '00/' || p_size || '0g'
    WHEN 1 THEN p_size || 'p/0,5l'
    WHEN 2 THEN '2x' || p_size || ',5 dl'
    WHEN 3 THEN 'ca: ' || p_size || 'kg'
    WHEN 4 THEN p_size || ' st'
    WHEN 5 THEN p_size || ' burkar'
    ELSE 'CA ' || p_size || ' cl' END AS label, p_size FROM part),
x AS (SELECT *, regexp_replace(regexp_replace(replace(lower(label), ',', '.'), '\\s', '', 'g'), '^ca:?', '') AS c FROM raw)
SELECT p_partkey, label,
  CASE p_partkey % 7 WHEN 0 THEN CAST(regexp_extract(c, '^(\\d+)/', 1) AS DOUBLE)
    WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN 2 * CAST(regexp_extract(c, '^2x([0-9.]+)dl$', 1) AS DOUBLE) * 100
    WHEN 3 THEN p_size * 1000.0 WHEN 4 THEN CAST(p_size AS DOUBLE) WHEN 5 THEN NULL ELSE p_size * 10.0 END AS quantity,
  CASE p_partkey % 7 WHEN 0 THEN 'g' WHEN 1 THEN 'piece' WHEN 2 THEN 'ml' WHEN 3 THEN 'g' WHEN 4 THEN 'piece' WHEN 5 THEN NULL ELSE 'ml' END AS unit,
  CASE WHEN p_partkey % 7 = 0 THEN CAST(regexp_extract(c, '/(\\d+)g$', 1) AS DOUBLE) END AS drained_grams,
  regexp_matches(label, '(?i)^ca') AS approximate,
  CASE WHEN regexp_matches(lower(label), '^[0-9]+ (st)$') THEN CAST(p_size AS DOUBLE) WHEN FALSE THEN 0 END AS feed_quantity
FROM x""")
def pack_label_parse(t: Tables):
    kind, size = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    label = (
        F.when(kind == 0, F.concat(size, F.lit("00/"), size, F.lit("0g"))).when(kind == 1, F.concat(size, F.lit("p/0,5l")))
        .when(kind == 2, F.concat(F.lit("2x"), size, F.lit(",5 dl"))).when(kind == 3, F.concat(F.lit("ca: "), size, F.lit("kg")))
        .when(kind == 4, F.concat(size, F.lit(" st"))).when(kind == 5, F.concat(size, F.lit(" burkar")))
        .otherwise(F.concat(F.lit("CA "), size, F.lit(" cl"))))
    rows = t.part.select("p_partkey", label.alias("label"))
    pack = packs.pack_label(F.col("label"), F.lit("kr/st"))
    feed = packs.feed_pack(F.col("label"))
    return rows.select("p_partkey", "label", pack["quantity"].alias("quantity"), pack["unit"].alias("unit"),
                       pack["drained_grams"].alias("drained_grams"), pack["approximate"].alias("approximate"), feed["quantity"].alias("feed_quantity"))


@query("quantity_text_parse", """
SELECT l_orderkey, l_linenumber,
  CASE l_linenumber % 4 WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 1 THEN CAST(l_quantity AS BIGINT) || '/' || l_linenumber
    WHEN 2 THEN CAST(l_quantity AS BIGINT) || ' 1/' || l_linenumber ELSE 'to taste' END AS amount_text,
  CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity / l_linenumber
    WHEN 2 THEN l_quantity + 1.0 / CAST(l_linenumber AS DOUBLE) END AS quantity
FROM lineitem""")
def quantity_text_parse(t: Tables):
    kind, q, n = F.col("l_linenumber") % 4, F.col("l_quantity").cast("bigint").cast("string"), F.col("l_linenumber").cast("string")
    amount = F.when(kind == 0, q).when(kind == 1, F.concat(q, F.lit("/"), n)).when(kind == 2, F.concat(q, F.lit(" 1/"), n)).otherwise("to taste")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", amount.alias("amount_text"))
    return rows.withColumn("quantity", packs.quantity_text(F.col("amount_text")))


_UNITS = {0: "kg", 1: "Cups", 2: "dozen", 3: "T", 4: "pinch"}
_UNIT_CASE = "CASE l_linenumber % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _UNITS.items()) + " END"


@query("unit_canonicalise", f"""
WITH dim(unit, kind, factor, measure) AS (VALUES ('kg','g',1000.0::DOUBLE,NULL), ('Cups','ml',236.5882365::DOUBLE,'cup'), ('dozen','piece',12.0::DOUBLE,NULL),
  ('T',NULL,NULL,'tablespoon'), ('pinch',NULL,NULL,NULL)),
lines AS (SELECT l_orderkey, l_linenumber, {_UNIT_CASE} AS unit, l_quantity, l_returnflag = 'R' AS conflict,
  CASE WHEN l_linestatus = 'O' AND l_tax = 0 THEN l_quantity * 2 END AS over FROM lineitem)
SELECT l_orderkey, l_linenumber, unit, measure,
  CASE WHEN over IS NOT NULL THEN over WHEN conflict OR kind IS NULL THEN NULL ELSE l_quantity * factor END AS quantity,
  CASE WHEN over IS NOT NULL THEN 'g' WHEN conflict THEN NULL ELSE kind END AS canonical_unit,
  CASE WHEN over IS NOT NULL THEN NULL WHEN conflict THEN 'conflicting_source_quantity' WHEN kind IS NULL THEN 'unit_conversion_unknown' END AS reason
FROM lines JOIN dim USING (unit)""")
def unit_canonicalise(t: Tables):
    unit = F.element_at(F.array(*[F.lit(v) for v in _UNITS.values()]), F.col("l_linenumber") % 5 + 1)
    over = F.when((F.col("l_linestatus") == "O") & (F.col("l_tax") == 0), F.struct((F.col("l_quantity") * 2).alias("quantity"), F.lit("g").alias("unit")))
    rows = t.lineitem.withColumn("unit", unit).withColumn("__o", over)
    amount = units.canonical_amount(F.col("l_quantity").cast("string"), F.col("unit"), F.col("l_returnflag") == "R", F.lit(1.0), F.col("__o"))
    rows = rows.withColumn("__a", amount)
    return rows.select("l_orderkey", "l_linenumber", "unit", units.measure_unit(F.col("unit")).alias("measure"),
                       F.col("__a.quantity").alias("quantity"), F.col("__a.unit").alias("canonical_unit"), F.col("__a.reason").alias("reason"))


_FOLD = "trim(regexp_replace(replace(replace(lower(strip_accents({0})), '’', ''), '''', ''), '[^a-z0-9%]+', ' ', 'g'))"


@query("fold_text", f"""
SELECT doc_id, {_FOLD.format('text')} AS folded, md5({_FOLD.format('text')}) AS folded_md5,
  regexp_replace(trim(regexp_replace(replace(lower(text), '&', 'and'), '\\s+', ' ', 'g')), '^[ ,.;:]+|[ ,.;:]+$', '', 'g') AS name_key
FROM documents""")
def fold_text(t: Tables):
    folded = text.fold_distinct(t.documents.select("doc_id", "text"), "text", "folded")
    return folded.select("doc_id", "folded", F.md5("folded").alias("folded_md5"), text.name_key(F.col("text")).alias("name_key"))


NOW = "2024-01-10 12:00:00"
_NOW = f"TIMESTAMP '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("stockholm_week_freshness", f"""
SELECT event_id, {m.sql_stamp(m.sql_week_end('ts'))} AS week_end,
  (ts <= {_NOW} + INTERVAL 60 SECONDS AND {m.sql_week_end('ts')} = {m.sql_week_end(_NOW)}) AS current,
  {m.sql_stamp(f"least({m.sql_week_end('ts')}, CASE WHEN offer_end > ts THEN offer_end END)")} AS expires_at
FROM (SELECT *, ts + (CAST(floor(value) AS BIGINT) - 10) * INTERVAL 1 HOUR AS offer_end FROM events)""")
def stockholm_week_freshness(t: Tables):
    hours = F.floor("value").cast("int") - 10
    rows = t.events.withColumn("ends", F.array(F.timestamp_add("HOUR", hours, F.col("ts"))))
    return rows.select("event_id", m.stamp(cal.week_end(F.col("ts"))).alias("week_end"), cal.scan_is_current(F.col("ts"), now()).alias("current"),
                       m.stamp(cal.expiry(F.col("ts"), F.col("ends"))).alias("expires_at"))


_PRICED_PARTS = """priced AS (
  SELECT p_partkey AS code, p_size, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS price_ore,
    CASE p_partkey % 4 WHEN 0 THEN 'kr/kg' WHEN 1 THEN 'kr/st' WHEN 2 THEN 'kr/förp' ELSE 'kr/l' END AS price_unit,
    CASE p_partkey % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' ELSE 'piece' END AS pack_unit,
    p_size % 10 = 0 AS approximate, p_size % 7 <> 0 AS available, p_size % 11 = 0 AS conditional,
    CASE WHEN p_size % 13 = 0 THEN NULL ELSE p_size * 10 END AS deposit_ore,
    CASE p_partkey % 5 WHEN 0 THEN 'l' WHEN 1 THEN 'piece' ELSE 'kg' END AS basis FROM part)"""


def priced_parts(t: Tables):
    key, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        key.alias("code"), "p_size", m.list_price_ore().alias("price_ore"),
        F.element_at(F.array(F.lit("kr/kg"), F.lit("kr/st"), F.lit("kr/förp"), F.lit("kr/l")), (key % 4 + 1).cast("int")).alias("price_unit"),
        F.struct(size.cast("double").alias("quantity"),
                 F.element_at(F.array(F.lit("g"), F.lit("ml"), F.lit("piece")), (key % 3 + 1).cast("int")).alias("unit"),
                 F.lit(None).cast("double").alias("drained_grams"), (size % 10 == 0).alias("approximate")).alias("pack"),
        (size % 7 != 0).alias("available"), (size % 11 == 0).alias("conditional"),
        F.when(size % 13 != 0, size * 10).cast("bigint").alias("deposit_ore"),
        F.when(key % 5 == 0, "l").when(key % 5 == 1, "piece").otherwise("kg").alias("basis"))


@query("comparable_unit_price", m.sql(_PRICED_PARTS, body="""
, unit AS (SELECT *, CASE WHEN price_unit = 'kr/' || basis THEN CAST(price_ore AS DOUBLE)
    WHEN price_unit IN ('kr/st', 'kr/förp') THEN CASE
      WHEN pack_unit = CASE basis WHEN 'kg' THEN 'g' WHEN 'l' THEN 'ml' ELSE 'piece' END AND NOT approximate
        THEN price_ore / CAST(p_size AS DOUBLE) * CASE WHEN basis = 'piece' THEN 1.0 ELSE 1000.0 END
      WHEN basis = 'kg' THEN CAST(price_ore + 1 AS DOUBLE) END END AS unit_price FROM priced)
SELECT code, basis, CAST(floor(unit_price + 0.5) AS BIGINT) AS unit_price_ore,
  CASE WHEN NOT available THEN 'unavailable' WHEN deposit_ore IS NULL OR unit_price IS NULL THEN 'price_or_comparison_basis_unknown'
    WHEN conditional THEN 'conditional_price' END AS exclusion,
  CASE WHEN deposit_ore IS NULL THEN NULL WHEN price_unit IN ('kr/st', 'kr/förp') THEN price_ore
    WHEN price_unit = 'kr/kg' AND pack_unit = 'g' OR price_unit = 'kr/l' AND pack_unit = 'ml'
    THEN CAST(floor(CAST(price_ore AS DOUBLE) * p_size / 1000 + 0.5) AS BIGINT) END AS pack_price_ore
FROM unit"""))
def comparable_unit_price(t: Tables):
    rows = priced_parts(t)
    price = pricing.comparable_unit_price(F.col("price_ore"), F.col("price_unit"), F.col("price_ore") + 1, F.lit("kr/kg"), F.col("pack"), F.col("basis"))
    rows = rows.withColumn("unit_price", price)
    offers = F.array(F.struct(F.lit(True).alias("applied"), F.when(F.col("conditional"), 2).otherwise(1).alias("qualifying_count"), F.lit("GENERAL").alias("campaign_type")))
    why = pricing.candidate_exclusion(
        F.lit(None).cast("string"), F.col("available"), F.col("price_ore"), F.col("deposit_ore"), F.col("unit_price"), now(), cal.week_end(now()), now(),
        pricing.conditional_offer(offers))
    pack_price = pricing.mapped_pack_price(F.col("price_ore"), F.col("price_unit"), F.col("deposit_ore"), F.col("p_size").cast("double"), F.col("pack.unit"))
    return rows.select("code", "basis", money.ore(F.col("unit_price")).alias("unit_price_ore"), why.alias("exclusion"), pack_price.alias("pack_price_ore"))


@query("text_policy_classify", f"""
WITH folded AS (SELECT DISTINCT text, {_FOLD.format('text')} AS s FROM documents),
extra AS (SELECT DISTINCT p_name || ' ' || w AS text, p_name || ' ' || w AS s FROM part, (VALUES ('red wine vinegar'), ('chicken broth'), ('beef stock'),
  ('vanilla extract'), ('vegan sausage'), ('bacon'), ('turkey bacon'), ('goat cheese'), ('goat'), ('vegetable shortening'), ('shortening'), ('gelatin'),
  ('coconut meat'), ('root beer'), ('ginger ale'), ('beer'), ('blood orange'), ('fish stock'), ('hamburger buns'), ('hens'), ('crab meat'))
  AS v(w)),
classified AS (SELECT text, {policy.classify_sql('s', 'reason')} AS reason, {policy.classify_sql('s', 'meat')} AS meat FROM
  (SELECT * FROM folded UNION ALL SELECT * FROM extra))
SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS subject, reason, meat FROM documents JOIN classified USING (text)
UNION ALL SELECT 'name', text, reason, meat FROM classified JOIN extra USING (text)""")
def text_policy_classify(t: Tables):
    words = ("red wine vinegar", "chicken broth", "beef stock", "vanilla extract", "vegan sausage", "bacon", "turkey bacon", "goat cheese", "goat",
             "vegetable shortening", "shortening", "gelatin", "coconut meat", "root beer", "ginger ale", "beer", "blood orange", "fish stock",
             "hamburger buns", "hens", "crab meat")
    names = t.part.select("p_name").distinct().select(F.explode(F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.concat_ws(" ", "p_name", w))).alias("text"))
    rows = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("subject"), "text").unionByName(
        names.select(F.lit("name").alias("kind"), F.col("text").alias("subject"), "text"))
    return policy.classify_names(rows, "text").select("kind", "subject", F.col("policy.reason").alias("reason"), F.col("policy.meat").alias("meat"))


@query("attribute_verification", """
WITH asked(request_id, request) AS (VALUES (1,'organic red bolt'), (2,'fresh blue plate'), (3,'frozen gear 20%'), (4,'light cream 5%'), (5,'heinz red ring'), (6,'dry roasted rod')),
goods AS (SELECT p_partkey AS code, p_name || CASE p_partkey % 6 WHEN 0 THEN ' eko' WHEN 1 THEN ' fryst' WHEN 2 THEN ' 20%' WHEN 3 THEN ' light 5%' WHEN 4 THEN ' torrrost' ELSE '' END AS title,
  lower(p_type) AS category, CASE WHEN p_size % 2 = 0 THEN 'heinz' ELSE 'other' END AS brand FROM part)
SELECT request_id, code, CASE request_id
  WHEN 1 THEN CASE WHEN NOT regexp_matches(title, '\\beko\\b') THEN 'organic_not_verified' END
  WHEN 2 THEN CASE WHEN title LIKE '%fryst%' THEN 'fresh_incompatible' END
  WHEN 3 THEN CASE WHEN title NOT LIKE '%fryst%' THEN 'frozen_not_verified' WHEN regexp_extract(title, '(\\d+)%', 1) <> '20' THEN 'percentage_not_verified' END
  WHEN 4 THEN CASE WHEN NOT regexp_matches(title, '\\blight\\b') THEN 'reduced_fat_not_verified' WHEN regexp_extract(title, '(\\d+)%', 1) <> '5' THEN 'percentage_not_verified' END
  WHEN 5 THEN CASE WHEN brand <> 'heinz' THEN 'requested_brand_not_verified' END
  ELSE CASE WHEN title LIKE '%fryst%' THEN 'dry_form_incompatible' WHEN title NOT LIKE '%torrrost%' THEN 'dry_roasting_not_verified' END END AS exclusion
FROM goods, asked""")
def attribute_verification(t: Tables):
    asked = {1: "organic red bolt", 2: "fresh blue plate", 3: "frozen gear 20%", 4: "light cream 5%", 5: "heinz red ring", 6: "dry roasted rod"}
    suffix = F.element_at(F.array(*[F.lit(s) for s in (" eko", " fryst", " 20%", " light 5%", " torrrost", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    goods = t.part.select(F.col("p_partkey").alias("code"), F.concat("p_name", suffix).alias("title"), F.array(F.lower("p_type")).alias("categories"),
                          F.when(F.col("p_size") % 2 == 0, "heinz").otherwise("other").alias("brand"))
    tests = [F.struct(F.lit(i).alias("request_id"), attributes.attribute_exclusion(
        F.lit(r), F.col("title"), text.fold_text(F.col("title")), F.col("brand"), F.col("categories"), F.lit(None).cast("double")).alias("exclusion"))
        for i, r in asked.items()]
    return goods.select("code", F.explode(F.array(*tests)).alias("x")).select("x.request_id", "code", "x.exclusion")


@query("public_promotion_pick", """
WITH offers AS (
  SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS regular_ore,
    CASE WHEN l_quantity > 10 THEN CAST(floor(l_extendedprice * 90 + 0.5) AS BIGINT) END AS a,
    CASE WHEN l_returnflag = 'N' THEN CAST(floor(l_extendedprice * 80 + 0.5) AS BIGINT) END AS b,
    CASE WHEN l_returnflag = 'A' AND l_quantity > 25 THEN CAST(floor(l_extendedprice * 70 + 0.5) AS BIGINT) END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(least(a, b, c), regular_ore) AS amount_ore, CASE WHEN least(a, b, c) IS NOT NULL THEN 1 END AS minimum
FROM offers""")
def public_promotion_pick(t: Tables):
    ship = F.col("l_shipdate")

    def offer(rate: int, kind, member, minimum, starts, ends):
        return F.struct(money.ore(F.col("l_extendedprice") * rate).alias("amount_ore"), kind.alias("type"), member.alias("member_only"),
                        minimum.cast("int").alias("minimum"), starts.alias("starts"), ends.alias("ends"))

    day = lambda n: F.timestamp_add("DAY", F.lit(n), ship)
    offers = F.array(
        offer(90, F.lit("FIXED_PRICE"), F.lit(False), F.when(F.col("l_quantity") > 10, 1).otherwise(2), day(-1), day(1)),
        offer(80, F.lit("FIXED_PRICE"), F.col("l_returnflag") != "N", F.lit(None), day(-3), day(0)),
        offer(70, F.when(F.col("l_returnflag") == "A", "FIXED_PRICE").otherwise("MULTI"), F.lit(False), F.lit(1),
              F.when(F.col("l_quantity") > 25, day(0)).otherwise(day(1)), day(2)))
    pick = pricing.public_promotion(money.ore(F.col("l_extendedprice") * 100), offers, ship)
    return t.lineitem.withColumn("__p", pick).select("l_orderkey", "l_linenumber", F.col("__p.amount_ore").alias("amount_ore"), F.col("__p.minimum").alias("minimum"))


@query("raw_json_scan", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS fields,
  CAST(floor(value * 100 + 0.5) AS BIGINT) AS price_ore, event_type <> 'error' AND event_type <> 'logout' AS available,
  CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) || 'g' AS label, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS grams
FROM events WHERE event_type <> 'error' AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 0""")
def raw_json_scan(t: Tables):
    k = F.get_json_object("props", "$.k")
    body = F.to_json(F.struct(
        F.concat(F.lit("e"), "event_id").alias("code"), F.col("event_type").alias("name"), F.col("value").alias("priceValue"), F.lit("kr/st").alias("priceUnit"),
        (F.col("event_type") != "error").alias("online"), (F.col("event_type") == "logout").alias("outOfStock"), F.lit(False).alias("addToCartDisabled"),
        F.concat(k, F.lit("g")).alias("displayVolume")))
    raw = feeds.online_only(feeds.parse_raw(t.events.select("event_id", "ts", "props", body.alias("raw")), "raw"))
    counted = raw.withColumn("__m", F.from_json("props", "map<string,bigint>"))
    facts = counted.select(F.concat(F.lit("e"), "event_id").alias("code"), "event_id", F.element_at("__m", "k").alias("k"), F.size("__m").cast("bigint").alias("fields"))
    rows = feeds.normalise(raw, F.lit("feed"), F.col("ts"))
    return rows.join(facts, "code").select("event_id", "k", "fields", "price_ore", "available",
                                           F.concat("k", F.lit("g")).alias("label"), F.col("pack.quantity").alias("grams"))


@query("content_and_price_hash", m.sql(m.SCANS, body="""
SELECT a.store, a.code, a.revision, a.content <> b.content AS content_changed, a.price_ore <> b.price_ore AS price_changed,
  'ing_' || substr(sha256(CAST(a.code AS VARCHAR)), 1, 24) AS ingredient_id
FROM scans a JOIN scans b ON a.store = b.store AND a.code = b.code AND b.revision = a.revision - 1"""))
def content_and_price_hash(t: Tables):
    empty = F.array().cast(f"array<{feeds.PROMOTION}>")
    source = F.create_map(F.lit("priceValue"), F.col("price_ore").cast("string"), F.lit("stockLevel"), F.col("stock"))
    rows = m.scans(t).select(
        "store", "code", "revision", hashing.content_hash(price=F.col("price_ore"), stock=F.col("stock")).alias("c"),
        hashing.price_hash(F.col("price_ore"), F.lit("kr/st"), F.lit(None).cast("bigint"), F.lit(""), F.lit(0), empty, source).alias("p"))
    before = rows.select("store", "code", (F.col("revision") + 1).alias("revision"), F.col("c").alias("c0"), F.col("p").alias("p0"))
    return rows.join(before, ["store", "code", "revision"]).select(
        "store", "code", "revision", (F.col("c") != F.col("c0")).alias("content_changed"), (F.col("p") != F.col("p0")).alias("price_changed"),
        hashing.ingredient_id(F.col("code").cast("string")).alias("ingredient_id"))


@query("table_digest_per_scan", m.sql(m.SCANS, body="""
, h AS (SELECT store, revision, sha256(code || ':' || content) AS x FROM scans)
SELECT store, revision, count(*) AS products, sha256(count(*) || ':' ||
  sum(CAST(('0x' || substr(x, 1, 15)) AS BIGINT)::HUGEINT) || ':' || sum(CAST(('0x' || substr(x, 16, 15)) AS BIGINT)::HUGEINT) || ':' ||
  sum(CAST(('0x' || substr(x, 31, 15)) AS BIGINT)::HUGEINT) || ':' || sum(CAST(('0x' || substr(x, 46, 15)) AS BIGINT)::HUGEINT)) AS digest
FROM h GROUP BY store, revision"""))
def table_digest_per_scan(t: Tables):
    rows = m.scans(t).select("store", "revision", F.sha2(F.concat_ws(":", "code", "content"), 256).alias("h"))
    return rows.groupBy("store", "revision").agg(F.count(F.lit(1)).alias("products"), hashing.table_digest(F.col("h")).alias("digest"))


@query("store_scope_key", """
SELECT s_suppkey, '["shop","' || s_suppkey || '","' || CASE WHEN s_acctbal < 0 THEN 'drone' WHEN s_nationkey % 2 = 0 THEN 'pickup' ELSE 'delivery' END || '",null]' AS scope_key,
  s_acctbal >= 0 AS valid, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') END AS postal_code
FROM supplier""")
def store_scope_key(t: Tables):
    channel = F.when(F.col("s_acctbal") < 0, "drone").when(F.col("s_nationkey") % 2 == 0, "pickup").otherwise("delivery")
    store, slot = F.col("s_suppkey").cast("string"), F.lit(None).cast("string")
    code = F.concat(F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"), F.when(F.col("s_suppkey") % 3 == 0, "-").otherwise(" "),
                    F.lpad(F.col("s_nationkey").cast("string"), 2, "0"))
    return t.supplier.select(
        "s_suppkey", feeds.scope_key(F.lit("shop"), store, channel, slot).alias("scope_key"),
        feeds.scope_valid(store, channel, slot).alias("valid"), feeds.postal_code(code).alias("postal_code"))
