"""Queries over store-scoped observations, connections and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal, hashing, policy, pricing
from ..functions.text import fold_text
from ..operators import quality, retail as rt, review as rv
from ..session import exchanged
from ..sources import feeds
from . import mapping as m
from .baskets import lot
from .quotes import NOW, now
from .registry import Tables, query

_NOW = f"TIMESTAMP '{NOW}'"


@query("retail_feed_scan", """
SELECT CAST(p_partkey AS VARCHAR) AS product_id, CASE WHEN p_partkey >= 10000000 THEN CAST(p_partkey AS VARCHAR) END AS ean, p_name AS name, p_brand AS brand, 'leaf' || p_size || ',' || lower(p_type) || ',root' AS categories,
  CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS DOUBLE) * 1000 WHEN p_size % 4 = 1 THEN p_size * 1.0 WHEN p_size % 4 = 2 THEN p_size * 10.0 END AS quantity,
  CASE WHEN p_size % 4 = 0 THEN 'g' WHEN p_size % 4 = 1 THEN 'piece' WHEN p_size % 4 = 2 THEN 'ml' END AS unit,
  CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) * 50 ELSE CAST(p_size AS BIGINT) * 100 END END AS amount_ore,
  CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_type = 'PROMO' THEN 'kg' ELSE 'pack' END END AS basis,
  CASE WHEN p_partkey % 5 = 0 THEN 'unknown' WHEN p_size % 6 = 0 THEN 'unavailable' ELSE 'available' END AS availability FROM part""")
def retail_feed_scan(t: Tables):
    size, key = F.col("p_size"), F.col("p_partkey")
    price = F.struct(F.concat(size.cast("string"), F.lit(",00 kr")).alias("b2cPrice"))
    half = F.struct(F.format_string("%.2f", size / 2).alias("b2cPrice"))
    offer = F.struct(F.lit("FIXED_PRICE").alias("type"), (key % 3 != 0).alias("medMeraRequired"), F.lit("2024-01-01T00:00:00Z").alias("startDate"),
                     F.lit("2024-02-01T00:00:00Z").alias("endDate"), half.alias("priceData"), half.alias("piecePriceData"))
    kind = size % 4
    package = F.when(kind == 0, F.concat(size.cast("string"), F.lit(" kg"))).when(kind == 1, size.cast("string")).when(kind == 2, F.concat(size.cast("string"), F.lit("cl"))).otherwise("en burk")
    parents = F.array(F.struct(F.lower("p_type").alias("code"), F.array(F.struct(F.lit("root").alias("code"))).alias("superCategories")))
    body = F.to_json(F.struct(
        key.cast("string").alias("code"), F.col("p_name").alias("displayName"), F.col("p_brand").alias("manufacturerName"), package.alias("packageSize"),
        F.when(F.col("p_type") == "PROMO", "VIKT").otherwise("ST").alias("salesUnit"), price.alias("piecePriceData"), price.alias("salesPriceData"),
        F.array(offer).alias("onlinePromotions"), (size % 6 != 0).alias("availableOnline"),
        F.array(F.struct(F.concat(F.lit("leaf"), size).alias("code"), parents.alias("superCategories"))).alias("navCategories")))
    rows = t.part.select(F.lit("s1").alias("scope"), body.alias("payload"), (key % 5 != 0).alias("verified"))
    out = feeds.retail_observations(rows, "payload", "scope", now(), F.col("verified"))
    return out.select("product_id", "ean", "name", "brand", F.array_join("categories", ",").alias("categories"), F.col("pack.quantity").alias("quantity"), F.col("pack.unit").alias("unit"),
                      "amount_ore", "basis", "availability")


def lots(t: Tables):
    """Lots of three parts: ``ingredient_id`` is the name of the first part with the number of the lot."""
    key = F.col("p_partkey")
    rows = t.part.groupBy(lot(3).alias("lot")).agg(F.min_by("p_name", key).alias("name"), F.array_sort(F.collect_list(key)).alias("approved"))
    return rows.select(F.concat_ws(" ", "name", "lot").alias("ingredient_id"), "approved")


_LOTS = "(SELECT *, first_value(p_name) OVER (PARTITION BY p_partkey // 3 ORDER BY p_partkey) || ' ' || (p_partkey // 3) AS lot FROM part)"


def connections(t: Tables):
    """A reviewed connection per lot of three parts, so that every part is connected; the lowest one is the main product."""
    goods = packages(t).select("product_id", "identity")
    long = lots(t).select("ingredient_id", F.explode("approved").alias("product_id")).join(exchanged(goods), "product_id")
    broken = F.when(F.col("product_id") % 11 == 0, F.lit("{}")).otherwise(F.col("identity"))
    rows = long.groupBy("ingredient_id").agg(
        F.array_sort(F.collect_list(F.struct("product_id", broken.alias("identity")))).alias("approved"), F.min("product_id").alias("main_product_id"))
    status = F.when(F.col("ingredient_id").startswith("new "), "unavailable").otherwise("matched")
    return rows.select("ingredient_id", F.col("ingredient_id").alias("name"), status.alias("status"), F.lit(policy.POLICY_VERSION).alias("policy_version"), "approved", "main_product_id")


def packages(t: Tables):
    size = F.col("p_size")
    pack = F.struct(size.cast("double").alias("quantity"), F.when(F.col("p_partkey") % 4 == 0, "g").otherwise("piece").alias("unit"), F.lit(False).alias("approximate"), F.lit(None).cast("double").alias("drained_grams"))
    rows = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.array(F.lower("p_type")).alias("categories"), pack.alias("pack"),
                         m.list_price_ore().alias("amount_ore"), (size * 10).cast("bigint").alias("deposit_ore"), F.when(size % 7 == 0, "unavailable").otherwise("available").alias("availability"),
                         F.when(size % 10 == 0, 2).otherwise(1).alias("minimum"), now().alias("checked_at"), cal.week_end(now()).alias("expires_at"))
    identity = hashing.package_identity(F.col("product_id").cast("string"), F.lit(None).cast("string"), F.col("title"), F.col("brand"), F.col("categories"), F.col("pack"), F.lit(None).cast("string"))
    return rows.withColumn("identity", identity)


def _usable():
    none = F.lit(None).cast("timestamp_ntz")
    return pricing.observation_usable(F.lit(True), F.col("availability"), F.col("checked_at"), F.col("expires_at"), F.col("amount_ore"), F.lit(False), F.col("minimum"), none, none, now())


_CONN = f"""conn AS (SELECT lot AS ingredient_id, p_partkey AS product_id, min(p_partkey) OVER (PARTITION BY lot) AS main, p_size, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS price,
  CASE WHEN p_partkey % 4 = 0 THEN 'g' ELSE 'piece' END AS unit, lot LIKE 'new %' AS closed FROM {_LOTS}),
okay AS (SELECT * FROM conn WHERE NOT closed AND product_id % 11 <> 0 AND p_size % 7 <> 0 AND p_size % 10 <> 0)"""


@query("approved_observations", m.sql(_CONN, body="SELECT ingredient_id, product_id FROM okay"))
def approved_observations(t: Tables):
    return rt.approved_observations(connections(t), packages(t), _usable(), F.lit(None).cast("string")).select("ingredient_id", "product_id")


@query("connection_health", m.sql(_CONN, body="""
, u AS (SELECT ingredient_id, min(unit) = max(unit) AS same, arg_min(product_id, struct_pack(c := CAST(price AS DOUBLE) / p_size, p := product_id)) AS cheap, arg_min(product_id, struct_pack(m := product_id <> main, p := product_id)) AS mainfirst FROM okay GROUP BY 1),
c AS (SELECT ingredient_id, any_value(main) AS main, any_value(closed) AS closed, bool_or(product_id % 11 = 0) AS changed FROM conn GROUP BY 1),
x AS (SELECT c.*, CASE WHEN same THEN cheap ELSE mainfirst END AS pick FROM c LEFT JOIN u USING (ingredient_id))
SELECT ingredient_id, CASE WHEN closed THEN 'unavailable' WHEN pick IS NOT NULL THEN 'matched' WHEN changed THEN 'needs_review' ELSE 'unavailable' END AS health, CASE WHEN NOT closed THEN pick END AS product_id,
  CASE WHEN closed THEN 'review_status' WHEN pick = main THEN 'approved_main_available' WHEN pick IS NOT NULL THEN 'approved_alternative_available' WHEN changed THEN 'product_identity_changed_review_required'
  ELSE 'no_fresh_public_price_for_approved_product' END AS reason FROM x"""))
def connection_health(t: Tables):
    rows, goods = connections(t), packages(t)
    usable = rt.approved_observations(rows, goods, _usable(), F.lit(None).cast("string")).select(
        "ingredient_id", "product_id", F.col("pack.unit").alias("unit"), (F.col("amount_ore") / F.col("pack.quantity")).alias("unit_cost"))
    approved = rows.filter("status = 'matched'").select("ingredient_id", F.explode("approved").alias("a")).select("ingredient_id", "a.*")
    changed = approved.withColumnRenamed("identity", "was").join(exchanged(goods), "product_id").filter(F.col("was") != F.col("identity"))
    return rt.connection_health(rows, usable, changed).select("ingredient_id", "health", "product_id", "reason")


@query("availability_summary", f"""
WITH l AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'needs_review' WHEN 'logout' THEN 'non_purchased' ELSE 'matched' END AS status, ts, value > 3 AS available, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 3 DAY END AS ends, event_id % 9 <> 0 AS has FROM events),
x AS (SELECT *, {m.sql_week_end('ts')} AS stale, ts - INTERVAL 60 SECOND AS settled, {m.sql_week_end(_NOW)} AS wk FROM l),
y AS (SELECT *, ts <= {_NOW} + INTERVAL 60 SECOND AND stale = wk AS current, status = 'matched' AND has AND available AS usable FROM x),
z AS (SELECT status, CASE WHEN status NOT IN ('matched', 'non_purchased') THEN TRUE WHEN status = 'non_purchased' THEN FALSE WHEN NOT usable THEN TRUE ELSE stale <= {_NOW} OR settled > {_NOW} OR NOT current OR coalesce(ends <= {_NOW}, FALSE) END AS broken,
  CASE WHEN usable THEN least(CASE WHEN stale > {_NOW} THEN stale END, CASE WHEN settled > {_NOW} THEN settled END, CASE WHEN NOT current AND stale > wk THEN wk END, CASE WHEN ends > {_NOW} THEN ends END) END AS nxt FROM y)
SELECT status, count(*) AS names, count(*) FILTER (broken) AS broken, {m.sql_stamp('min(nxt)')} AS next_change FROM z GROUP BY status""")
def availability_summary(t: Tables):
    status = F.when(F.col("event_type") == "error", "needs_review").when(F.col("event_type") == "logout", "non_purchased").otherwise("matched")
    links = t.events.select(F.col("event_id").alias("name"), status.alias("status"), F.when(status == "matched", F.col("event_id")).alias("code"))
    ends = F.when(F.col("event_id") % 4 == 0, F.array(F.timestamp_add("DAY", F.lit(3), F.col("ts"))))
    products = t.events.filter("event_id % 9 <> 0").select(F.col("event_id").alias("code"), (F.col("value") > 3).alias("available"), F.col("ts").alias("observed_at"), ends.alias("offer_ends"))
    rows = rt.availability_rows(links, products, now()).join(links.select("name", "status"), "name")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("names"), F.count_if("broken").alias("broken"), m.stamp(F.min("next_change")).alias("next_change"))


_STATE = """, a AS (SELECT * FROM scans WHERE revision = 6), b AS (SELECT * FROM scans WHERE revision = 7)"""


@query("tracked_publish", m.sql(m.SCANS, body=_STATE + """
SELECT 'state' AS kind, coalesce(a.store, b.store) AS store, coalesce(a.code, b.code) AS code, CASE WHEN b.code IS NOT NULL AND (a.code IS NULL OR a.content <> b.content) THEN b.content ELSE a.content END AS content FROM a FULL JOIN b ON a.store = b.store AND a.code = b.code
UNION ALL SELECT 'history', b.store, b.code, CAST(b.price_ore AS VARCHAR) FROM b LEFT JOIN a ON a.store = b.store AND a.code = b.code WHERE a.code IS NULL OR a.price_ore <> b.price_ore"""))
def tracked_publish(t: Tables):
    rows = m.scans(t).select("store", "code", "content", "price_ore", "revision")
    state, history = rt.publish_observations(rows.filter("revision = 6").drop("revision"), rows.filter("revision = 7").drop("revision"), ["store", "code"], "content", "price_ore")
    return state.select(F.lit("state").alias("kind"), "store", "code", "content").unionByName(
        history.select(F.lit("history").alias("kind"), "store", "code", F.col("price_ore").cast("string").alias("content")))


@query("run_summary", m.sql(m.SCANS, _CONN, body=_STATE + f"""
, d AS (SELECT b.code, CASE WHEN a.code IS NULL THEN 'inserted' WHEN a.content <> b.content THEN 'updated' ELSE 'kept' END AS action, a.code IS NULL OR a.price_ore <> b.price_ore AS moved, b.observed_at FROM b LEFT JOIN a ON a.store = b.store AND a.code = b.code),
h AS (SELECT ingredient_id, bool_or(closed) AS closed, bool_or(NOT closed AND product_id % 11 <> 0 AND p_size % 7 <> 0 AND p_size % 10 <> 0) AS ok, bool_or(NOT closed AND product_id % 11 = 0) AS changed FROM conn GROUP BY 1)
SELECT count(*) AS checked, count(*) FILTER (action <> 'kept') AS changed, count(*) FILTER (moved) AS price_changes, {m.sql_stamp("min(observed_at) FILTER (observed_at > TIMESTAMP '2001-06-01')")} AS earliest_price_boundary,
  (SELECT count(*) FROM h WHERE ok) AS matched, (SELECT count(*) FROM h WHERE NOT ok AND changed) AS needs_review, (SELECT count(*) FROM h WHERE NOT ok AND NOT changed) AS unavailable, CAST(0 AS BIGINT) AS non_purchased FROM d"""))
def run_summary(t: Tables):
    rows = m.scans(t).select("store", "code", "content", "price_ore", "revision", "observed_at")
    before, after = rows.filter("revision = 6"), rows.filter("revision = 7")
    old = before.select("store", "code", F.col("content").alias("c0"), F.col("price_ore").alias("p0"))
    joined = after.join(old, ["store", "code"], "left")
    action = F.when(F.col("c0").isNull(), "inserted").when(F.col("c0") != F.col("content"), "updated").otherwise("kept")
    changes = joined.select(action.alias("action"), (F.col("p0").isNull() | (F.col("p0") != F.col("price_ore"))).alias("price_changed"), "observed_at")
    out = rt.run_summary(changes, connection_health(t), [F.col("observed_at")], F.lit("2001-06-01").cast("timestamp_ntz"))
    return out.withColumn("earliest_price_boundary", m.stamp(F.col("earliest_price_boundary")))


@query("reuse_or_lookup", f"""
WITH w AS (SELECT DISTINCT user_id AS scope, event_type AS product_id FROM events),
f AS (SELECT DISTINCT user_id AS scope, event_type AS product_id FROM events WHERE ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-10 12:00:00' AND ts <= TIMESTAMP '2024-01-10 12:01:00' AND ts > TIMESTAMP '2024-01-10 11:30:00' AND event_type <> 'error')
SELECT w.scope, w.product_id, CASE WHEN f.scope IS NOT NULL THEN 'reuse' ELSE 'lookup' END AS action FROM w LEFT JOIN f USING (scope, product_id)""")
def reuse_or_lookup(t: Tables):
    wanted = t.events.select(F.col("user_id").alias("scope"), F.col("event_type").alias("product_id"))
    cached = t.events.filter("event_type <> 'error'").select(
        F.col("user_id").alias("scope"), F.col("event_type").alias("product_id"), F.col("ts").alias("checked_at"), F.timestamp_add("DAY", F.lit(1), F.col("ts")).alias("expires_at"))
    return rt.refresh_plan(wanted, cached, now())


@query("confirmed_disappearance", """
SELECT CAST(p_partkey AS VARCHAR) AS product_id, CASE WHEN p_size % 5 = 0 AND p_size % 3 = 0 AND p_size % 2 = 1 THEN NULL ELSE p_name END AS name,
  CASE WHEN p_size % 5 = 0 AND p_size % 3 = 0 THEN NULL ELSE CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) END AS price_ore, CASE WHEN p_size % 5 = 0 AND p_size % 3 = 0 THEN 'unknown' ELSE 'available' END AS availability,
  CASE WHEN p_size % 5 = 0 AND p_size % 3 = 0 AND p_size % 2 = 1 THEN 'confirmed_missing_product_without_prior_identity' END AS violation FROM part""")
def confirmed_disappearance(t: Tables):
    rows = t.part.select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("name"), m.list_price_ore().alias("price_ore"), F.lit("available").alias("availability"),
                         now().alias("checked_at"), "p_size")
    prior = rows.filter("p_size % 2 = 0").select("product_id", "name", "checked_at", F.lit(None).cast("timestamp_ntz").alias("last_verified_at"))
    out = rt.confirm_disappearances(rows, rows.filter("p_size % 5 <> 0").drop("p_size"), rows.filter("p_size % 3 <> 0").drop("p_size"), prior, now())
    return out.select("product_id", "name", "price_ore", "availability", "violation")


@query("tracked_report", """
WITH r AS (SELECT DISTINCT l_partkey + CASE WHEN l_returnflag = 'R' THEN 100 ELSE 0 END AS product_id FROM lineitem)
SELECT product_id, p_partkey IS NOT NULL AS fresh, coalesce(p_size % 7 <> 0 AND p_size % 10 <> 0, FALSE) AS usable, p_partkey IS NULL AS missing FROM r LEFT JOIN part ON p_partkey = product_id""")
def tracked_report(t: Tables):
    requested = t.lineitem.select((F.col("l_partkey") + F.when(F.col("l_returnflag") == "R", 100).otherwise(0)).alias("product_id"))
    return rt.tracked_report(requested, packages(t), _usable(), now()).select("product_id", "fresh", "usable", "missing")


@query("local_id_mapping", f"""
WITH c AS (SELECT lot AS ingredient_id, p_partkey AS product_id, p_size FROM {_LOTS}),
x AS (SELECT *, product_id % 2 = 0 AS has_map, product_id % 2 = 0 AND p_size % 5 <> 0 AND p_size % 7 <> 0 AND product_id % 11 <> 0 AS good FROM c WHERE ingredient_id NOT LIKE 'new %')
SELECT ingredient_id, CASE WHEN good THEN 'local' || product_id ELSE CAST(product_id AS VARCHAR) END AS product_id, CASE WHEN has_map AND NOT good THEN 'unverified_local_mapping' END AS violation FROM x""")
def local_id_mapping(t: Tables):
    approved = connections(t).filter("status = 'matched'").select("ingredient_id", F.explode("approved").alias("a")).select(
        "ingredient_id", F.col("a.product_id").cast("string").alias("product_id"), F.col("a.identity").alias("identity"))
    goods = packages(t).filter("product_id % 2 = 0")
    size = F.col("pack.quantity")
    mappings = goods.select(
        F.col("product_id").cast("string").alias("reference_product_id"), F.col("identity").alias("reference_identity"), F.concat(F.lit("local"), "product_id").alias("local_id"),
        F.when(size % 5 != 0, "7300000000000").alias("local_ean"), F.concat(F.lit("L"), "identity").alias("local_identity"),
        F.when(size % 7 != 0, F.col("identity")).otherwise("other").alias("identity_under_reference_id"), "checked_at")
    kept, bad = rt.map_local_ids(approved, mappings)
    return kept.select("ingredient_id", "product_id", F.lit(None).cast("string").alias("violation")).unionByName(bad)


@query("observation_validity", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_size % 9 = 0 OR p_size % 13 = 0 THEN 'invalid_product_observation' WHEN p_size % 7 = 0 THEN 'invalid_product_price' WHEN p_size % 11 = 0 THEN 'invalid_product_pack' END AS violation FROM part""")
def observation_validity(t: Tables):
    size = F.col("p_size")
    pack = F.struct(F.when(size % 11 == 0, 0.0).otherwise(1.0).alias("quantity"), F.lit("g").alias("unit"), F.lit(None).cast("double").alias("drained_grams"), F.lit(False).alias("approximate"))
    expires = F.when(size % 9 == 0, F.timestamp_add("DAY", F.lit(9), now())).otherwise(cal.week_end(now()))
    why = quality.observation_violation(
        F.lit(True), size % 13 != 0, F.lit(False), F.when(size % 5 == 0, "bad id!").otherwise("p1"), F.col("p_name"), F.lit("available"), now(), expires, F.lit(True),
        F.when(size % 7 != 0, size), F.lit("pack"), F.lit(0), F.lit(1), pack, F.lit(None).cast("timestamp_ntz"))
    good, bad = quality.quarantine(t.part, why)
    return good.select("p_partkey", F.lit(None).cast("string").alias("violation")).unionByName(bad.select("p_partkey", "violation"))


@query("connection_set_validity", f"""
WITH c AS (SELECT lot AS ingredient_id, p_partkey AS product_id, p_size FROM {_LOTS}),
x AS (SELECT ingredient_id, bool_or(product_id % 11 = 0) AS changed, ingredient_id LIKE 'new %' AS closed, ingredient_id LIKE 'old %' AS overfull, bool_or(p_size % 7 = 0) AS barred FROM c GROUP BY 1)
SELECT ingredient_id, 'unmatched_connection_has_products' AS violation FROM x WHERE closed
UNION ALL SELECT ingredient_id, 'invalid_connection_review' FROM x WHERE ingredient_id LIKE 'hot rod %' UNION ALL SELECT ingredient_id, 'non_purchased_requires_water' FROM x WHERE ingredient_id LIKE 'red gear %'
UNION ALL SELECT ingredient_id, 'unmatched_connection_has_products' FROM x WHERE ingredient_id LIKE 'red gear %'
UNION ALL SELECT ingredient_id, 'invalid_approved_products' FROM x WHERE overfull UNION ALL SELECT ingredient_id, 'connection_product_not_permitted' FROM x WHERE changed OR barred""")
def connection_set_validity(t: Tables):
    status = F.when(F.col("name").startswith("red gear "), "non_purchased").otherwise(F.col("status"))
    rows = connections(t).withColumn("status", status).withColumn("reviewed_at", F.when(~F.col("name").startswith("hot rod "), now())).withColumn(
        "main_product_id", F.when(~F.col("name").startswith("old "), F.col("main_product_id")))
    goods = packages(t).select("product_id", "identity", F.when(F.col("availability") == "unavailable", "blocked").alias("policy_reason"))
    return rt.connection_violations(rows, goods, F.lit(None).cast("string"))


@query("decision_fold", """
WITH e AS (SELECT user_id AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS code, CASE event_type WHEN 'error' THEN 'clear' WHEN 'click' THEN 'reject' ELSE 'approve' END AS action, ts, event_id FROM events),
c AS (SELECT name, max(struct_pack(ts := ts, id := event_id)) AS cut FROM e WHERE action = 'clear' GROUP BY 1)
SELECT e.name, code, action FROM e LEFT JOIN c USING (name) WHERE action <> 'clear' AND (cut IS NULL OR struct_pack(ts := ts, id := event_id) > cut)
QUALIFY row_number() OVER (PARTITION BY e.name, code ORDER BY ts DESC, event_id DESC) = 1""")
def decision_fold(t: Tables):
    action = F.when(F.col("event_type") == "error", "clear").when(F.col("event_type") == "click", "reject").otherwise("approve")
    events = t.events.select(F.col("user_id").alias("name"), (F.get_json_object("props", "$.k").cast("bigint") % 10).alias("code"), action.alias("action"), "ts", "event_id")
    return rv.fold_decisions(events).select("name", "code", "action")


_UNION = """src AS (SELECT p_name AS name, p_partkey AS code, p_size % 7 <> 0 AS eligible, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) / CAST(p_size AS DOUBLE) AS unit_price, p_size % 2 = 0 AS m, p_type = 'PROMO' AS p, p_brand = 'Brand#4' AS n FROM part),
labelled AS (SELECT name, code, eligible, unit_price, CASE WHEN m AND p AND n THEN 'all_sources' WHEN m AND p THEN 'both' WHEN m AND n THEN 'matcher_and_manual_nomination' WHEN p AND n THEN 'prior_review_and_manual_nomination'
  WHEN n THEN 'manual_nomination' WHEN p THEN 'prior_review_same_name_brand' ELSE 'matcher' END AS source FROM src WHERE m OR p OR n)"""


def _union(t: Tables, named=None):
    """Candidates by part name, or under the names of ``named`` (name, code)."""
    facts = t.part if named is None else t.part.drop("p_name").join(named.select(F.col("name").alias("p_name"), F.col("code").alias("p_partkey")), "p_partkey")
    rows = facts.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("code"), (F.col("p_size") % 7 != 0).alias("eligible"), (m.list_price_ore() / F.col("p_size")).alias("unit_price"), "p_size", "p_type", "p_brand")
    return rv.union_candidates(rows.filter("p_size % 2 = 0"), rows.filter("p_type = 'PROMO'"), rows.filter("p_brand = 'Brand#4'"))


@query("candidate_source_union", m.sql(_UNION, body="""
SELECT name, code, source, CAST(row_number() OVER (PARTITION BY name ORDER BY eligible DESC, source = 'matcher', unit_price, code) AS INTEGER) AS rank FROM labelled QUALIFY rank <= 8"""))
def candidate_source_union(t: Tables):
    return rv.review_candidates(_union(t)).select("name", "code", "source", "rank")


@query("review_queue", """
WITH n AS (SELECT name, row_number() OVER (ORDER BY name) AS p, count(*) OVER () AS c FROM (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part))
SELECT name, CAST(ceil(p / 25.0) AS INTEGER) AS batch, CAST(ceil(p / ceil(c / 3.0)) AS INTEGER) AS part FROM n""")
def review_queue(t: Tables):
    items = t.part.select(F.concat_ws(" ", "p_name", "p_brand").alias("name")).distinct()
    return rv.review_queue(items).select("name", "batch", "part")


_LOT_UNION = _UNION.replace("SELECT p_name AS name", "SELECT lot AS name").replace("FROM part)", f"FROM {_LOTS})")


@query("decision_checks", m.sql(_LOT_UNION, body=f"""
, inv AS (SELECT DISTINCT lot AS name, CAST(length(lot) % 3 AS INTEGER) AS part FROM {_LOTS}), top AS (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY name ORDER BY eligible DESC, source = 'matcher', unit_price, code) <= 8),
pick AS (SELECT lot AS name, p_partkey AS code, p_size FROM {_LOTS}),
d AS (SELECT name, CAST(CASE WHEN name LIKE 'red rod %' THEN 9 ELSE length(name) % 3 END AS INTEGER) AS part, CASE WHEN name LIKE 'cold %' THEN 'unavailable' ELSE 'matched' END AS status FROM inv WHERE name NOT LIKE 'hot bolt %')
SELECT name, 'decision_missing' AS violation FROM inv ANTI JOIN d USING (name) UNION SELECT 'mystery', 'decision_for_unknown_name' UNION SELECT name, 'decision_in_wrong_part' FROM d JOIN inv USING (name) WHERE d.part <> inv.part
UNION SELECT name, 'unmatched_has_products' FROM d WHERE status = 'unavailable' UNION SELECT 'mystery', 'match_requires_products'
UNION SELECT name, CASE WHEN top.code IS NULL THEN 'product_not_emitted' WHEN p_size > 45 THEN 'policy_excluded' ELSE 'product_not_eligible' END FROM d JOIN pick USING (name) LEFT JOIN top USING (name, code)
  WHERE top.code IS NULL OR p_size > 45 OR NOT top.eligible"""))
def decision_checks(t: Tables):
    """Decisions on every lot of parts, each approving all parts of its lot."""
    picks = lots(t).select(F.col("ingredient_id").alias("name"), "approved")
    inventory = picks.select("name", (F.length("name") % 3).alias("part"))
    decided = picks.filter(~F.col("name").startswith("hot bolt ")).select(
        "name", F.when(F.col("name").startswith("red rod "), 9).otherwise(F.length("name") % 3).alias("part"), F.when(F.col("name").startswith("cold "), "unavailable").otherwise("matched").alias("status"), "approved")
    stray = t.region.filter("r_name = 'ASIA'").select(F.lit("mystery").alias("name"), F.lit(1).alias("part"), F.lit("matched").alias("status"), F.array().cast("array<bigint>").alias("approved"))
    named = picks.select("name", F.explode("approved").alias("code"))
    emitted = rv.review_candidates(_union(t, named)).join(t.part.select(F.col("p_partkey").alias("code"), F.when(F.col("p_size") > 45, "policy_excluded").alias("violation")), "code")
    return rv.decision_violations(decided.unionByName(stray), inventory, emitted.select("name", "code", "eligible", "violation"))


@query("decision_expansion", f"""
WITH pick AS (SELECT lot AS name, p_partkey AS code, p_brand, row_number() OVER (PARTITION BY lot ORDER BY p_partkey) AS rk FROM {_LOTS})
SELECT name, CASE WHEN name LIKE 'cold %' THEN 'needs_review' ELSE 'matched' END AS status, CASE WHEN name NOT LIKE 'cold %' THEN arg_max(code, rk) END AS main_product_id,
  CASE WHEN name LIKE 'cold %' THEN '' ELSE string_agg(code || '=' || p_brand, ',' ORDER BY rk DESC) END AS approved FROM pick GROUP BY name""")
def decision_expansion(t: Tables):
    picks = lots(t).select(F.col("ingredient_id").alias("name"), F.reverse("approved").alias("approved"))
    cold = F.col("name").startswith("cold ")
    decisions = picks.select("name", F.when(cold, "needs_review").otherwise("matched").alias("status"), F.when(cold, F.array().cast("array<bigint>")).otherwise(F.col("approved")).alias("approved"))
    goods = t.part.select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("identity"))
    out = rv.expand_decisions(decisions, goods)
    return out.select("name", "status", "main_product_id", F.array_join(F.transform("approved", lambda a: F.concat_ws("=", a["product_id"], a["identity"])), ",").alias("approved"))


_LABELS = ("Fryst fisk", "Kött & fågel", "Mejeri ost", "Färsk frukt", "Skafferi pasta", "Övrigt")


@query("category_families", """
SELECT p_partkey, (['fryst,fisk,Fryst fisk','kott,Kött & fågel','mejeri,Mejeri ost','frukt,Färsk frukt','skafferi,Skafferi pasta',''])[1 + p_partkey % 6] AS families, p_size % 7 <> 0 AS available,
  CASE WHEN p_type = 'PROMO' THEN 'kr/kg' ELSE 'kr/förp' END AS price_unit, p_size % 10 = 0 AS conditional FROM part""")
def category_families(t: Tables):
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = t.part.select("p_partkey", "p_type", "p_size", label.alias("label")).withColumn("families", F.array(rv.category_families(F.col("label"))))
    observed = rows.select(
        F.col("p_partkey").alias("product_id"), F.col("label").alias("name"), F.lit(None).cast("string").alias("brand"), "families", F.lit(100).cast("bigint").alias("amount_ore"),
        F.when(F.col("p_type") == "PROMO", "kg").otherwise("pack").alias("basis"), F.lit(0).cast("bigint").alias("deposit_ore"), F.lit(False).alias("member_only"),
        F.when(F.col("p_size") % 10 == 0, 2).otherwise(1).alias("minimum"), F.lit(None).cast("timestamp_ntz").alias("valid_until"),
        F.when(F.col("p_size") % 7 != 0, "available").otherwise("unavailable").alias("availability"), now().alias("checked_at"), F.lit(None).cast("string").alias("pack"))
    shaped = rv.matcher_rows(observed)
    return shaped.select(F.col("code").alias("p_partkey"), F.array_join("categories", ",").alias("families"), "available", "price_unit", pricing.conditional_offer(F.col("offers")).alias("conditional"))


@query("fragment_merge", """
SELECT p_name AS name, 'name_repeated' AS violation FROM (SELECT p_name FROM part WHERE p_type = 'PROMO' GROUP BY 1 UNION ALL SELECT p_name FROM part WHERE p_type = 'SMALL' AND p_size > 40 GROUP BY 1) GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT NULL, 'snapshot_mismatch'""")
def fragment_merge(t: Tables):
    pick = lambda test, snapshot: t.part.filter(test).select(F.col("p_name").alias("name")).distinct().withColumn("snapshot", F.lit(snapshot))
    _, bad = rv.merge_fragments([pick("p_type = 'PROMO'", "s1"), pick("p_type = 'SMALL' AND p_size > 40", "s2")])
    return bad


@query("disclosed_ingredient_policy", """
WITH x AS (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'Vatten, Hönsägg' WHEN 1 THEN 'mjölk, löpe' WHEN 2 THEN 'milk, mikrobiell löpe' WHEN 3 THEN 'nötfärs, salt' WHEN 4 THEN 'bacon' WHEN 5 THEN '  ' WHEN 6 THEN 'egg, hens' ELSE 'kyckling' END AS ing,
  CASE WHEN p_partkey % 2 = 0 THEN 'Affco' ELSE 'Eldorado' END AS brand, p_size % 8 AS k FROM part)
SELECT p_partkey, CASE k WHEN 1 THEN 'product_excluded_uncertain_animal_source' WHEN 3 THEN CASE WHEN brand <> 'Affco' THEN 'product_excluded_ingredient_meat_brand_not_permitted' END WHEN 4 THEN 'product_excluded_ingredient_pork' END AS reason FROM x""")
def disclosed_ingredient_policy(t: Tables):
    lists = ("Vatten, Hönsägg", "mjölk, löpe", "milk, mikrobiell löpe", "nötfärs, salt", "bacon", "  ", "egg, hens", "kyckling")
    text = F.element_at(F.array(*[F.lit(x) for x in lists]), (F.col("p_size") % 8 + 1).cast("int"))
    brand = F.when(F.col("p_partkey") % 2 == 0, "Affco").otherwise("Eldorado")
    rows = t.part.select("p_partkey", fold_text(F.col("p_name")).alias("title"), fold_text(brand).alias("brand"), F.array(F.lower("p_type")).alias("categories"), text.alias("text"))
    rows = rows.withColumn("own", policy.classify(F.col("title")))
    title = policy.product_policy(F.col("title"), F.col("brand"), F.col("categories"), F.col("own"))
    return rows.withColumn("title_reason", title).select("p_partkey", policy.disclosed_policy(F.col("title_reason"), F.col("text"), F.col("brand")).alias("reason"))
