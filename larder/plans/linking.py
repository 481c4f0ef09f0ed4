"""Queries over ingredient linking and dietary policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal, pricing
from ..functions.text import fold_text
from ..operators import linking as link, versions as v
from . import mapping as m
from .quotes import now
from .registry import Tables, query

#: Demonstration rules over the driver's part names; real jobs pass their reviewed vocabulary.
RULES = (
    link.FoodRule("plate", ("plate", "plates"), r"\bplate$", ("standard", "economy"), basis="piece"),
    link.FoodRule("red-plate", ("red plate",), r"^red plate$", ("standard", "promo", "large"), basis="piece"),
    link.FoodRule("gear", ("gear",), r"\bgear$", ("small", "medium"), basis="kg", exclude=r"^old\b"),
    link.FoodRule("ring", ("ring", "hot ring"), r"\bring$", ("promo", "econ"), basis="kg", ambiguous=True),
    link.FoodRule("rod", ("rod",), r"\brod$", ("large",), basis="l", form="dried"),
    link.FoodRule("widget", ("small widget",), r"\bwidget$", ("medium", "standard"), basis="piece"),
)
#: Modifiers that turn part names into ingredient names of every kind.
MODIFIERS = ("", "chopped ", "fresh ", "organic ", "odd ", "cooked ")

_ALIASES = "(VALUES " + ", ".join(
    f"('{a}', '{r.id}', {i}, '{r.basis}', {str(r.ambiguous).upper()}, '{r.form or ''}')" for i, (r, a) in enumerate((r, a) for r in RULES for a in r.aliases)
) + ") AS a(alias, rule_id, rule_order, basis, ambiguous, form)"

_NAMES = """names AS (SELECT CASE l_linenumber % 6 WHEN 0 THEN '' WHEN 1 THEN 'chopped ' WHEN 2 THEN 'fresh ' WHEN 3 THEN 'organic ' WHEN 4 THEN 'odd ' ELSE 'cooked ' END || p_name AS name,
  count(*) AS occurrences FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""

_LINKED = """folded AS (SELECT name, occurrences, name AS original, trim(regexp_replace(regexp_replace(name, '\\b(?:chopped|small|large)\\b', ' ', 'g'), ' +', ' ', 'g')) AS clean FROM names),
hits AS (SELECT f.*, a.*, (a.alias = original OR a.alias = clean) AS exact, row_number() OVER (PARTITION BY name ORDER BY (a.alias = original OR a.alias = clean) DESC, length(alias) DESC, rule_order) AS rk
  FROM folded f JOIN """ + _ALIASES + """ ON contains(' ' || clean || ' ', ' ' || alias || ' ') OR alias = original),
best AS (SELECT f.name, f.occurrences, f.original, f.clean, h.rule_id, h.basis, h.alias, h.exact, h.ambiguous, h.form FROM folded f LEFT JOIN (SELECT * FROM hits WHERE rk = 1) h USING (name)),
linked AS (SELECT *, CASE WHEN alias IS NULL THEN '' ELSE trim(regexp_replace(regexp_replace(CASE WHEN strpos(clean, alias) > 0 THEN substr(clean, 1, strpos(clean, alias) - 1) || substr(clean, strpos(clean, alias) + length(alias)) ELSE clean END,
   '\\b(?:organic|extra virgin|fresh|frozen|dried|ground|raw|boneless|skinless)\\b', ' ', 'g'), ' +', ' ', 'g')) END AS leftover FROM best),
links AS (SELECT *, CASE WHEN rule_id IS NOT NULL THEN ambiguous OR (NOT exact AND leftover <> '') OR (regexp_matches(original, '\\bfresh\\b') AND form = 'dried')
   OR (regexp_matches(original, '\\bdried\\b') AND form = 'fresh') OR regexp_matches(original, '\\bcooked\\b') END AS uncertain FROM linked)"""


def requirements(t: Tables):
    modifier = F.element_at(F.array(*[F.lit(x) for x in MODIFIERS]), F.col("l_linenumber") % 6 + 1)
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(modifier, "p_name").alias("ingredient"))
    return link.inventory(lines, "ingredient")


def _links(t: Tables):
    return link.link_aliases(requirements(t), link.alias_table(t.spark, RULES))


@query("alias_link", m.sql(_NAMES, _LINKED, body="SELECT name, clean, rule_id, basis, alias, exact, leftover, uncertain FROM links"))
def alias_link(t: Tables):
    return _links(t).select("name", "clean", "rule_id", "basis", "alias", "exact", "leftover", "uncertain")


_POOL = "pool AS (" + " UNION ALL ".join(
    f"SELECT code, '{r.id}' AS rule_id FROM products WHERE regexp_matches(name, '{r.title}') AND ({' OR '.join(f'starts_with(category, {c!r})' for c in r.categories)})"
    + (f" AND NOT regexp_matches(name, '{r.exclude}')" if r.exclude else "") for r in RULES) + ")"


def catalogue(t: Tables):
    return m.products(t).select(
        "code", F.col("name").alias("raw_title"), fold_text(F.col("name")).alias("title"), fold_text(F.col("brand")).alias("brand"),
        F.array("category").alias("categories"), "price_ore", "size")


@query("rule_pool_join", m.sql(m.PRODUCTS, _POOL, body="SELECT code, rule_id FROM pool"))
def rule_pool_join(t: Tables):
    return link.rule_pools(catalogue(t), RULES)


#: Product facts of the candidate: packs in grams, millilitres or pieces, priced by the basis of the rule; out of stock where the size is a multiple of seven.
_CANDIDATES = """priced_ AS (SELECT l.name, p.code, l.original, p.size % 7 <> 0 AS available, CASE WHEN l.basis = CASE p.code % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'l' ELSE 'piece' END
    THEN p.price_ore / CAST(p.size AS DOUBLE) * CASE WHEN l.basis = 'piece' THEN 1.0 ELSE 1000.0 END END AS unit_price
  FROM links l JOIN pool USING (rule_id) JOIN products p USING (code) WHERE l.rule_id IS NOT NULL AND NOT regexp_matches(l.original, '\\borganic\\b')),
cand AS (SELECT name, code, available AND unit_price IS NOT NULL AS eligible, unit_price FROM priced_)"""


def _candidates(t: Tables) -> link.Pools:
    pools = link.rule_pools(catalogue(t), RULES, keep=("code", "raw_title", "title", "brand", "categories", "price_ore", "size"))
    basis = F.create_map(*[F.lit(x) for r in RULES for x in (r.id, r.basis)])[F.col("rule_id")]
    unit = F.element_at(F.array(F.lit("g"), F.lit("ml"), F.lit("piece")), (F.col("code") % 3 + 1).cast("int"))
    pack = F.struct(F.col("size").cast("double").alias("quantity"), unit.alias("unit"), F.lit(None).cast("double").alias("drained_grams"), F.lit(False).alias("approximate"))
    price = pricing.comparable_unit_price(F.col("price_ore"), F.lit("kr/st"), F.lit(None).cast("bigint"), F.lit(None).cast("string"), pack, basis)
    rows = pools.withColumn("unit_price", price)
    why = pricing.candidate_exclusion(F.lit(None).cast("string"), F.col("size") % 7 != 0, F.col("price_ore"), F.lit(0), F.col("unit_price"), now(), cal.week_end(now()), now(), F.lit(False))
    return link.build_pools(_links(t), rows.withColumn("eligible", why.isNull()), keep=("code", "eligible", "unit_price"))


_SELECTED = """best_ AS (SELECT c.name, count(*) AS candidates, arg_min(struct_pack(code := code, unit_price := unit_price), struct_pack(p := unit_price, c := code)) FILTER (eligible AND NOT l.uncertain) AS b
  FROM cand c JOIN links l USING (name) GROUP BY c.name),
selected AS (SELECT n.name, n.occurrences, l.rule_id, CASE WHEN b IS NOT NULL THEN 'matched' WHEN l.rule_id IS NULL OR l.uncertain THEN 'needs_review' ELSE 'unavailable' END AS status,
  CASE WHEN b IS NOT NULL THEN 'food_rule' WHEN l.rule_id IS NULL THEN 'no_verified_food_rule' WHEN l.uncertain THEN 'food_form_needs_review' WHEN coalesce(candidates, 0) > 0 THEN 'no_compatible_product_with_fresh_price' ELSE 'no_compatible_product_in_catalogue' END AS reason,
  b.code AS selected_code, b.unit_price AS unit_price, coalesce(candidates, 0) AS candidates FROM names n JOIN links l USING (name) LEFT JOIN best_ USING (name))"""
_ALL = (m.PRODUCTS, _NAMES, _LINKED, _POOL, _CANDIDATES, _SELECTED)


def selected_links(t: Tables):
    return link.select_links(requirements(t), _links(t), _candidates(t))


@query("cheapest_eligible_link", m.sql(*_ALL, body="SELECT * FROM selected"))
def cheapest_eligible_link(t: Tables):
    return selected_links(t)


@query("candidate_ranking", m.sql(*_ALL, body="""
SELECT * FROM (SELECT name, code, eligible, unit_price, CAST(row_number() OVER (PARTITION BY name ORDER BY eligible DESC, unit_price NULLS LAST, code) AS INTEGER) AS rank FROM cand) WHERE rank <= 8"""))
def candidate_ranking(t: Tables):
    return link.name_candidates(_links(t), _candidates(t)).select("name", "code", "eligible", "unit_price", "rank")


@query("link_summary", m.sql(*_ALL, body="""
SELECT status, count(*) AS names, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(occurrences) AS DOUBLE) / (SELECT sum(occurrences) FROM selected) AS fraction FROM selected GROUP BY status"""))
def link_summary(t: Tables):
    return link.summarize_links(selected_links(t))


@query("reviewed_identity_join", m.sql(m.PRODUCTS, body="""
, reviewed AS (SELECT DISTINCT name, brand FROM products WHERE category = 'promo')
SELECT r.name, upper(r.name) AS product_name, r.brand AS product_brand, p.code FROM reviewed r LEFT JOIN (SELECT * FROM products WHERE category <> 'promo') p ON p.name = r.name AND p.brand = r.brand"""))
def reviewed_identity_join(t: Tables):
    rows = m.products(t)
    reviewed = rows.filter("category = 'promo'").select("name", F.upper("name").alias("product_name"), F.col("brand").alias("product_brand")).distinct()
    current = rows.filter("category <> 'promo'").select("code", F.col("name").alias("title"), F.replace("brand", F.lit("#"), F.lit("#-")).alias("brand"))
    return link.identity_candidates(reviewed, current.withColumn("brand", F.replace("brand", F.lit("#-"), F.lit(" ")))).select(
        "name", "product_name", "product_brand", "code")


@query("reviewed_assessment", m.sql(m.PRODUCTS, body="""
, reviewed AS (SELECT DISTINCT name, brand FROM products WHERE category = 'promo'), found AS (SELECT r.name, r.brand, p.code, p.size, p.price_ore FROM reviewed r LEFT JOIN (SELECT * FROM products WHERE category <> 'promo') p USING (name, brand)),
lost AS (SELECT name, bool_or(n = 0) AS lost FROM (SELECT name, brand, count(code) AS n FROM found GROUP BY ALL) GROUP BY name),
sel AS (SELECT name, arg_min(code, struct_pack(p := CAST(price_ore AS DOUBLE) / size, c := code)) AS code FROM found WHERE size % 7 <> 0 GROUP BY name),
o AS (SELECT DISTINCT name, CASE WHEN length(name) % 3 = 0 THEN 'approve' WHEN length(name) % 3 = 1 THEN 'unavailable' ELSE 'clarify' END AS outcome, CASE WHEN name LIKE 'red%' THEN 'then' ELSE 'now' END AS digest FROM products WHERE category = 'promo')
SELECT name, outcome, CASE WHEN outcome = 'approve' AND sel.code IS NOT NULL THEN 'matched' WHEN outcome = 'approve' AND NOT coalesce(lost, FALSE) THEN 'unavailable'
  WHEN outcome = 'unavailable' AND digest = 'now' THEN 'unavailable' ELSE 'needs_review' END AS status, CASE WHEN outcome = 'approve' THEN sel.code END AS selected_code
FROM o LEFT JOIN lost USING (name) LEFT JOIN sel USING (name)"""))
def reviewed_assessment(t: Tables):
    rows = m.products(t)
    reviewed = rows.filter("category = 'promo'").select("name", F.col("name").alias("product_name"), F.col("brand").alias("product_brand")).distinct()
    current = rows.filter("category <> 'promo'").select("code", F.col("name").alias("title"), "brand", "size", "price_ore")
    found = link.identity_candidates(reviewed, current)
    priced = found.filter(F.col("code").isNotNull()).join(current.select("code", "size", "price_ore"), "code").select(
        "name", "code", (F.col("size") % 7 != 0).alias("eligible"), (F.col("price_ore") / F.col("size")).alias("unit_price"))
    kind = F.length("name") % 3
    outcomes = reviewed.select("name").distinct().select(
        "name", F.when(kind == 0, "approve").when(kind == 1, "unavailable").otherwise("clarify").alias("outcome"),
        F.when(F.col("name").startswith("red"), "then").otherwise("now").alias("digest"))
    return link.assess(found, priced, outcomes, F.lit("now"))


_AUDIT_LINES = """lines AS (SELECT o_orderkey AS recipe_id, p_name || CASE WHEN p_size % 17 = 0 THEN ' bacon' WHEN p_size % 19 = 0 THEN ' wine' WHEN p_size % 23 = 0 THEN ' chicken' ELSE '' END AS name
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
audit AS (SELECT DISTINCT name, CASE WHEN name LIKE '%bacon' THEN 'pork' WHEN name LIKE '%wine' THEN 'alcohol' ELSE 'no_permitted_meat_match' END AS reason FROM lines WHERE name LIKE '%bacon' OR name LIKE '%wine' OR name LIKE '%chicken')"""


def _audit(t: Tables):
    suffix = F.when(F.col("p_size") % 17 == 0, " bacon").when(F.col("p_size") % 19 == 0, " wine").when(F.col("p_size") % 23 == 0, " chicken").otherwise("")
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("o_orderkey").alias("recipe_id"), F.concat("p_name", suffix).alias("name"))
    links = lines.select("name").distinct().withColumn("status", F.lit("needs_review"))
    return lines, link.dietary_audit(links)


@query("dietary_subset_audit", m.sql(_AUDIT_LINES, body="""
SELECT 'kept' AS kind, count(*) AS recipes FROM (SELECT DISTINCT recipe_id FROM lines EXCEPT SELECT recipe_id FROM lines JOIN audit USING (name))
UNION ALL SELECT reason, count(DISTINCT recipe_id) FROM lines JOIN audit USING (name) GROUP BY reason"""))
def dietary_subset_audit(t: Tables):
    lines, audit = _audit(t)
    kept = link.dietary_subset(lines, audit).agg(F.count(F.lit(1)).alias("recipes")).select(F.lit("kept").alias("kind"), "recipes")
    return kept.unionByName(link.removal_reasons(lines, audit).select(F.col("reason").alias("kind"), "recipes"))


@query("connection_coverage", m.sql(*_ALL, body="""
, rl AS (SELECT l_orderkey AS recipe_id, CASE l_linenumber % 6 WHEN 0 THEN '' WHEN 1 THEN 'chopped ' WHEN 2 THEN 'fresh ' WHEN 3 THEN 'organic ' WHEN 4 THEN 'odd ' ELSE 'cooked ' END || p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT recipe_id, bool_and(status = 'matched') AS whole, count(*) FILTER (status = 'matched') AS c, count(*) AS n FROM rl JOIN selected USING (name) GROUP BY recipe_id)
SELECT count(*) AS recipes, count(*) FILTER (whole) AS fully_linked, CAST(sum(c) AS BIGINT) AS covered_lines, CAST(sum(n) AS BIGINT) AS lines FROM r"""))
def connection_coverage(t: Tables):
    modifier = F.element_at(F.array(*[F.lit(x) for x in MODIFIERS]), F.col("l_linenumber") % 6 + 1)
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("recipe_id"), F.concat(modifier, "p_name").alias("name"))
    return link.coverage(lines, selected_links(t))


@query("stored_link_hydration", m.sql(*_ALL, body="""
, top AS (SELECT name, code, row_number() OVER (PARTITION BY name ORDER BY eligible DESC, unit_price NULLS LAST, code) AS rk FROM cand)
SELECT n.name, coalesce(string_agg(CAST(code AS VARCHAR) || ':' || price_ore, ',' ORDER BY rk), '') AS candidates
FROM (SELECT DISTINCT name FROM cand) n LEFT JOIN (SELECT * FROM top JOIN products USING (code) WHERE rk <= 8 AND size % 5 <> 0) x USING (name) GROUP BY n.name"""))
def stored_link_hydration(t: Tables):
    ranked = link.name_candidates(_links(t), _candidates(t))
    stored = ranked.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda c: c["code"]).alias("codes"))
    current = m.products(t).filter("size % 5 <> 0").select("code", "price_ore")
    return link.hydrate(stored, current).select("name", F.array_join(
        F.transform("candidates", lambda c: F.concat_ws(":", c["code"], c["price_ore"])), ",").alias("candidates"))


@query("requested_order_lookup", m.sql(*_ALL, body="""
, asked AS (SELECT conv_id, turn AS pos, CASE WHEN turn % 3 = 2 THEN role ELSE (['red plate', 'blue gear', 'hot ring', 'old rod', 'chopped small widget'])[1 + CAST(conv_id % 5 AS INTEGER)] END AS name FROM conversations)
SELECT conv_id, pos, name, coalesce(status, 'unknown_ingredient') AS status, selected_code FROM asked LEFT JOIN selected USING (name)"""))
def requested_order_lookup(t: Tables):
    pick = F.element_at(F.array(*[F.lit(x) for x in ("red plate", "blue gear", "hot ring", "old rod", "chopped small widget")]), (F.col("conv_id") % 5 + 1).cast("int"))
    asked = t.conversations.select("conv_id", F.col("turn").alias("pos"), F.when(F.col("turn") % 3 == 2, F.col("role")).otherwise(pick).alias("name"))
    found = selected_links(t).select("name", "status", "selected_code")
    return link.requested_lookup(asked, found, "name", "status", "unknown_ingredient").select("conv_id", "pos", "name", "status", "selected_code")


@query("link_refresh_tombstones", """
WITH runs AS (SELECT p_name || ' ' || lower(p_type) AS name, year(l_shipdate) AS run, max(l_suppkey) AS content FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 30 OR l_returnflag = 'A' GROUP BY ALL),
a AS (SELECT * FROM runs WHERE run = 1996 AND content > 20), b AS (SELECT * FROM runs WHERE run = 1997 AND content > 60)
SELECT name, CAST(1996 AS INTEGER) AS valid_from, CASE WHEN b.content IS NULL OR b.content <> a.content THEN 1997 END AS valid_to, a.content AS content, FALSE AS is_deleted FROM a LEFT JOIN b USING (name)
UNION ALL SELECT name, 1997, NULL, b.content, FALSE FROM b LEFT JOIN a USING (name) WHERE a.content IS NULL OR a.content <> b.content
UNION ALL SELECT name, 1997, NULL, NULL, TRUE FROM a ANTI JOIN b USING (name)""")
def link_refresh_tombstones(t: Tables):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).filter((F.col("p_size") > 30) | (F.col("l_returnflag") == "A"))
    runs = lines.groupBy(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"), F.year("l_shipdate").alias("run")).agg(F.max("l_suppkey").alias("content"))
    state = runs.filter("run = 1996 AND content > 20").select("name", F.lit(1996).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"), "content", F.lit(False).alias("is_deleted"))
    return v.apply_delta(state, runs.filter("run = 1997 AND content > 60").drop("run"), 1997, ["name"], "content", tombstones=True)


@query("reviewed_selection", m.sql(*_ALL, body="""
, rej AS (SELECT name, code FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY eligible DESC, unit_price NULLS LAST, code) AS rk FROM cand) WHERE rk <= 8 AND name LIKE 'chopped %' AND code % 2 = 0), app AS (SELECT n.name, p.code, p.size % 3 <> 0 AS eligible, CAST(p.price_ore AS DOUBLE) / p.size AS unit_price FROM names n JOIN products p ON n.name = 'odd ' || p.name WHERE p.category = 'promo'),
c2 AS (SELECT c.*, FALSE AS approved FROM cand c ANTI JOIN rej r ON r.name = c.name AND r.code = c.code UNION ALL SELECT *, TRUE FROM app),
b AS (SELECT c2.name, arg_min(struct_pack(code := code, approved := approved), struct_pack(p := unit_price, c := code, a := NOT approved)) FILTER (eligible AND (approved OR NOT coalesce(l.uncertain, TRUE))) AS b FROM c2 JOIN links l USING (name) GROUP BY 1)
SELECT n.name, CASE WHEN b IS NOT NULL THEN 'matched' WHEN l.rule_id IS NULL OR l.uncertain THEN 'needs_review' ELSE 'unavailable' END AS status, b.code AS selected_code, CASE WHEN b IS NOT NULL THEN b.approved END AS reviewed
FROM names n JOIN links l USING (name) LEFT JOIN b USING (name)"""))
def reviewed_selection(t: Tables):
    links, candidates = _links(t), _candidates(t)
    rejected = link.name_candidates(links.filter(F.col("name").startswith("chopped ")), candidates).filter("code % 2 = 0").select("name", "code")
    goods = m.products(t).filter("category = 'promo'")
    names = links.select("name").join(goods.select(F.concat(F.lit("odd "), "name").alias("name"), "code", (F.col("size") % 3 != 0).alias("eligible"), (F.col("price_ore") / F.col("size")).alias("unit_price")), "name")
    out = link.select_links(requirements(t), links, candidates, approved=names, rejected=rejected)
    return out.select("name", "status", "selected_code", F.when(F.col("status") == "matched", F.col("reason") == "reviewed").alias("reviewed"))
