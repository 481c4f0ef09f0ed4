"""Queries over demands, pack covers, components and menu ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pricing
from ..operators import basket as b
from ..session import exchanged, stored
from . import mapping as m
from .quotes import now
from .registry import Tables, query


def lot(size: int, shift: int = 0):
    """Runs of ``size`` neighbouring part keys, so that ingredients grow with the parts and every part is approved by one."""
    return F.expr(f"(p_partkey + {shift}) DIV {size}").cast("string")


def approved_in(t: Tables, label):
    """All parts under each label; the label bounds their number."""
    return t.part.groupBy(label.alias("ingredient_id")).agg(F.array_sort(F.collect_list("p_partkey")).alias("approved"))


def demands(t: Tables):
    """Order lines as needs for a lot of three parts; odd lines approve all three products, even lines the first two."""
    label = F.concat(F.lit("lot "), lot(3))
    lines = t.lineitem.select(
        "l_orderkey", "l_partkey", F.when(~((F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1)), F.col("l_quantity")).alias("quantity"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R"), "g").otherwise("piece").alias("unit"), (F.col("l_linenumber") % 2 == 0).alias("even"))
    # lists meet the parts, of which there are fewer than lines
    parts = t.part.select("p_partkey", F.col("p_name").alias("name"), label.alias("ingredient_id")).join(exchanged(approved_in(t, label)), "ingredient_id")
    joined = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(exchanged(parts), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        "ingredient_id", F.col("o_custkey").alias("menu_id"), "name", "quantity", "unit", (F.col("name") == "hot plate").alias("non_purchased"),
        F.when(F.col("even"), F.slice("approved", 1, 2)).otherwise(F.col("approved")).alias("approved"))


def observations(t: Tables):
    size = F.col("p_size")
    return t.part.filter("p_size <> 21").select(
        F.col("p_partkey").alias("product_id"), F.lit("pack").alias("basis"), m.list_price_ore().alias("amount_ore"), (size * 10).cast("bigint").alias("deposit_ore"),
        size.cast("double").alias("pack_quantity"), now().alias("checked_at"), (size % 7 != 0).alias("current"), F.when(size % 10 == 0, 2).otherwise(1).alias("minimum"))


def failure():
    pack = F.struct(F.col("pack_quantity").alias("quantity"), F.lit("piece").alias("unit"), F.lit(None).cast("double").alias("drained_grams"), F.lit(False).alias("approximate"))
    none = F.lit(None).cast("timestamp_ntz")
    return pricing.option_failure(F.col("current"), F.lit(True), F.lit(False), F.col("minimum"), F.col("amount_ore"), F.col("deposit_ore"), none, none,
                                  F.lit(None).cast("string"), F.col("basis"), pack, F.col("unit"), now())


_DEMANDS = """appr AS (SELECT 'lot ' || (p_partkey // 3) AS ingredient_id, p_partkey AS product_id, row_number() OVER (PARTITION BY p_partkey // 3 ORDER BY p_partkey) AS rk FROM part),
dem AS (SELECT o_custkey AS menu_id, 'lot ' || (p_partkey // 3) AS ingredient_id, CASE WHEN NOT (l_tax = 0.08 AND l_discount = 0.1) THEN l_quantity END AS quantity,
  CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'g' ELSE 'piece' END AS unit, l_linenumber % 2 = 0 AS even FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_name <> 'hot plate'),
needs AS (SELECT menu_id, ingredient_id, sum(quantity) AS quantity, min(unit) AS unit, bool_or(even) AS any_even,
  CASE WHEN min(unit) <> max(unit) THEN 'incompatible_or_unknown_quantity_unit' WHEN count(*) FILTER (quantity IS NULL) > 0 THEN 'quantity_unknown_or_invalid' END AS reason FROM dem GROUP BY ALL)"""
_OPTIONS = """cand AS (SELECT n.*, a.product_id, o.p_size AS size, CAST(floor(o.p_retailprice * 100 + 0.5) AS BIGINT) AS amount_ore,
  CASE WHEN o.p_partkey IS NULL OR o.p_size = 21 THEN 'approved_product_not_observed' WHEN o.p_size % 7 = 0 THEN 'product_unavailable_stale_or_wrong_store' WHEN o.p_size % 10 = 0 THEN 'conditional_price_excluded'
   WHEN n.unit <> 'piece' THEN 'package_quantity_or_unit_unknown' END AS why
  FROM needs n JOIN appr a ON a.ingredient_id = n.ingredient_id AND (a.rk <= 2 OR NOT n.any_even) LEFT JOIN part o ON o.p_partkey = a.product_id WHERE n.reason IS NULL),
opts AS (SELECT * FROM cand WHERE why IS NULL),
failed AS (SELECT menu_id, ingredient_id, arg_min(why, CASE why WHEN 'conditional_price_excluded' THEN 1 WHEN 'package_quantity_or_unit_unknown' THEN 5 WHEN 'product_unavailable_stale_or_wrong_store' THEN 7 ELSE 8 END) AS reason
  FROM cand c GROUP BY ALL HAVING count(*) FILTER (why IS NULL) = 0)"""


def _needs_and_options(t: Tables):
    rows = demands(t)
    needs = stored(b.group_demands(rows), b.NEED)
    return needs, *b.priced_options(b.approved_products(rows, needs), observations(t), failure())


@query("demand_grouping", m.sql(_DEMANDS, body="SELECT menu_id, ingredient_id, quantity, reason FROM needs"))
def demand_grouping(t: Tables):
    return b.group_demands(demands(t)).select("menu_id", "ingredient_id", "quantity", "reason")


@query("option_resolution", m.sql(_DEMANDS, _OPTIONS, body="""
SELECT menu_id, ingredient_id, product_id, NULL AS reason FROM opts UNION ALL SELECT menu_id, ingredient_id, NULL, reason FROM failed"""))
def option_resolution(t: Tables):
    _, options, failed = _needs_and_options(t)
    return options.select("menu_id", "ingredient_id", "product_id", F.lit(None).cast("string").alias("reason")).unionByName(
        failed.select("menu_id", "ingredient_id", F.lit(None).cast("bigint").alias("product_id"), "reason"))


_COVER = """packs AS (SELECT menu_id, ingredient_id, any_value(quantity) AS q, list(struct_pack(id := product_id, size := size, price := amount_ore + size * 10) ORDER BY product_id) AS p FROM opts GROUP BY ALL),
s1 AS (SELECT *, unnest(generate_series(0, CASE WHEN len(p) > 1 THEN CAST(ceil(q / p[2].size) AS BIGINT) ELSE 0 END)) AS n2 FROM packs),
s2 AS (SELECT *, unnest(generate_series(0, CASE WHEN len(p) > 2 THEN CAST(ceil(greatest(0, q - n2 * p[2].size) / p[3].size) AS BIGINT) ELSE 0 END)) AS n3 FROM s1),
cover AS (SELECT menu_id, ingredient_id, any_value(q) AS quantity, min(CAST(ceil(greatest(0, q - n2 * coalesce(p[2].size, 0) - n3 * coalesce(p[3].size, 0)) / p[1].size) AS BIGINT) * p[1].price
   + n2 * coalesce(p[2].price, 0) + n3 * coalesce(p[3].price, 0)) AS cost FROM s2 GROUP BY ALL)"""


@query("pack_cover_exact", m.sql(_DEMANDS, _OPTIONS, _COVER, body="SELECT menu_id, ingredient_id, quantity, CAST(cost AS BIGINT) AS cost_ore FROM cover"))
def pack_cover_exact(t: Tables):
    _, options, _ = _needs_and_options(t)
    return b.cover_independent(options).select("menu_id", "ingredient_id", "quantity", F.col("cost").cast("bigint").alias("cost_ore"))


@query("basket_line_totals", m.sql(_DEMANDS, _OPTIONS, _COVER, body="""
SELECT menu_id, CAST(sum(cost) AS BIGINT) AS purchase_ore, CAST(sum(quantity) AS BIGINT) AS consumed_quantity FROM cover GROUP BY menu_id"""))
def basket_line_totals(t: Tables):
    _, options, _ = _needs_and_options(t)
    lines = b.basket_lines(b.cover_independent(options), options)
    return lines.groupBy("menu_id").agg(F.sum("purchase").cast("bigint").alias("purchase_ore"), F.sum(F.round("consumed_quantity", 3).cast("decimal(20,3)")).cast("bigint").alias("consumed_quantity"))


@query("reference_estimate", m.sql(_DEMANDS, _OPTIONS, body="""
, pick AS (SELECT menu_id, arg_min(struct_pack(id := product_id, size := size, price := amount_ore + size * 10, q := quantity), struct_pack(c := CAST(ceil(quantity / size) AS BIGINT) * (amount_ore + size * 10), id := product_id)) AS b FROM opts GROUP BY menu_id, ingredient_id),
need AS (SELECT menu_id, b.id, b.size AS size, b.price AS price, sum(b.q) AS q FROM pick GROUP BY ALL)
SELECT menu_id, CASE WHEN NOT open THEN CAST((SELECT sum(CAST(ceil(q / size) AS BIGINT) * price) FROM need WHERE need.menu_id = x.menu_id) AS BIGINT) END AS reference_ore
FROM (SELECT n.menu_id, bool_or(o.menu_id IS NULL) AS open FROM needs n LEFT JOIN (SELECT DISTINCT menu_id, ingredient_id FROM opts) o ON o.menu_id = n.menu_id AND o.ingredient_id = n.ingredient_id GROUP BY n.menu_id) x"""))
def reference_estimate(t: Tables):
    needs, options, _ = _needs_and_options(t)
    return b.reference_estimate(options, needs)


_BASKET = """unres AS (SELECT menu_id, ingredient_id FROM needs WHERE reason IS NOT NULL UNION ALL SELECT menu_id, ingredient_id FROM failed),
menus AS (SELECT DISTINCT o_custkey AS menu_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
basket AS (SELECT m.menu_id, coalesce(u.n, 0) AS unresolved, coalesce(c.cost, 0) AS known FROM menus m LEFT JOIN (SELECT menu_id, count(*) AS n FROM unres GROUP BY 1) u USING (menu_id)
  LEFT JOIN (SELECT menu_id, CAST(sum(cost) AS BIGINT) AS cost FROM cover GROUP BY 1) c USING (menu_id)),
priced AS (SELECT b.*, unresolved = 0 AS complete, c_nationkey AS request_id, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) * 100 AS budget_ore FROM basket b JOIN customer ON c_custkey = menu_id)"""


def _optimised(t: Tables, resolved=None):
    budget = t.customer.select(F.col("c_custkey").alias("menu_id"), ((F.floor(F.col("c_acctbal") * 100 + 0.5)) * 100).alias("budget_ore"))
    return b.optimize(demands(t), observations(t), failure(), budget=budget, resolved=resolved)


@query("basket_optimisation", m.sql(_DEMANDS, _OPTIONS, _COVER, _BASKET, body="""
SELECT menu_id, complete, TRUE AS optimization_complete, CASE WHEN complete THEN known END AS purchase_ore, known AS known_purchase_ore, unresolved,
  CASE WHEN complete THEN known <= budget_ore END AS within_budget FROM priced"""))
def basket_optimisation(t: Tables):
    return _optimised(t)


@query("menu_ranking", m.sql(_DEMANDS, _OPTIONS, _COVER, _BASKET, body="""
, f AS (SELECT *, complete AND known <= budget_ore AS feasible FROM priced)
SELECT request_id, menu_id, feasible, CAST(row_number() OVER (PARTITION BY request_id ORDER BY feasible DESC, CASE WHEN feasible THEN known END NULLS LAST, menu_id) AS BIGINT) AS position FROM f"""))
def menu_ranking(t: Tables):
    priced = _optimised(t).join(t.customer.select(F.col("c_custkey").alias("menu_id"), F.col("c_nationkey").alias("request_id")), "menu_id")
    return b.rank_menus(priced).select("request_id", "menu_id", "feasible", "position")


@query("equivalent_demands", m.sql(_DEMANDS, _OPTIONS, body="""
, k AS (SELECT menu_id, ingredient_id, arg_min(quantity, product_id) AS q, string_agg(CAST(product_id % 3 AS VARCHAR), ',' ORDER BY product_id % 3) AS sig FROM (SELECT DISTINCT menu_id, ingredient_id, product_id % 3 AS product_id, quantity FROM opts) GROUP BY ALL)
SELECT menu_id, min(ingredient_id) AS ingredient_id, sum(q) AS quantity, count(*) AS merged FROM k GROUP BY menu_id, sig"""))
def equivalent_demands(t: Tables):
    _, options, _ = _needs_and_options(t)
    shared = options.select("menu_id", "ingredient_id", "quantity", "unit", (F.col("product_id") % 3).alias("product_id")).distinct()
    return b.merge_equal_needs(shared).groupBy("menu_id", "ingredient_id").agg(F.first("quantity").alias("quantity"), F.first("merged").alias("merged"))


def _coupled_sql(labels: str) -> str:
    """Needs and edges under ``labels``: SQL giving (p_partkey, noun, adj, one)."""
    return f"""lab AS ({labels}),
ap AS (SELECT adj AS ingredient_id, p_partkey AS product_id FROM lab UNION ALL SELECT noun, p_partkey FROM lab UNION ALL SELECT one, p_partkey FROM lab),
nd AS (SELECT o_custkey AS menu_id, CASE l_linenumber % 3 WHEN 0 THEN noun WHEN 1 THEN adj ELSE one END AS ingredient_id, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN lab ON l_partkey = p_partkey GROUP BY ALL),
edges AS (SELECT menu_id, ingredient_id, product_id, q FROM nd JOIN ap USING (ingredient_id)),
links AS (SELECT DISTINCT a.menu_id, a.ingredient_id AS x, b.ingredient_id AS y FROM edges a JOIN edges b USING (menu_id, product_id)),
reach AS (SELECT menu_id, x, y FROM links UNION SELECT r.menu_id, r.x, l.y FROM reach r JOIN links l ON l.menu_id = r.menu_id AND l.x = r.y)"""


_NEIGHBOURS = "SELECT p_partkey, 'n ' || (p_partkey // 3) AS noun, 'a ' || ((p_partkey + 1) // 2) AS adj, 'p ' || p_partkey AS one FROM part"
_COUPLED = _coupled_sql(_NEIGHBOURS)
# the same table of counts and sets for every component: counts by generate_series, sets of goods as bit masks
_ENUMERATED = """comp AS (SELECT menu_id, x AS ingredient_id, min(y) AS component FROM reach GROUP BY ALL HAVING count(*) > 1),
ce AS (SELECT menu_id, component, ingredient_id, product_id, q, p_size AS size, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) + p_size * 10 AS price FROM edges JOIN comp USING (menu_id, ingredient_id) JOIN part ON p_partkey = product_id),
goods AS (SELECT *, CAST(row_number() OVER (PARTITION BY menu_id, component ORDER BY price / size, product_id) - 1 AS INTEGER) AS k FROM (SELECT DISTINCT menu_id, component, product_id, size, price FROM ce)),
masks AS (SELECT menu_id, component, ingredient_id, any_value(q) AS q, sum(CAST(1 AS BIGINT) << k)::BIGINT AS mask, min(price / size) AS least, min(CAST(ceil(q / size) AS BIGINT) * price) AS plain FROM ce JOIN goods USING (menu_id, component, product_id, size, price) GROUP BY ALL),
sets AS (SELECT menu_id, component, mask FROM masks UNION SELECT s.menu_id, s.component, s.mask | m.mask FROM sets s JOIN masks m ON m.menu_id = s.menu_id AND m.component = s.component AND (s.mask & m.mask) <> 0),
wants AS (SELECT s.menu_id, s.component, s.mask, sum(m.q) AS want FROM sets s JOIN masks m ON m.menu_id = s.menu_id AND m.component = s.component AND (m.mask & ~s.mask) = 0 GROUP BY ALL),
excess AS (SELECT g.menu_id, g.component, g.k, any_value(g.size) AS size, any_value(g.price) AS price, any_value(g.price) - any_value(g.size) * max(m.least) AS excess FROM goods g JOIN masks m ON m.menu_id = g.menu_id AND m.component = g.component AND (m.mask >> g.k) & 1 = 1 GROUP BY ALL),
box AS (SELECT menu_id, component, m, w, s, p, e, least, plain FROM
  (SELECT menu_id, component, list(mask ORDER BY mask) AS m, list(want ORDER BY mask) AS w FROM wants GROUP BY ALL) JOIN
  (SELECT menu_id, component, list(size ORDER BY k) AS s, list(price ORDER BY k) AS p, list(excess ORDER BY k) AS e FROM excess GROUP BY ALL) USING (menu_id, component) JOIN
  (SELECT menu_id, component, sum(q * least) AS least, sum(plain) AS plain FROM masks GROUP BY ALL) USING (menu_id, component)),
walk AS (SELECT menu_id, component, 0 AS k, CAST(0 AS BIGINT) AS paid, CAST(0 AS DOUBLE) AS over, list_transform(w, lambda x: x * 0) AS held FROM box
  UNION SELECT menu_id, component, k + 1, paid + n * p[k + 1], over + n * e[k + 1], [CASE WHEN (m[i] >> k) & 1 = 1 THEN least(w[i], held[i] + n * s[k + 1]) ELSE held[i] END for i in range(1, len(m) + 1)]
  FROM (SELECT t.*, b.m, b.w, b.s, b.p, b.e, b.least, b.plain, unnest(generate_series(
      list_max([CASE WHEN (b.m[i] >> t.k) & 1 = 1 AND b.m[i] >> (t.k + 1) = 0 THEN CAST(ceil((b.w[i] - t.held[i]) / b.s[t.k + 1]) AS BIGINT) ELSE 0 END for i in range(1, len(b.m) + 1)]),
      list_max([CASE WHEN (b.m[i] >> t.k) & 1 = 1 THEN CAST(ceil((b.w[i] - t.held[i]) / b.s[t.k + 1]) AS BIGINT) ELSE 0 END for i in range(1, len(b.m) + 1)]))) AS n
    FROM walk t JOIN box b ON b.menu_id = t.menu_id AND b.component = t.component WHERE t.k < len(b.s))
  WHERE least + over + n * e[k + 1] <= plain + 0.001)"""
_CHEAPEST = "SELECT t.menu_id, t.component, min(t.paid) AS cost_ore, TRUE AS optimization_complete FROM walk t JOIN box b ON b.menu_id = t.menu_id AND b.component = t.component AND t.k = len(b.s) GROUP BY ALL"


def coupled_options(t: Tables, labels: list):
    """Needs under three labels for parts, by line number; parts of one label serve its needs, so products overlap."""
    approved = None
    for label in labels:
        part = approved_in(t, label)
        approved = part if approved is None else approved.unionByName(part)
    kind = F.col("l_linenumber") % 3
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(exchanged(t.part), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("o_custkey").alias("menu_id"), F.when(kind == 0, labels[0]).when(kind == 1, labels[1]).otherwise(labels[2]).alias("ingredient_id"), F.col("l_quantity").alias("quantity"))
    needs = lines.groupBy("menu_id", "ingredient_id").agg(F.sum("quantity").alias("quantity"))
    goods = t.part.select(F.col("p_partkey").alias("product_id"), F.lit("pack").alias("basis"), m.list_price_ore().alias("amount_ore"),
                          (F.col("p_size") * 10).cast("bigint").alias("deposit_ore"), F.col("p_size").cast("double").alias("pack_quantity"))
    pairs = needs.join(exchanged(approved.select("ingredient_id", F.explode("approved").alias("product_id")).join(exchanged(goods), "product_id")), "ingredient_id")
    return pairs.withColumn("unit", F.lit("piece"))


def neighbouring_lots():
    """Lots of three, two or one neighbouring parts."""
    return [F.concat(F.lit("n "), lot(3)), F.concat(F.lit("a "), lot(2, 1)), F.concat(F.lit("p "), lot(1))]


@query("basket_components", m.sql(_COUPLED, body="SELECT menu_id, x AS ingredient_id, min(y) AS component FROM reach GROUP BY ALL"))
def basket_components(t: Tables):
    return b.connected_components(coupled_options(t, neighbouring_lots()), "menu_id", "ingredient_id", "product_id").select("menu_id", "ingredient_id", "component")


def _covers(options):
    _, coupled = b.split_coupled(stored(options, b.NEED))
    labels = b.connected_components(coupled, "menu_id", "ingredient_id", "product_id")
    covers = b.cover_coupled(coupled, labels)
    return covers.select("menu_id", "component", F.col("cost").cast("bigint").alias("cost_ore"), "optimization_complete")


@query("coupled_cover", m.sql(_COUPLED, _ENUMERATED, body=_CHEAPEST))
def coupled_cover(t: Tables):
    """Components of needs that share products of neighbouring lots."""
    return _covers(coupled_options(t, neighbouring_lots()))


_SCATTERED = """SELECT p_partkey, 'c ' || ((p_partkey * 7 + 3) % n.parts // 3) AS noun, 'd ' || ((p_partkey * 11 + 5) % n.parts // 2) AS adj, 'p ' || p_partkey AS one FROM part, (SELECT count(*) AS parts FROM part) n"""


def scattered_lots(t: Tables):
    """Lots whose parts lie far apart, differently for each label, so that needs are coupled across the catalogue."""
    parts = t.part.count()
    return [F.expr(f"concat('c ', ((p_partkey * 7 + 3) % {parts}) DIV 3)"), F.expr(f"concat('d ', ((p_partkey * 11 + 5) % {parts}) DIV 2)"), F.concat(F.lit("p "), lot(1))]


@query("coupled_cover_scattered", m.sql(_coupled_sql(_SCATTERED), _ENUMERATED, body=_CHEAPEST))
def coupled_cover_scattered(t: Tables):
    """Components of needs whose products lie anywhere in the catalogue."""
    return _covers(coupled_options(t, scattered_lots(t)))


@query("unit_switch", """
WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 'ml' ELSE 'piece' END AS unit, l_quantity, CASE WHEN l_discount < 0.05 THEN l_quantity * 3 END AS grams, p_size FROM lineitem JOIN part ON l_partkey = p_partkey),
x AS (SELECT *, CASE l_partkey % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' ELSE 'piece' END AS pu FROM d)
SELECT id, CASE WHEN grams IS NOT NULL AND pu = 'g' THEN grams ELSE l_quantity END AS quantity, CASE WHEN grams IS NOT NULL AND pu = 'g' THEN 'g' ELSE unit END AS unit, grams IS NOT NULL AND pu = 'g' AS converted FROM x""")
def unit_switch(t: Tables):
    rows = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.xxhash64(*t.lineitem.columns).alias("line"), F.when(F.col("l_linenumber") % 2 == 0, "ml").otherwise("piece").alias("unit"),
        F.col("l_quantity").alias("quantity"), F.when(F.col("l_discount") < 0.05, F.col("l_quantity") * 3).alias("grams"), F.array("l_partkey").alias("approved"))
    goods = t.part.select(F.col("p_partkey").alias("product_id"), F.element_at(F.array(F.lit("g"), F.lit("ml"), F.lit("piece")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("pack_unit"), F.lit("pack").alias("basis"))
    return b.switch_units(rows, goods).select("id", "quantity", "unit", "converted")


@query("tracked_products", m.sql(_DEMANDS, body="SELECT DISTINCT product_id FROM dem JOIN appr USING (ingredient_id) WHERE rk <= 2 OR NOT even"))
def tracked_products(t: Tables):
    return b.tracked_products(demands(t))


@query("finalist_pricing", m.sql(_DEMANDS, _OPTIONS, _COVER, _BASKET, body="""
, pick AS (SELECT menu_id, arg_min(struct_pack(id := product_id, size := size, price := amount_ore + size * 10, q := quantity), struct_pack(c := CAST(ceil(quantity / size) AS BIGINT) * (amount_ore + size * 10), id := product_id)) AS b FROM opts GROUP BY menu_id, ingredient_id),
need AS (SELECT menu_id, b.id, b.size AS size, b.price AS price, sum(b.q) AS q FROM pick GROUP BY ALL), refk AS (SELECT menu_id, CAST(sum(CAST(ceil(q / size) AS BIGINT) * price) AS BIGINT) AS known_ore FROM need GROUP BY menu_id),
refs AS (SELECT n.menu_id, bool_or(o.menu_id IS NULL) AS open FROM needs n LEFT JOIN (SELECT DISTINCT menu_id, ingredient_id FROM opts) o ON o.menu_id = n.menu_id AND o.ingredient_id = n.ingredient_id GROUP BY n.menu_id),
ref AS (SELECT menu_id, CASE WHEN NOT open THEN known_ore END AS reference_ore FROM refs LEFT JOIN refk USING (menu_id)),
f AS (SELECT *, complete AND known <= budget_ore AS feasible FROM priced),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY feasible DESC, CASE WHEN feasible THEN known END NULLS LAST, menu_id) AS position FROM f)
SELECT request_id, menu_id, reference_ore, CASE WHEN complete THEN known END AS purchase_ore, feasible AND position = 1 AS selected FROM rk LEFT JOIN ref USING (menu_id)"""))
def finalist_pricing(t: Tables):
    needs, options, failed = _needs_and_options(t)
    estimates = b.reference_estimate(options, needs)
    ranked = b.rank_menus(_optimised(t, (needs, options, failed)).join(t.customer.select(F.col("c_custkey").alias("menu_id"), F.col("c_nationkey").alias("request_id")), "menu_id"))
    return ranked.join(estimates, "menu_id", "left").select("request_id", "menu_id", "reference_ore", "purchase_ore", "selected")
