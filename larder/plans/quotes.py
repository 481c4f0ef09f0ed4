"""Queries over line costs, shopping lists, menu quotes and bulk prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.money import exact_cost, round_cost
from ..operators import quotes as q
from . import mapping as m
from .registry import Tables, query
from .scalars import priced_parts

NOW = "2024-01-10 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def piece_products(t: Tables):
    """Parts sold per package of ``p_size`` pieces."""
    return t.part.select(
        F.col("p_partkey").alias("code"), m.list_price_ore().alias("price_ore"), F.lit("kr/st").alias("price_unit"),
        (F.col("p_size") * 10).cast("bigint").alias("deposit_ore"), F.lit(True).alias("available"), now().alias("observed_at"), cal.week_end(now()).alias("expires_at"),
        F.struct(F.col("p_size").cast("double").alias("quantity"), F.lit("piece").alias("unit"), F.lit(None).cast("double").alias("drained_grams"),
                 F.lit(False).alias("approximate")).alias("pack"))


def menu_lines(t: Tables):
    """Order lines of every customer's menu, priced per piece."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("menu_id"), F.col("l_orderkey").alias("recipe_id"), F.col("l_partkey").alias("code"), F.col("l_quantity").alias("amount"))
    goods = t.part.select(F.col("p_partkey").alias("code"), m.list_price_ore().alias("__p"), F.col("p_size").alias("__s"))
    cost = exact_cost(F.col("__p") * F.col("amount") / F.col("__s"))
    return lines.join(goods, "code").select("menu_id", "recipe_id", "code", "amount", cost.alias("cost"), F.lit("priced").alias("status"),
                                            F.lit("piece").alias("amount_unit"), F.lit(False).alias("amount_approximate"))


def shopping_list_quote(t: Tables):
    """Menus to shopping lists to totals: the flagship."""
    groups = q.line_groups(menu_lines(t))
    return q.quote_totals(groups, piece_products(t)).select("menu_id", "unresolved", "complete", "consumed_ore", "purchase_ore", m.stamp(F.col("earliest_expiry")).alias("earliest_expiry"))


query("shopping_list_quote", m.sql(m.PRODUCTS, body=f"""
, lines AS (SELECT o_custkey AS menu_id, l_partkey AS code, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, sum(CAST(price_ore * l_quantity / size AS DECIMAL(28,9))) AS cost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN products ON l_partkey = code GROUP BY ALL),
buy AS (SELECT menu_id, cost, CAST(ceil(qty / CAST(size AS DOUBLE)) AS BIGINT) * (price_ore + size * 10) AS total FROM lines JOIN products USING (code))
SELECT menu_id, CAST(0 AS BIGINT) AS unresolved, TRUE AS complete, CAST(floor(sum(cost) + 0.5) AS BIGINT) AS consumed_ore, CAST(sum(total) AS BIGINT) AS purchase_ore,
  {m.sql_stamp(m.sql_week_end(f"TIMESTAMP '{NOW}'"))} AS earliest_expiry FROM buy GROUP BY menu_id"""))(shopping_list_quote)


@query("shopping_list_lines", m.sql(m.PRODUCTS, body="""
, lines AS (SELECT o_custkey AS menu_id, l_partkey AS code, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, sum(CAST(price_ore * l_quantity / size AS DECIMAL(28,9))) AS cost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN products ON l_partkey = code GROUP BY ALL)
SELECT menu_id, code, CAST(qty AS DOUBLE) AS amount, CAST(ceil(qty / CAST(size AS DOUBLE)) AS BIGINT) AS packs, CAST(floor(cost + 0.5) AS BIGINT) AS consumed_ore,
  CAST(ceil(qty / CAST(size AS DOUBLE)) AS BIGINT) * price_ore AS purchase_ore, CAST(ceil(qty / CAST(size AS DOUBLE)) AS BIGINT) * size * 10 AS deposit_ore FROM lines JOIN products USING (code)"""))
def shopping_list_lines(t: Tables):
    return q.shopping_list(q.line_groups(menu_lines(t)), piece_products(t)).select("menu_id", "code", "amount", "packs", "consumed_ore", "purchase_ore", "deposit_ore")


_COSTED = """priced AS (
  SELECT p_partkey AS code, p_size, p_type, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS price_ore,
    CASE p_partkey % 4 WHEN 0 THEN 'kr/kg' WHEN 1 THEN 'kr/st' WHEN 2 THEN 'kr/förp' ELSE 'kr/l' END AS price_unit,
    CASE p_partkey % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' ELSE 'piece' END AS pack_unit, p_size % 10 = 0 AS approximate, p_size % 7 <> 0 AS available,
    CASE WHEN p_size % 13 = 0 THEN NULL ELSE p_size * 10 END AS deposit_ore, p_size % 6 = 0 AS stale,
    CASE WHEN p_size % 9 = 0 THEN 'needs_review' WHEN p_size % 9 = 1 THEN 'non_purchased' ELSE 'matched' END AS link FROM part),
src AS (SELECT o_custkey AS menu_id, l_orderkey AS recipe_id, l_linenumber AS idx, p.*, CASE l_linenumber % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' WHEN 2 THEN 'piece' END AS unit0,
    CASE l_linenumber % 4 WHEN 1 THEN 236.5882365::DOUBLE ELSE 1.0::DOUBLE END AS factor, l_linenumber % 4 = 3 AS pinch,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN NULL ELSE l_quantity END AS qty, l_tax = 0.08 AS conflict,
    CASE WHEN l_orderkey % 3 = 0 THEN 1.0::DOUBLE WHEN o_custkey % 5 = 0 THEN NULL ELSE 6.0::DOUBLE / (o_custkey % 5) END AS scale, o.recipe IS NOT NULL AS over
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN priced p ON l_partkey = code
  LEFT JOIN (SELECT DISTINCT l_orderkey AS recipe, l_linenumber AS n FROM lineitem WHERE l_discount = 0) o ON o.recipe = l_orderkey AND o.n = l_linenumber),
amt AS (SELECT *, CASE WHEN over THEN NULL WHEN qty IS NULL THEN 'quantity_unknown_or_qualitative' WHEN conflict THEN 'conflicting_source_quantity' WHEN pinch THEN 'unit_conversion_unknown' END AS bad,
    CASE WHEN over THEN 100.0::DOUBLE * scale * 1.0 ELSE qty * scale * factor END AS a0, CASE WHEN over THEN 'g' ELSE unit0 END AS u0,
    (NOT over AND idx % 4 = 1 AND p_type = 'PROMO' AND (pack_unit = 'g' OR price_unit = 'kr/kg')) AS sourced FROM src),
fin AS (SELECT *, CASE WHEN sourced THEN qty * scale * (p_size * 3.0::DOUBLE) ELSE a0 END AS a, CASE WHEN sourced THEN 'g' ELSE u0 END AS u FROM amt),
raw_cost AS (SELECT *, CASE WHEN price_unit = 'kr/kg' AND u = 'g' OR price_unit = 'kr/l' AND u = 'ml' THEN price_ore * a / 1000
    WHEN price_unit IN ('kr/st', 'kr/förp') AND pack_unit = u AND NOT approximate THEN price_ore * a / p_size END AS c FROM fin),
reasoned AS (SELECT *, CASE WHEN scale IS NULL THEN 'source_servings_unknown' WHEN link = 'non_purchased' THEN NULL WHEN link <> 'matched' THEN 'ingredient_connection_unavailable'
    WHEN NOT available OR stale THEN 'product_unavailable_or_stale' WHEN deposit_ore IS NULL THEN 'price_unknown' WHEN bad IS NOT NULL THEN bad
    WHEN c IS NULL THEN CASE WHEN u = 'ml' AND pack_unit = 'g' THEN 'density_required' WHEN u = 'piece' AND pack_unit = 'g' THEN 'piece_weight_required' ELSE 'package_or_unit_conversion_unknown' END END AS reason FROM raw_cost),
costed AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'unresolved' WHEN link = 'non_purchased' THEN 'not_purchased' ELSE 'priced' END AS status,
    CASE WHEN reason IS NOT NULL THEN NULL WHEN link = 'non_purchased' THEN 0 ELSE CAST(c AS DECIMAL(28,9)) END AS cost FROM reasoned)"""


def costed_lines(t: Tables):
    unit = F.element_at(F.array(F.lit("g"), F.lit("cup"), F.lit("count"), F.lit("pinch")), F.col("l_linenumber") % 4 + 1)
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("menu_id"), F.col("l_orderkey").alias("recipe_id"), F.col("l_linenumber").alias("ingredient_index"),
        F.concat(F.lit("part "), "l_partkey").alias("name"), unit.alias("unit"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "to taste").otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("measured_quantity"),
        (F.col("l_tax") == 0.08).alias("quantity_conflict"), (F.col("o_custkey") % 5).cast("double").alias("servings"),
        F.when(F.col("l_orderkey") % 3 != 0, 6.0).alias("requested_servings"))
    overrides = t.lineitem.filter("l_discount = 0").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("menu_id"), F.col("l_orderkey").alias("recipe_id"), F.col("l_linenumber").alias("ingredient_index")).distinct().withColumn(
        "quantity", F.lit(100)).withColumn("unit", F.lit("g"))
    aliases = t.part.filter("p_type = 'PROMO'").select(F.concat(F.lit("part "), "p_partkey").alias("alias"), F.col("p_size").alias("food_id"))
    measures = t.part.select(F.col("p_size").alias("food_id")).distinct().select(
        "food_id", F.lit("cup").alias("unit"), F.lit(None).cast("string").alias("size"), (F.col("food_id") * 3.0).alias("grams_per_unit"))
    staged = q.with_overrides(q.reference_amounts(lines, aliases, measures).drop("food_id"), overrides)
    observed = F.when(F.col("p_size") % 6 == 0, F.timestamp_add("DAY", F.lit(-7), now())).otherwise(now())
    products = priced_parts(t).withColumn("observed_at", observed).withColumn("expires_at", cal.week_end(F.col("observed_at"))).drop("p_size", "conditional", "basis")
    size = F.col("p_size") % 9
    links = t.part.select(F.concat(F.lit("part "), "p_partkey").alias("name"), F.when(size == 0, "needs_review").when(size == 1, "non_purchased").otherwise("matched").alias("status"),
                          F.col("p_partkey").alias("code"))
    return q.cost_lines(staged, links, products, now(), overrides=True), products


@query("line_costing", m.sql(_COSTED, body="""
SELECT menu_id, recipe_id, idx AS ingredient_index, code, status, CAST(floor(cost + 0.5) AS BIGINT) AS cost_ore, reason, CASE WHEN status = 'priced' THEN u END AS amount_unit, status = 'priced' AND sourced AS approximate FROM costed"""))
def line_costing(t: Tables):
    lines, _ = costed_lines(t)
    return lines.select("menu_id", "recipe_id", "ingredient_index", "code", "status", round_cost(F.col("cost")).alias("cost_ore"), "reason",
                        F.when(F.col("status") == "priced", F.col("amount_unit")).alias("amount_unit"),
                        ((F.col("status") == "priced") & F.col("amount_approximate")).alias("approximate"))


@query("recipe_costs", m.sql(_COSTED, body="""
SELECT menu_id, recipe_id, count(*) AS lines, count(*) FILTER (status = 'unresolved') AS unresolved,
  CASE WHEN count(*) FILTER (status = 'unresolved') = 0 THEN CAST(floor(sum(coalesce(cost, 0)) + 0.5) AS BIGINT) END AS consumed_ore, CAST(floor(sum(coalesce(cost, 0)) + 0.5) AS BIGINT) AS known_consumed_ore FROM costed GROUP BY ALL"""))
def recipe_costs(t: Tables):
    return q.recipe_costs(costed_lines(t)[0])


@query("menu_quote", m.sql(_COSTED, body="""
, need AS (SELECT menu_id, code, u, sum(a) AS amount, sum(cost) AS cost FROM costed WHERE status = 'priced' GROUP BY ALL),
shop AS (SELECT n.menu_id, CAST(floor(n.cost + 0.5) AS BIGINT) AS consumed, price_unit IN ('kr/kg', 'kr/l') AS weighed, p.*,
  CASE WHEN price_unit NOT IN ('kr/kg', 'kr/l') THEN CAST(ceil(round(n.amount, 6) / p_size) AS BIGINT) END AS packs FROM need n JOIN priced p USING (code)),
s AS (SELECT menu_id, CASE WHEN weighed THEN consumed ELSE packs * price_ore END AS purchase, CASE WHEN NOT weighed THEN packs * deposit_ore WHEN deposit_ore = 0 THEN 0 END AS deposit FROM shop),
st AS (SELECT menu_id, count(*) FILTER (purchase IS NULL OR deposit IS NULL) AS open FROM s GROUP BY 1)
SELECT menu_id, count(*) FILTER (status = 'unresolved') AS unresolved, count(*) FILTER (status = 'unresolved') = 0 AS complete,
  count(*) FILTER (status = 'unresolved') = 0 AND coalesce(any_value(open), 0) = 0 AS purchase_complete,
  CASE WHEN count(*) FILTER (status = 'unresolved') = 0 THEN CAST(floor(sum(coalesce(cost, 0)) + 0.5) AS BIGINT) END AS consumed_ore,
  CAST(floor(sum(coalesce(cost, 0)) + 0.5) AS BIGINT) AS known_consumed_ore FROM costed LEFT JOIN st USING (menu_id) GROUP BY menu_id"""))
def menu_quote(t: Tables):
    lines, products = costed_lines(t)
    groups = q.line_groups(lines)
    return q.quote_totals(groups, products).select("menu_id", "unresolved", "complete", "purchase_complete", "consumed_ore", "known_consumed_ore")


@query("override_violations", """
WITH o AS (SELECT l_orderkey AS recipe_id, l_linenumber + CASE WHEN l_returnflag = 'R' THEN 3 ELSE 0 END AS ingredient_index, CASE WHEN l_tax = 0 THEN -l_quantity ELSE l_quantity END AS quantity,
  CASE WHEN l_linestatus = 'O' AND l_discount = 0.1 THEN 'oz' ELSE 'g' END AS unit FROM lineitem),
x AS (SELECT o.*, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.recipe_id AND l_linenumber = o.ingredient_index) AS known FROM o)
SELECT recipe_id, ingredient_index, quantity, unit, CASE WHEN NOT known THEN 'ingredient_index_out_of_range' ELSE 'invalid_amount_override' END AS violation FROM x WHERE NOT known OR quantity <= 0 OR unit = 'oz'""")
def override_violations(t: Tables):
    keys = ("recipe_id", "ingredient_index")
    lines = t.lineitem.select(F.col("l_orderkey").alias("recipe_id"), F.col("l_linenumber").alias("ingredient_index"))
    overrides = t.lineitem.select(
        F.col("l_orderkey").alias("recipe_id"), (F.col("l_linenumber") + F.when(F.col("l_returnflag") == "R", 3).otherwise(0)).alias("ingredient_index"),
        F.when(F.col("l_tax") == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_discount") == 0.1), "oz").otherwise("g").alias("unit"))
    return q.override_violations(lines, overrides, keys)


@query("bulk_price_query", """
WITH priced AS (SELECT p_partkey AS code, p_size, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS price_ore,
    CASE p_partkey % 4 WHEN 0 THEN 'kr/kg' WHEN 1 THEN 'kr/st' WHEN 2 THEN 'kr/förp' ELSE 'kr/l' END AS price_unit,
    CASE WHEN p_size % 13 = 0 THEN NULL ELSE p_size * 10 END AS deposit_ore, p_size % 6 = 0 AS stale FROM part WHERE p_size <> 21),
r AS (SELECT l_orderkey * 10 + l_linenumber AS product_id, l_partkey AS code, CASE WHEN l_linenumber % 2 = 0 THEN 'g' ELSE 'ml' END AS unit, l_quantity FROM lineitem),
x AS (SELECT product_id, r.code, deposit_ore, stale, p.code IS NULL AS unknown, CASE WHEN deposit_ore IS NULL THEN NULL WHEN price_unit IN ('kr/st', 'kr/förp') THEN price_ore
  WHEN price_unit = 'kr/kg' AND unit = 'g' OR price_unit = 'kr/l' AND unit = 'ml' THEN CAST(floor(price_ore * l_quantity / 1000 + 0.5) AS BIGINT) END AS price FROM r LEFT JOIN priced p USING (code)),
y AS (SELECT *, CASE WHEN unknown THEN 'unknown_code' WHEN price IS NULL THEN 'pack_price_unresolved' WHEN stale THEN 'stale' END AS reason FROM x)
SELECT product_id, code, CASE WHEN reason IS NULL THEN price END AS price_ore, CASE WHEN reason IS NULL THEN CAST(deposit_ore AS BIGINT) END AS deposit_ore, reason FROM y""")
def bulk_price_query(t: Tables):
    requests = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("product_id"), F.col("l_partkey").alias("code"),
                                 F.when(F.col("l_linenumber") % 2 == 0, "g").otherwise("ml").alias("unit"), F.col("l_quantity").alias("pack_quantity"))
    observed = F.when(F.col("p_size") % 6 == 0, F.timestamp_add("DAY", F.lit(-7), now())).otherwise(now())
    products = priced_parts(t).filter("p_size <> 21").withColumn("observed_at", observed).withColumn("expires_at", cal.week_end(F.col("observed_at"))).select(
        "code", "price_ore", "price_unit", "deposit_ore", "observed_at", "expires_at")
    return q.price_query(requests, products, now())


@query("earliest_price_boundary", f"""
WITH b AS (SELECT user_id, ts + INTERVAL 2 DAY AS x, CASE WHEN event_type = 'view' THEN ts + INTERVAL 1 HOUR END AS y FROM events),
f AS (SELECT user_id, least(min(x) FILTER (x > TIMESTAMP '{NOW}'), min(y) FILTER (y > TIMESTAMP '{NOW}')) AS b FROM b GROUP BY 1)
SELECT user_id, {m.sql_stamp(f"least(b, {m.sql_week_end(f"TIMESTAMP '{NOW}'")})")} AS valid_until FROM f""")
def earliest_price_boundary(t: Tables):
    later = lambda unit, n: F.timestamp_add(unit, F.lit(n), F.col("ts"))
    rows = q.earliest_boundary(t.events, ["user_id"], [later("DAY", 2), F.when(F.col("event_type") == "view", later("HOUR", 1))], now())
    return rows.select("user_id", m.stamp(F.col("valid_until")).alias("valid_until"))


