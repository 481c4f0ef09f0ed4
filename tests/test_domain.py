import datetime as dt

from pyspark.sql import functions as F

from larder.functions import calendar as cal
from larder.functions.policy import POLICY_VERSION
from larder.functions.text import fold_text
from larder.operators import corpus, linking as link, quotes as q, recipes as r, retail as rt, review as rv

NOW = "2026-10-14 12:00:00"
RULES = (
    link.FoodRule("onion", ("onion", "yellow onion"), r"^gul lok", ("frukt",)),
    link.FoodRule("garlic-powder", ("garlic powder",), r"^vitlokspulver", ("skafferi",), form="dried"),
    link.FoodRule("garlic", ("garlic",), r"^vitlok\b", ("frukt",), form="fresh"),
    link.FoodRule("milk", ("milk",), r"^mjolk", ("mejeri",), basis="l", exclude="choklad"),
)


def products(spark):
    rows = [("1", "gul lok", ["frukt gront"], 1000), ("2", "gul lok eko", ["frukt"], 900), ("3", "vitlok", ["frukt"], 500), ("4", "vitlokspulver", ["skafferi"], 100), ("5", "mjolk choklad", ["mejeri"], 10), ("6", "gul lok", ["fryst"], 1)]
    return spark.createDataFrame(rows, "code string, title string, categories array<string>, price bigint")


def test_alias_choice_and_uncertainty(spark):
    names = spark.createDataFrame([("Yellow Onion, chopped",), ("fresh garlic",), ("dried garlic",), ("garlic powder",), ("odd onion",), ("stone",), ("cooked onion",)], "name string")
    got = {x.name: (x.rule_id, x.uncertain) for x in link.link_aliases(names, link.alias_table(spark, RULES)).collect()}
    assert got == {"Yellow Onion, chopped": ("onion", False), "fresh garlic": ("garlic", False), "dried garlic": ("garlic", True), "garlic powder": ("garlic-powder", False),
                   "odd onion": ("onion", True), "stone": (None, None), "cooked onion": ("onion", True)}


def test_pools_and_statuses(spark):
    pools = link.rule_pools(products(spark), RULES)
    assert sorted((x.rule_id, x.code) for x in pools.collect()) == [("garlic", "3"), ("garlic-powder", "4"), ("onion", "1"), ("onion", "2")]
    wanted = spark.createDataFrame([("onion", 5), ("milk", 2), ("bacon", 1), ("hot water", 9), ("stone", 1)], "name string, occurrences bigint")
    links = link.link_aliases(wanted, link.alias_table(spark, RULES))
    goods = link.rule_pools(products(spark).withColumn("raw_title", F.col("title")).withColumn("brand", F.lit(None).cast("string")), RULES, ("code", "title", "raw_title", "categories", "brand", "price"))
    goods = goods.withColumn("eligible", F.lit(True)).withColumn("unit_price", F.col("price").cast("double"))
    built = link.build_pools(links, goods, ("code", "eligible", "unit_price"))
    got = {x.name: (x.status, x.selected_code) for x in link.select_links(wanted, links, built).collect()}
    assert got == {"onion": ("matched", "2"), "milk": ("unavailable", None), "bacon": ("excluded", None), "hot water": ("non_purchased", None), "stone": ("needs_review", None)}


LINK_RULES = (
    link.FoodRule("milk", ("milk",), r"^(?:mjolk|mellanmjolk)", ("mejeri",), basis="l"), link.FoodRule("honey", ("honey",), "honung", ("skafferi",)),
    link.FoodRule("beef-mince", ("ground beef",), "fars", ("kott",)), link.FoodRule("chicken", ("chicken breast",), "kyckling", ("kott",)), link.FoodRule("peas", ("peas",), "arter", ("fryst", "frukt")))
GOODS = [  # code, title, aisle, brand, price
    ("m1", "Mjölk 3%", "mejeri", "arla", 900.0), ("m2", "Mellanmjölk 1,5% eko", "mejeri", "arla", 950.0), ("m3", "Mjölk 3% eko", "mejeri", "arla", 1100.0), ("m4", "Mjölk", "mejeri", "arla", 100.0),
    ("h1", "Flytande honung", "skafferi", "x", 500.0), ("h2", "Honung", "skafferi", "x", 400.0), ("p1", "Ärter", "fryst", "x", 50.0), ("p2", "Ärter", "frukt", "x", 80.0)]


def linked(spark, names, goods=GOODS, eligible=True, rejected=None):
    wanted = spark.createDataFrame([(n, 1) for n in names], "name string, occurrences bigint")
    links = link.link_aliases(wanted, link.alias_table(spark, LINK_RULES))
    rows = spark.createDataFrame(goods, "code string, raw_title string, aisle string, brand string, unit_price double").select(
        "code", "raw_title", fold_text(F.col("raw_title")).alias("title"), F.array("aisle").alias("categories"), fold_text(F.col("brand")).alias("brand"), "unit_price", F.lit(eligible).alias("eligible"))
    pools = link.build_pools(links, link.rule_pools(rows, LINK_RULES, ("code", "title", "raw_title", "categories", "brand", "unit_price", "eligible")), ("code", "eligible", "unit_price"))
    no = None if rejected is None else spark.createDataFrame(rejected, "name string, code string")
    return links, pools, {r.name: (r.status, r.selected_code, r.candidates) for r in link.select_links(wanted, links, pools, rejected=no).collect()}


def test_signatures_choose_among_groups_of_proofs(spark):
    _, pools, got = linked(spark, ["milk", "3% milk", "organic milk", "3% organic milk", "1.5% milk", "liquid honey", "liquid milk", "honey", "fresh peas", "frozen peas", "peas", "40% milk"])
    assert got["milk"] == ("matched", "m4", 4) and got["organic milk"] == ("matched", "m2", 2)
    assert {n: got[n][1:] for n in ("3% milk", "3% organic milk", "1.5% milk", "40% milk")} == {
        "3% milk": (None, 2), "3% organic milk": (None, 1), "1.5% milk": (None, 1), "40% milk": (None, 0)}
    # a word that is no part of a rule leaves the name doubtful; its pool is counted all the same
    assert got["liquid honey"][2] == 1 and got["liquid milk"][2] == 4 and got["honey"] == ("matched", "h2", 2)
    assert got["fresh peas"] == ("matched", "p2", 1) and got["frozen peas"] == ("matched", "p1", 1) and got["peas"] == ("matched", "p1", 2)
    assert pools.products.count() == len(GOODS)


def test_rejected_products_give_way_to_the_next(spark):
    links, pools, got = linked(spark, ["milk", "peas", "honey"], rejected=[("milk", "m4"), ("milk", "m1"), ("honey", "h1"), ("honey", "h2")])
    assert got == {"milk": ("matched", "m2", 4), "peas": ("matched", "p1", 2), "honey": ("unavailable", None, 2)}
    best = sorted((r.name, r.rank, r.code) for r in link.name_candidates(links, pools, keep=2).collect())
    assert best == [("honey", 1, "h2"), ("honey", 2, "h1"), ("milk", 1, "m4"), ("milk", 2, "m1"), ("peas", 1, "p1"), ("peas", 2, "p2")]


def test_requested_meat_and_permitted_brands(spark):
    from larder.functions.policy import CHICKEN_BRANDS, MEAT_BRANDS

    chicken, meat = sorted(CHICKEN_BRANDS)[0], sorted(MEAT_BRANDS)[0]
    goods = [("c1", "Kycklingfilé", "kott", chicken, 900.0), ("c2", "Kycklingfilé", "kott", "okand", 100.0), ("b1", "Nötfärs", "kott", meat, 700.0), ("b2", "Nötfärs", "kott", "okand", 10.0), ("b3", "Kycklingfärs", "kott", chicken, 5.0)]
    _, pools, got = linked(spark, ["chicken breast", "ground beef"], goods)
    assert got == {"chicken breast": ("matched", "b3", 2), "ground beef": ("matched", "b1", 1)}
    assert {r.code for r in pools.products.collect()} == {"c1", "b1", "b3"}


def test_line_costs(spark):
    lines = spark.createDataFrame(
        [("flour", "g", "500", False, None, None), ("flour", "cup", "1", False, None, 120.0), ("oil", "ml", "100", False, None, None), ("egg", "count", "3", False, None, None), ("beans", "g", "100", False, None, None),
         ("flour", "pinch", "1", False, None, None), ("none", "g", "1", False, None, None), ("water", "g", "1", False, None, None), ("old", "g", "1", False, None, None), ("flour", "g", "1 1/2", True, None, None), ("egg", "g", "5", False, None, None)],
        "name string, unit string, measured_quantity string, quantity_conflict boolean, servings double, grams_per_unit double").withColumn("requested_servings", F.lit(None).cast("double"))
    links = spark.createDataFrame([("flour", "matched", "f"), ("oil", "matched", "o"), ("egg", "matched", "e"), ("beans", "matched", "b"), ("water", "non_purchased", None), ("old", "matched", "x")], "name string, status string, code string")
    pack = "struct<quantity:double,unit:string,drained_grams:double,approximate:boolean>"
    at, week_ago = dt.datetime(2026, 10, 14, 11), dt.datetime(2026, 10, 7, 11)
    rows = [("f", 2000, "kr/st", (1000.0, "g", None, False), at), ("o", 5000, "kr/l", None, at), ("e", 3000, "kr/förp", (6.0, "piece", None, False), at), ("b", 900, "kr/st", (400.0, "g", 240.0, False), at), ("x", 100, "kr/kg", None, week_ago)]
    goods = spark.createDataFrame(rows, f"code string, price_ore bigint, price_unit string, pack {pack}, observed_at timestamp_ntz").withColumn("deposit_ore", F.lit(0).cast("bigint")).withColumn(
        "available", F.lit(True)).withColumn("expires_at", cal.week_end(F.col("observed_at")))
    got = [(x.name, x.status, None if x.cost is None else float(x.cost), x.reason, x.amount_approximate) for x in q.cost_lines(lines, links, goods, F.lit(NOW).cast("timestamp_ntz")).collect()]
    assert sorted(got, key=str) == sorted([
        ("flour", "priced", 1000.0, None, False), ("flour", "priced", 240.0, None, True), ("oil", "priced", 500.0, None, False), ("egg", "priced", 1500.0, None, False),
        ("beans", "unresolved", None, "drained_weight_basis_requires_review", False), ("flour", "unresolved", None, "unit_conversion_unknown", False),
        ("none", "unresolved", None, "ingredient_connection_unavailable", False), ("water", "not_purchased", 0.0, None, False), ("old", "unresolved", None, "product_unavailable_or_stale", False),
        ("flour", "unresolved", None, "conflicting_source_quantity", False), ("egg", "unresolved", None, "package_or_unit_conversion_unknown", False)], key=str)


def test_reference_amounts_need_an_explicit_size(spark):
    lines = spark.createDataFrame([("Small Onion", "count"), ("onion", "count"), ("Honey", "Tbsp."), ("honey", "jar")], "name string, unit string")
    aliases = spark.createDataFrame([("small onion", 1), ("onion", 1), ("honey", 2)], "alias string, food_id int")
    measures = spark.createDataFrame([(1, "count", "small", 70.0), (2, "tablespoon", None, 21.0)], "food_id int, unit string, size string, grams_per_unit double")
    got = {(x.name, x.unit): x.grams_per_unit for x in q.reference_amounts(lines, aliases, measures).collect()}
    assert got == {("Small Onion", "count"): 70.0, ("onion", "count"): None, ("Honey", "Tbsp."): 21.0, ("honey", "jar"): None}


def test_strict_filter_never_accepts_unknown(spark):
    rows = [(1, "diet", "vegan", "yes"), (1, "allergen", "nuts", "no"), (1, "cuisine", "thai", "yes"), (2, "diet", "vegan", "unknown"), (2, "allergen", "nuts", "no"), (2, "cuisine", "thai", "yes"),
            (3, "diet", "vegan", "yes"), (3, "allergen", "nuts", "unknown"), (3, "cuisine", "greek", "yes"), (4, "diet", "vegan", "yes"), (4, "allergen", "nuts", "no"), (4, "cuisine", "greek", "yes"), (5, "diet", "vegan", "yes")]
    table = spark.createDataFrame(rows, "recipe_id bigint, domain string, key string, state string")
    wanted = [r.Wanted("diet", "vegan"), r.Wanted("allergen", "nuts"), r.Wanted("cuisine", "thai"), r.Wanted("cuisine", "greek")]
    assert {x.recipe_id for x in r.strict_filter(table, wanted).collect()} == {1, 4}


def test_filter_sets_are_chunked_and_complete(spark):
    table = spark.range(3000).select(F.lit(7).alias("filter_id"), F.lit("yes").alias("state"), F.col("id").alias("recipe_id"))
    sets = r.filter_sets(table)
    assert {(x.state, x.chunk, len(x.recipe_ids)) for x in sets.collect()} == {("yes", 0, 1024), ("yes", 1, 1024), ("yes", 2, 952), ("no", 0, 0), ("unknown", 0, 0)}
    assert r.set_members(sets, F.lit(7), "yes").distinct().count() == 3000


def test_nutrient_fit(spark):
    rows = [(1, 2.0, 500.0, 0, 25.0, 1.0), (2, 2.0, 500.0, 0, 10.0, 1.0), (3, 2.0, 500.0, 1, 40.0, 1.0), (4, 2.0, 500.0, 0, None, 1.0), (5, None, 500.0, 0, 90.0, 1.0), (6, 2.0, 0.0, 0, 90.0, 1.0)]
    table = spark.createDataFrame(rows, "recipe_id bigint, servings double, calories double, unresolved int, protein double, sodium double")
    profile = r.Profile(1, 2000.0, {"protein": r.Target(low=100.0), "sodium": r.Target(high=2.0)}, ("protein", "sodium"))
    ranked = r.rank_recipes(r.nutrient_fit(table, [profile]), 10).orderBy("position").collect()
    assert [x.recipe_id for x in ranked] == [1, 2, 3]
    assert ranked[1].score == (100 - 40) / 100 * (100 - 40) / 100 + ((4 - 2) / 2) ** 2 and ranked[2].density == 160 / 100


def test_title_search_equals_contains(spark):
    titles = [(i, t) for i, t in enumerate(["Tomato soup", "tom yum", "ÄPPLE pie", "a.b", "pie", "x", "soup of tomatoes", ""])]
    df = spark.createDataFrame(titles, "id int, title string")
    queries = {1: "tom", 2: "PIE", 3: "a.b", 4: "äp", 5: "x", 6: "tomato soup", 7: "zzz"}
    got = {(x.query_id, x.id) for x in r.title_search(df, "id", "title", queries).collect()}
    assert got == {(k, i) for k, s in queries.items() for i, t in titles if s.lower() in t.lower()}
    stored = r.gram_index(df, "id", "title")
    assert r.index_differences(df, stored, "id", "title").count() == 0


def test_connection_health_picks(spark):
    connections = spark.createDataFrame([("a", "a", "matched", "1"), ("b", "b", "matched", "1"), ("c", "c", "matched", "1"), ("d", "d", "matched", "1"), ("e", "e", "non_purchased", None)],
                                        "ingredient_id string, name string, status string, main_product_id string")
    usable = spark.createDataFrame([("a", "1", "g", 3.0), ("a", "2", "g", 2.0), ("b", "1", "g", 3.0), ("b", "2", "ml", 1.0)], "ingredient_id string, product_id string, unit string, unit_cost double")
    changed = spark.createDataFrame([("c",)], "ingredient_id string")
    got = {x.ingredient_id: (x.health, x.product_id) for x in rt.connection_health(connections, usable, changed).collect()}
    assert got == {"a": ("matched", "2"), "b": ("matched", "1"), "c": ("needs_review", None), "d": ("unavailable", None), "e": ("non_purchased", None)}


def test_decisions_fold_in_event_order(spark):
    rows = [("n", "1", "approve", 1), ("n", "2", "approve", 2), ("n", None, "clear", 3), ("n", "1", "reject", 4), ("n", "1", "approve", 5), ("n", "3", "reject", 6), ("m", "1", "approve", 1)]
    events = spark.createDataFrame([(n, c, a, t, t) for n, c, a, t in rows], "name string, code string, action string, ts int, event_id int")
    assert {(x.name, x.code, x.action) for x in rv.fold_decisions(events).collect()} == {("n", "1", "approve"), ("n", "3", "reject"), ("m", "1", "approve")}


def test_connection_set_rules(spark):
    schema = "ingredient_id string, name string, status string, policy_version string, reviewed_at string, main_product_id string, approved array<struct<product_id:string,identity:string>>"
    rows = [("a", "a", "matched", POLICY_VERSION, "t", "1", [("1", "I1")]), ("b", "water", "non_purchased", POLICY_VERSION, "t", None, []), ("c", "milk", "non_purchased", POLICY_VERSION, "t", None, []),
            ("d", "d", "matched", POLICY_VERSION, "t", "1", [("1", "old")]), ("e", "e", "matched", "other", "t", "9", [("1", "I1")]), ("f", "a", "unavailable", POLICY_VERSION, "t", None, [])]
    goods = spark.createDataFrame([("1", "I1", None)], "product_id string, identity string, policy_reason string")
    got = {(x.ingredient_id, x.violation) for x in rt.connection_violations(spark.createDataFrame(rows, schema), goods, F.lit(None).cast("string")).collect()}
    assert got == {("a", "invalid_connection_inventory"), ("f", "invalid_connection_inventory"), ("c", "non_purchased_requires_water"), ("d", "connection_product_not_permitted"),
                   ("e", "invalid_connection_review"), ("e", "invalid_approved_products")}


def test_documents_split_huge_parents(spark):
    children = spark.range(2500).select(F.when(F.col("id") < 2490, "hot").otherwise("small").alias("doc"), F.col("id").alias("idx"))
    parts = corpus.nest_children(children, "doc", ["idx"], [], F.col("idx"))
    counted = corpus.nest_children(children, "doc", ["idx"], [], bucket=F.floor(F.col("idx") / 100))
    assert {(x.doc, x.part, len(x["items"])) for x in counted.collect()} == {("hot", 0, 1000), ("hot", 1, 1000), ("hot", 2, 490), ("small", 0, 10)}
    assert {(x.doc, x.part, len(x["items"])) for x in parts.collect()} == {("hot", 0, 1000), ("hot", 1, 1000), ("hot", 2, 490), ("small", 2, 10)}


def test_conversions_agree_or_are_withheld(spark):
    rows = [(1, "cup", "", 1.0, 200.0), (1, "cup", "", 0.5, 90.0), (2, "cup", "", 0.5, 40.0), (2, "cup", "", 0.25, 20.0), (3, "cup", "", 1.0, 10.0), (3, "cup", "", 1.0, 11.0), (4, "count", "small", 1.0, 70.0)]
    table = corpus.conversion_table(spark.createDataFrame(rows, "food_id int, unit string, size string, basis double, grams double"))
    assert {(x.food_id, x.unit, x.size, x.grams_per_unit) for x in table.collect()} == {(1, "cup", "", 200.0), (2, "cup", "", 80.0), (4, "count", "small", 70.0)}
    measures = spark.createDataFrame([("1 cup", ""), ("cup, chopped", ""), ("", "tbsp"), ("stalk, large (11 inch)", ""), ("medium", ""), ("TSP", "")], "m string, u string")
    got = [None if x[0] is None else tuple(x[0]) for x in measures.select(corpus.portion_measure(F.col("m"), F.col("u"))).collect()]
    assert got == [("cup", ""), None, ("tablespoon", ""), ("count", "large"), ("count", "medium"), ("teaspoon", "")]
