import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.functions import attributes, calendar as cal, hashing, money, packs, policy, pricing, text, units


def column(spark, values, expr, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col("v")).alias("x")).collect()]


def test_money_text(spark):
    cases = {"11,27 kr": 1127, "12.90": 1290, "1 234,5 kr/kg": 123450, "39,90kr/st": 3990, "20 KR/L": 2000, "0": 0,
             "-5": None, "1.234": None, "kr": None, "": None, "12,": None, None: None}
    assert column(spark, list(cases), money.money_ore) == list(cases.values())
    assert column(spark, ["kr 12,50", "7"], money.nested_money_ore) == [1250, 700]
    assert column(spark, [19.9, 0.005, -1.0, None], money.money_number_ore, "v double") == [1990, 1, None, None]


def test_pack_labels(spark):
    cases = {
        "500g": (500.0, "g", None, False), "2x1,5l": (3000.0, "ml", None, False), "6p": (6.0, "piece", None, False), "400/240g": (400.0, "g", 240.0, False),
        "1/0.5kg": (1000.0, "g", 500.0, False), "ca: 1kg": (1000.0, "g", None, True), "6p/0,5l": (6.0, "piece", None, False), "25 cl": (250.0, "ml", None, False),
        "en burk": (None, None, None, False), "2dl": (200.0, "ml", None, False)}
    got = column(spark, list(cases), lambda c: packs.pack_label(c, F.lit("kr/st")))
    assert [tuple(r) for r in got] == list(cases.values())
    assert column(spark, ["1kg"], lambda c: packs.pack_label(c, F.lit("kr/kg")))[0]["approximate"]


def test_feed_quantities(spark):
    cases = {"1,5 kg": (1500.0, "g"), "500 mg": (0.5, "g"), "33cl": (330.0, "ml"), "2 litres": (2000.0, "ml"), "6": (6.0, "piece"), "4 pcs": (4.0, "piece"), "0 g": None, "x": None}
    got = column(spark, list(cases), packs.feed_quantity)
    assert [None if r is None else tuple(r) for r in got] == list(cases.values())


def test_quantity_text(spark):
    cases = {"3": 3.0, "1/2": 0.5, "1 1/2": 1.5, "2.25": 2.25, "0": None, "1/0": None, "to taste": None, "-1": None, "": None, None: None}
    assert column(spark, list(cases), packs.quantity_text) == list(cases.values())


def test_canonical_amounts(spark):
    rows = [("1/2", "cup", False), ("2", "lb", False), ("1", "Dozen", False), ("3", "eggs", False), ("1", "pinch", False), (None, "g", False), ("2", "g", True)]
    df = spark.createDataFrame(rows, "q string, u string, clash boolean")
    got = df.select(units.canonical_amount(F.col("q"), F.col("u"), F.col("clash"), F.lit(2.0)).alias("a")).select("a.*").collect()
    assert [tuple(r) for r in got] == [
        (236.5882365, "ml", None), (1814.36948, "g", None), (24.0, "piece", None), (6.0, "piece", None), (None, None, "unit_conversion_unknown"),
        (None, None, "quantity_unknown_or_qualitative"), (None, None, "conflicting_source_quantity")]
    over = F.struct(F.lit(5.0).alias("quantity"), F.lit("ml").alias("unit"))
    got = df.select(units.canonical_amount(F.col("q"), F.col("u"), F.col("clash"), F.lit(2.0), over)["quantity"]).collect()
    assert {r[0] for r in got} == {10.0}


def test_measure_units_keep_case(spark):
    assert column(spark, ["T", "t", "Tbsp.", "CUPS", "pcs", "jar"], units.measure_unit) == ["tablespoon", "teaspoon", "tablespoon", "cup", "count", None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_week_end_boundaries(spark, zone):
    cases = {"2026-10-11 21:59:59.999": "2026-10-11 22:00", "2026-10-11 22:00": "2026-10-18 22:00", "2026-12-31 12:00": "2027-01-03 23:00",
             "2027-01-03 23:00": "2027-01-10 23:00", "2026-03-29 21:59:59.999": "2026-03-29 22:00", "2026-10-25 22:59:59.999": "2026-10-25 23:00"}
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = column(spark, list(cases), lambda c: cal.week_end(c.cast("timestamp_ntz")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [dt.datetime.fromisoformat(v) for v in cases.values()]


def test_scan_is_current(spark):
    now = F.lit("2026-10-14 12:00:00").cast("timestamp_ntz")
    cases = {"2026-10-14 12:01:00": True, "2026-10-14 12:01:01": False, "2026-10-11 22:00:00": True, "2026-10-11 21:59:59": False, None: False}
    assert column(spark, list(cases), lambda c: cal.scan_is_current(c.cast("timestamp_ntz"), now)) == list(cases.values())


def test_fold_text(spark):
    cases = {"Crème Fraîche": "creme fraiche", "Jell-O® 2%": "jell o 2%", "Confectioners’ sugar": "confectioners sugar", "  Äpple--röd ": "apple rod", "weiß": "wei"}
    assert column(spark, list(cases), text.fold_text) == list(cases.values())
    df = spark.createDataFrame([("½ cup ﬁg",), ("plain",), ("𝐁old",), (None,)], "name string")
    got = {r["name"]: r["f"] for r in text.fold_distinct(df, "name", "f").collect()}
    assert got == {"½ cup ﬁg": "1 2 cup fig", "plain": "plain", "𝐁old": "bold", None: None}


def test_name_key_and_leftovers(spark):
    assert column(spark, [" Half & Half, ", "Egg;"], text.name_key) == ["half and half", "egg"]
    got = column(spark, ["finely chopped red onion"], lambda c: text.leftover_words(text.strip_preparation(c), F.lit("onion")))
    assert got == ["red"]


def test_policy_classifier(spark):
    cases = {
        "red wine": ("alcohol", None), "red wine vinegar": (None, None), "root beer": (None, None), "vanilla extract": ("uncertain_extract", None), "yeast extract": (None, None),
        "bacon": ("pork", None), "turkey bacon": (None, "other_meat"), "vegan bacon": (None, None), "gelatin": ("uncertain_animal_source", None), "shortening": ("uncertain_animal_source", None),
        "vegetable shortening": (None, None), "chicken broth": (None, "chicken"), "poultry seasoning": (None, None), "ground beef": (None, "red_meat"), "hamburger buns": (None, None),
        "goat cheese": (None, None), "goat": (None, "red_meat"), "crab meat": (None, None), "vegetable stock": (None, None), "stock": ("uncertain_animal_source", None),
        "blood orange": (None, None), "pear cider": ("uncertain_alcohol_source", None), "cassis": (None, None), "creme de cassis": ("alcohol", None), "gin": ("alcohol", None),
        "ginger": (None, None), "jello pudding": (None, None), "kidney beans": (None, None), "bratwurst": (None, "other_meat")}
    got = column(spark, list(cases), lambda c: policy.classify(text.fold_text(c)))
    assert {k: tuple(r) for k, r in zip(cases, got)} == cases


def test_factored_patterns_match_the_same_names(spark):
    names = ["ale", "pale", "grand marnier", "triple sec", "kirschwasser", "vin", "vinegar", "rom", "a rom b", "sirloin tip", "kalvfile", "lammkott", "steakhouse", "ribeye steak", "hot dog", "hotdogs"]
    for pattern in (policy.ALCOHOL, policy.RED_MEAT, policy.MIXED_MEAT, policy.PORK):
        assert column(spark, names, lambda c, p=pattern: c.rlike(p)) == column(spark, names, lambda c, p=pattern: c.rlike(policy.factored(p)))


def test_product_policy(spark):
    rows = [("kycklingfile", "eldorado", [], None), ("kycklingfile", "okand", [], None), ("notfars", "eldorado", [], None), ("notfars", "affco", [], None), ("farsbiff", None, ["kott chark"], None),
            ("tomat", None, [], "chicken breast"), ("kycklingfile", "affco", [], "chicken breast"), ("tomat", None, [], "beer")]
    df = spark.createDataFrame(rows, "title string, brand string, cats array<string>, asked string")
    own, asked = policy.classify(F.col("title")), policy.classify(F.col("asked"))
    plain = [r[0] for r in df.filter("asked IS NULL").select(policy.product_policy(F.col("title"), F.col("brand"), F.col("cats"), own)).collect()]
    assert plain == [None, "meat_brand_not_permitted", "meat_brand_not_permitted", None, "meat_brand_not_permitted"]
    wanted = [r[0] for r in df.filter("asked IS NOT NULL").select(policy.product_policy(F.col("title"), F.col("brand"), F.col("cats"), own, asked)).collect()]
    assert wanted == ["meat_identity_not_compatible", None, "ingredient_excluded_alcohol"]


def test_attribute_claims(spark):
    rows = [("organic milk", "Mjölk eko", [], None), ("organic milk", "Mjölk", [], None), ("frozen peas", "Ärtor", ["fryst"], None), ("dried apricots", "Aprikoser", ["frukt"], None),
            ("canned beans", "Bönor", [], 240.0), ("canned beans", "Bönor", [], None), ("2% milk", "Mjölk 2%", [], None), ("2% milk", "Mjölk 3,0%", [], None), ("red plums", "Plommon röda", [], None),
            ("red plums", "Plommon gula", [], None), ("heinz ketchup", "Ketchup", [], None), ("all purpose flour", "Vetemjöl", [], None)]
    df = spark.createDataFrame(rows, "asked string, title string, cats array<string>, drained double").withColumn("t", text.fold_text(F.col("title")))
    got = [r[0] for r in df.select(attributes.attribute_exclusion(F.col("asked"), F.col("title"), F.col("t"), F.lit(None).cast("string"), F.col("cats"), F.col("drained"))).collect()]
    assert got == [None, "organic_not_verified", None, "dry_form_incompatible", None, "preserved_beans_not_verified", None, "percentage_not_verified", None,
                   "plum_colour_not_verified", "requested_brand_not_verified", None]
    assert len(attributes.CLAIMS) == 29


def test_promotions(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    offers = [(900, "FIXED_PRICE", False, None, at(1), at(20)), (700, "FIXED_PRICE", True, None, at(1), at(20)), (600, "MULTI", False, 1, at(1), at(20)), (500, "FIXED_PRICE", False, 2, at(1), at(20)),
              (400, "FIXED_PRICE", False, 1, at(11), at(20)), (850, "FIXED_PRICE", False, 1, at(10), at(10))]
    df = spark.createDataFrame([(1000, offers), (1000, []), (None, offers)],
                               "regular bigint, offers array<struct<amount_ore:bigint,type:string,member_only:boolean,minimum:int,starts:timestamp_ntz,ends:timestamp_ntz>>")
    got = df.select(pricing.public_promotion(F.col("regular"), F.col("offers"), F.lit("2024-01-10").cast("timestamp_ntz")).alias("p")).collect()
    assert [None if r.p is None else (r.p.amount_ore, r.p.minimum) for r in got] == [(850, 1), (1000, None), None]


def test_hashes_ignore_order_and_time(spark):
    df = spark.createDataFrame([(1, ["b", "a"], {"y": "1", "price": "2"}), (1, ["a", "b"], {"price": "2", "y": "3"})], "id int, tags array<string>, src map<string,string>")
    pack = F.lit(None).cast("struct<quantity:double,unit:string,approximate:boolean,drained_grams:double>")
    same = df.select(hashing.package_identity(F.lit("1"), F.lit(None), F.lit("n"), F.lit(None), F.col("tags"), pack, F.lit(None)).alias("i"), hashing.sorted_map(hashing.pricing_map(F.col("src"))).alias("p"))
    assert same.distinct().count() == 1
    digests = [spark.range(100).repartition(n).select(F.sha2(F.col("id").cast("string"), 256).alias("h")).agg(hashing.table_digest(F.col("h"))).first()[0] for n in (1, 7)]
    assert digests[0] == digests[1]
