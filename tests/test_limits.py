"""Nothing is dropped at a size limit, and answers that SQL alone would not question."""

import pytest

from larder.operators import basket, corpus, linking, review
from larder.operators import recipes as r
from larder.sources import feeds, tables


def test_documents_keep_all_children(spark):
    children = spark.range(2500).selectExpr("1L AS recipe_id", "id AS position", "id * 2 AS value")
    from pyspark.sql import functions as F

    nested = corpus.nest_children(children, "recipe_id", ["position"], ["value"], F.col("position"))
    assert nested.count() == 3
    documents = corpus.assemble_documents(spark.sql("SELECT 1L AS recipe_id UNION ALL SELECT 2L"), "recipe_id", {"ingredients": nested, "reviews": nested})
    row = documents.filter("recipe_id = 1").first()
    assert [i["position"] for i in row.ingredients] == list(range(2500))
    totals = r.nested_totals(documents.na.fill({}).withColumn("ingredients", F.coalesce("ingredients", F.array())).withColumn("reviews", F.coalesce("reviews", F.array()))).first()
    assert (totals.recipes, totals.ingredients, totals.reviews) == (2, 2500, 2500)


def test_long_aliases_are_found_inside_names(spark):
    alias = "one two three four five six seven"
    aliases = spark.createDataFrame([(alias, "rule", "exact", False, None, 1)], "alias string, rule_id string, basis string, ambiguous boolean, form string, rule_order int")
    names = spark.createDataFrame([(f"big {alias} pack",), ("other",)], "name string")
    got = {x.name: x.alias for x in linking.link_aliases(names, aliases).collect()}
    assert got == {f"big {alias} pack": alias, "other": None}


@pytest.mark.parametrize("name, want", [("1.5% milk", "1.5%"), ("milk 3%", "3%"), ("milk", "")])
def test_percentage_keeps_its_decimals(spark, name, want):
    aliases = spark.createDataFrame([("milk", "milk", "exact", False, None, 1)], "alias string, rule_id string, basis string, ambiguous boolean, form string, rule_order int")
    assert linking.link_aliases(spark.createDataFrame([(name,)], "name string"), aliases).first().signature == want


def test_closure_of_a_deep_tree(spark):
    edges = spark.range(110).selectExpr("id AS parent", "id + 1 AS child")
    closure = feeds.category_closure(edges)
    assert closure.filter("root = 0").count() == 110 and closure.filter("cyclic").count() == 0


def test_progress_counts_open_ranges_only(spark):
    parts = spark.createDataFrame([(0, 10, 1, 10, False), (1, 10, 11, 20, True), (2, 10, 21, 30, False)], "part int, rows long, first_id long, last_id long, finished boolean")
    assert tables.load_progress(parts, spark.range(11, 21).toDF("id"), "id").first().loaded == 10
    assert tables.load_progress(parts, spark.range(5, 25).toDF("id"), "id").first().loaded == 20
    assert tables.load_progress(parts.filter("finished"), spark.range(5, 25).toDF("id"), "id").first().loaded == 10


def test_category_families(spark):
    labels = {
        "Frukt & grönsaker > Grönsaker > Gurka": {"frukt"}, "Kött, fågel & chark > Kyckling & fågel": {"kott"}, "Skafferi": {"skafferi"}, "Kött & fiskkonserver > Tonfisk": {"fisk"},
        "Kött & fiskkonserver > Kyckling": {"kott"}, "Läsk": set(), "Övrigt": set()}
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(x,) for x in labels], "label string")
    for row in frame.select("label", review.category_families(F.col("label")).alias("families")).collect():
        assert set(row.families) - {row.label, row.label.replace("Kött & fiskkonserver", "fiskkonserver")} == labels[row.label]
        assert bool(row.families) == bool(labels[row.label])


def test_a_menu_with_an_open_need_has_no_estimate(spark):
    options = spark.createDataFrame(
        [(1, "a", "piece", 2.0, 10, "pack", 100, 0, 1.0), (2, "a", "piece", 3.0, 10, "pack", 100, 0, 1.0)],
        "menu_id int, ingredient_id string, unit string, quantity double, product_id long, basis string, amount_ore long, deposit_ore long, pack_quantity double")
    needs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "menu_id int, ingredient_id string")
    assert {x.menu_id: x.reference_ore for x in basket.reference_estimate(options, needs).collect()} == {1: None, 2: 300, 3: None}
