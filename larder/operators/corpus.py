"""Recipe documents, conversion tables and release checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import name_key
from .batching import with_position
from .versions import table_differences

#: Children of one document are nested in parts of this many rows.
PART_WIDTH = 1000


def nest_children(children: DataFrame, parent: str, order: Sequence[str], fields: Sequence[str], index: Column | None = None,
                  bucket: Column | None = None, width: int = PART_WIDTH) -> DataFrame:
    """(parent, part, items): children of each parent in order, at most ``width`` per row.

    ``index`` is the child's position where the source has one; otherwise positions are counted over
    ``bucket``, which must not decrease along ``order``.  Ordinary documents have one part.  A
    parent with a huge number of children gets many parts in many tasks and is never gathered.
    """
    if index is None:
        children = with_position(children, [F.col(c).asc() for c in order], bucket, [parent], out="__position")
        index = F.col("__position") - 1
    part = F.floor(index / width).cast("int")
    item = F.struct(*order, *[f for f in fields if f not in order])
    return children.groupBy(F.col(parent), part.alias("part")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def assemble_documents(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Parents with each nested child list attached whole: all parts, in order.

    A document is one row, so its children end up together; work on very long child lists belongs
    on the parts of ``nest_children``.
    """
    out = parents
    for name, nested in children.items():
        parts = F.array_sort(F.collect_list(F.struct("part", "items")))
        whole = nested.groupBy(key).agg(F.flatten(F.transform(parts, lambda p: p["items"])).alias(name))
        out = out.join(whole, key, "left")
    return out


def release_differences(documents: DataFrame, key: str, array: str, source: DataFrame) -> DataFrame:
    """Parity after nesting: explode a nested list and compare it with its source rows both ways."""
    rows = documents.select(key, F.explode(array).alias("__i")).select(key, "__i.*")
    return table_differences(rows.select(*source.columns), source)


#: Portion descriptors accepted as unqualified measures (fixed values).
VOLUME_DESCRIPTORS = {"cup": ("cup", "cups"), "tablespoon": ("tbsp", "tablespoon", "tablespoons"), "teaspoon": ("tsp", "teaspoon", "teaspoons")}


def portion_measure(modifier: Column, unit_name: Column) -> Column:
    """struct(unit, size) of a food portion, or NULL when it is qualified or unknown."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(modifier, F.lit("")))), r"\s+", " ")
    text = F.trim(F.regexp_replace(text, "^1 ", ""))
    text = F.when(text == "", F.trim(F.lower(F.coalesce(unit_name, F.lit(""))))).otherwise(text)
    size = F.regexp_extract(text, r"^(?:stalk, *)?(small|medium|large)\b", 1)
    picked = F.when(size != "", F.struct(F.lit("count").alias("unit"), size.alias("size")))
    for unit, words in VOLUME_DESCRIPTORS.items():
        picked = F.when(text.isin(*words), F.struct(F.lit(unit).alias("unit"), F.lit("").alias("size"))).otherwise(picked)
    return picked


def conversion_table(portions: DataFrame) -> DataFrame:
    """Grams per unit on which every supporting portion agrees.

    portions (food_id, unit, size, basis, grams).  Direct one-unit portions are preferred for
    volumes; foods whose portions disagree are withheld.  Agreement is min = max, so nothing is listed.
    """
    per = F.round(F.col("grams") / F.col("basis"), 5)
    valid = portions.filter((F.col("basis") > 0) & (F.col("grams") > 0)).withColumn("__g", per)
    direct = (F.col("basis") == 1) & (F.col("unit") != "count")
    agg = valid.groupBy("food_id", "unit", "size").agg(
        F.min(F.when(direct, F.col("__g"))).alias("d0"), F.max(F.when(direct, F.col("__g"))).alias("d1"), F.count_if(direct).alias("dn"),
        F.min("__g").alias("a0"), F.max("__g").alias("a1"), F.count(F.lit(1)).alias("an"))
    use = F.col("dn") > 0
    low, high = F.when(use, F.col("d0")).otherwise(F.col("a0")), F.when(use, F.col("d1")).otherwise(F.col("a1"))
    return agg.filter(low == high).select("food_id", "unit", "size", low.alias("grams_per_unit"),
                                          F.when(use, F.col("dn")).otherwise(F.col("an")).alias("support"))


def conversion_coverage(inventory: DataFrame, aliases: DataFrame, table: DataFrame) -> DataFrame:
    """Mapped names and occurrences of an inventory."""
    foods = table.select("food_id").distinct()
    mapped = aliases.join(foods, "food_id", "left_semi").select(F.col("alias").alias("__k"), F.lit(True).alias("__m")).distinct()
    rows = inventory.withColumn("__k", name_key(F.col("name"))).join(mapped, "__k", "left")
    return rows.agg(F.count(F.lit(1)).alias("names"), F.sum("occurrences").alias("occurrences"),
                    F.count_if("__m").alias("mapped_names"), F.coalesce(F.sum(F.when(F.col("__m"), F.col("occurrences"))), F.lit(0)).alias("mapped_occurrences"))


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Aliases claimed by more than one food."""
    return aliases.select(name_key(F.col("alias")).alias("alias"), "food_id").groupBy("alias").agg(
        F.min("food_id").alias("a"), F.max("food_id").alias("b")).filter("a <> b").select("alias")


def record_violation(doc_hash: Column, body: Column, doc_id: Column, record_id: Column, state: Column, units_known: Column,
                     policy_reason: Column, names_agree: Column, size_limit: int = 1_900_000) -> Column:
    """First reason a release record must not be loaded, or NULL."""
    return F.coalesce(
        F.when((F.sha2(body, 256) != doc_hash) | (F.octet_length(body) > size_limit) | (record_id < 1), F.lit("invalid_recipe_document")),
        F.when(doc_id != record_id, F.lit("recipe_id_mismatch")),
        F.when((state != "consistent") | ~units_known | policy_reason.isNotNull() | ~names_agree, F.lit("ingredient_quality_or_policy")))


def part_violations(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Declared count, first and last id of each part against its rows."""
    actual = records.groupBy("part").agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("__lo"), F.max("id").alias("__hi"))
    joined = manifest.join(actual, "part", "full_outer")
    same = (F.col("rows").eqNullSafe(F.col("__n")) & F.col("first_id").eqNullSafe(F.col("__lo")) & F.col("last_id").eqNullSafe(F.col("__hi")))
    return joined.filter(~same).select("part", F.lit("recipe_part_count_or_order_mismatch").alias("violation"))
