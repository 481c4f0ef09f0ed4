"""Mixing sources to target weights by weighted sampling without replacement.

Each document draws an exponential key whose rate is its quality weight (Efraimidis and Spirakis);
along the keys a source is a weighted random order.  A source first gives as many complete
epochs as its target holds, then the head of that order, up to the rest of the target: the
document at the edge gives only its first words, so the words taken meet the target exactly.
Prefix sums run inside buckets of about equal size, and only one row per bucket is summed over the
source, so a source that holds a third of all rows is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.batching import with_running_sum
from ..session import cut_lineage
from .common import NOT_WHITE, PLACE, row_name, with_place
from .registry import query, table

WEIGHTS = (5, 2, 1)
ROWS_A_BUCKET = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WHITE)), F.lit(0)).cast("long")


def quality_weight(text: Column, words: Column) -> Column:
    """1 for documents whose words (with one separator) are 4 to 9 characters on average, else 1/4."""
    mean = F.length(text) / F.nullif(words, F.lit(0))
    return F.when((mean >= 4) & (mean <= 9), 1.0).otherwise(0.25)


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Words wanted of each source; input and output have one row per source.

    Sources in code-point order, null last, take the weights in turn.  Where a share would exceed
    ``most`` times the source, it stops there and the excess goes to the others by weight, until
    none is above: with sources in the order of their limit per weight, those that stop are a prefix.
    """
    rank = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("sid", F.row_number().over(rank) - 1)
    ranked = ranked.withColumn("__w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "sid")
    all_rows = Window.partitionBy()
    total = F.sum("source_size").over(all_rows) * F.lit(float(share))
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("__level", (total - before) / left)
    free = F.when(F.col("__cap") > F.col("__level") * F.col("__w"), F.struct(F.col("__cap") / F.col("__w"), "sid", "__level"))
    levels = levels.withColumn("__common", F.min(free).over(all_rows)["__level"])
    return levels.select("source", "sid", "source_size", F.coalesce(F.least("__cap", F.col("__common") * F.col("__w")), "__cap").alias("target"), "__rows")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = 1.5,
        most: float = 2.0, seed: int = 7, quality=quality_weight, row: str | None = None) -> DataFrame:
    """Per document: size, its source's size and target, and ``taken``, the words that the mix takes (repeats counted); also ``__row``, the column ``row`` or a number of this read.

    Null or blank text has size 0 and nothing is taken.  Null is a source like any other.  A document without
    id draws its key by its text.  Rows with equal keys follow in id order; fully repeated rows are interchangeable.
    No input gives no rows; other columns are not read.
    """
    lean = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.length(F.col(text)).alias("__chars"),
        F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("__name"),
        row_name(row).alias("__row"), F.col(text).alias("__text"))
    lean = lean.withColumn("__q", quality(F.col("__text"), F.col("size")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__name")).cast("binary")), 1, 13), 16, 10).cast("long")
    lean = lean.withColumn("__key", -F.log((draw + 0.5) / float(2**52)) / F.col("__q"))
    lean = cut_lineage(lean.select("doc_id", "source", "size", "__row", "__key"))
    sizes = lean.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    targets = source_targets(sizes, weights, share, most)
    rows = lean.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    bucket = F.floor((1 - F.exp(-F.col("__key"))) * F.ceil(F.col("__rows") / ROWS_A_BUCKET))
    rows = with_running_sum(rows, F.col("size"), [F.col("__key"), F.col("doc_id"), F.col("size"), F.col("__row")], bucket, ["sid"], "__upto")
    want = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0)
    rest = want - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("__upto") - F.col("size"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "__row")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, whole and repeated as often as taken; a part counts as whole from one half on."""
    placed = with_place(docs)
    taken = mix(placed, row=PLACE, **settings).filter("taken > 0").select(F.col("__row").alias(PLACE), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("__times"))
    rows = placed.join(taken.filter("__times > 0"), PLACE)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop(PLACE, "__times", "__copy")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, length(text) AS chars,
         coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS name
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('7:' || name), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
           / (CASE WHEN size > 0 AND chars / size >= 4 AND chars / size <= 9 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid FROM k GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, sid, source_size, coalesce(least(cap, (SELECT arg_min(level, cap / w) FROM l WHERE cap > level * w) * w), cap) AS target,
  FROM l),
e AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS want,
         (sum(k.size) OVER (PARTITION BY t.sid ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS epochs FROM e)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, want - epochs * source_size - (upto - size))))::BIGINT AS taken
FROM f
"""


@query("op3_weighted_mix", SQL)
def op3_weighted_mix(spark, folder):
    return mix(table(spark, folder, "documents")).drop("source", "__row")
