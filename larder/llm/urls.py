"""URL filter: rules first, then a ratio of two character language models.

The models are variable-order Markov chains over a fixed alphabet of 41 signs, up to three signs of context, smoothed by
mixing every order with the next shorter one (Witten-Bell): one learns from URLs that a rule accepts, one from those that a
rule rejects.  A URL's score is the mean, over its signs, of the difference of their log probabilities, in whole
millionths, so sums do not depend on task order.  The threshold comes from three sixteenths of the ruled URLs, which the models have not seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .registry import query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every URL sign becomes a lower-case letter, 0 (any digit), one of the marks below, or *; ^ stands before the first sign.
MARKS = ":/.-_?=&%#+~"
SIGNS = 26 + 1 + len(MARKS) + 2
ORDER = 3
#: URLs whose MD5 starts with a hex digit below this one calibrate and do not teach (three sixteenths).
HELD = "3"
#: Width of a calibration step in millionths, and the steps kept on either side of 0.
STEP, STEPS = 20_000, 400

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: Sequence[tuple[str, str, str]], host: Column, path: Column, of) -> Column:
    """``of(rule)`` for the longest rule that fits; the earlier one in a tie; null if none fits.  Rules are a short job parameter."""
    chain = F
    for rule in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        chain = chain.when(fits, F.lit(of(rule)))
    return chain.otherwise(F.lit(None).cast("string")) if chain is not F else F.lit(None).cast("string")


def signs(url: Column) -> Column:
    folded = F.translate(F.coalesce(url, F.lit("")), UPPER + "123456789", LOWER + "0" * 9)
    return F.regexp_replace(folded, "[^a-z0" + "".join("\\" + m for m in MARKS) + "]", "*")


def _windows(rows: DataFrame, *keep: str) -> DataFrame:
    """A row per sign, with the signs before it: ``gram`` of ORDER + 1 signs."""
    placed = rows.select(*keep, F.concat(F.lit("^" * ORDER), "signs").alias("s"), F.explode(F.sequence(F.lit(1), F.col("length"))).alias("i"))
    return placed.select(*keep, F.substring(F.col("s"), F.col("i"), F.lit(ORDER + 1)).alias("gram"))


def charges(grams: DataFrame) -> DataFrame:
    """(gram, ratio): accepted over rejected log probability of the last sign, in millionths; input is (gram, yes, no) counts.

    All tables are bounded by the alphabet: SIGNS ** 4 rows at most.
    """
    below = None
    for order in range(ORDER + 1):
        level = grams.groupBy(F.expr(f"right(gram, {order + 1})").alias("g")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        context = Window.partitionBy(F.expr(f"left(g, {order})"))
        shorter = None if below is None else below.select(F.col("g").alias("__s"), *(F.col(f"p_{c}").alias(f"q_{c}") for c in ("yes", "no")))
        if shorter is not None:
            level = level.join(shorter, F.expr(f"right(g, {order})") == F.col("__s")).drop("__s")
        for c in ("yes", "no"):
            total, kinds = F.sum(c).over(context), F.sum((F.col(c) > 0).cast("long")).over(context)
            if shorter is None:
                p = (F.col(c) + 1) / (total + SIGNS)
            else:
                p = F.when(total > 0, (F.col(c) + kinds * F.col(f"q_{c}")) / (total + kinds)).otherwise(F.col(f"q_{c}"))
            level = level.withColumn(f"p_{c}", p)
        below = level
    return below.select(F.col("g").alias("gram"), F.round((F.log("p_yes") - F.log("p_no")) * 1e6).cast("long").alias("ratio"))


def threshold(ruled: DataFrame) -> int:
    """The calibration step from which URLs are accepted: least sum of both error rates on (step, accepted); then nearest 0, then lower.

    0 where one of the kinds is missing.  At most 2 * STEPS + 1 rows are compared.
    """
    steps = ruled.groupBy("step").agg(F.sum(F.col("accepted").cast("long")).alias("yes"), F.sum((~F.col("accepted")).cast("long")).alias("no"))
    everything, before = Window.partitionBy(), Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    below = steps.withColumn("yes_below", F.coalesce(F.sum("yes").over(before), F.lit(0))).withColumn("no_below", F.coalesce(F.sum("no").over(before), F.lit(0)))
    below = below.withColumn("all_yes", F.sum("yes").over(everything)).withColumn("all_no", F.sum("no").over(everything))
    wrong = F.col("yes_below") * F.col("all_no") + (F.col("all_no") - F.col("no_below")) * F.col("all_yes")
    # Between two steps that occur every threshold errs alike: take the one nearest 0.
    before_it = F.coalesce(F.lag("step").over(Window.orderBy("step")), F.lit(-STEPS - 1))
    below = below.withColumn("limit", F.least(F.greatest(F.lit(0), before_it + 1), "step"))
    best = below.filter("all_yes > 0 AND all_no > 0").agg(F.min(F.struct(wrong, F.abs("limit"), "limit")).alias("best")).first()["best"]
    return 0 if best is None else best["limit"]


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and ``step``, the calibrated score in steps of 0.02.

    A null URL is empty: no host, no path, score 0.  URLs of any length are read whole.  Repeated rows are judged
    alike, each counting in the models.  Without accepted or without rejected URLs the ratio still
    stands, against an even model, and the threshold is 0.  No input gives no rows; other columns are not read.
    ``pages`` must be a table (stable row order).
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.monotonically_increasing_id().alias("__row"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("signs", signs(F.col("url")))
    host, path = F.col("host"), F.col("path")
    rows = rows.withColumn("rule", longest_rule(rules, host, path, lambda r: r[1] + r[2])).withColumn("ruled", longest_rule(rules, host, path, lambda r: r[0]))
    rows = rows.withColumn("length", F.length("signs")).withColumn("held", F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 1) < HELD)
    rows = cut_lineage(rows.drop("url"))
    some = rows.filter("length > 0")
    teaches = lambda verdict: F.sum(((F.col("ruled") == verdict) & ~F.col("held")).cast("long"))
    grams = _windows(some, "ruled", "held").groupBy("gram").agg(*(F.coalesce(teaches(v), F.lit(0)).alias(c) for v, c in (("allow", "yes"), ("block", "no"))))
    table_ = cut_lineage(charges(grams))
    # At most SIGNS ** 4 rows (2.8 million, 30 MB) whatever the pages are, hence the broadcast.
    sums = _windows(some, "__row").join(F.broadcast(table_), "gram").groupBy("__row").agg(F.sum("ratio").alias("sum"))
    scored = rows.join(sums, "__row", "left")
    step = F.floor(F.coalesce("sum", F.lit(0)) / (F.greatest("length", F.lit(1)) * STEP))
    scored = cut_lineage(scored.withColumn("step", F.least(F.greatest(step, F.lit(-STEPS)), F.lit(STEPS)).cast("int")).drop("signs", "sum"))
    limit = threshold(scored.filter("held AND ruled IS NOT NULL").select("step", (F.col("ruled") == "allow").alias("accepted")))
    verdict = F.coalesce("ruled", F.when(F.col("step") >= limit, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "step")


def _oracle() -> str:
    """The same in SQL for DuckDB, with the rules of the query."""
    parts = []
    for kind, value in (("rule", lambda r: r[1] + r[2]), ("ruled", lambda r: r[0])):
        cases = " ".join(
            f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{value(r)}'" for r in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
        parts.append(f"CASE {cases} END AS {kind}")
    levels = []
    for k in range(ORDER + 1):
        join = f"JOIN p{k - 1} q ON right(l.g, {k}) = q.g" if k else ""
        cols = []
        for c in ("yes", "no"):
            total, kinds = f"sum(l.{c}) OVER w", f"sum((l.{c} > 0)::BIGINT) OVER w"
            if k:
                cols.append(f"CASE WHEN {total} > 0 THEN (l.{c} + {kinds} * q.p_{c}) / ({total} + {kinds}) ELSE q.p_{c} END AS p_{c}")
            else:
                cols.append(f"(l.{c} + 1) / ({total} + {SIGNS}) AS p_{c}")
        levels.append(f"""l{k} AS (SELECT right(gram, {k + 1}) AS g, sum(yes)::BIGINT AS yes, sum(no)::BIGINT AS no FROM g GROUP BY 1),
p{k} AS (SELECT l.g, {', '.join(cols)} FROM l{k} l {join} WINDOW w AS (PARTITION BY left(l.g, {k})))""")
    marks = "".join("\\" + m for m in MARKS)
    return f"""
WITH u AS (
  SELECT page_id, url, row_number() OVER () AS r, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(translate(coalesce(url, ''), '{UPPER}123456789', '{LOWER}000000000'), '[^a-z0{marks}]', '*', 'g') AS signs,
         coalesce(url, '') AS whole
  FROM pages),
v AS (SELECT *, {', '.join(parts)}, length(signs) AS n FROM u),
h AS (SELECT *, substr(md5(whole), 1, 1) < '{HELD}' AS held FROM v),
x AS (SELECT r, ruled, held, substr('^^^' || signs, i::INTEGER, 4) AS gram FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM h WHERE n > 0)),
g AS (SELECT gram, coalesce(sum((ruled = 'allow' AND NOT held)::BIGINT), 0) AS yes, coalesce(sum((ruled = 'block' AND NOT held)::BIGINT), 0) AS no FROM x GROUP BY gram),
{', '.join(levels)},
c AS (SELECT g AS gram, round((ln(p_yes) - ln(p_no)) * 1e6)::BIGINT AS ratio FROM p{ORDER}),
s AS (SELECT r, sum(ratio) AS total FROM x JOIN c USING (gram) GROUP BY r),
z AS (SELECT h.*, least(greatest(floor(coalesce(total, 0)::DOUBLE / (greatest(n, 1) * {STEP})), -{STEPS}), {STEPS})::INTEGER AS step FROM h LEFT JOIN s USING (r)),
b AS (SELECT step, sum((ruled = 'allow')::BIGINT) AS yes, sum((ruled = 'block')::BIGINT) AS no FROM z WHERE held AND ruled IS NOT NULL GROUP BY step),
t AS (SELECT step, coalesce(sum(yes) OVER o, 0) AS yes_below, coalesce(sum(no) OVER o, 0) AS no_below, sum(yes) OVER () AS all_yes, sum(no) OVER () AS all_no,
             least(greatest(0, coalesce(lag(step) OVER (ORDER BY step), -{STEPS} - 1) + 1), step) AS lim
      FROM b WINDOW o AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT coalesce((SELECT lim FROM t WHERE all_yes > 0 AND all_no > 0 ORDER BY yes_below * all_no + (all_no - no_below) * all_yes, abs(lim), lim LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN step >= (SELECT least FROM m) THEN 'allow' ELSE 'block' END) AS verdict, step
FROM z
"""


@query("op5_url_models", _oracle())
def op5_url_models(spark, folder):
    return judge(table(spark, folder, "pages"))
