"""Queries over the recipe corpus: classifications, overlays, search, ranking, documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import contains_folded
from ..operators import batching, corpus, quality, recipes as r, search, versions as v
from ..session import shared_folder
from ..sources import feeds, tables
from . import mapping as m
from .registry import Tables, query

def line_band():
    """Lines are ordered by number and part; a band of parts never decreases along that order."""
    return F.struct(F.col("l_linenumber").alias("n"), F.floor(F.col("l_partkey") / 1024).alias("p"))


WANTED = (r.Wanted("diet", "status"), r.Wanted("allergen", "nuts"), r.Wanted("cuisine", "low"), r.Wanted("cuisine", "urgent"))

#: A recipe's classification rows: one diet, one allergen and five cuisines.
_CLASSES = f"""lines AS (SELECT l_orderkey AS recipe_id, {m.STATE} AS state, l_linestatus, l_linenumber FROM lineitem),
diet AS (SELECT recipe_id, CASE WHEN bool_or(state = 'yes') AND NOT bool_or(state = 'no') THEN 'yes' WHEN bool_or(state = 'no') THEN 'no' ELSE 'unknown' END AS state FROM lines GROUP BY 1),
nuts AS (SELECT recipe_id, CASE WHEN bool_or(l_linestatus = 'O') THEN 'yes' WHEN count(*) > 2 THEN 'no' ELSE 'unknown' END AS state FROM lines GROUP BY 1),
classes AS (SELECT recipe_id, 'diet' AS domain, 'status' AS key, state FROM diet UNION ALL SELECT recipe_id, 'allergen', 'nuts', state FROM nuts
  UNION ALL SELECT o_orderkey, 'cuisine', CASE o_orderpriority WHEN '5-LOW' THEN 'low' WHEN '1-URGENT' THEN 'urgent' ELSE 'other' END, 'yes' FROM orders)"""


def classifications(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("recipe_id"), m.states("l_returnflag").alias("state"), "l_linestatus")
    facts = rows.groupBy("recipe_id").agg(
        F.max(F.col("state") == "yes").alias("y"), F.max(F.col("state") == "no").alias("n"), F.max(F.col("l_linestatus") == "O").alias("o"), F.count(F.lit(1)).alias("c"))
    diet = F.when(F.col("y") & ~F.col("n"), "yes").when(F.col("n"), "no").otherwise("unknown")
    nuts = F.when(F.col("o"), "yes").when(F.col("c") > 2, "no").otherwise("unknown")
    cells = F.array(F.struct(F.lit("diet").alias("domain"), F.lit("status").alias("key"), diet.alias("state")),
                    F.struct(F.lit("allergen").alias("domain"), F.lit("nuts").alias("key"), nuts.alias("state")))
    own = facts.select("recipe_id", F.explode(cells).alias("c")).select("recipe_id", "c.*")
    cuisine = F.when(F.col("o_orderpriority") == "5-LOW", "low").when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("other")
    return own.unionByName(t.orders.select(F.col("o_orderkey").alias("recipe_id"), F.lit("cuisine").alias("domain"), cuisine.alias("key"), F.lit("yes").alias("state")))


_STRICT = """strict AS (SELECT recipe_id FROM classes WHERE domain = 'diet' AND state = 'yes' INTERSECT SELECT recipe_id FROM classes WHERE domain = 'allergen' AND state = 'no'
  INTERSECT SELECT recipe_id FROM classes WHERE domain = 'cuisine' AND key IN ('low', 'urgent') AND state = 'yes')"""


@query("strict_tristate_filter", m.sql(_CLASSES, _STRICT, body="SELECT 'recipe' AS kind, recipe_id FROM strict UNION ALL SELECT 'document', doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0"))
def strict_tristate_filter(t: Tables):
    found = r.strict_filter(classifications(t), WANTED).select(F.lit("recipe").alias("kind"), "recipe_id")
    labelled = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    state = lambda c: F.when(F.col(c) == 1, "yes").when(F.col(c) == 0, "no").otherwise("unknown")
    rows = labelled.select(F.col("doc_id").alias("recipe_id"), F.explode(F.array(
        F.struct(F.lit("diet").alias("domain"), F.lit("quality").alias("key"), state("quality").alias("state")),
        F.struct(F.lit("allergen").alias("domain"), F.lit("toxic").alias("key"), state("toxic").alias("state")))).alias("c")).select("recipe_id", "c.*")
    documents = r.strict_filter(rows, (r.Wanted("diet", "quality"), r.Wanted("allergen", "toxic")))
    return found.unionByName(documents.select(F.lit("document").alias("kind"), "recipe_id"))


@query("all_available_filter", """
SELECT o_orderkey AS recipe_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_name LIKE '%rod')
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)""")
def all_available_filter(t: Tables):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("recipe_id"), F.col("p_name").alias("name"))
    broken = t.part.filter(F.col("p_name").endswith("rod")).select(F.col("p_name").alias("name"))
    open_recipes = r.available_only(t.orders.select(F.col("o_orderkey").alias("recipe_id")), lines, broken)
    curated = t.lineitem.filter("l_quantity = 50").select(F.col("l_orderkey").alias("recipe_id"), F.lit("all").alias("slot"))
    return r.without_curated_exclusions(open_recipes, curated, "dinner")


@query("filter_sets", m.sql(_CLASSES, body="""
, axes AS (SELECT DISTINCT domain || ':' || key AS filter_id FROM classes), st(state) AS (VALUES ('yes'), ('no'), ('unknown')),
s AS (SELECT domain || ':' || key AS filter_id, state, CAST(floor(recipe_id / 1024) AS BIGINT) AS chunk, string_agg(CAST(recipe_id AS VARCHAR), ',' ORDER BY recipe_id) AS recipe_ids FROM classes GROUP BY ALL)
SELECT * FROM s UNION ALL SELECT filter_id, state, 0, '' FROM axes, st WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.filter_id = axes.filter_id AND s.state = st.state)"""))
def filter_sets(t: Tables):
    rows = classifications(t).select(F.concat_ws(":", "domain", "key").alias("filter_id"), "state", "recipe_id")
    return r.filter_sets(rows).select("filter_id", "state", "chunk", F.array_join("recipe_ids", ",").alias("recipe_ids"))


@query("overlay_merge", f"""
WITH base AS (SELECT l_orderkey AS recipe_id, l_linenumber AS filter_id, max({m.STATE}) AS state FROM lineitem GROUP BY ALL),
patch AS (SELECT l_orderkey AS recipe_id, l_linenumber + 2 AS filter_id, min({m.STATE}) AS state FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
changed AS (SELECT p.* FROM patch p LEFT JOIN base b USING (recipe_id, filter_id) WHERE b.state IS DISTINCT FROM p.state)
SELECT coalesce(b.recipe_id, c.recipe_id) AS recipe_id, coalesce(b.filter_id, c.filter_id) AS filter_id, coalesce(c.state, b.state) AS state, c.state IS NOT NULL AS patched
FROM base b FULL JOIN changed c ON b.recipe_id = c.recipe_id AND b.filter_id = c.filter_id""")
def overlay_merge(t: Tables):
    rows = t.lineitem.withColumn("state", m.states("l_returnflag"))
    base = rows.groupBy(F.col("l_orderkey").alias("recipe_id"), F.col("l_linenumber").alias("filter_id")).agg(F.max("state").alias("state"))
    patch = rows.filter("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("recipe_id"), (F.col("l_linenumber") + 2).alias("filter_id")).agg(F.min("state").alias("state"))
    changed = v.changed_rows(base, patch, ["recipe_id", "filter_id"], ["state"])
    return r.merge_overlay(base, changed, ["recipe_id", "filter_id"], ["state"])


@query("profile_overlay", """
WITH d AS (SELECT o_orderkey AS recipe_id, CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE CAST(o_custkey % 9 AS VARCHAR) END AS servings, CAST(floor(o_totalprice + 0.5) AS BIGINT) AS calories,
  CAST(o_custkey % 4 + 1 AS DOUBLE) AS recovered, CASE WHEN o_orderstatus = 'F' THEN 'RecipeYield:' || o_custkey ELSE 'guess' END AS provenance FROM orders)
SELECT recipe_id, coalesce(CASE WHEN coalesce(servings, '') = '' AND provenance LIKE 'RecipeYield:%' THEN recovered END, TRY_CAST(servings AS DOUBLE)) AS servings, calories,
  CASE WHEN coalesce(servings, '') = '' AND provenance LIKE 'RecipeYield:%' THEN provenance END AS provenance FROM d""")
def profile_overlay(t: Tables):
    servings = F.when(F.col("o_orderpriority") == "5-LOW", "").when(F.col("o_orderpriority") != "3-MEDIUM", (F.col("o_custkey") % 9).cast("string"))
    rows = t.orders.select(
        F.col("o_orderkey").alias("recipe_id"), servings.alias("raw"), F.floor(F.col("o_totalprice") + 0.5).alias("calories"),
        (F.col("o_custkey") % 4 + 1).cast("double").alias("recovered"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("RecipeYield:"), "o_custkey")).otherwise("guess").alias("source"))
    patch = rows.withColumn("p", r.recovered_servings(F.col("raw"), F.col("recovered"), F.col("source"))).filter("p IS NOT NULL").select("recipe_id", "p.*")
    base = rows.select("recipe_id", F.col("raw").try_cast("double").alias("servings"), "calories", F.lit(None).cast("string").alias("provenance"))
    return r.merge_profile(base, patch, "recipe_id", ["servings", "provenance"])


AXES = ("protein", "sodium", "fiber")
PROFILES = (
    r.Profile(1, 2000.0, {"protein": r.Target(low=60.0), "sodium": r.Target(high=2.0), "fiber": r.Target(low=1.0, high=4.0)}, AXES),
    r.Profile(2, 1500.0, {"protein": r.Target(low=10.0, high=20.0)}, ("protein",)),
    r.Profile(3, 3000.0, {"sodium": r.Target(high=0.5), "fiber": r.Target(low=0.0)}, ("sodium", "fiber")),
)

_VECTORS = """vec AS (SELECT l_orderkey AS recipe_id, CAST(max(l_linenumber) AS DOUBLE) AS servings, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS calories,
  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS protein, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS sodium,
  CASE WHEN bool_or(l_returnflag = 'R') AND bool_or(l_linestatus = 'F') THEN CAST(count(*) AS DOUBLE) END AS fiber, count(*) FILTER (l_returnflag = 'N') AS unresolved FROM lineitem GROUP BY 1)"""


def vectors(t: Tables):
    whole = lambda c, k=1: F.sum(F.round(F.col(c) * k).cast("bigint")).cast("double")
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("recipe_id")).agg(
        F.max("l_linenumber").cast("double").alias("servings"), whole("l_quantity").alias("calories"), whole("l_tax", 100).alias("protein"),
        whole("l_discount", 100).alias("sodium"), F.max(F.col("l_returnflag") == "R").alias("__r"), F.max(F.col("l_linestatus") == "F").alias("__f"),
        F.count(F.lit(1)).alias("__n"), F.count_if(F.col("l_returnflag") == "N").alias("unresolved"))
    typed = rows.withColumn("fiber", F.when(F.col("__r") & F.col("__f"), F.col("__n").cast("double"))).drop("__r", "__f", "__n")
    return r.planning_vectors(typed, ("calories", *AXES))


def _fit_sql(pid, kcal, terms, known):
    score, density = [], []
    for axis, low, high in terms:
        actual = f"({axis} / calories * {kcal}::DOUBLE)"
        if low:
            score.append(f"pow(greatest(0.0, ({low}::DOUBLE - {actual}) / {low}::DOUBLE), 2)")
            density.append(f"least(2.0, {actual} / {low}::DOUBLE)")
        if high:
            score.append(f"pow(greatest(0.0, ({actual} - {high}::DOUBLE) / {max(1.0, high)}::DOUBLE), 2)")
    return (f"SELECT {pid} AS profile_id, recipe_id, unresolved, {' + '.join(score) or '0'} AS score, {' + '.join(density) or '0'} AS density FROM vec "
            f"WHERE servings > 0 AND calories > 0 AND {' AND '.join(k + ' IS NOT NULL' for k in known)}")


_FIT = "fit AS (" + " UNION ALL ".join(
    _fit_sql(p.id, p.calories, [(a, x.low, x.high) for a, x in p.targets.items()], p.tracked) for p in PROFILES) + ")"
_RANK = "CAST(row_number() OVER (PARTITION BY profile_id ORDER BY unresolved, round(score, 9), round(density, 9) DESC, recipe_id) AS INTEGER) AS position"


@query("nutrient_fit_ranking", m.sql(_VECTORS, _FIT, body=f"""
SELECT profile_id, recipe_id, unresolved, position FROM (SELECT *, {_RANK} FROM fit) WHERE position BETWEEN 11 AND 60"""))
def nutrient_fit_ranking(t: Tables):
    return r.rank_recipes(r.nutrient_fit(vectors(t), PROFILES), limit=50, offset=10).select("profile_id", "recipe_id", "unresolved", "position")


@query("planning_candidate_search", m.sql(_CLASSES, _STRICT, _VECTORS.replace("GROUP BY 1)", "AND l_orderkey IN (SELECT recipe_id FROM strict) GROUP BY 1)").replace("FROM lineitem AND", "FROM lineitem WHERE"), _FIT, body=f"""
SELECT profile_id, recipe_id, position FROM (SELECT *, {_RANK} FROM (SELECT * FROM fit WHERE recipe_id NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name = 'old rod'))) WHERE position <= 25"""))
def planning_candidate_search(t: Tables):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("recipe_id"), F.col("p_name").alias("name"))
    broken = t.part.filter("p_name = 'old rod'").select(F.col("p_name").alias("name"))
    return r.planning_candidates(vectors(t), classifications(t), lines, PROFILES, wanted=WANTED, broken=broken, limit=25).select("profile_id", "recipe_id", "position")


@query("recipe_search", m.sql(_CLASSES, _STRICT, body="""
SELECT o_orderkey AS recipe_id, o_orderpriority AS name FROM orders JOIN strict ON recipe_id = o_orderkey
WHERE contains(lower(o_orderpriority), 'urg') AND o_orderkey > 100 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name = 'old rod') ORDER BY 1 LIMIT 21"""))
def recipe_search(t: Tables):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("recipe_id"), F.col("p_name").alias("name"))
    broken = t.part.filter("p_name = 'old rod'").select(F.col("p_name").alias("name"))
    corpus_ = t.orders.select(F.col("o_orderkey").alias("recipe_id"), F.col("o_orderpriority").alias("name"))
    return r.search_recipes(corpus_, classifications(t), lines, wanted=WANTED, broken=broken, text="Urg", after=100, limit=20)


SEARCHES = {1: "red pl", 2: " BOLT", 3: "e r", 4: "nothing here", 5: "is", 6: "q", 7: "the"}
_SEARCHES = "q(query_id, q) AS (VALUES " + ", ".join(f"({i}, '{s.strip().lower()}')" for i, s in SEARCHES.items()) + ")"


@query("trigram_search", m.sql(_SEARCHES, body="""
SELECT query_id, 'part' AS kind, p_partkey AS id FROM part, q WHERE contains(lower(p_name), q)
UNION ALL SELECT query_id, 'document', doc_id FROM documents, q WHERE contains(lower(text), q)"""))
def trigram_search(t: Tables):
    titles = t.part.select(F.struct(F.lit("part").alias("kind"), F.col("p_partkey").alias("id")).alias("key"), F.col("p_name").alias("title")).unionByName(
        t.documents.select(F.struct(F.lit("document").alias("kind"), F.col("doc_id").alias("id")).alias("key"), F.col("text").alias("title")))
    return r.title_search(titles, "key", "title", SEARCHES).select("query_id", "id.kind", "id.id")


def _search_titles(t: Tables):
    """Titles of parts and documents before and after a delta: part names turn from others' into their own, some parts are new, some rows leave."""
    key = lambda kind, id: F.struct(F.lit(kind).alias("kind"), id.alias("id")).alias("key")
    parts = t.part.select(key("part", F.col("p_partkey")), F.col("p_name").alias("title"), "p_partkey", "p_size")
    documents = t.documents.select(key("document", F.col("doc_id")), F.col("text").alias("title"))
    renamed, fresh = F.col("p_partkey") % 5 == 0, F.col("p_size") == 50
    changed = parts.filter(renamed | fresh).select("key", "title")
    before = parts.filter(renamed & ~fresh).select("key", F.reverse("title").alias("title")).unionByName(
        parts.filter("p_size = 7").select(key("part", -F.col("p_partkey")), "title"))
    kept = parts.filter(~renamed & ~fresh).select("key", "title").unionByName(documents)
    return kept, before, changed


def _stored_search(t: Tables, kinds: tuple[str, ...] = ("part", "document")):
    kept, before, changed = _search_titles(t)
    kept = kept.filter(F.col("key.kind").isin(*kinds))
    root = f"{shared_folder(t.spark)}/search-{uuid.uuid4().hex}"
    search.store_postings(kept.unionByName(before), root, "key", "title")
    search.update_postings(before, changed, root, "key", "title", 1)
    return kept.unionByName(changed), root


@query("stored_trigram_search", m.sql(_SEARCHES, body="""
SELECT query_id, 'part' AS kind, p_partkey AS id FROM part, q WHERE contains(lower(p_name), q)
UNION ALL SELECT query_id, 'document', doc_id FROM documents, q WHERE contains(lower(text), q)"""))
def stored_trigram_search(t: Tables):
    """The same search from stored postings that went through a delta."""
    titles, root = _stored_search(t)
    return search.search(titles, root, "key", "title", SEARCHES).select("query_id", "id.kind", "id.id")


@query("stored_posting_counts", """
SELECT lower(p_name)[i:i + 2] AS gram, count(DISTINCT p_partkey) AS titles FROM part, range(1, 60) r(i) WHERE i + 2 <= length(p_name) GROUP BY 1""")
def stored_posting_counts(t: Tables):
    """Titles per gram in the stored postings of the parts, after the delta."""
    _, root = _stored_search(t, ("part",))
    held = search.read_postings(t.spark, root).filter("id.kind = 'part'")
    return held.groupBy("gram").agg(F.count(F.lit(1)).alias("titles"))


@query("search_index_parity", """
SELECT p_partkey AS id, lower(p_name) AS title, CAST(CASE WHEN p_size = 50 THEN 1 ELSE 0 END AS BIGINT) AS surplus FROM part WHERE p_size = 50""")
def search_index_parity(t: Tables):
    titles = t.part.select("p_partkey", "p_name")
    index = r.gram_index(t.part.filter("p_size <> 50").select("p_partkey", "p_name"), "p_partkey", "p_name")
    return r.index_differences(titles, index, "p_partkey", "p_name")


@query("keyset_page", """
(SELECT 'code' AS kind, p_partkey AS key, p_name AS name, NULL AS occurrences FROM part WHERE p_partkey > 57 ORDER BY p_partkey LIMIT 101)
UNION ALL (SELECT 'frequency', NULL, name, n FROM (SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1) WHERE (n < 35 OR n = 35 AND name > 'cold gear') AND contains(name, 'r') ORDER BY n DESC, name LIMIT 21)
UNION ALL (SELECT 'offset', NULL, name, n FROM (SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, name LIMIT 10 OFFSET 5)
UNION ALL (SELECT 'search', p_partkey, p_name, NULL FROM part WHERE contains(lower(p_name), 'd ri') ORDER BY p_name, p_partkey LIMIT 30)""")
def keyset_page(t: Tables):
    none = F.lit(None).cast("bigint")
    page = r.keyset_page(t.part, "p_partkey", 57, 100).select(F.lit("code").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), none.alias("occurrences"))
    counts = t.part.groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("occurrences"))
    shape = lambda df, kind: df.select(F.lit(kind).alias("kind"), none.alias("key"), "name", "occurrences")
    popular = shape(r.frequency_page(counts, (35, "cold gear"), 20, text="R"), "frequency")
    shifted = shape(r.offset_page(counts, [F.col("occurrences").desc(), F.col("name").asc()], 5, 10), "offset")
    found = t.part.filter(contains_folded(F.col("p_name"), "D ri")).orderBy("p_name", "p_partkey").limit(30)
    return page.unionByName(popular).unionByName(shifted).unionByName(
        found.select(F.lit("search").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), none.alias("occurrences")))


@query("nested_slice", """
WITH d AS (SELECT conv_id, list(role || ':' || length(text) ORDER BY turn) AS items FROM conversations GROUP BY 1)
SELECT conv_id, len(items) AS total, coalesce(array_to_string(items[2:4], ','), '') AS items FROM d""")
def nested_slice(t: Tables):
    turns = t.conversations.select("conv_id", "turn", F.concat_ws(":", "role", F.length("text")).alias("item"))
    nested = corpus.nest_children(turns, "conv_id", ["turn"], ["item"], F.col("turn"))
    documents = corpus.assemble_documents(turns.select("conv_id").distinct(), "conv_id", {"items": nested})
    flat = documents.select("conv_id", F.transform("items", lambda i: i["item"]).alias("items"))
    return r.nested_slice(flat, "items", 1, 3).select("conv_id", F.col("total").cast("bigint").alias("total"), F.array_join("items", ",").alias("items"))


@query("document_assembly", """
SELECT o_orderkey AS recipe_id, CAST(CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 2 END AS DOUBLE) AS servings, count(l_orderkey) AS ingredient_count,
  coalesce(string_agg(l_linenumber || '/' || l_partkey || '/' || CAST(l_quantity AS BIGINT), ';' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice), '') AS ingredients,
  CAST(o_custkey AS BIGINT) AS calories
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def document_assembly(t: Tables):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = t.lineitem.select("l_orderkey", *order, F.col("l_partkey").cast("string").alias("ingredient_original"), F.lit("piece").alias("unit"),
                              F.col("l_quantity").cast("bigint").cast("string").alias("measured_quantity"), F.lit(None).cast("string").alias("qualitative_amount"),
                              F.lit(False).alias("quantity_conflict"))
    fields = ["ingredient_original", "unit", "measured_quantity", "qualitative_amount", "quantity_conflict"]
    nested = corpus.nest_children(lines.withColumnRenamed("l_orderkey", "recipe_id"), "recipe_id", order, fields, bucket=line_band())
    parents = t.orders.select(
        F.col("o_orderkey").alias("recipe_id"), F.struct(F.when(F.col("o_orderstatus") == "F", 4.0).otherwise(2.0).alias("servings"), F.lit(None).cast("string").alias("yield"),
                                                         F.col("o_orderpriority").alias("name")).alias("source"),
        F.struct(F.col("o_custkey").alias("nutrients")).alias("profile"))
    documents = corpus.assemble_documents(parents, "recipe_id", {"ingredients": nested})
    numbered = documents.withColumn("lines", F.transform("ingredients", lambda i: F.concat_ws("/", i["l_linenumber"], i["ingredient_original"], i["measured_quantity"])))
    narrow = r.quote_projection(documents).select("recipe_id", "servings", F.size(F.coalesce("ingredients", F.array())).cast("bigint").alias("ingredient_count"), F.col("nutrients_per_serving").alias("calories"))
    return narrow.join(numbered.select("recipe_id", F.coalesce(F.array_join("lines", ";"), F.lit("")).alias("ingredients")), "recipe_id")


@query("release_parity", """
WITH a AS (SELECT conv_id, turn, role FROM conversations), b AS (SELECT conv_id, turn, CASE WHEN turn = 0 AND conv_id % 9 = 0 THEN upper(role) ELSE role END AS role FROM conversations)
SELECT *, CAST(1 AS BIGINT) AS surplus FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, -1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def release_parity(t: Tables):
    turns = t.conversations.select("conv_id", "turn", "role")
    nested = corpus.nest_children(turns, "conv_id", ["turn"], ["role"], F.col("turn"))
    edited = F.when((F.col("turn") == 0) & (F.col("conv_id") % 9 == 0), F.upper("role")).otherwise(F.col("role"))
    return corpus.release_differences(nested, "conv_id", "items", turns.withColumn("role", edited))


@query("equal_part_split", """
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS p, count(*) OVER () AS c FROM orders),
x AS (SELECT *, CAST(least(floor((p - 1) * 5 / c), 4) AS INTEGER) AS part, CAST(ceil(p / 25.0) AS INTEGER) AS batch, CAST(ceil(p / ceil(c / 3.0)) AS INTEGER) AS compact_part FROM n)
SELECT part, batch, compact_part, count(*) AS rows, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM x GROUP BY ALL""")
def equal_part_split(t: Tables):
    rows = batching.numbered(t.orders.select("o_orderkey"), [F.col("o_orderkey").asc()])
    rows = batching.compact_parts(batching.fixed_batches(batching.equal_parts(rows, 5), 25), 3, out="compact_part")
    return rows.groupBy("part", "batch", "compact_part").agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"))


@query("size_bounded_chunks", """
WITH s AS (SELECT doc_id, octet_length(encode(text)) AS n, sum(octet_length(encode(text))) OVER (ORDER BY doc_id) AS c FROM documents)
SELECT CAST(floor((c - n) / 100000) AS BIGINT) AS chunk, count(*) AS rows, min(doc_id) AS first_id, max(doc_id) AS last_id FROM s GROUP BY 1""")
def size_bounded_chunks(t: Tables):
    sized = t.documents.select("doc_id", F.octet_length("text").cast("bigint").alias("n"))
    chunked = batching.size_chunks(sized, F.col("n"), 100_000, [F.col("doc_id").asc()])
    return batching.part_summary(chunked, "doc_id", "chunk")


@query("unresolved_readiness", """
SELECT l_orderkey AS recipe_id, count(*) FILTER (l_returnflag = 'N' OR l_quantity > 40) AS unresolved FROM lineitem GROUP BY 1""")
def unresolved_readiness(t: Tables):
    lines = t.lineitem.select(F.col("l_orderkey").alias("recipe_id"), "l_returnflag", "l_quantity")
    counted = r.unresolved_counts(lines, (F.col("l_returnflag") != "N") & (F.col("l_quantity") <= 40))
    document = counted.select(F.to_json(F.create_map(F.col("recipe_id").cast("string"), F.col("unresolved"))).alias("doc"))
    return feeds.readiness_counts(document, "doc").filter("violation IS NULL").select("recipe_id", "unresolved")


@query("nested_length_totals", """
SELECT (SELECT count(*) FROM orders) AS recipes, (SELECT count(*) FROM lineitem) AS ingredients, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS reviews""")
def nested_length_totals(t: Tables):
    lines = t.lineitem.select(F.col("l_orderkey").alias("recipe_id"), "l_linenumber", "l_partkey", "l_returnflag")
    nest = lambda rows: corpus.nest_children(rows, "recipe_id", ["l_linenumber", "l_partkey"], [], bucket=line_band())
    parents = t.orders.select(F.col("o_orderkey").alias("recipe_id"))
    documents = corpus.assemble_documents(parents, "recipe_id", {"ingredients": nest(lines), "reviews": nest(lines.filter("l_returnflag = 'R'"))})
    filled = documents.select("recipe_id", *[F.coalesce(c, F.array()).alias(c) for c in ("ingredients", "reviews")])
    return r.nested_totals(filled)


@query("conversion_consensus", """
WITH p AS (SELECT l_partkey AS food_id, CASE l_linenumber % 4 WHEN 0 THEN '1 cup' WHEN 1 THEN 'tbsp' WHEN 2 THEN 'large' ELSE 'chopped cup' END AS modifier,
  CAST(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS DOUBLE) AS basis, CAST(CASE WHEN l_tax > 0.06 THEN 7 ELSE l_partkey % 50 + 1 END AS DOUBLE) AS grams FROM lineitem),
q AS (SELECT food_id, CASE modifier WHEN '1 cup' THEN 'cup' WHEN 'tbsp' THEN 'tablespoon' ELSE 'count' END AS unit, CASE WHEN modifier = 'large' THEN 'large' ELSE '' END AS size, basis, round(grams / basis, 5) AS g FROM p WHERE modifier <> 'chopped cup'),
z AS (SELECT *, bool_or(basis = 1 AND unit <> 'count') OVER (PARTITION BY food_id, unit, size) AS direct FROM q)
SELECT food_id, unit, size, min(g) AS grams_per_unit, count(*) AS support FROM z WHERE NOT direct OR basis = 1 GROUP BY food_id, unit, size HAVING min(g) = max(g)""")
def conversion_consensus(t: Tables):
    kind = F.col("l_linenumber") % 4
    modifier = F.when(kind == 0, "1 cup").when(kind == 1, "tbsp").when(kind == 2, "large").otherwise("chopped cup")
    measure = corpus.portion_measure(modifier, F.lit("undetermined"))
    portions = t.lineitem.select(
        F.col("l_partkey").alias("food_id"), measure.alias("m"), F.when(F.col("l_returnflag") == "R", 2.0).otherwise(1.0).alias("basis"),
        F.when(F.col("l_tax") > 0.06, 7.0).otherwise((F.col("l_partkey") % 50 + 1).cast("double")).alias("grams"))
    return corpus.conversion_table(portions.filter("m IS NOT NULL").select("food_id", "m.unit", "m.size", "basis", "grams"))


@query("load_plan", """
WITH n AS (SELECT o_orderkey, CAST(least(floor((row_number() OVER (ORDER BY o_orderkey) - 1) * 5 / count(*) OVER ()), 4) AS INTEGER) AS part FROM orders),
p AS (SELECT part, count(*) AS rows, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM n GROUP BY part)
SELECT part, CASE WHEN part < 2 THEN 'loaded' WHEN part = 2 THEN 'conflict' ELSE 'pending' END AS state, rows,
  (SELECT CAST(sum(rows) AS BIGINT) FROM p WHERE part < 3) AS loaded FROM p""")
def load_plan(t: Tables):
    parted = batching.equal_parts(t.orders.select("o_orderkey"), 5, [F.col("o_orderkey").asc()])
    manifest = batching.part_summary(parted, "o_orderkey").withColumn("sha256", F.sha2(F.concat_ws(":", "part", "rows"), 256))
    loaded = manifest.filter("part < 3").select("part", F.when(F.col("part") == 2, "other").otherwise(F.col("sha256")).alias("sha256"))
    progress = tables.load_progress(manifest.withColumn("finished", F.col("part") < 2), parted.filter("part < 3"), "o_orderkey")
    planned = tables.pending_parts(manifest, loaded).join(manifest.select("part", "rows"), "part")
    return planned.withColumn("one", F.lit(1)).join(progress.withColumn("one", F.lit(1)), "one").drop("one")


@query("release_record_checks", """
WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 0 THEN 'x' ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS h, o_custkey % 11 = 0 AS wrong_id, o_orderstatus = 'P' AS bad_state FROM orders)
SELECT CASE WHEN h = 'x' OR id < 1 THEN 'invalid_recipe_document' WHEN wrong_id THEN 'recipe_id_mismatch' WHEN bad_state THEN 'ingredient_quality_or_policy' END AS violation, count(*) AS records FROM r GROUP BY 1
UNION ALL SELECT 'recipe_part_count_or_order_mismatch', 1""")
def release_record_checks(t: Tables):
    body = F.col("o_orderkey").cast("string")
    digest = F.when(F.col("o_custkey") % 10 == 0, "x").otherwise(F.sha2(body, 256))
    doc_id = F.when(F.col("o_custkey") % 11 == 0, -1).otherwise(F.col("o_orderkey"))
    why = corpus.record_violation(digest, body, doc_id, F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "P", "conflict").otherwise("consistent"),
                                  F.lit(True), F.lit(None).cast("string"), F.lit(True))
    checked = t.orders.groupBy(why.alias("violation")).agg(F.count(F.lit(1)).alias("records"))
    records = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(1).alias("part"))
    manifest = t.orders.agg((F.count(F.lit(1)) + 1).alias("rows"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id")).withColumn("part", F.lit(1))
    return checked.unionByName(corpus.part_violations(records, manifest).groupBy("violation").agg(F.count(F.lit(1)).alias("records")))


@query("summary_projection", """
SELECT o_orderkey AS recipe_id, o_orderpriority AS name, count(*) AS ingredient_count, count(*) FILTER (l_returnflag = 'R') AS review_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def summary_projection(t: Tables):
    lines = t.lineitem.select(F.col("l_orderkey").alias("recipe_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", m.states("l_returnflag").alias("state"))
    nest = lambda rows, fields: corpus.nest_children(rows, "recipe_id", ["l_linenumber", "l_partkey", "l_suppkey"], fields, bucket=line_band())
    filters = lines.groupBy("recipe_id", F.col("l_linenumber").alias("filter_id")).agg(F.max("state").alias("state"))
    parents = t.orders.select(F.col("o_orderkey").alias("recipe_id"), F.struct(F.col("o_orderpriority").alias("name"), F.lit(2.0).alias("servings")).alias("source"),
                              F.struct(F.lit(1).alias("nutrients")).alias("profile"))
    documents = corpus.assemble_documents(parents, "recipe_id", {
        "ingredients": nest(lines, []), "reviews": nest(lines.filter("l_returnflag = 'R'"), []), "filters": corpus.nest_children(filters, "recipe_id", ["filter_id"], ["state"], F.col("filter_id"))})
    filled = documents.filter("ingredients IS NOT NULL").withColumn("reviews", F.coalesce("reviews", F.array()))
    return r.summary_projection(filled).select("recipe_id", "name", F.col("ingredient_count").cast("bigint").alias("ingredient_count"), F.col("review_count").cast("bigint").alias("review_count"))


@query("readiness_reconciliation", """
WITH a AS (SELECT count(*) AS extra FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem))
SELECT 'readiness_ids' AS gate, extra = 0 AS ok, CAST(extra AS VARCHAR) AS observed, '0' AS expected FROM a""")
def readiness_reconciliation(t: Tables):
    return quality.same_keys_gate("readiness_ids", t.orders.select(F.col("o_orderkey").alias("recipe_id")),
                                  t.lineitem.select(F.col("l_orderkey").alias("recipe_id")), ["recipe_id"])


@query("overlay_build", f"""
WITH base AS (SELECT l_orderkey AS recipe_id, l_linenumber AS filter_id, max({m.STATE}) AS state FROM lineitem GROUP BY ALL), rev AS (SELECT l_orderkey AS recipe_id, l_linenumber AS filter_id, min({m.STATE}) AS state FROM lineitem GROUP BY ALL),
st(state) AS (VALUES ('yes'), ('no'), ('unknown'))
SELECT 'changed' AS kind, CAST(floor(recipe_id / 1024) AS BIGINT) AS chunk, NULL AS filter_key, count(*) AS rows FROM rev JOIN base USING (recipe_id, filter_id) WHERE rev.state <> base.state GROUP BY ALL
UNION ALL SELECT 'set', NULL, filter_id || ':' || state, (SELECT count(*) FROM rev r WHERE r.filter_id = f.filter_id AND r.state = st.state) FROM (SELECT DISTINCT filter_id FROM rev) f, st""")
def overlay_build(t: Tables):
    rows = t.lineitem.withColumn("state", m.states("l_returnflag")).groupBy(F.col("l_orderkey").alias("recipe_id"), F.col("l_linenumber").alias("filter_id"))
    both = rows.agg(F.max("state").alias("old"), F.min("state").alias("new"))
    changed, sets = r.build_overlay(both.select("recipe_id", "filter_id", F.col("old").alias("state")), both.select("recipe_id", "filter_id", F.col("new").alias("state")))
    per_chunk = changed.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("changed").alias("kind"), "chunk", F.lit(None).cast("string").alias("filter_key"), "rows")
    per_set = sets.groupBy(F.concat_ws(":", "filter_id", "state").alias("filter_key")).agg(F.sum(F.size("recipe_ids")).alias("rows"))
    return per_chunk.unionByName(per_set.select(F.lit("set").alias("kind"), F.lit(None).cast("bigint").alias("chunk"), "filter_key", "rows"))


@query("projection_backfill", """
SELECT o_orderkey AS recipe_id, CASE WHEN o_orderkey <= 1000 THEN 'kept' WHEN o_orderkey % 5 = 0 THEN 'inserted' WHEN o_orderkey % 5 = 1 THEN 'updated' ELSE 'kept' END AS action FROM orders WHERE o_orderkey > 1000 OR o_orderkey % 5 <> 0""")
def projection_backfill(t: Tables):
    key = F.col("o_orderkey")
    line = F.struct(F.lit("x").alias("ingredient_original"), F.lit("g").alias("unit"), F.lit("1").alias("measured_quantity"), F.lit(None).cast("string").alias("qualitative_amount"), F.lit(False).alias("quantity_conflict"))
    documents = t.orders.select(key.alias("recipe_id"), F.struct(F.lit(2.0).alias("servings"), F.lit(None).cast("string").alias("yield")).alias("source"), F.array(line).alias("ingredients"),
                                F.struct(F.col("o_custkey").alias("nutrients")).alias("profile"))
    narrow = r.quote_projection(documents)
    body = F.to_json(F.struct(*[c for c in narrow.columns if c != "recipe_id"]), {"ignoreNullFields": "false"})
    stored = narrow.filter("recipe_id % 5 <> 0").select("recipe_id", F.when(F.col("recipe_id") % 5 == 1, "old").otherwise(body).alias("document"))
    return r.backfill_projection(documents, stored, after=1000).select("recipe_id", "action")
