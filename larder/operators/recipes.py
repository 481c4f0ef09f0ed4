"""Recipe corpus: classifications, overlays, search and ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


STATES = ("yes", "no", "unknown")
CHUNK_WIDTH = 1024
#: Domains whose keys must all hold; the others accept any of their keys (fixed values).
CONJUNCTIVE_DOMAINS = ("diet", "allergen", "nutrition_feature")


@dataclass(frozen=True)
class Wanted:
    """One requested filter value."""

    domain: str
    key: str

    @property
    def state(self) -> str:
        return "no" if self.domain == "allergen" else "yes"

    @property
    def group(self) -> str:
        return f"{self.domain}:{self.key}" if self.domain in CONJUNCTIVE_DOMAINS else self.domain


def strict_filter(classifications: DataFrame, wanted: Sequence[Wanted]) -> DataFrame:
    """Recipe ids that satisfy every group; ``unknown`` and missing rows never do.

    classifications (recipe_id, domain, key, state).  One scan and one combinable
    aggregate, however many groups are asked for.
    """
    groups = sorted({w.group for w in wanted})
    hits = [
        F.max(F.coalesce(_any([(F.col("domain") == w.domain) & (F.col("key") == w.key) & (F.col("state") == w.state)
                               for w in wanted if w.group == g]), F.lit(False))).alias(f"g{i}")
        for i, g in enumerate(groups)
    ]
    relevant = classifications.filter(_any([
        (F.col("domain") == w.domain) & (F.col("key") == w.key) & (F.col("state") == w.state) for w in wanted]))
    per_recipe = relevant.groupBy("recipe_id").agg(*hits)
    return per_recipe.filter(" AND ".join(f"g{i}" for i in range(len(groups)))).select("recipe_id")


def _any(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def available_only(recipes: DataFrame, lines: DataFrame, broken: DataFrame) -> DataFrame:
    """Recipes none of whose ingredient names is broken.  recipes (recipe_id), lines (recipe_id, name), broken (name)."""
    hit = lines.join(broken.select("name").distinct(), "name", "left_semi").select("recipe_id").distinct()
    return recipes.join(hit, "recipe_id", "left_anti")


def without_curated_exclusions(recipes: DataFrame, rules: DataFrame, slot: str | None = None) -> DataFrame:
    """Drop reviewed source defects.  rules (recipe_id, slot), slot ``all`` hits every request."""
    hit = rules.filter(F.col("slot").isin("all", *([slot] if slot else []))).select("recipe_id").distinct()
    return recipes.join(hit, "recipe_id", "left_anti")


def filter_sets(classifications: DataFrame, width: int = CHUNK_WIDTH) -> DataFrame:
    """Inverted sets (filter_id, state, chunk) -> sorted ids, empty sets included.

    A popular filter matches most of the corpus, so its id list is cut by recipe-id
    chunk: a list holds at most ``width`` ids and no group grows with the data.
    """
    chunk = F.floor(F.col("recipe_id") / width).cast("bigint")
    lists = classifications.groupBy("filter_id", "state", chunk.alias("chunk")).agg(
        F.array_sort(F.collect_set("recipe_id")).alias("recipe_ids"))
    sizes = lists.groupBy("filter_id", "state").agg(F.count(F.lit(1)).alias("__n"))
    axes = classifications.select("filter_id").distinct().withColumn("state", F.explode(F.array(*[F.lit(s) for s in STATES])))
    empty = axes.join(sizes, ["filter_id", "state"], "left_anti").select(
        "filter_id", "state", F.lit(0).cast("bigint").alias("chunk"), F.array().cast("array<bigint>").alias("recipe_ids"))
    return lists.filter(F.col("state").isin(*STATES)).unionByName(empty)


def set_members(sets: DataFrame, filter_id: Column, state: str) -> DataFrame:
    return sets.filter((F.col("filter_id") == filter_id) & (F.col("state") == state)).select(F.explode("recipe_ids").alias("recipe_id"))


def merge_overlay(base: DataFrame, patch: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Patched rows replace base rows with the same key; new keys are added."""
    over = patch.select(*keys, *[F.col(v).alias(f"__p_{v}") for v in values], F.lit(True).alias("__patched"))
    joined = base.join(over, list(keys), "full_outer")
    patched = F.coalesce(F.col("__patched"), F.lit(False))
    return joined.select(*keys, *[F.when(patched, F.col(f"__p_{v}")).otherwise(F.col(v)).alias(v) for v in values], patched.alias("patched"))


def merge_profile(base: DataFrame, patch: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Field-wise overlay: a patched value wins where present, otherwise the base value stays."""
    over = patch.select(key, *[F.col(v).alias(f"__p_{v}") for v in values])
    return base.join(over, key, "left").select(
        *[c for c in base.columns if c not in values], *[F.coalesce(F.col(f"__p_{v}"), F.col(v)).alias(v) for v in values])


def recovered_servings(servings: Column, recovered: Column, provenance: Column) -> Column:
    """Servings from the yield, only when the source has none and the provenance says so."""
    missing = servings.isNull() | (F.trim(servings) == "")
    usable = missing & recovered.isNotNull() & F.coalesce(provenance.startswith("RecipeYield:"), F.lit(False))
    return F.when(usable, F.struct(recovered.cast("double").alias("servings"), provenance.alias("provenance")))


def quote_projection(documents: DataFrame) -> DataFrame:
    """Narrow recipe for pricing.  Column pruning then reads only these parquet leaves."""
    lines = F.transform("ingredients", lambda i: F.struct(
        i["ingredient_original"].alias("ingredient_original"), i["unit"].alias("unit"),
        i["measured_quantity"].alias("measured_quantity"), i["qualitative_amount"].alias("qualitative_amount"),
        i["quantity_conflict"].alias("quantity_conflict")))
    return documents.select("recipe_id", F.col("source.servings").alias("servings"), F.col("source.yield").alias("recipe_yield"),
                            lines.alias("ingredients"), F.col("profile.nutrients").alias("nutrients_per_serving"))


def summary_projection(documents: DataFrame) -> DataFrame:
    states = F.map_from_entries(F.transform("filters", lambda f: F.struct(f["filter_id"].cast("string"), f["state"])))
    return documents.select(
        "recipe_id", F.col("source.name").alias("name"), F.col("source.servings").alias("servings"),
        F.size("reviews").alias("review_count"), F.size("ingredients").alias("ingredient_count"),
        F.col("profile.nutrients").alias("nutrients_per_serving"), states.alias("filters"))


def planning_vectors(recipes: DataFrame, nutrients: Sequence[str]) -> DataFrame:
    """Finite numeric nutrients and positive servings; anything else is unknown."""
    def finite(c: str) -> Column:
        v = F.col(c).try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias(c)

    servings = F.col("servings").try_cast("double")
    rest = [c for c in recipes.columns if c not in (*nutrients, "servings")]
    return recipes.select(*rest, F.when(servings > 0, servings).alias("servings"), *[finite(c) for c in nutrients])


@dataclass(frozen=True)
class Target:
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Profile:
    """One ranking request: daily calories and nutrient targets on the tracked axes."""

    id: int
    calories: float
    targets: Mapping[str, Target]
    tracked: tuple[str, ...]


def nutrient_fit(recipes: DataFrame, profiles: Sequence[Profile]) -> DataFrame:
    """Score every recipe for every profile.

    recipes carry ``recipe_id, servings, calories, unresolved`` and one column per axis.  The
    profiles are the request batch, so each compiles to constant arithmetic and the
    corpus is read once, whatever the number of profiles.  Score adds the squared
    relative shortfall and excess of each target at the profile's calories; density
    rewards up to twice a minimum.
    """
    cells = []
    for profile in profiles:
        score, density, known = F.lit(0.0), F.lit(0.0), F.lit(True)
        for axis in profile.tracked:
            known = known & F.col(axis).isNotNull()
        for axis, target in profile.targets.items():
            if axis not in profile.tracked:
                continue
            actual = F.col(axis) / F.col("calories") * F.lit(float(profile.calories))
            if target.low is not None and target.low > 0:
                short = F.greatest(F.lit(0.0), (F.lit(target.low) - actual) / F.lit(target.low))
                score = score + short * short
                density = density + F.least(F.lit(2.0), actual / F.lit(target.low))
            if target.high is not None:
                over = F.greatest(F.lit(0.0), (actual - F.lit(target.high)) / F.lit(max(1.0, target.high)))
                score = score + over * over
        cells.append(F.when(known, F.struct(F.lit(profile.id).alias("profile_id"), score.alias("score"), density.alias("density"))))
    usable = recipes.filter((F.col("servings") > 0) & (F.col("calories") > 0))
    scored = usable.select("recipe_id", "unresolved", F.explode(F.array(*cells)).alias("__s")).filter(F.col("__s").isNotNull())
    return scored.select("__s.profile_id", "recipe_id", "unresolved", "__s.score", "__s.density")


def rank_recipes(scored: DataFrame, limit: int, offset: int = 0, decimals: int = 9) -> DataFrame:
    """Page of the ranking per profile: unresolved, score, density (desc), id.

    ``row_number() <= k`` is cut inside each task before the shuffle, so the corpus is
    never sorted in one place.
    """
    order = [F.col("unresolved").asc(), F.round("score", decimals).asc(), F.round("density", decimals).desc(), F.col("recipe_id").asc()]
    ranked = scored.withColumn("position", F.row_number().over(Window.partitionBy("profile_id").orderBy(*order)))
    return ranked.filter(F.col("position") <= offset + limit).filter(F.col("position") > offset)


GRAM = 3


def grams(text: Column, n: int) -> Column:
    """Distinct substrings of length ``n``; overlapping matches keep this linear in the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def gram_index(titles: DataFrame, key: str, title: str, n: int = GRAM, only: Sequence[str] | None = None) -> DataFrame:
    """Posting table (gram, id, title).

    ``only`` keeps the postings of some grams, for a search that does not store the table.
    """
    lowered = titles.select(F.col(key).alias("id"), F.lower(F.col(title)).alias("title"))
    if only is None:
        found = grams(F.col("title"), n)
    else:
        found = F.filter(F.array(*[F.lit(g) for g in only]), lambda g: F.contains(F.col("title"), g))
    return lowered.select("id", "title", F.explode(found).alias("gram"))


def title_search(titles: DataFrame, key: str, title: str, queries: Mapping[int, str]) -> DataFrame:
    """(query_id, id) of titles containing each query text, ignoring case.

    A query of three or more characters probes the trigram postings with *one* gram, the
    rarest of its grams, and the exact substring test follows.  Any single gram is
    enough for completeness, and the rarest one keeps common grams from multiplying
    pairs.  A shorter query is itself a gram of its own length.
    """
    spark = titles.sparkSession
    asked = {i: q.strip().lower() for i, q in queries.items() if q.strip()}
    found = []
    for n in sorted({min(len(q), GRAM) for q in asked.values()}):
        parts = [(i, q, q[k : k + n]) for i, q in asked.items() if min(len(q), GRAM) == n for k in range(len(q) - n + 1)]
        probes = spark.createDataFrame(parts, "query_id int, q string, gram string").distinct()
        postings = gram_index(titles, key, title, n, sorted({g for _, _, g in parts}))
        if n == GRAM:
            counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("__n"))
            probes = probes.join(counts, "gram", "left").groupBy("query_id", "q").agg(
                F.min_by("gram", F.struct(F.coalesce("__n", F.lit(0)), "gram")).alias("gram"))
        found.append(postings.join(probes, "gram").filter(F.contains("title", "q")).select("query_id", "id"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def index_differences(titles: DataFrame, index: DataFrame, key: str, title: str) -> DataFrame:
    """Search-index parity: (id, title) pairs that only one side holds."""
    from .versions import table_differences

    source = titles.select(F.col(key).alias("id"), F.lower(F.col(title)).alias("title")).filter(F.length("title") >= GRAM)
    return table_differences(source, index.select("id", "title").distinct())


def keyset_page(df: DataFrame, key: str, after: object | None, limit: int, *, probe: bool = True) -> DataFrame:
    """Next page after a cursor, plus one row that tells whether another page follows."""
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit + int(probe))


def frequency_page(df: DataFrame, after: tuple[int, str] | None, limit: int, status: str | None = None, text: str = "") -> DataFrame:
    """Names by falling occurrences, then name, after a composite cursor."""
    rows = df
    if after is not None:
        n, name = after
        rows = rows.filter((F.col("occurrences") < n) | ((F.col("occurrences") == n) & (F.col("name") > name)))
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if text:
        rows = rows.filter(F.contains(F.lower("name"), F.lit(text.lower())))
    return rows.orderBy(F.col("occurrences").desc(), F.col("name").asc()).limit(limit + 1)


def offset_page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def nested_slice(df: DataFrame, array: str, offset: int, limit: int) -> DataFrame:
    """Slice of a nested array with its total length."""
    return df.withColumn("total", F.size(array)).withColumn(array, F.slice(array, offset + 1, limit))


def nested_totals(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count(F.lit(1)).alias("recipes"), F.sum(F.size("ingredients")).alias("ingredients"),
                         F.sum(F.size("reviews")).alias("reviews"))


def unresolved_counts(lines: DataFrame, resolved: Column) -> DataFrame:
    return lines.groupBy("recipe_id").agg(F.count_if(~F.coalesce(resolved, F.lit(False))).alias("unresolved"))


def search_recipes(recipes: DataFrame, classifications: DataFrame, lines: DataFrame, *, wanted: Sequence[Wanted] = (),
                   broken: DataFrame | None = None, text: str = "", after: int | None = None, limit: int = 20) -> DataFrame:
    """Filtered keyset search.  recipes (recipe_id, name)."""
    rows = recipes
    if text:
        rows = rows.filter(F.contains(F.lower("name"), F.lit(text.lower())))
    if wanted:
        rows = rows.join(strict_filter(classifications, wanted), "recipe_id", "left_semi")
    if broken is not None:
        rows = available_only(rows, lines, broken)
    return keyset_page(rows, "recipe_id", after, limit)


def planning_candidates(recipes: DataFrame, classifications: DataFrame, lines: DataFrame, profiles: Sequence[Profile],
                        *, wanted: Sequence[Wanted] = (), broken: DataFrame | None = None,
                        curated: DataFrame | None = None, slot: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Hard constraints first, then the nutrient-fit ranking per profile."""
    rows = recipes
    if wanted:
        rows = rows.join(strict_filter(classifications, wanted), "recipe_id", "left_semi")
    if broken is not None:
        rows = available_only(rows, lines, broken)
    if curated is not None:
        rows = without_curated_exclusions(rows, curated, slot)
    return rank_recipes(nutrient_fit(rows, profiles), limit, offset)


def unpivot_axes(df: DataFrame, key: str, axes: Mapping[str, str]) -> DataFrame:
    """Wide per-recipe classification columns to (recipe_id, filter_id, state) rows."""
    cells = [F.struct(F.lit(name).alias("filter_id"), F.col(col).alias("state")) for name, col in axes.items()]
    return df.select(F.col(key).alias("recipe_id"), F.explode(F.array(*cells)).alias("__c")).select("recipe_id", "__c.*")


def build_overlay(base: DataFrame, revised: DataFrame, width: int = CHUNK_WIDTH) -> tuple[DataFrame, DataFrame]:
    """(changed classification rows with their chunk, full replacement sets).

    base / revised (recipe_id, filter_id, state).  Only changed rows ship; the sets ship whole, with
    empty ones, so that an old match cannot leak through.
    """
    from .versions import changed_rows

    changed = changed_rows(base, revised, ["recipe_id", "filter_id"], ["state"])
    return changed.withColumn("chunk", F.floor(F.col("recipe_id") / width)), filter_sets(revised, width)


def backfill_projection(documents: DataFrame, stored: DataFrame, after: int = 0) -> DataFrame:
    """New projection table after projecting every document past a key; equal rows are kept untouched."""
    from .versions import upsert_if_changed

    fresh = quote_projection(documents.filter(F.col("recipe_id") > after))
    body = F.to_json(F.struct(*[c for c in fresh.columns if c != "recipe_id"]), {"ignoreNullFields": "false"})
    return upsert_if_changed(stored, fresh.select("recipe_id", body.alias("document")), ["recipe_id"], "document")
