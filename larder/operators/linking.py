"""Weighted ingredient names linked to products."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.policy import classify, meat_kind, product_policy
from ..functions.text import fold_text, leftover_words, strip_preparation

CANDIDATES_KEPT = 8
TAP_WATER = r"^(?:(?:boiling|hot|cold|warm|ice|tap|filtered|lukewarm|distilled) )?water$|^ice cubes?$"


@dataclass(frozen=True)
class FoodRule:
    """One reviewed food: its names, and how its products look (all text folded)."""

    id: str
    aliases: tuple[str, ...]
    title: str
    categories: tuple[str, ...]
    basis: str = "kg"
    exclude: str | None = None
    ambiguous: bool = False
    form: str | None = None


def alias_table(spark, rules: Sequence[FoodRule]) -> DataFrame:
    rows = [(a, r.id, order, r.basis, r.ambiguous, r.form)
            for order, (r, a) in enumerate((r, a) for r in rules for a in r.aliases)]
    return spark.createDataFrame(
        rows, "alias string, rule_id string, rule_order int, basis string, ambiguous boolean, form string")


def word_runs(text: Column, longest: int) -> Column:
    """Every run of 1..``longest`` consecutive words of a folded text."""
    words = F.split(text, " ")
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words)))
    runs = F.flatten(F.transform(sizes, lambda n: F.transform(
        F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    return F.array_distinct(runs)


def link_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Best alias of each distinct ``name``: exact first, then longest, then rule order.

    A phrase contained in a name is one of the name's word runs, so containment becomes
    an equi-join on the run.  The best hit is an aggregate with map-side combine.
    The longest run is the longest alias of the (reviewed) table, in words.
    """
    longest = aliases.agg(F.coalesce(F.max(F.size(F.split("alias", " "))), F.lit(1))).first()[0]
    folded = names.select("name").distinct().withColumn("original", fold_text(F.col("name"))).withColumn(
        "clean", strip_preparation(F.col("original")))
    runs = F.array_union(word_runs(F.col("clean"), longest), F.array("original", "clean"))
    phrases = folded.select("name", "original", "clean", F.explode(runs).alias("alias"))
    hits = phrases.join(aliases, "alias")
    exact = (F.col("alias") == F.col("original")) | (F.col("alias") == F.col("clean"))
    order = F.struct(exact.cast("int").alias("exact"), F.length("alias").alias("len"), (-F.col("rule_order")).alias("order"))
    best = hits.withColumn("exact", exact).withColumn("__order", order).groupBy("name").agg(
        F.max_by(F.struct("alias", "rule_id", "basis", "ambiguous", "form", "exact"), "__order").alias("__hit"))
    linked = folded.join(best, "name", "left").select("name", "original", "clean", "__hit.*")
    left = F.when(F.col("alias").isNotNull(), leftover_words(F.col("clean"), F.col("alias")))
    wants = {w: F.col("original").rlike(rf"\b{w}\b") for w in ("fresh", "dried", "cooked")}
    form = F.coalesce(F.col("form"), F.lit(""))
    swapped = (wants["fresh"] & (form == "dried")) | (wants["dried"] & (form == "fresh")) | wants["cooked"]
    canned = wants["fresh"] & ((form == "dried") | F.col("rule_id").endswith("-canned"))
    doubtful = F.col("ambiguous") | (~F.col("exact") & (left != ""))
    return linked.select(
        "name", "original", "clean", "rule_id", "basis", "alias", "exact",
        F.coalesce(left, F.lit("")).alias("leftover"),
        F.when(F.col("rule_id").isNotNull(), doubtful | swapped | canned).alias("uncertain"),
        constraint_signature(F.col("original"), F.col("name")).alias("signature"),
    )


def rule_pools(products: DataFrame, rules: Sequence[FoodRule], keep: Sequence[str] = ("code",)) -> DataFrame:
    """(rule_id, product) pairs: category prefix, title pattern, no excluded pattern.

    The reviewed rules are job parameters, so each becomes a constant predicate with a
    precompiled pattern and the products are read once: no theta join and no shuffle.
    Products carry folded ``title`` and ``categories``.
    """
    def in_category(prefixes: str) -> Column:
        return F.exists("categories", lambda c: c.rlike(prefixes))

    hits = []
    for rule in rules:
        test = F.col("title").rlike(rule.title) & in_category("^(?:" + "|".join(rule.categories) + ")")
        if rule.exclude:
            test = test & ~F.col("title").rlike(rule.exclude)
        hits.append(F.when(test, F.lit(rule.id)))
    matched = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return products.select(*keep, F.explode(matched).alias("rule_id"))


#: Words of a name that constrain its products (fixed values), and how they are recognised.
CONSTRAINT_WORDS = (
    ("frozen", r"\bfrozen\b"), ("fresh", r"\bfresh\b"), ("organic", r"\borganic\b"), ("extra virgin", r"\bextra virgin\b"), ("philadelphia", "philadelphia"),
    ("gluten free", "gluten free|glutenfree"), ("unsalted", "unsalted"), ("unsweetened", "unsweetened"), ("liquid", r"\bliquid\b"), ("raw", r"\braw\b"),
    ("boneless", r"\bboneless\b"), ("tabasco", "tabasco"), ("lean", r"\blean\b"), ("sharp", r"\bsharp\b"),
)


#: Rules to which a word alone applies (fixed values); other words apply to every rule.
CONSTRAINED_RULES = {
    "unsweetened": ("applesauce", "almond-milk", "soy-milk"), "liquid": ("honey",), "raw": ("honey",), "boneless": ("pork-chop",), "lean": ("beef-mince",), "sharp": ("cheddar",)}
MEAT_MARK = "meat="


def meat_class(meat: Column) -> Column:
    """chicken, other or empty: what a requested name and a product must have in common."""
    return F.when(meat == "chicken", "chicken").when(meat.isNotNull(), "other").otherwise("")


def constraint_signature(original: Column, raw: Column) -> Column:
    """What a folded name asks of its products: constraining words in a fixed order, the percentage as written, the class of meat.

    Folding drops the decimal point, so the percentage must come from the raw name.  Names with the same rule and signature accept
    exactly the same products, and there are few signatures however many names there are.
    """
    meat = meat_class(classify(original)["meat"])
    words = F.array(*[F.when(original.rlike(pattern), F.lit(word)) for word, pattern in CONSTRAINT_WORDS],
                    F.nullif(F.regexp_extract(raw, r"\d+(?:\.\d+)?%", 0), F.lit("")), F.when(meat != "", F.concat(F.lit(MEAT_MARK), meat)))
    return F.array_join(F.filter(words, lambda w: w.isNotNull()), " ")


def _mask(tests: Sequence[Column]) -> Column:
    """Bit i for the i-th test."""
    bits = [F.when(F.coalesce(test, F.lit(False)), 1 << i).otherwise(0) for i, test in enumerate(tests)]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return total.cast("bigint")


def needed_proofs(signature: Column, rule_id: Column) -> Column:
    """The words of a signature that hold under its rule, as bits in the order of ``CONSTRAINT_WORDS``."""
    words = F.regexp_replace(signature, MEAT_MARK + r"\w+", "")
    return _mask([words.rlike(pattern) & (rule_id.isin(*CONSTRAINED_RULES[word]) if word in CONSTRAINED_RULES else F.lit(True)) for word, pattern in CONSTRAINT_WORDS])


def product_proofs(title: Column, raw_title: Column, categories: Column, brand: Column) -> Column:
    """The words that a product satisfies, as bits in the order of ``CONSTRAINT_WORDS``."""
    from ..functions.attributes import PERCENT_IN_TITLE, percent

    frozen_aisle = F.exists(categories, lambda c: c.startswith("fryst"))
    brand = F.coalesce(brand, F.lit(""))
    proofs = {
        "frozen": frozen_aisle | title.rlike("fryst"), "fresh": ~frozen_aisle, "organic": title.rlike(r"\beko\b|ekologisk"),
        "extra virgin": title.rlike("extra virgin|extra vergine|extra jungfru"), "philadelphia": brand == "philadelphia", "gluten free": title.rlike("glutenfri"),
        "unsalted": title.rlike("osalt"), "unsweetened": title.rlike("osotad|utan tillsatt socker|sockerfri"), "liquid": title.rlike("flytande"),
        "raw": title.rlike("raw|ra honung|oupphettad"), "boneless": title.rlike("benfri|utan ben"), "tabasco": title.rlike("tabasco") | (brand == "tabasco"),
        "lean": percent(raw_title, PERCENT_IN_TITLE) <= 10, "sharp": title.rlike(r"lagrad|mature|extra|\d+man"),
    }
    return _mask([proofs[word] for word, _ in CONSTRAINT_WORDS])


POOL = ("rule_id", "signature")
GROUP = ("rule_id", "proofs", "fat", "meat")
NO_PERCENT = -1.0


@dataclass(frozen=True)
class Pools:
    """Products by what they prove, and which signatures accept which groups of proofs.

    ``products`` (rule_id, proofs, fat, meat, code, eligible, unit_price, ...) holds a product once a rule; ``bridge`` (rule_id,
    signature, proofs, fat, meat) is a table of signatures and groups, which are few whatever the products and names.
    """

    products: DataFrame
    bridge: DataFrame

    def rows(self) -> DataFrame:
        """(rule_id, signature, product): every product under every signature that accepts it.  Large; for joins with few signatures."""
        return self.products.join(self.bridge, list(GROUP))


def build_pools(links: DataFrame, pools: DataFrame, keep: Sequence[str]) -> Pools:
    """Group the products of each rule by proof bits, percentage and meat, and let signatures choose among the groups.

    pools (rule_id, title, raw_title, categories, brand, *keep).  Products that the dietary policy excludes are left out.  A signature
    accepts a group whose bits include its own, whose percentage is the one asked for, and whose meat is of the class asked for.
    """
    from ..functions.attributes import PERCENT_IN_REQUEST, PERCENT_IN_TITLE, percent

    own = pools.withColumn("__own", classify(F.col("title")))
    allowed = own.filter(product_policy(F.col("title"), F.col("brand"), F.col("categories"), F.col("__own")).isNull())
    products = allowed.select(
        "rule_id", product_proofs(F.col("title"), F.col("raw_title"), F.col("categories"), F.col("brand")).alias("proofs"),
        F.coalesce(percent(F.col("raw_title"), PERCENT_IN_TITLE), F.lit(NO_PERCENT)).alias("fat"),
        meat_class(meat_kind(F.col("title"), F.col("categories"), F.col("__own"))).alias("meat"), *keep)
    wanted = links.filter(F.col("rule_id").isNotNull()).select(*POOL).distinct().select(
        *POOL, needed_proofs(F.col("signature"), F.col("rule_id")).alias("__needs"), percent(F.col("signature"), PERCENT_IN_REQUEST).alias("__percent"),
        F.regexp_extract("signature", MEAT_MARK + r"(\w+)", 1).alias("__meat"))
    accepts = (F.col("__needs").bitwiseAND(F.col("proofs")) == F.col("__needs")) & (F.col("__percent").isNull() | (F.col("fat") == F.col("__percent"))) & (
        (F.col("__meat") == "") | (F.col("meat") == F.col("__meat")))
    # both sides are distinct combinations of a few bits: signatures of names, proofs of products
    bridge = wanted.join(products.select(*GROUP).distinct(), "rule_id").filter(accepts).select("signature", *GROUP)
    return Pools(products, bridge)


def rank_candidates(candidates: DataFrame, keep: int = CANDIDATES_KEPT, first: Sequence[Column] = (), keys: Sequence[str] = ("name",)) -> DataFrame:
    """Eligible first, cheapest first (unknown last), then code; the best ``keep`` per key."""
    order = [F.col("eligible").desc(), *first, F.col("unit_price").asc_nulls_last(), F.col("code").asc()]
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= keep)


def name_candidates(links: DataFrame, pools: Pools, keep: int = CANDIDATES_KEPT) -> DataFrame:
    """The best candidates of every name (code, eligible, unit_price, rank): the best of each group first, then of the groups of a signature."""
    best = rank_candidates(pools.products.select(*GROUP, "code", "eligible", "unit_price"), keep, keys=GROUP).drop("rank")
    return links.select("name", *POOL).join(rank_candidates(best.join(pools.bridge, list(GROUP)).drop("proofs", "fat", "meat"), keep, keys=POOL), list(POOL)).drop(*POOL)


def _cheapest(test: Column) -> Column:
    order = F.struct(F.coalesce(F.col("unit_price"), F.lit(float("inf"))), "code")
    return F.min_by(F.when(test, F.struct("code", "unit_price")), F.when(test, order))


def _least(column: str) -> Column:
    """The cheapest of already chosen (code, unit_price) structs."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.struct(F.coalesce(F.col(f"{column}.unit_price"), F.lit(float("inf"))), F.col(f"{column}.code"))))


def select_links(requirements: DataFrame, links: DataFrame, pools: Pools, approved: DataFrame | None = None,
                 rejected: DataFrame | None = None) -> DataFrame:
    """Five-status link per requirement.

    requirements (name, occurrences); links from ``link_aliases``; pools from ``build_pools``; approved (name, code,
    eligible, unit_price) are reviewed products; rejected (name, code).  Products are reduced to the cheapest of each group before
    they meet signatures, and signatures before they meet names.  A name that rejected r products needs the r + 1
    cheapest of each group at most.  ``candidates`` counts the pool, rejected products included.
    """
    certain = links.select("name", *POOL, F.coalesce(~F.col("uncertain"), F.lit(False)).alias("__certain"))
    grouped = pools.products.groupBy(*GROUP).agg(_cheapest(F.col("eligible")).alias("__best"), F.count(F.lit(1)).alias("__n"))
    pooled = grouped.join(pools.bridge, list(GROUP)).groupBy(*POOL).agg(_least("__best").alias("__pool"), F.sum("__n").alias("candidates"))
    picks = certain.join(pooled, list(POOL), "left").select("name", "__certain", "__pool", "candidates")
    if rejected is not None:
        most = rejected.groupBy("name").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        near = rank_candidates(pools.products.filter("eligible").select(*GROUP, "code", "eligible", "unit_price"), most + 1, keys=GROUP).drop("rank")
        touched = rejected.select("name").distinct()
        rows = certain.join(touched, "name", "left_semi").join(pools.bridge, list(POOL)).join(near, list(GROUP)).join(rejected, ["name", "code"], "left_anti")
        redone = rows.groupBy("name").agg(_cheapest(F.col("eligible")).alias("__redone"))
        marked = picks.join(touched.withColumn("__touched", F.lit(True)), "name", "left").join(redone, "name", "left")
        picks = marked.withColumn("__pool", F.when(F.col("__touched"), F.col("__redone")).otherwise(F.col("__pool"))).drop("__touched", "__redone")
    policy = requirements.select("name").distinct().withColumn("__policy", classify(fold_text(F.col("name"))))
    joined = requirements.join(policy, "name").join(links.drop("signature"), "name", "left").join(picks, "name", "left")
    pool_pick = F.when(F.col("__certain"), F.col("__pool"))
    if approved is None:
        best, was_reviewed, reviewed = pool_pick, F.lit(False), F.lit(False)
    else:
        kept = approved if rejected is None else approved.join(rejected, ["name", "code"], "left_anti")
        named = kept.groupBy("name").agg(_cheapest(F.col("eligible")).alias("__named"), F.lit(True).alias("__reviewed"))
        joined = joined.join(named, "name", "left")
        price = lambda c: F.coalesce(F.col(f"{c}.unit_price"), F.lit(float("inf")))
        use_named = F.col("__named").isNotNull() & (pool_pick.isNull() | (F.struct(price("__named"), F.col("__named.code")) <= F.struct(price("__pool"), F.col("__pool.code"))))
        best, was_reviewed, reviewed = F.when(use_named, F.col("__named")).otherwise(pool_pick), use_named, F.coalesce("__reviewed", F.lit(False))
    rows = joined.withColumn("__best", best).withColumn("__was_reviewed", was_reviewed).withColumn("__reviewed_name", reviewed)
    blocked = F.col("__policy.reason").isNotNull()
    water = F.coalesce(F.col("original").rlike(TAP_WATER) & ~F.col("__reviewed_name"), F.lit(False))
    matched = F.col("__best").isNotNull()
    doubtful = F.col("rule_id").isNull() | F.coalesce(F.col("uncertain"), F.lit(False))
    status = (
        F.when(blocked, "excluded").when(water, "non_purchased").when(matched, "matched").when(doubtful, "needs_review").otherwise("unavailable")
    )
    reason = (
        F.when(blocked, F.col("__policy.reason"))
        .when(water, "tap_water_not_purchased")
        .when(matched, F.when(F.col("__was_reviewed"), "reviewed").otherwise("food_rule"))
        .when(F.col("rule_id").isNull(), "no_verified_food_rule")
        .when(doubtful, "food_form_needs_review")
        .when(F.coalesce(F.col("candidates"), F.lit(0)) > 0, "no_compatible_product_with_fresh_price")
        .otherwise("no_compatible_product_in_catalogue")
    )
    chosen = status == "matched"
    return rows.select(
        "name", "occurrences", "rule_id", status.alias("status"), reason.alias("reason"),
        F.when(chosen, F.col("__best.code")).alias("selected_code"), F.when(chosen, F.col("__best.unit_price")).alias("unit_price"),
        F.coalesce(F.col("candidates"), F.lit(0)).cast("bigint").alias("candidates"))


def summarize_links(links: DataFrame) -> DataFrame:
    """Names and occurrences per status with their share of all occurrences."""
    per_status = links.groupBy("status").agg(F.count(F.lit(1)).alias("names"), F.sum("occurrences").alias("occurrences"))
    total = F.sum("occurrences").over(Window.partitionBy())
    return per_status.select("status", "names", "occurrences", (F.col("occurrences") / total).alias("fraction"))


def inventory(lines: DataFrame, name: str) -> DataFrame:
    return lines.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("occurrences"))


def identity_candidates(reviewed: DataFrame, products: DataFrame) -> DataFrame:
    """Current products with the same folded (name, brand) as a reviewed product.

    reviewed (name, product_name, product_brand); products (code, title, brand) unfolded.
    """
    def keyed(df: DataFrame, title: str, brand: str) -> DataFrame:
        return df.withColumn("__t", fold_text(F.col(title))).withColumn("__b", fold_text(F.coalesce(F.col(brand), F.lit(""))))

    left = keyed(reviewed.select("name", "product_name", "product_brand").distinct(), "product_name", "product_brand")
    right = keyed(products, "title", "brand").select("code", "__t", "__b")
    return left.join(right, ["__t", "__b"], "left").drop("__t", "__b")


def assess(reviewed: DataFrame, candidates: DataFrame, outcomes: DataFrame, catalogue_digest: Column) -> DataFrame:
    """Status of reviewed names that found no eligible product.

    reviewed (name, product_name, product_brand, code or NULL); outcomes (name, outcome, digest).
    A lost identity or a changed catalogue reopens the review.
    """
    lost = reviewed.groupBy("name", "product_name", "product_brand").agg(F.max(F.col("code").isNotNull()).alias("found"))
    lost = lost.groupBy("name").agg(F.max(~F.col("found")).alias("lost"))
    eligible = candidates.filter(F.col("eligible")).groupBy("name").agg(
        F.min_by("code", F.struct(F.coalesce(F.col("unit_price"), F.lit(float("inf"))), "code")).alias("selected_code"))
    joined = outcomes.join(lost, "name", "left").join(eligible, "name", "left")
    missing = F.coalesce(F.col("lost"), F.lit(False))
    unchanged = F.col("digest") == catalogue_digest
    status = (
        F.when((F.col("outcome") == "approve") & F.col("selected_code").isNotNull(), "matched")
        .when((F.col("outcome") == "approve") & ~missing, "unavailable")
        .when((F.col("outcome") == "unavailable") & unchanged, "unavailable")
        .otherwise("needs_review")
    )
    return joined.select("name", "outcome", status.alias("status"), F.when(status == "matched", F.col("selected_code")).alias("selected_code"))


def dietary_audit(links: DataFrame) -> DataFrame:
    """Names that remove a recipe: blocked by policy, or meat without a permitted product."""
    meat = classify(fold_text(F.col("name")))
    return links.withColumn("__p", meat).filter(
        F.col("__p.reason").isNotNull() | (F.col("__p.meat").isNotNull() & (F.col("status") != "matched"))
    ).select("name", F.coalesce(F.col("__p.reason"), F.lit("no_permitted_meat_match")).alias("reason"))


def dietary_subset(lines: DataFrame, audit: DataFrame, recipe: str = "recipe_id") -> DataFrame:
    """Recipes without any audited name."""
    offending = lines.join(audit.select("name"), "name", "left_semi").select(recipe).distinct()
    return lines.select(recipe).distinct().join(offending, recipe, "left_anti")


def removal_reasons(lines: DataFrame, audit: DataFrame, recipe: str = "recipe_id") -> DataFrame:
    """Recipes per removal reason; a recipe counts once for each of its reasons."""
    pairs = lines.join(audit, "name").select(recipe, "reason").distinct()
    return pairs.groupBy("reason").agg(F.count(F.lit(1)).alias("recipes"))


def coverage(lines: DataFrame, links: DataFrame, recipe: str = "recipe_id") -> DataFrame:
    """Fully linked recipes and covered occurrence share of a connection set."""
    linked = links.select("name", F.col("status").isin("matched", "non_purchased").alias("__ok"))
    rows = lines.join(linked, "name", "left").withColumn("__ok", F.coalesce("__ok", F.lit(False)))
    per_recipe = rows.groupBy(recipe).agg(F.min("__ok").alias("full"), F.count_if("__ok").alias("covered"), F.count(F.lit(1)).alias("n"))
    return per_recipe.agg(
        F.count(F.lit(1)).alias("recipes"), F.count_if("full").alias("fully_linked"),
        F.sum("covered").alias("covered_lines"), F.sum("n").alias("lines"))


def requested_lookup(requests: DataFrame, table: DataFrame, key: str, status: str, unknown: str) -> DataFrame:
    """Requested keys in their order, misses marked.  ``requests`` has (pos, key)."""
    found = table.withColumn("__hit", F.lit(True))
    joined = requests.join(found, key, "left")
    return joined.withColumn(status, F.when(F.col("__hit").isNull(), F.lit(unknown)).otherwise(F.col(status))).drop("__hit")


def hydrate(links: DataFrame, products: DataFrame, codes: str = "codes") -> DataFrame:
    """Replace stored candidate codes by current product rows, order kept; vanished codes drop out.

    ``products`` has ``code`` plus the columns to nest.  A link stores at most
    ``CANDIDATES_KEPT`` codes, so a nested row stays small.
    """
    fields = [c for c in products.columns]
    long = links.select("name", F.posexplode(codes).alias("pos", "code"))
    rows = long.join(products, "code").groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("__c"))
    return links.join(rows, "name", "left").withColumn(
        "candidates", F.coalesce(F.col("__c"), F.array())).drop("__c", codes)
