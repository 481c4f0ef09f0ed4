"""Queries over versioned catalogues, histories, maintenance and publication gates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import quality, version_store, versions as v
from ..session import shared_folder
from ..sources import feeds, tables
from . import mapping as m
from .registry import Tables, query

LAST = 7  # revision of the newest yearly scan
KEYS = ["store", "code"]

_PAIR = """, a AS (SELECT * FROM scans WHERE revision = 6), b AS (SELECT * FROM scans WHERE revision = 7),
delta AS (SELECT coalesce(a.store, b.store) AS store, coalesce(a.code, b.code) AS code,
  CASE WHEN a.code IS NULL THEN 'added' WHEN b.code IS NULL THEN 'removed' WHEN a.content = b.content THEN 'unchanged' ELSE 'updated' END AS change,
  (b.code IS NOT NULL AND (a.code IS NULL OR a.price_ore <> b.price_ore)) AS price_changed
  FROM a FULL JOIN b ON a.store = b.store AND a.code = b.code)"""


def _delta(t: Tables):
    return v.classify_delta(m.scans(t, LAST - 1, LAST), m.scans(t, LAST, LAST + 1), KEYS, "content", "price_ore")


@query("snapshot_delta", m.sql(m.SCANS, body=_PAIR + " SELECT * FROM delta"))
def snapshot_delta(t: Tables):
    return _delta(t)


@query("delta_reconciliation", m.sql(m.SCANS, body=_PAIR + """
, per AS (SELECT store, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
  count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (price_changed) AS moved,
  (SELECT count(*) FROM a WHERE a.store = delta.store) AS prev, (SELECT count(*) FROM b WHERE b.store = delta.store) AS cur FROM delta GROUP BY store)
SELECT store, 'count_reconciliation' AS gate, prev + added - removed = cur AS ok, CAST(cur AS VARCHAR) AS observed, CAST(prev + added - removed AS VARCHAR) AS expected FROM per
UNION ALL SELECT store, 'changed_rows', TRUE, CAST(added + updated AS VARCHAR), NULL FROM per
UNION ALL SELECT store, 'price_changes', moved <= added + updated, CAST(moved AS VARCHAR), NULL FROM per"""))
def delta_reconciliation(t: Tables):
    return quality.reconciliation_gate(_delta(t), ["store"])


_VERSIONS = """, ranked AS (SELECT store, revision, row_number() OVER (PARTITION BY store ORDER BY revision) AS rk FROM (SELECT DISTINCT store, revision FROM scans)),
rows_ AS (SELECT s.*, r.rk FROM scans s JOIN ranked r USING (store, revision)),
marked AS (SELECT *, CASE WHEN lag(rk) OVER w = rk - 1 AND lag(content) OVER w = content THEN 0 ELSE 1 END AS st FROM rows_ WINDOW w AS (PARTITION BY store, code ORDER BY rk)),
runs AS (SELECT *, sum(st) OVER (PARTITION BY store, code ORDER BY rk) AS run FROM marked),
spans AS (SELECT store, code, run, min(revision) AS valid_from, max(rk) AS last_rk, min(content) AS content FROM runs GROUP BY ALL),
versions AS (SELECT s.store, s.code, s.valid_from, r.revision AS valid_to, s.content FROM spans s LEFT JOIN ranked r ON r.store = s.store AND r.rk = s.last_rk + 1)"""


def _versions(t: Tables):
    rows = m.scans(t).select("store", "revision", "code", "content", "price_ore")
    return v.build_versions(rows, rows, KEYS, "content", ["price_ore"])


@query("scd2_versions", m.sql(m.SCANS, body=_VERSIONS + " SELECT * FROM versions"))
def scd2_versions(t: Tables):
    return _versions(t).select("store", "code", "valid_from", "valid_to", "content")


@query("delta_publish", m.sql(m.SCANS, body=_VERSIONS + " SELECT *, valid_to IS NULL AS open FROM versions"))
def delta_publish(t: Tables):
    """The last yearly scan published to the stored versions of the earlier ones."""
    earlier = m.scans(t, before=LAST).select("store", "revision", "code", "content")
    store = _stored(t, v.build_versions(earlier, earlier, KEYS, "content"))
    after = store.publish(m.scans(t, LAST, LAST + 1).select("store", "code", "content"), LAST)
    return after.read().withColumn("open", F.col("valid_to").isNull())


def _stored(t: Tables, versions):
    return version_store.store_versions(versions, f"{shared_folder(t.spark)}/versions-{uuid.uuid4().hex}", KEYS, "content")


@query("as_of_catalogue", m.sql(m.SCANS, body="SELECT store, revision, code, content FROM scans"))
def as_of_catalogue(t: Tables):
    """Every scan read back from the stored versions."""
    rows = m.scans(t).select("store", "revision", "code", "content")
    return _stored(t, v.build_versions(rows, rows, KEYS, "content")).as_of(rows).select("store", "revision", "code", "content")


@query("pinned_revision", m.sql(m.SCANS, body="SELECT store, code, content FROM scans WHERE revision = 5"))
def pinned_revision(t: Tables):
    """One revision read back after two later ones were published."""
    earlier = m.scans(t, before=LAST - 1).select("store", "revision", "code", "content")
    store = _stored(t, v.build_versions(earlier, earlier, KEYS, "content"))
    for revision in (LAST - 1, LAST):
        store = store.publish(m.scans(t, revision, revision + 1).select("store", "code", "content"), revision)
    return store.at(5).select("store", "code", "content")


@query("latest_version_with_tombstones", m.sql(m.SCANS, body="""
SELECT store, code, content, revision AS valid_from FROM scans s WHERE revision = 7 AND NOT EXISTS (
  SELECT 1 FROM scans p WHERE p.store = s.store AND p.code = s.code AND p.revision = 6 AND p.content = s.content)
UNION ALL SELECT s.store, s.code, s.content, 6 FROM scans s JOIN scans p ON p.store = s.store AND p.code = s.code AND p.revision = 6 AND p.content = s.content WHERE s.revision = 7"""))
def latest_version_with_tombstones(t: Tables):
    rows = m.scans(t).select("store", "revision", "code", "content")
    first = rows.filter(F.col("revision") == LAST - 1).select(
        "store", "code", F.col("revision").alias("valid_from"), F.lit(None).cast("int").alias("valid_to"), "content", F.lit(False).alias("is_deleted"))
    batch = rows.filter(F.col("revision") == LAST).drop("revision")
    published = v.apply_delta(first, batch, LAST, KEYS, "content", tombstones=True)
    return v.latest_version(published, KEYS, LAST).select("store", "code", "content", "valid_from")


@query("price_change_history", m.sql(m.PRICE_ROWS, body="""
, c AS (SELECT *, lag(price_ore) OVER w AS previous_ore, row_number() OVER w AS rn FROM price_rows WINDOW w AS (PARTITION BY store, code ORDER BY observed_at)),
d AS (SELECT *, row_number() OVER (PARTITION BY store, code ORDER BY observed_at DESC) AS recency FROM c WHERE rn = 1 OR previous_ore <> price_ore)
SELECT store, code, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at, price_ore, previous_ore, CAST(recency AS INTEGER) AS recency FROM d WHERE recency <= 100"""))
def price_change_history(t: Tables):
    changes = v.changes_only(m.price_rows(t), KEYS, ["observed_at"], ["price_ore"], F.trunc("observed_at", "month"))
    recent = v.most_recent(changes.withColumn("previous_ore", F.col("previous.price_ore")), KEYS, [F.col("observed_at").desc()])
    return recent.select("store", "code", m.stamp(F.col("observed_at")).alias("observed_at"), "price_ore", "previous_ore", "recency")


@query("link_change_log", """
WITH runs AS (SELECT l_partkey AS name, year(l_shipdate) AS run, max(l_suppkey) AS selected_code, bool_or(l_returnflag = 'R') AS review FROM lineitem GROUP BY ALL),
x AS (SELECT *, CASE WHEN review THEN 'needs_review' ELSE 'matched' END AS status FROM runs),
y AS (SELECT *, lag(selected_code) OVER w AS previous_code, lag(status) OVER w AS previous_status FROM x WINDOW w AS (PARTITION BY name ORDER BY run))
SELECT name, CAST(run AS INTEGER) AS run, previous_code, selected_code, status FROM y
WHERE previous_status IS NULL OR previous_status <> status OR previous_code <> selected_code""")
def link_change_log(t: Tables):
    runs = t.lineitem.groupBy(F.col("l_partkey").alias("name"), F.year("l_shipdate").alias("run")).agg(
        F.max("l_suppkey").alias("selected_code"), F.max(F.col("l_returnflag") == "R").alias("review"))
    rows = runs.withColumn("status", F.when(F.col("review"), "needs_review").otherwise("matched"))
    changes = v.changes_only(rows, ["name"], ["run"], ["selected_code", "status"], F.floor(F.col("run") / 10))
    return changes.select("name", "run", F.col("previous.selected_code").alias("previous_code"), "selected_code", "status")


@query("retention_cutoff", m.sql(m.SCANS, body=_VERSIONS + """,
kept AS (SELECT v.* FROM versions v WHERE EXISTS (SELECT 1 FROM ranked r WHERE r.store = v.store AND r.revision >= 5 AND (v.valid_to IS NULL OR v.valid_to > r.revision)))
SELECT 'version' AS kind, store, code, valid_from AS at FROM kept
UNION ALL SELECT 'history', l_suppkey, l_partkey, CAST(date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) AS INTEGER) FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-11-01' - INTERVAL 90 DAY"""))
def retention_cutoff(t: Tables):
    snapshots = m.scans(t).select("store", "revision").filter(F.col("revision") >= 5)
    kept = v.retained_versions(_versions(t), snapshots).select(F.lit("version").alias("kind"), F.col("store").cast("bigint"), "code", F.col("valid_from").alias("at"))
    recent = v.retained_history(t.lineitem, "l_shipdate", F.lit("2001-11-01").cast("timestamp_ntz"), 90)
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return kept.unionByName(recent.select(F.lit("history").alias("kind"), F.col("l_suppkey").alias("store"), F.col("l_partkey").alias("code"), days.alias("at")))


@query("union_two_layouts", m.sql(m.SCANS, body="SELECT store, revision, code, content, CASE WHEN revision <= 3 THEN 'full' ELSE 'interval' END AS layout FROM scans"))
def union_two_layouts(t: Tables):
    rows = m.scans(t).select("store", "revision", "code", "content")
    later = rows.filter(F.col("revision") > 3)
    intervals = v.build_versions(later, later, KEYS, "content")
    read = v.union_layouts(rows.withColumn("layout", F.lit("full")), intervals, later)
    return read.withColumn("layout", F.coalesce("layout", F.lit("interval")))


@query("upsert_if_changed", m.sql(m.SCANS, body=_PAIR + """
SELECT coalesce(a.store, b.store) AS store, coalesce(a.code, b.code) AS code, coalesce(b.content, a.content) AS content,
  CASE WHEN a.code IS NULL THEN 'inserted' WHEN b.code IS NOT NULL AND a.content <> b.content THEN 'updated' ELSE 'kept' END AS action
FROM a FULL JOIN b ON a.store = b.store AND a.code = b.code"""))
def upsert_if_changed(t: Tables):
    rows = m.scans(t).select("store", "code", "content", "revision")
    return v.upsert_if_changed(rows.filter(F.col("revision") == LAST - 1).drop("revision"), rows.filter(F.col("revision") == LAST).drop("revision"), KEYS, "content")


@query("insert_once_and_sync", m.sql(m.SCANS, body=_PAIR + """
SELECT 'insert_once' AS kind, b.store, b.code, NULL AS action FROM b ANTI JOIN a ON a.store = b.store AND a.code = b.code
UNION ALL SELECT 'sync', store, code, CASE change WHEN 'added' THEN 'insert' WHEN 'removed' THEN 'delete' ELSE 'update' END FROM delta WHERE change <> 'unchanged'"""))
def insert_once_and_sync(t: Tables):
    rows = m.scans(t).select("store", "code", "content", "revision")
    before, after = rows.filter(F.col("revision") == LAST - 1), rows.filter(F.col("revision") == LAST)
    once = v.insert_once(before, after, KEYS).select(F.lit("insert_once").alias("kind"), *KEYS, F.lit(None).cast("string").alias("action"))
    return once.unionByName(v.sync_set(before, after, KEYS, "content").select(F.lit("sync").alias("kind"), *KEYS, "action"))


@query("table_equality_proof", """
WITH a AS (SELECT p_partkey, p_name, p_size FROM part), b AS (SELECT p_partkey, p_name, CASE WHEN p_brand = 'Brand#7' THEN p_size + 1 ELSE p_size END AS p_size FROM part)
SELECT *, 1 AS surplus FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, -1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def table_equality_proof(t: Tables):
    left = t.part.select("p_partkey", "p_name", "p_size")
    right = t.part.select("p_partkey", "p_name", F.when(F.col("p_brand") == "Brand#7", F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return v.table_differences(left, right)


@query("publish_gates", m.sql(m.SCANS, body="""
, b AS (SELECT * FROM scans WHERE revision = 7), g AS (SELECT count(*) AS n, count(DISTINCT (store, code)) AS k, count(*) FILTER (observed_at IS NULL) AS u,
  count(*) FILTER (NOT (observed_at <= TIMESTAMP '2001-10-01 12:00:00' AND {0} = {1})) AS stale FROM b), p AS (SELECT count(*) AS n FROM scans WHERE revision = 6),
o AS (SELECT count(*) AS n FROM lineitem ANTI JOIN supplier ON l_suppkey = s_suppkey),
m AS (SELECT count(*) AS n FROM ((SELECT DISTINCT code FROM b EXCEPT SELECT p_partkey FROM part) UNION ALL (SELECT p_partkey FROM part EXCEPT SELECT code FROM b)))
SELECT 'non_empty' AS gate, n > 0 AS ok, CAST(n AS VARCHAR) AS observed, NULL AS expected FROM g
UNION ALL SELECT 'unique_codes', n = k, CAST(k AS VARCHAR), CAST(n AS VARCHAR) FROM g
UNION ALL SELECT 'observation_time_known', u = 0, CAST(u AS VARCHAR), '0' FROM g
UNION ALL SELECT 'no_stale_observation', stale = 0, CAST(stale AS VARCHAR), '0' FROM g
UNION ALL SELECT 'shrink_guard', g.n * 100 >= p.n * 80, CAST(g.n AS VARCHAR), CAST(p.n AS VARCHAR) FROM g, p
UNION ALL SELECT 'orphan_store', n = 0, CAST(n AS VARCHAR), '0' FROM o
UNION ALL SELECT 'tracked_equals_refreshed', n = 0, CAST(n AS VARCHAR), '0' FROM m""".format(
    m.sql_week_end("observed_at"), m.sql_week_end("TIMESTAMP '2001-10-01 11:59:00'"))))
def publish_gates(t: Tables):
    rows = m.scans(t)
    batch, previous = rows.filter(F.col("revision") == LAST), rows.filter(F.col("revision") == LAST - 1)
    now = F.lit("2001-10-01 11:59:00").cast("timestamp_ntz")
    gates = quality.batch_gates(batch, KEYS, "observed_at", now, previous.agg(F.count(F.lit(1)).alias("n")))
    orphans = quality.orphan_gate("orphan_store", t.lineitem.select(F.col("l_suppkey").alias("s_suppkey")), t.supplier, "s_suppkey")
    tracked = quality.same_keys_gate("tracked_equals_refreshed", t.part.select(F.col("p_partkey").alias("code")), batch.select("code"), ["code"])
    return gates.unionByName(orphans).unionByName(tracked)


@query("inventory_gates", """
WITH inv AS (SELECT p_name AS name, count(*) AS occurrences FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), d AS (SELECT count(*) AS occ FROM lineitem),
k AS (SELECT count(DISTINCT p_name) AS names FROM part), s AS (SELECT sum(occurrences) AS occ, count(*) AS n FROM inv)
SELECT 'inventory_occurrences' AS gate, s.occ = d.occ AS ok, CAST(s.occ AS VARCHAR) AS observed, CAST(d.occ AS VARCHAR) AS expected FROM s, d
UNION ALL SELECT 'inventory_names', s.n = k.names, CAST(s.n AS VARCHAR), CAST(k.names AS VARCHAR) FROM s, k
UNION ALL SELECT 'inventory_unique', TRUE, CAST(n AS VARCHAR), CAST(n AS VARCHAR) FROM s
UNION ALL SELECT 'inventory_positive', TRUE, '0', '0' UNION ALL SELECT 'inventory_policy', TRUE, '0', '0'""")
def inventory_gates(t: Tables):
    from ..functions.policy import classify
    from ..functions.text import fold_text
    from ..operators.linking import inventory

    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    inv = inventory(lines, "p_name").withColumn("__reason", classify(fold_text(F.col("name")))["reason"])
    names = t.part.select("p_name").distinct().agg(F.count(F.lit(1)).alias("names"))
    declared = quality.side_by_side(t.lineitem.agg(F.count(F.lit(1)).alias("occurrences")), names)
    return quality.inventory_gates(inv, declared, F.col("__reason"))


@query("landed_page_checks", """
WITH p AS (SELECT l_suppkey AS category, l_partkey AS code, CAST(l_linenumber - 1 AS INTEGER) AS page, 50 AS page_size,
  (SELECT count(*) FROM lineitem x WHERE x.l_suppkey = l.l_suppkey) + CASE WHEN l_suppkey % 5 = 0 AND l_linenumber = 3 THEN 1 ELSE 0 END AS declared_total FROM lineitem l),
pg AS (SELECT category, page, count(code) AS n, min(declared_total) AS lo, max(declared_total) AS hi, 50 AS ps FROM p GROUP BY ALL),
c AS (SELECT category, CAST(sum(n) AS BIGINT) AS collected, count(*) AS pages, min(page) AS f, max(page) AS l, min(lo) AS lo, max(hi) AS hi,
  count(*) FILTER (n <> least(ps, greatest(0, hi - page * ps))) AS short FROM pg GROUP BY ALL),
d AS (SELECT category, CAST(sum(n - 1) AS BIGINT) AS rep FROM (SELECT category, code, count(*) AS n FROM p GROUP BY ALL) GROUP BY ALL),
x AS (SELECT c.*, rep FROM c JOIN d USING (category)),
vio AS (SELECT category, 'category_total_changed' AS v FROM x WHERE lo <> hi UNION ALL SELECT category, 'page_numbers_not_contiguous' FROM x WHERE f <> 0 OR pages <> l - f + 1
  UNION ALL SELECT category, 'missing_results' FROM x WHERE short > 0 UNION ALL SELECT category, 'duplicate_product_in_category' FROM x WHERE rep > 0
  UNION ALL SELECT category, 'incomplete_category' FROM x WHERE collected - rep <> hi)
SELECT category, collected, hi AS declared, v AS violation FROM x LEFT JOIN vio USING (category)""")
def landed_page_checks(t: Tables):
    totals = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    pages = t.lineitem.join(totals, "l_suppkey").select(
        F.col("l_suppkey").alias("category"), F.col("l_partkey").alias("code"), (F.col("l_linenumber") - 1).alias("page"), F.lit(50).alias("page_size"),
        (F.col("n") + F.when((F.col("l_suppkey") % 5 == 0) & (F.col("l_linenumber") == 3), 1).otherwise(0)).alias("declared_total"))
    return quality.page_set_gates(pages)


@query("cross_category_dedupe", """
WITH r AS (SELECT l_partkey AS code, l_suppkey % 25 AS category, (l_orderkey * 100 + l_linenumber) * 1000000 + l_suppkey AS seq, CAST(l_quantity AS BIGINT) AS amount FROM lineitem),
u AS (SELECT code, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories, arg_max(amount, seq) AS amount FROM r GROUP BY code),
s AS (SELECT code, min(amount) AS lo, max(amount) AS hi, count(*) AS hits FROM r GROUP BY code)
SELECT code, categories, amount, hits, CASE WHEN lo <> hi THEN 'product_changed_during_scan' END AS violation FROM u JOIN s USING (code)""")
def cross_category_dedupe(t: Tables):
    rows = t.lineitem.select(
        F.col("l_partkey").alias("code"), F.array(F.col("l_suppkey") % 25).alias("categories"), F.col("l_quantity").cast("bigint").alias("amount"),
        ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1000000 + F.col("l_suppkey")).alias("seq"), "l_shipdate")
    merged = feeds.merge_category_hits(rows.drop("l_shipdate"), "code", "categories", "seq")
    scanned = feeds.merge_scanned(rows.withColumn("checked_at", F.col("l_shipdate")).withColumn("expires_at", cal.week_end(F.col("l_shipdate"))), "code", "amount")
    return merged.join(scanned, "code").select("code", F.array_join("categories", ",").alias("categories"), "amount", "hits", "violation")


@query("category_closure", """
WITH RECURSIVE e AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION SELECT 'root', 'R' || r_regionkey FROM region
  UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier),
c AS (SELECT parent AS root, child AS node, 1 AS depth FROM e UNION ALL SELECT c.root, e.child, depth + 1 FROM c JOIN e ON c.node = e.parent)
SELECT root, node, CAST(depth AS INTEGER) AS depth, FALSE AS cyclic, node NOT IN (SELECT parent FROM e) AS leaf FROM c""")
def category_closure(t: Tables):
    edges = (
        t.nation.select(F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.concat(F.lit("N"), "n_nationkey").alias("child"))
        .unionByName(t.region.select(F.lit("root").alias("parent"), F.concat(F.lit("R"), "r_regionkey").alias("child")))
        .unionByName(t.supplier.select(F.concat(F.lit("N"), "s_nationkey").alias("parent"), F.concat(F.lit("S"), "s_suppkey").alias("child"))))
    leaves = feeds.leaf_nodes(edges).withColumn("leaf", F.lit(True))
    return feeds.category_closure(edges).join(leaves, "node", "left").select("root", "node", "depth", "cyclic", F.coalesce("leaf", F.lit(False)).alias("leaf"))


@query("store_directory", """
WITH l AS (SELECT s_suppkey AS store_id, s_name AS name, 'pickup' AS channel, CASE WHEN s_acctbal > 0 THEN 'N' || s_nationkey END AS address, 1 AS seq FROM supplier WHERE s_nationkey <> 3
  UNION ALL SELECT s_suppkey, upper(s_name), 'delivery', 'D' || s_nationkey, 2 FROM supplier WHERE s_acctbal < 5000)
SELECT store_id, array_to_string(list_sort(list_distinct(list(channel))), '+') AS channels, arg_min(name, seq) AS name,
  arg_min(address, seq) FILTER (address IS NOT NULL) AS address FROM l GROUP BY store_id""")
def store_directory(t: Tables):
    def listing(df, channel, seq, name, address):
        return df.select(F.col("s_suppkey").alias("store_id"), name.alias("name"), F.lit(channel).alias("channel"),
                         F.lit(None).cast("string").alias("postal_code"), address.alias("address"), F.lit(seq).alias("seq"))

    pickup = listing(t.supplier.filter("s_nationkey <> 3"), "pickup", 1, F.col("s_name"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("N"), "s_nationkey")))
    delivery = listing(t.supplier.filter("s_acctbal < 5000"), "delivery", 2, F.upper("s_name"), F.concat(F.lit("D"), "s_nationkey"))
    return feeds.store_directory([pickup, delivery]).select("store_id", F.array_join("channels", "+").alias("channels"), "name", "address")


@query("chunk_manifest", """
SELECT 'orders' AS kind, CAST(floor(o_orderkey / 1024) AS BIGINT) AS chunk, count(*) AS rows,
  CAST(sum(octet_length(encode('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}'))) AS BIGINT) AS bytes FROM orders GROUP BY ALL""")
def chunk_manifest(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    chunked = rows.withColumn("kind", F.lit("orders")).withColumn("chunk", F.floor(F.col("o_orderkey") / 1024))
    return tables.chunk_manifest(chunked, rows.columns).drop("digest")


@query("links_as_of_snapshot", m.sql(m.SCANS, body="""
, ptr AS (SELECT store, max(revision) AS revision FROM scans GROUP BY store), l AS (SELECT DISTINCT n_regionkey AS store, l_partkey AS code FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT l.store, 'part ' || l.code AS name, l.code, s.price_ore FROM l JOIN ptr USING (store) LEFT JOIN scans s ON s.store = l.store AND s.code = l.code AND s.revision = ptr.revision"""))
def links_as_of_snapshot(t: Tables):
    rows = m.scans(t)
    links = rows.select("store", "code").distinct().withColumn("name", F.concat(F.lit("part "), "code"))
    priced = v.price_links(links, _versions(t), v.active_snapshots(rows))
    return priced.select("store", "name", "code", "price_ore")


@query("catalogue_freshness", m.sql(m.SCANS, body=f"""
SELECT store, revision, {m.sql_stamp('min(observed_at)')} AS oldest, count(*) AS products, min(observed_at) <= TIMESTAMP '1996-01-05' AND {m.sql_week_end('min(observed_at)')} = {m.sql_week_end("TIMESTAMP '1996-01-04 12:00:00'")} AS fresh,
  {m.sql_stamp(m.sql_week_end('min(observed_at)'))} AS expires_at FROM scans GROUP BY store, revision"""))
def catalogue_freshness(t: Tables):
    out = v.freshness(m.scans(t), "observed_at", F.lit("1996-01-04 12:00:00").cast("timestamp_ntz"), ["store", "revision"])
    return out.withColumn("oldest", m.stamp(F.col("oldest"))).withColumn("expires_at", m.stamp(F.col("expires_at")))
