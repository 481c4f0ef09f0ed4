"""Wall seconds of the headline queries, one JSON line.

Each query is written to the ``noop`` sink, so every row and column is computed and nothing is
collected.  One untimed run at the start warms the JVM.
"""

from __future__ import annotations

import json
import os
import time

from larder.plans import QUERIES
from larder.session import local_session

HEADLINE = (
    "shopping_list_quote", "menu_quote", "line_costing", "snapshot_delta", "scd2_versions", "delta_publish", "as_of_catalogue",
    "price_change_history", "cheapest_eligible_link", "text_policy_classify", "fold_text", "strict_tristate_filter", "nutrient_fit_ranking",
    "planning_candidate_search", "trigram_search", "filter_sets", "document_assembly", "demand_grouping", "pack_cover_exact",
    "basket_optimisation", "menu_ranking", "basket_components", "connection_health", "decision_fold", "bulk_price_query", "stream_price_changes",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "larder-bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    scanned = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    delta = {r["change"]: r["count"] for r in QUERIES["snapshot_delta"](spark, folder).groupBy("change").count().collect()}
    total = sum(delta.values())
    written = total - delta.get("unchanged", 0)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")), "lineitem_rows": scanned, "delta_rows_written_per_scanned": round(written / max(total, 1), 4)}))


if __name__ == "__main__":
    main()
