"""Sides that grow with the tables are exchanged between tasks, not collected by the driver."""

import datetime as dt

import pytest

from larder.plans import QUERIES, baskets
from larder.plans.registry import Tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables small enough for Spark to broadcast any of them."""
    at, day = str(tmp_path_factory.mktemp("tables")), dt.datetime(2000, 5, 1)
    tables = {
        "nation": ("n_nationkey int, n_regionkey int, n_name string", [(0, 0, "A")]),
        "supplier": ("s_suppkey bigint, s_name string, s_nationkey int", [(1, "s", 0)]),
        "customer": ("c_custkey bigint, c_nationkey int, c_acctbal double", [(1, 0, 9000.0), (2, 0, 10.0), (3, 0, 1.0)]),
        "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
                 [(k, "nut" if k < 6 else "new nut", "Brand#1", "SMALL", 1 + k % 6, 10.0 + k) for k in range(12)]),
        "orders": ("o_orderkey bigint, o_custkey bigint", [(1, 1), (2, 2), (3, 2)]),
        "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
                     [(1 + k % 3, (k * 5) % 12, 1, 1 + k % 7, 1.0 + k, 10.0 * (1 + k), 0.01 * (k % 5), 0.02, "N", "O", day + dt.timedelta(days=100 * (k % 8))) for k in range(30)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def broadcast_sides(df):
    """The plan below every broadcast, as first planned."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_connection_health_collects_no_parts(spark, folder):
    assert not [x for x in broadcast_sides(QUERIES["connection_health"](spark, folder)) if "p_partkey" in x]
    assert QUERIES["connection_health"](spark, folder).count() == 4


def test_run_summary_collects_no_parts(spark, folder):
    assert not [x for x in broadcast_sides(QUERIES["run_summary"](spark, folder)) if "p_partkey" in x]
    assert QUERIES["run_summary"](spark, folder).first().checked > 0


@pytest.mark.parametrize("name", ["menu_ranking", "finalist_pricing", "basket_line_totals", "basket_optimisation", "equivalent_demands", "reference_estimate"])
def test_lines_are_read_once(spark, folder, name):
    """What lines come to is stored as columns: neither lines nor checkpoints are read by the result."""
    out = QUERIES[name](spark, folder)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "ExistingRDD" not in plan and "stored_" in plan
    assert out.count() > 0


@pytest.mark.parametrize("name", ["basket_components", "coupled_cover"])
def test_coupled_options_collect_no_parts(spark, folder, name):
    options = baskets.coupled_options(Tables(spark, folder), baskets.neighbouring_lots())
    assert not [x for x in broadcast_sides(options.select("menu_id", "ingredient_id", "product_id")) if "p_partkey" in x]
    assert QUERIES[name](spark, folder).count() > 0
