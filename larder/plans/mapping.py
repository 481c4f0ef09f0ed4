"""How the driver's tables stand in for the domain tables, in Spark and in SQL.

    product       part            code, name, brand, category, list price, pack size
    price row     lineitem        (store = supplier, code = part, observed_at = ship date)
    full scan     lineitem        (store = region, revision = ship year, code = part)
    recipe line   lineitem        (recipe = order, index = line number, quantity)
    menu          customer        its orders
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import ore
from ..operators.versions import first_per_key, latest_per_key
from .registry import Tables


def list_price_ore() -> Column:
    return ore(F.col("p_retailprice") * 100)


def products(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.lower("p_type").alias("category"), F.col("p_size").alias("size"), list_price_ore().alias("price_ore"))


PRODUCTS = """products AS (
  SELECT p_partkey AS code, p_name AS name, p_brand AS brand, lower(p_type) AS category, p_size AS size,
         CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS price_ore FROM part)"""


def price_rows(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("store"), F.col("l_partkey").alias("code"), F.col("l_shipdate").alias("observed_at"),
        "l_orderkey", "l_linenumber", ore(F.col("l_extendedprice") / F.col("l_quantity") * 100).alias("price_ore"))
    return first_per_key(rows, ["store", "code", "observed_at"], ["l_orderkey", "l_linenumber"]).drop("l_orderkey", "l_linenumber")


PRICE_ROWS = """price_rows AS (
  SELECT l_suppkey AS store, l_partkey AS code, l_shipdate AS observed_at,
         CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS price_ore
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_shipdate ORDER BY l_orderkey, l_linenumber) = 1)"""


FIRST_YEAR = 1994


def scans(t: Tables, since: int | None = None, before: int | None = None) -> DataFrame:
    """One full scan per (region, year): the last row of each part in that year.

    Revisions ``since`` up to, but not including, ``before``: as dates, which reach the scan of the lines.
    """
    lines = t.lineitem
    for bound, inside in ((since, F.col("l_shipdate").__ge__), (before, F.col("l_shipdate").__lt__)):
        if bound is not None:
            lines = lines.filter(inside(F.lit(dt.datetime(FIRST_YEAR + bound, 1, 1)).cast(lines.schema["l_shipdate"].dataType)))
    where = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("store"))
    rows = lines.join(where, "l_suppkey").select(
        "store", (F.year("l_shipdate") - FIRST_YEAR).alias("revision"), F.col("l_partkey").alias("code"),
        ((100 - F.round(F.col("l_discount") * 100)) * 100).cast("bigint").alias("price_ore"), F.col("l_linestatus").alias("stock"),
        F.col("l_shipdate").alias("observed_at"), "l_orderkey", "l_linenumber")
    last = latest_per_key(rows, ["store", "revision", "code"], ["observed_at", "l_orderkey", "l_linenumber"])
    return last.drop("l_orderkey", "l_linenumber").withColumn("content", F.concat_ws(":", "price_ore", "stock"))


SCANS = """scans AS (
  SELECT n_regionkey AS store, CAST(year(l_shipdate) - 1994 AS INTEGER) AS revision, l_partkey AS code,
         CAST((100 - round(l_discount * 100)) * 100 AS BIGINT) AS price_ore, l_linestatus AS stock, l_shipdate AS observed_at,
         CAST((100 - round(l_discount * 100)) * 100 AS BIGINT) || ':' || l_linestatus AS content
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  QUALIFY row_number() OVER (PARTITION BY n_regionkey, year(l_shipdate), l_partkey
                             ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1)"""


def states(flag: str) -> Column:
    return F.when(F.col(flag) == "A", "yes").when(F.col(flag) == "N", "no").otherwise("unknown")


STATE = "CASE WHEN l_returnflag = 'A' THEN 'yes' WHEN l_returnflag = 'N' THEN 'no' ELSE 'unknown' END"


def sql(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body if ctes else body


def stamp(ts: Column) -> Column:
    """Timestamps as text, so that both engines print them alike."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def sql_week_end(expr: str) -> str:
    local = f"timezone('Europe/Stockholm', timezone('UTC', {expr}))"
    return f"timezone('UTC', timezone('Europe/Stockholm', date_trunc('week', {local}) + INTERVAL 7 DAY))"
