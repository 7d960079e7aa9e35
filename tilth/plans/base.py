"""How queries are registered, and the domain's tables as read from the star schema.

An observation is an event (user = parcel, type = sensor, props.k = cloud cover in per cent); a plot is an order and its
holder a customer; a crop cycle is a line item (sown at shipping, as many days long as its quantity); daily weather is
the orders of a nation and day; a map label is a return flag and its reference a line status.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ANCHOR = "2024-01-01"


def query(sql: str | None = None, name: str | None = None):
    """Registers the function under its own name, with SQL for the same rows if there is any."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are called {key}")
        QUERIES[key] = f
        if sql:
            SQL[key] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, parcel_id, day, sensor, cloud and signal; rows of type error are masked (no signal)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("obs_id"),
        F.col("user_id").alias("parcel_id"),
        F.col("ts").cast("date").alias("day"),
        F.col("event_type").alias("sensor"),
        F.get_json_object("props", "$.k").cast("int").alias("cloud"),
        F.when(F.col("event_type") != "error", F.col("value") / (F.col("value") + 50)).alias("signal"),
    )


OBS = """obs AS (
  SELECT event_id AS obs_id, user_id AS parcel_id, CAST(ts AS DATE) AS day, event_type AS sensor,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS cloud,
         CASE WHEN event_type <> 'error' THEN value / (value + 50) END AS signal
  FROM events)"""


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cycle_id (order and line), parcel_id (supplier), crop (part), sown, harvested (exclusive), days, area."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("cycle_id"),
        F.col("l_suppkey").alias("parcel_id"),
        F.col("l_partkey").alias("crop_id"),
        F.col("l_shipdate").cast("date").alias("sown"),
        F.date_add(F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int")).alias("harvested"),
        F.col("l_quantity").cast("int").alias("days"),
        (F.col("l_extendedprice") / 10000).alias("area_ha"),
    )


CYCLES = """cycles AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS cycle_id, l_suppkey AS parcel_id, l_partkey AS crop_id,
         CAST(l_shipdate AS DATE) AS sown, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS harvested,
         CAST(l_quantity AS INTEGER) AS days, l_extendedprice / 10000 AS area_ha
  FROM lineitem)"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell (nation), day, rain in mm and n (orders of the day). Sums are exact, so no value hangs on the order of rows."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return joined.groupBy(F.col("c_nationkey").alias("cell"), F.col("o_orderdate").cast("date").alias("day")).agg((F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double") / 20000).alias("rain"), F.count(F.lit(1)).alias("n"))


WEATHER = """weather AS (
  SELECT c_nationkey AS cell, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(15, 2))) AS DOUBLE) / 20000 AS rain, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
