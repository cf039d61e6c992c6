"""Registry, and the trial's tables as views of the driver's tables (Spark and SQL side by side).

Every query reads its tables whole. Remainders of ids only shape what the tables stand for: which
logger a user is, which cells a second source lacks or alters. They never shrink the work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.slices import shift
from ..session import prepare

# counts to engineering units; also keeps means of two-digit numbers off exact rounding ties (the factor is irrational), where
# the order of a floating-point sum would decide the last digit
UNIT = 1.7320508075688772

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """`events` as long readings: the user gives logger and depth, the event type the variable."""
    user = F.col("user_id")
    names = F.create_map(*[F.lit(x) for x in (
        "click", "VWC", "view", "precip", "purchase", "EC", "error", "BattV_Min", "signup", "T")])
    return table(spark, sf, "events").select(
        F.col("ts"),
        F.concat(F.lit("S"), (user % 4 + 1).cast("string")).alias("strip"),
        F.element_at(F.array(F.lit("T"), F.lit("M"), F.lit("B")), (F.floor(user / 4) % 3 + 1).cast("int")).alias("location"),
        (F.floor(user / 12) % 3 + 1).cast("string").alias("depth"),
        names[F.col("event_type")].alias("variable"),
        (F.col("value") / UNIT).alias("value"),
        F.col("event_id").alias("row_no"),
    )


READINGS = """readings AS (
  SELECT ts, 'S' || CAST(user_id % 4 + 1 AS VARCHAR) AS strip,
    CASE (user_id // 4) % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'M' ELSE 'B' END AS location,
    CAST((user_id // 12) % 3 + 1 AS VARCHAR) AS depth,
    CASE event_type WHEN 'click' THEN 'VWC' WHEN 'view' THEN 'precip' WHEN 'purchase' THEN 'EC'
      WHEN 'error' THEN 'BattV_Min' ELSE 'T' END AS variable,
    value / 1.7320508075688772::DOUBLE AS value, event_id AS row_no
  FROM events)"""


def irrigation(spark: SparkSession, sf: str) -> DataFrame:
    """Every purchase as an irrigation event: 1 to 12 hours long, a thousand gallons per unit."""
    user = F.col("user_id")
    return table(spark, sf, "events").filter("event_type = 'purchase'").select(
        F.col("event_id"),
        F.concat(F.lit("S"), (user % 4 + 1).cast("string")).alias("strip"),
        F.element_at(F.array(F.lit("T"), F.lit("M"), F.lit("B")), (F.floor(user / 4) % 3 + 1).cast("int")).alias("location"),
        F.col("ts").alias("start"),
        shift("ts", (F.floor(F.col("value")) % 12 + 1) * 3600).alias("end"),
        (F.col("value") / UNIT * 1000.0).alias("gallons_strip"),
        F.year("ts").alias("year"),
    )


IRRIGATION = """irrigation AS (
  SELECT event_id, 'S' || CAST(user_id % 4 + 1 AS VARCHAR) AS strip,
    CASE (user_id // 4) % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'M' ELSE 'B' END AS location,
    ts AS start, ts + to_hours(CAST(floor(value) AS BIGINT) % 12 + 1) AS "end",
    value / 1.7320508075688772::DOUBLE * 1000.0 AS gallons_strip, year(ts) AS year
  FROM events WHERE event_type = 'purchase')"""


def order_times(spark: SparkSession, sf: str) -> DataFrame:
    """`orders` as a long history: hour and quarter from the key, so days are filled."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_no"),
        shift("o_orderdate", key % 24 * 3600 + F.floor(key / 24) % 4 * 900).alias("ts"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("variable"),
        (F.col("o_totalprice") / 3.141592653589793).alias("value"),
    )


ORDER_TIMES = """order_times AS (
  SELECT o_orderkey AS row_no,
    o_orderdate + to_hours(o_orderkey % 24) + to_minutes((o_orderkey // 24) % 4 * 15) AS ts,
    o_orderstatus AS status, o_orderpriority AS variable, o_totalprice / 3.141592653589793::DOUBLE AS value
  FROM orders)"""
