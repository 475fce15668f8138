"""The reference relations (panel, draws, realized) made from the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.session import table


def fx(spark: SparkSession, d: str) -> DataFrame:
    """Panel (unit, asset, date, value): the spot rates by card and currency, a day's mean of finite positive values."""
    g = table(spark, d, "g10_daily").select(F.col("card_id").alias("unit"), "asset", F.substring("date", 1, 10).try_cast("date").alias("date"), "value")
    return g.where("value > 0 and value < double('infinity') and date is not null").groupBy("unit", "asset", "date").agg(F.avg("value").alias("value"))


FX = """fx AS (SELECT card_id AS unit, asset, try_cast(substr(date, 1, 10) AS date) AS date, avg(value) AS value FROM g10_daily
  WHERE value > 0 AND isfinite(value) AND try_cast(substr(date, 1, 10) AS date) IS NOT NULL GROUP BY 1, 2, 3)"""


def shipments(spark: SparkSession, d: str) -> DataFrame:
    """Panel (unit, asset, date, value): mean price a day by line status and return flag."""
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_linestatus").alias("unit"), F.col("l_returnflag").alias("asset"), F.to_date("l_shipdate").alias("date"))
        .agg(F.avg("l_extendedprice").alias("value"))
    )


SHIPMENTS = """shipments AS (SELECT l_linestatus AS unit, l_returnflag AS asset, CAST(l_shipdate AS date) AS date, avg(l_extendedprice) AS value
  FROM lineitem GROUP BY 1, 2, 3)"""


def returns(spark: SparkSession, d: str) -> DataFrame:
    """Panel (asset, date, value) of simple returns: relative changes of the daily mean order price by priority."""
    p = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("p"))
    return p.select("asset", "date", (F.col("p") / F.lag("p").over(Window.partitionBy("asset").orderBy("date")) - 1).alias("value")).where("value is not null")


RETURNS = """prices AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS date) AS date, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2),
returns AS (SELECT * FROM (SELECT asset, date, p / lag(p) OVER (PARTITION BY asset ORDER BY date) - 1 AS value FROM prices) WHERE value IS NOT NULL)"""


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Panel (asset, date, value): orders rolled up to month starts."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("asset"), F.trunc("o_orderdate", "MM").alias("date")).agg(F.avg("o_totalprice").alias("value"))


MONTHLY = """monthly AS (SELECT o_orderpriority AS asset, CAST(date_trunc('month', o_orderdate) AS date) AS date, avg(o_totalprice) AS value
  FROM orders GROUP BY 1, 2)"""


def draws(spark: SparkSession, d: str) -> DataFrame:
    """Draws (unit, asset, horizon, draw, value): prices numbered within line status, return flag and line number."""
    order = Window.partitionBy("unit", "asset", "horizon").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "value", "l_shipdate")
    rows = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("unit"), F.col("l_returnflag").alias("asset"), F.col("l_linenumber").alias("horizon"), F.col("l_extendedprice").alias("value"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate",
    )
    return rows.select("unit", "asset", "horizon", (F.row_number().over(order) - 1).alias("draw"), "value")


DRAWS = """draws AS (SELECT l_linestatus AS unit, l_returnflag AS asset, l_linenumber AS horizon,
  row_number() OVER (PARTITION BY l_linestatus, l_returnflag, l_linenumber
    ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS draw, l_extendedprice AS value FROM lineitem)"""


def realized(spark: SparkSession, d: str) -> DataFrame:
    """Realized (unit, asset, horizon, value): the outcome of a cell, a quantile of its prices after discount."""
    li = table(spark, d, "lineitem")
    cell = [F.col("l_linestatus").alias("unit"), F.col("l_returnflag").alias("asset"), F.col("l_linenumber").alias("horizon")]
    return li.groupBy(*cell).agg(F.percentile(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.lit(0.6)).alias("value"))


REALIZED = """realized AS (SELECT l_linestatus AS unit, l_returnflag AS asset, l_linenumber AS horizon,
  quantile_cont(l_extendedprice * (1 - l_discount), 0.6) AS value FROM lineitem GROUP BY 1, 2, 3)"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
