"""Queries of the general data-preparation operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.instants import to_instants
from quantloom.operators.regular import regular_grid, unread_days
from quantloom.operators.spikes import implausible_readings
from quantloom.session import table

UST_PANEL, G10_PANEL = "rates_daily", "g10_fx_daily"


def _ust(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ust_daily").withColumn("panel_id", F.coalesce("panel_id", F.lit(UST_PANEL)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return unread_days(_ust(spark, d), table(spark, d, "market_days"))


def p1_grid_by_asset(spark: SparkSession, d: str) -> DataFrame:
    """How much of each asset's grid was observed, filled and marked missing."""
    grid = regular_grid(_ust(spark, d), table(spark, d, "market_days"))
    return grid.groupBy("asset", "status").agg(F.count("*").alias("n_days"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(table(spark, d, "g10_daily"), defaults={"panel_id": G10_PANEL}).select("reading_id")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    flagged = implausible_readings(table(spark, d, "g10_daily"), defaults={"panel_id": G10_PANEL})
    return flagged.groupBy("kind").agg(F.count("*").alias("n_readings"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return to_instants(table(spark, d, "corpus_index"), table(spark, d, "issuers")).select("entry_id", "instant_utc")


def p5_status(spark: SparkSession, d: str) -> DataFrame:
    known = to_instants(table(spark, d, "corpus_index"), table(spark, d, "issuers"))
    return known.groupBy("status").agg(F.count("*").alias("n_entries"))


QUERIES = {f.__name__: f for f in (p1_found, p1_grid_by_asset, p4_found, p4_kinds, p5_found, p5_status)}

_UST = """r AS (SELECT card_id, coalesce(panel_id, 'rates_daily') AS panel_id, asset, try_cast(CASE WHEN substr(date, 5, 1) = '-' THEN substr(date, 1, 10)
    ELSE substr(date, 1, 4) || '-' || substr(date, 5, 2) || '-' || substr(date, 7, 2) END AS date) AS d FROM ust_daily WHERE value > -5 AND value < 30 AND NOT isnan(value)),
s AS (SELECT card_id, panel_id, asset, min(d) AS a, max(d) AS b FROM r WHERE d IS NOT NULL GROUP BY ALL),
o AS (SELECT obs_day, CAST(obs_day AS date) AS od FROM market_days WHERE is_open),
g AS (SELECT s.card_id, s.panel_id, s.asset, o.obs_day, o.od FROM s JOIN o ON o.od BETWEEN s.a AND s.b),
k AS (SELECT DISTINCT coalesce(card_id, '') AS c, panel_id, asset, d FROM r),
m AS (SELECT g.*, k.d IS NOT NULL AS seen FROM g LEFT JOIN k ON k.c = coalesce(g.card_id, '') AND k.panel_id = g.panel_id AND k.asset = g.asset AND k.d = g.od)"""
_G10 = """r AS (SELECT DISTINCT reading_id, coalesce(card_id, '') AS c, coalesce(panel_id, 'g10_fx_daily') AS p, asset, try_cast(substr(date, 1, 10) AS date) AS d, value AS v
  FROM g10_daily WHERE value IS NOT NULL AND reading_id IS NOT NULL),
bad AS (SELECT reading_id FROM r WHERE isnan(v) OR isinf(v) OR v <= 0),
g AS (SELECT *, ln(v) AS x, row_number() OVER w AS rn, lag(ln(v)) OVER w AS l1 FROM r WHERE NOT (isnan(v) OR isinf(v) OR v <= 0) WINDOW w AS (PARTITION BY c, p, asset ORDER BY d, reading_id)),
t AS (SELECT c, p, asset, median(abs(x - l1)) AS m FROM g GROUP BY ALL),
h AS (SELECT g.*, t.m, abs(x - l1) AS mv, lead(x, 1) OVER w AS n1, lead(x, 2) OVER w AS n2, lead(x, 3) OVER w AS n3 FROM g JOIN t USING (c, p, asset) WINDOW w AS (PARTITION BY g.c, g.p, g.asset ORDER BY rn)),
sp AS (SELECT c, p, asset, rn, 1 AS k FROM h WHERE l1 IS NOT NULL AND n1 IS NOT NULL AND (x - greatest(l1, n1) > 15 * m OR least(l1, n1) - x > 15 * m)
  UNION ALL SELECT c, p, asset, rn, 2 FROM h WHERE l1 IS NOT NULL AND n2 IS NOT NULL AND (least(x, n1) - greatest(l1, n2) > 15 * m OR least(l1, n2) - greatest(x, n1) > 15 * m)
  UNION ALL SELECT c, p, asset, rn, 3 FROM h WHERE l1 IS NOT NULL AND n3 IS NOT NULL AND (least(x, n1, n2) - greatest(l1, n3) > 15 * m OR least(l1, n3) - greatest(x, n1, n2) > 15 * m)),
spikes AS (SELECT g.reading_id FROM g JOIN (SELECT DISTINCT c, p, asset, rn + unnest(range(k)) AS rn FROM sp) s USING (c, p, asset, rn)),
st AS (SELECT *, sum(CASE WHEN l1 IS NOT NULL AND mv < 0.02 * m THEN 0 ELSE 1 END) OVER (PARTITION BY c, p, asset ORDER BY rn) AS run FROM h),
stuck AS (SELECT reading_id FROM (SELECT *, count(*) OVER (PARTITION BY c, p, asset, run) AS n, row_number() OVER (PARTITION BY c, p, asset, run ORDER BY rn) AS i FROM st) WHERE n >= 8 AND i > 1)"""

#: The regular grid's fits, and the parsing of timestamps, are tested against brute force instead.
ORACLES = {
    "p1_found": f"WITH {_UST} SELECT card_id, panel_id, asset, obs_day FROM m WHERE NOT seen",
    "p4_kinds": f"""WITH {_G10}, a AS (SELECT reading_id, 1 AS o, 'range' AS kind FROM bad UNION ALL SELECT reading_id, 2, 'spike' FROM spikes UNION ALL SELECT reading_id, 3, 'stuck' FROM stuck)
        SELECT kind, count(*) AS n_readings FROM (SELECT reading_id, arg_min(kind, o) AS kind FROM a GROUP BY 1) GROUP BY 1""",
    "p4_found": f"WITH {_G10} SELECT reading_id FROM bad UNION SELECT reading_id FROM spikes UNION SELECT reading_id FROM stuck",
}
