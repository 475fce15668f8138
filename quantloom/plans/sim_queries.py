"""Queries of draw generators, regimes and overlays; SQL where the generator's numbers can be written in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.functions.rng import unit_seed
from quantloom.operators import overlay, panel, simulate, steps
from quantloom.plans.relations import DRAWS, FX, MONTHLY, SHIPMENTS, draws, fx, monthly, shipments, with_ctes
from quantloom.plans.score_queries import U01
from quantloom.plans.series_queries import gaps, sigmas
from quantloom.session import table

KEY = ["unit", "asset"]
CELL = [*KEY, "horizon"]
N_DRAWS = 200
M0_DRAWS = 500


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _moments(spark: SparkSession, d: str) -> DataFrame:
    """(unit, asset, horizon, anchor, drift, sd, n) of the currencies, at the horizons of their cards."""
    p = fx(spark, d)
    m = steps.moments(steps.clean_steps(p, KEY), KEY)
    last = p.groupBy(*KEY).agg(F.max_by("value", "date").alias("anchor"))
    cards = table(spark, d, "task_cards").select(F.col("card_id").alias("unit"), F.explode("horizons").alias("horizon"))
    return m.join(last, KEY).join(cards, "unit").select(*CELL, "anchor", F.col("mean").alias("drift"), F.col("sd_samp").alias("sd"), "n")


def _summary(rows: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("value"), digits).alias("mean_value"), F.round(F.stddev_samp("value"), digits).alias("sd_value"))


def walk_adapter_draws(spark: SparkSession, d: str) -> DataFrame:
    return _summary(simulate.adapter_walk(_moments(spark, d), N_DRAWS, simulate.ADAPTER_SEEDS["chronos"]), CELL)


def walk_reference_moments(spark: SparkSession, d: str) -> DataFrame:
    pairs = steps.correlations(steps.aligned(steps.clean_steps(fx(spark, d), KEY), ["unit"]), ["unit"])
    loads = simulate.factors(pairs)
    return _summary(simulate.correlated_walk(_moments(spark, d), loads, N_DRAWS, 1), CELL)


def walk_monthly_paths(spark: SparkSession, d: str) -> DataFrame:
    p = monthly(spark, d).withColumn("unit", F.lit("orders"))
    m = steps.moments(steps.monthly_steps(p, KEY), KEY)
    last = p.groupBy(*KEY).agg(F.max_by("value", "date").alias("anchor"), F.max(steps.month_index(F.col("date"))).alias("last_month"))
    cells = m.join(last, KEY).withColumn("horizon", F.explode(F.array(*map(F.lit, (1, 3, 6)))))
    cells = cells.select(*CELL, "last_month", "anchor", F.col("mean").alias("drift"), F.col("sd_samp").alias("sd"))
    return _summary(simulate.monthly_walk(cells, N_DRAWS, 3), CELL, 3)


def m0_draws(spark: SparkSession, d: str) -> DataFrame:
    """The text-blind baseline: mean, covariance and anchor of the last 300 rows at or before the card's as-of, on the dates that
    all assets of a card share. Cards without a readable as-of, or with fewer than two such dates, have none."""
    cards = table(spark, d, "task_cards").select(F.col("card_id").alias("unit"), F.col("asof").try_cast("date").alias("cut"), "horizons")
    p = steps.trailing_rows(panel.as_of(fx(spark, d).join(cards.select("unit", "cut"), "unit"), F.col("cut")), KEY)
    s = steps.aligned(steps.clean_steps(p, KEY), ["unit"])
    last = p.groupBy(*KEY).agg(F.max_by("value", "date").alias("anchor"))
    m = steps.moments(s, KEY).where("n >= 2").join(last, KEY).join(cards.select("unit", F.explode("horizons").alias("horizon")), "unit")
    cells = m.select(*CELL, "anchor", F.col("mean").alias("drift"), F.col("sd_samp").alias("sd"), "n")
    cov = steps.correlations(s, ["unit"]).select("unit", "a", "b", "cov").unionByName(
        s.groupBy("unit", F.col("asset").alias("a")).agg(F.var_samp("step").alias("cov")).select("unit", "a", F.col("a").alias("b"), "cov")
    )
    return _summary(simulate.covariance_draws(cells, cov, M0_DRAWS, 7), CELL)


def _weights(spark: SparkSession, d: str) -> DataFrame:
    days = shipments(spark, d).select("unit", "date").distinct()
    row = F.row_number().over(Window.partitionBy("unit").orderBy("date")) - 1
    return days.select("unit", row.alias("row")).select("unit", "row", (F.col("row") + 1).cast("double").alias("weight"))


def bootstrap_indexes(spark: SparkSession, d: str) -> DataFrame:
    return simulate.bootstrap_rows(_weights(spark, d), 100, 30, 8.0, 5)


def bootstrap_paths(spark: SparkSession, d: str) -> DataFrame:
    p = shipments(spark, d)
    z = steps.innovations(steps.clean_steps(p, KEY), KEY)
    w = steps.start_weights(z.groupBy("unit", "date").agg(F.max(F.abs("z")).alias("z")), ["unit"])
    row = F.row_number().over(Window.partitionBy("unit").orderBy("date")) - 1
    w = w.select("unit", "date", row.alias("row"), "weight")
    models = steps.regime(steps.clean_steps(p, KEY), KEY).join(steps.mean_reversion(p, KEY), KEY).join(p.groupBy(*KEY).agg(F.max_by("value", "date").alias("anchor")), KEY)
    models = models.select(*KEY, "anchor", F.col("sigma_now").alias("sigma"), "drift", "phi", F.lit(False).alias("log_return"))
    picks = simulate.bootstrap_rows(w, 100, 21, 8.0, 5)
    return _summary(simulate.bootstrap_paths(picks, z.join(w.select("unit", "date", "row"), ["unit", "date"]).select(*KEY, "row", "z"), models, (5, 21), 5), CELL, 3)


def pseudo_origins(spark: SparkSession, d: str) -> DataFrame:
    n = fx(spark, d).groupBy(*KEY).agg(F.count("*").alias("n"))
    return n.select(*KEY, F.explode(simulate.pseudo_origins(F.col("n"), F.lit(5))).alias("origin"))


def unit_seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task_cards").select("card_id", unit_seed(F.col("card_id")).alias("seed"))


def _models(spark: SparkSession, d: str) -> DataFrame:
    return steps.moments(steps.clean_steps(fx(spark, d), KEY), KEY).select(*KEY, F.col("sd_samp").alias("sigma"))


def synthetic_model(spark: SparkSession, d: str) -> DataFrame:
    m = _models(spark, d)
    assets = m.agg(F.sort_array(F.collect_set("asset")).alias("a")).first().a  # the currencies, a fixed list
    roster = m.select("unit").distinct().select("unit", F.explode(F.array(*map(F.lit, assets))).alias("asset"))
    return simulate.synthetic_models(roster, m).select(*KEY, "anchor", _r("sigma"))


def _ends(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task_cards").select(F.col("card_id").alias("unit"), F.col("asof").try_cast("date").alias("end"))


def basket_regime(spark: SparkSession, d: str) -> DataFrame:
    return steps.basket(fx(spark, d), ["unit"], _ends(spark, d)).select("unit", _r("ratio", 5), _r("basket"))


def stressed_sigma(spark: SparkSession, d: str) -> DataFrame:
    return steps.stressed(steps.clean_steps(fx(spark, d), KEY), KEY).select(*KEY, _r("s75"))


def transfer_rescale(spark: SparkSession, d: str) -> DataFrame:
    p = fx(spark, d)
    m = _models(spark, d).join(p.groupBy(*KEY).agg(F.max_by("value", "date").alias("anchor")), KEY)
    m = m.join(steps.stressed(steps.clean_steps(p, KEY), KEY), KEY, "left").join(steps.basket(p, ["unit"], _ends(spark, d)), "unit", "left")
    return simulate.transfer_scale(m).select(*KEY, _r("sigma_out", 5))


def apply_corrections(spark: SparkSession, d: str) -> DataFrame:
    c = spark.createDataFrame([("F", "A", 0.2, 0.8, 1.3), ("O", "R", -0.1, 1.2, 0.9)], "unit string, asset string, shift_sd double, scale_lo double, scale_hi double")
    return _summary(overlay.corrected(draws(spark, d), c, KEY), CELL, 3)


ADJ = "unit string, asset string, horizon int, scale double, drift_bp double, vol_scale double, skew double"


def overlay_adjust(spark: SparkSession, d: str) -> DataFrame:
    a = spark.createDataFrame([("F", "A", None, 50000.0, 200.0, 1.2, 0.1), ("F", "A", 3, 50000.0, -9000.0, 2.5, -0.9), ("O", "N", None, 50000.0, 30.0, 0.2, None)], ADJ)
    return _summary(overlay.adjusted(draws(spark, d), a), CELL, 3)


def scenario_mixture(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame([(1, 0.25, 1.5), (2, 0.1, 3.0)], "branch int, p double, vol double")
    k = spark.createDataFrame([(1, "A", 1.0), (2, "A", -2.0), (2, "N", 0.5)], "branch int, asset string, k double")
    return _summary(overlay.mixed_scenarios(draws(spark, d), s, k), CELL, 3)


def two_scalar_adjust(spark: SparkSession, d: str) -> DataFrame:
    a = spark.createDataFrame([("F", "A", 1e6, 3.0), ("O", "R", -500.0, 0.7)], "unit string, asset string, shift double, vol double")
    return _summary(overlay.two_scalar(draws(spark, d), a), CELL, 3)


def family_prior(spark: SparkSession, d: str) -> DataFrame:
    f = spark.createDataFrame([("F", "F4"), ("O", "F2")], "unit string, family string")
    return _summary(overlay.family_prior(draws(spark, d), f), CELL, 3)


QUERIES = {
    f.__name__: f
    for f in (
        walk_adapter_draws, walk_reference_moments, walk_monthly_paths, m0_draws, bootstrap_indexes, bootstrap_paths, pseudo_origins, unit_seeds,
        synthetic_model, basket_regime, stressed_sigma, transfer_rescale, apply_corrections, overlay_adjust, scenario_mixture, two_scalar_adjust, family_prior,
    )
}

MOMENTS = """mom AS (SELECT s.unit, s.asset, h.horizon, l.anchor, s.drift, s.sd FROM (SELECT unit, asset, avg(step) AS drift, stddev_samp(step) AS sd FROM gs GROUP BY 1, 2) s
  JOIN (SELECT unit, asset, arg_max(value, date) AS anchor FROM fx GROUP BY 1, 2) l USING (unit, asset) JOIN (SELECT card_id AS unit, unnest(horizons) AS horizon FROM task_cards) h ON h.unit = s.unit)"""


def z01(key: str) -> str:
    """SQL of a standard normal of the key's two uniforms."""
    return f"(sqrt(-2 * ln(1 - {U01.format(key=key + " || '|a'")})) * cos(2 * pi() * {U01.format(key=key + " || '|b'")}))"


_SUM = "SELECT unit, asset, horizon, count(*) AS n, round(avg(value), {n}) AS mean_value, round(stddev_samp(value), {n}) AS sd_value FROM {t} GROUP BY 1, 2, 3"
_STATS = """st AS (SELECT *, median(value) OVER c AS med, stddev_pop(value) OVER c AS sd, avg(value) OVER c AS mu FROM draws WINDOW c AS (PARTITION BY unit, asset, horizon))"""
BASKET = """kind AS (SELECT unit, asset, count(*) AS obs, median(abs(value)) < 0.5 AS ret, arg_max(value, date) AS last FROM fx GROUP BY 1, 2),
bs AS (SELECT gs.unit, gs.asset, gs.date, gs.step FROM gs JOIN kind USING (unit, asset) WHERE NOT ret UNION ALL SELECT fx.unit, fx.asset, fx.date, fx.value FROM fx JOIN kind USING (unit, asset) WHERE ret)"""
BASKETS = """nw AS (SELECT b.unit, b.asset, arg_max(sigma, date) AS now, arg_max(sigma, date) FILTER (date <= try_cast(t."asof" AS date)) AS was FROM b JOIN task_cards t ON b.unit = t.card_id GROUP BY 1, 2),
basket AS (SELECT unit, median(CASE WHEN obs >= 120 AND was > 0 THEN greatest(0.5, least(3.0, now / was)) END) AS ratio, median(CASE WHEN obs >= 60 AND last <> 0 THEN now / abs(last) END) AS basket
  FROM nw JOIN kind USING (unit, asset) GROUP BY 1)"""

ORACLES = {
    "walk_adapter_draws": with_ctes(FX, gaps("fx"), MOMENTS, f"""w AS (SELECT unit, asset, horizon, anchor + drift * horizon + greatest(sd, 1e-4 * abs(anchor), 1e-6) * sqrt(horizon) *
        {z01("'11|' || draw || '|' || horizon || '|' || asset")} AS value FROM mom, (SELECT unnest(range({N_DRAWS})) AS draw))""", select=_SUM.format(n=6, t="w")),
    "walk_monthly_paths": with_ctes(MONTHLY, f"""ms AS (SELECT asset, value - lag(value) OVER w AS step, date_diff('month', lag(date) OVER w, date) AS g FROM monthly WINDOW w AS (PARTITION BY asset ORDER BY date)),
        mm AS (SELECT asset, avg(step) AS drift, stddev_samp(step) AS sd FROM ms WHERE g = 1 GROUP BY 1), l AS (SELECT asset, arg_max(value, date) AS anchor, max(year(date) * 12 + month(date) - 1) AS lm FROM monthly GROUP BY 1),
        z AS (SELECT asset, draw, m, {z01("'3|' || draw || '|' || (lm + m) || '|' || asset")} AS z FROM l, (SELECT unnest(range({N_DRAWS})) AS draw), (SELECT unnest(range(1, 7)) AS m)),
        w AS (SELECT 'orders' AS unit, z.asset, h.horizon, draw, max(anchor) + max(drift) * h.horizon + max(sd) * sum(z) AS value FROM z JOIN mm USING (asset) JOIN l USING (asset), (SELECT unnest([1, 3, 6]) AS horizon) h
          WHERE m <= h.horizon GROUP BY 1, 2, 3, 4)""", select=_SUM.format(n=3, t="w")),
    "bootstrap_indexes": with_ctes(SHIPMENTS, f"""r AS (SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY date) - 1 AS i FROM (SELECT DISTINCT unit, date FROM shipments)),
        c AS (SELECT unit, i, sum(i + 1.0) OVER (PARTITION BY unit ORDER BY i) AS c, count(*) OVER (PARTITION BY unit) AS n, sum(i + 1.0) OVER (PARTITION BY unit) AS total FROM r),
        u AS (SELECT unit, max(n) AS n, max(total) AS total FROM c GROUP BY 1),
        s AS (SELECT unit, n, total, draw, t, {U01.format(key="'5|' || draw || '|' || t || '|block'")} AS u, {U01.format(key="'5|' || draw || '|' || t || '|start'")} AS v FROM u, (SELECT unnest(range(100)) AS draw), (SELECT unnest(range(30)) AS t)),
        o AS (SELECT *, CASE WHEN t = 0 OR u >= 0.875 THEN least((SELECT count(*) FROM c WHERE c.unit = s.unit AND c.c <= s.v * s.total), n - 1) END AS start FROM s),
        p AS (SELECT unit, draw, t, n, last_value(start IGNORE NULLS) OVER w AS b, last_value(CASE WHEN start IS NOT NULL THEN t END IGNORE NULLS) OVER w AS opened FROM o WINDOW w AS (PARTITION BY unit, draw ORDER BY t))""",
        select='SELECT unit, CAST(draw AS INT) AS draw, CAST(t AS INT) AS t, CAST((b + t - opened) % n AS INT) AS "row" FROM p'),
    "pseudo_origins": with_ctes(FX, "n AS (SELECT unit, asset, count(*) AS n FROM fx GROUP BY 1, 2), o AS (SELECT unit, asset, unnest(range(CAST(greatest(floor(n / 5), 40) AS BIGINT), n - 6, 8)) AS origin FROM n)",
        select="SELECT unit, asset, CAST(origin AS INT) AS origin FROM o QUALIFY row_number() OVER (PARTITION BY unit, asset ORDER BY origin DESC) <= 14"),
    "synthetic_model": with_ctes(FX, gaps("fx"), "m AS (SELECT unit, asset, stddev_samp(step) AS s FROM gs GROUP BY 1, 2)", select="""SELECT u.unit, a.asset, CAST(1.0 AS DOUBLE) AS anchor, round(2 * coalesce(u.s, 0.5), 6) AS sigma
        FROM (SELECT unit, median(s) AS s FROM m GROUP BY 1) u, (SELECT DISTINCT asset FROM m) a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.unit = u.unit AND m.asset = a.asset)"""),
    "basket_regime": with_ctes(FX, gaps("fx"), BASKET, sigmas("bs", "b"), BASKETS, select="SELECT unit, round(ratio, 5) AS ratio, round(basket, 6) AS basket FROM basket"),
    "stressed_sigma": with_ctes(FX, gaps("fx"), sigmas("gs"), select="SELECT unit, asset, round(quantile_cont(sigma, 0.75), 6) AS s75 FROM e GROUP BY 1, 2 HAVING count(*) >= 30"),
    "transfer_rescale": with_ctes(FX, gaps("fx"), sigmas("gs"), BASKET, sigmas("bs", "b"), BASKETS, """m AS (SELECT unit, asset, stddev_samp(step) AS sigma FROM gs GROUP BY 1, 2),
        s75 AS (SELECT unit, asset, quantile_cont(sigma, 0.75) AS s75 FROM e GROUP BY 1, 2 HAVING count(*) >= 30),
        f AS (SELECT m.unit, m.asset, ratio, greatest(sigma, coalesce(s75, 0), CASE WHEN coalesce(basket, 0) = 0 OR last = 0 THEN sigma ELSE 0.8 * 1.5 * basket * abs(last) END) AS base
          FROM m LEFT JOIN s75 USING (unit, asset) LEFT JOIN basket USING (unit) JOIN kind USING (unit, asset))""",
        select="SELECT unit, asset, round(least(base * greatest(coalesce(ratio, 1.0), 1.0), 4 * base), 5) AS sigma_out FROM f"),
    "apply_corrections": with_ctes(DRAWS, _STATS, """w AS (SELECT unit, asset, horizon, CASE WHEN sd > 0 THEN med + (value - med) * CASE WHEN unit || asset = 'FA' THEN CASE WHEN value > med THEN 1.3 ELSE 0.8 END
        WHEN unit || asset = 'OR' THEN CASE WHEN value > med THEN 0.9 ELSE 1.2 END ELSE 1.0 END + sd * CASE unit || asset WHEN 'FA' THEN 0.2 WHEN 'OR' THEN -0.1 ELSE 0.0 END ELSE value END AS value FROM st)""",
        select=_SUM.format(n=3, t="w")),
    "overlay_adjust": with_ctes(DRAWS, _STATS, """p AS (SELECT *, CASE WHEN unit || asset = 'FA' THEN CASE WHEN horizon = 3 THEN -9000.0 ELSE 200.0 END WHEN unit || asset = 'ON' THEN 30.0 END AS bp,
        CASE WHEN unit || asset = 'FA' THEN CASE WHEN horizon = 3 THEN 1.6 ELSE 1.2 END ELSE 0.7 END AS v, CASE WHEN unit || asset = 'FA' THEN CASE WHEN horizon = 3 THEN -0.5 ELSE 0.1 END ELSE 0.0 END AS k FROM st),
        w AS (SELECT unit, asset, horizon, CASE WHEN bp IS NULL THEN value ELSE med + (value - med) * CASE WHEN value > med THEN 1 + k ELSE 1 - k END * v + greatest(-1.5 * sd, least(1.5 * sd, 50000.0 * bp / 1e4)) END AS value FROM p)""",
        select=_SUM.format(n=3, t="w")),
    "scenario_mixture": with_ctes(DRAWS, """b AS (SELECT *, CASE WHEN draw < round_even(0.25 * n, 0) THEN 1 WHEN draw < round_even(0.25 * n, 0) + round_even(0.1 * n, 0) THEN 2 ELSE 0 END AS br
          FROM (SELECT *, count(*) OVER w AS n, stddev_pop(value) OVER w AS sd FROM draws WINDOW w AS (PARTITION BY unit, asset, horizon))),
        m AS (SELECT *, median(value) OVER (PARTITION BY unit, asset, horizon, br) AS med, CASE WHEN br = 1 THEN 1.5 WHEN br = 2 THEN 2.0 ELSE 1.0 END AS v,
          CASE WHEN br = 1 AND asset = 'A' THEN 1.0 WHEN br = 2 AND asset = 'A' THEN -2.0 WHEN br = 2 AND asset = 'N' THEN 0.5 ELSE 0.0 END AS k FROM b),
        w AS (SELECT unit, asset, horizon, CASE WHEN k = 0 THEN value ELSE med + (value - med) * v + k * sd END AS value FROM m)""", select=_SUM.format(n=3, t="w")),
    "two_scalar_adjust": with_ctes(DRAWS, _STATS, """w AS (SELECT unit, asset, horizon, mu + (value - mu) * CASE unit || asset WHEN 'FA' THEN 2.0 WHEN 'OR' THEN 0.7 ELSE 1.0 END
        + CASE unit || asset WHEN 'FA' THEN least(1e6, 3 * sd) WHEN 'OR' THEN greatest(-500.0, -3 * sd) ELSE 0.0 END AS value FROM st)""", select=_SUM.format(n=3, t="w")),
    "family_prior": with_ctes(DRAWS, _STATS, """w AS (SELECT unit, asset, horizon, med + (value - med) * CASE WHEN unit = 'F' THEN 2.2 * CASE WHEN value > med THEN 0.65 ELSE 1.35 END ELSE 1.5 * CASE WHEN value > med THEN 0.85 ELSE 1.15 END END AS value FROM st)""",
        select=_SUM.format(n=3, t="w")),
}
