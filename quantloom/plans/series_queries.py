"""Queries of panels, steps and their alignment, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import panel, steps
from quantloom.plans.relations import FX, MONTHLY, RETURNS, SHIPMENTS, fx, monthly, returns, shipments, with_ctes
from quantloom.session import table

KEY = ["unit", "asset"]
CUTOFF = "2000-06-30"


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def panel_asof_series(spark: SparkSession, d: str) -> DataFrame:
    """The last value of each series at or before its card's as-of date."""
    cards = table(spark, d, "task_cards").select(F.col("card_id").alias("unit"), F.col("asof").try_cast("date").alias("cut"))
    rows = fx(spark, d).join(cards, "unit")
    return panel.last_values(rows, F.col("cut"), KEY).select(*KEY, "last_date", "n_obs", _r("anchor"))


def panel_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Of two panels with an asset, the first by name that has rows before the cutoff; the last row of a day."""
    li = table(spark, d, "lineitem")
    rows = li.select(
        F.concat(F.lit("panel_"), F.lower("l_linestatus")).alias("panel_id"), F.col("l_returnflag").alias("asset"), F.to_date("l_shipdate").alias("date"),
        F.col("l_extendedprice").alias("value"), F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("row_no"),
    )
    return panel.first_panel_series(rows, F.lit(CUTOFF).cast("date")).select("panel_id", "asset", "date", _r("value", 2))


def panel_late_rows(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "task_cards").select(F.col("card_id").alias("unit"), F.col("asof").try_cast("date").alias("asof"))
    return panel.look_ahead(fx(spark, d), cards, "unit")


def panel_profile(spark: SparkSession, d: str) -> DataFrame:
    return panel.profile(fx(spark, d), "unit")


def strict_instant_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Corpus timestamps against the end of 2018-06-30: late, in time or unreadable, with what instants are exact to the nanosecond."""
    t = F.col("timestamp")
    late = panel.strictly_late(t, F.lit("2018-06-30").cast("date"))
    rows = table(spark, d, "corpus_index").select(late.alias("late"), panel.instant(t).alias("at"))
    return rows.groupBy("late").agg(F.count("*").alias("n"), F.count("at").alias("n_instants"), F.max("at.seconds").alias("last_second"), F.sum("at.nanos").alias("nanos"))


def asof_resolution(spark: SparkSession, d: str) -> DataFrame:
    own = F.col("asof").try_cast("date")
    rows = table(spark, d, "task_cards").select("card_id", panel.resolved_as_of(F.lit("2016-12-31").cast("date"), own).alias("resolved"))
    return rows


def value_at_dates(spark: SparkSession, d: str) -> DataFrame:
    """Each series' value at or before the first day of every quarter."""
    p = fx(spark, d)
    points = p.select(*KEY, F.trunc("date", "quarter").alias("at")).distinct()
    return panel.value_at(p, points, KEY).select(*KEY, "at", _r("found"))


def locf_fill(spark: SparkSession, d: str) -> DataFrame:
    """Open days between a series' first and last, filled from at most three open days before; days on which two or more of a
    card's series stay missing are left out."""
    days = table(spark, d, "market_days").where("is_open").select(F.col("obs_day").cast("date").alias("date"))
    filled = panel.carried_forward(fx(spark, d), days, KEY)
    return filled.groupBy(*KEY).agg(F.count("*").alias("n_days"), F.count_if(F.col("carried") & F.col("value").isNotNull()).alias("n_carried"), F.round(F.sum("value"), 4).alias("total"))


def business_day_offset(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "market_days").select(F.col("obs_day").cast("date").alias("day"))
    return days.select("day", *(panel.business_day(F.col("day"), h).alias(f"h{h}") for h in (1, 5, 21)))


def cross_unit_leak_join(spark: SparkSession, d: str) -> DataFrame:
    """Last values of each card's series that stand in another card's panel on the same day."""
    p = fx(spark, d).withColumn("value", F.round("value", 3))
    last = p.groupBy(*KEY).agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))
    return panel.leaked_outcomes(last, p)


def targets_present_missing(spark: SparkSession, d: str) -> DataFrame:
    """Currencies that a card's panel has, and how many of the roster's are missing."""
    p = fx(spark, d).select(*KEY).distinct()
    roster = p.select("asset").distinct()
    have = p.groupBy("unit").agg(F.count("*").alias("n_present"), F.sort_array(F.collect_set("asset")).alias("a"))
    total = roster.agg(F.count("*").alias("n"))
    n = total.first().n  # one number
    return have.select("unit", "n_present", (F.lit(n) - F.col("n_present")).alias("n_missing"), F.array_join("a", ",").alias("present"))


def steps_level_gap_trailing300(spark: SparkSession, d: str) -> DataFrame:
    return steps.clean_steps(fx(spark, d), KEY).groupBy(*KEY).agg(F.count("*").alias("n_steps"), F.round(F.sum("step"), 6).alias("total"), F.round(F.max(F.abs("step")), 6).alias("largest"))


def steps_gap_full_history(spark: SparkSession, d: str) -> DataFrame:
    rows = steps.gap_limits(fx(spark, d), KEY)
    return rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if("hole").alias("n_holes"), F.max("gap").alias("widest"))


def steps_log_return(spark: SparkSession, d: str) -> DataFrame:
    return steps.log_return_steps(returns(spark, d), ["asset"]).select("asset", "date", _r("step"))


def return_panel_tripwire(spark: SparkSession, d: str) -> DataFrame:
    g = returns(spark, d).groupBy("asset").agg(F.median(F.abs("value")).alias("median_abs"))
    return g.select("asset", _r("median_abs"), (F.col("median_abs") >= 0.2).alias("refused"))


def cadence_by_asset(spark: SparkSession, d: str) -> DataFrame:
    both = shipments(spark, d).select(F.concat("unit", "asset").alias("asset"), "date", "value").unionByName(monthly(spark, d))
    return steps.cadence(both, ["asset"])


def dense_daily_flag(spark: SparkSession, d: str) -> DataFrame:
    return steps.cadence(fx(spark, d), KEY).select(*KEY, "dense_daily", "cadence")


def monthly_series_check(spark: SparkSession, d: str) -> DataFrame:
    return steps.monthly_check(monthly(spark, d), ["asset"])


def monthly_consecutive_steps(spark: SparkSession, d: str) -> DataFrame:
    return steps.monthly_steps(monthly(spark, d), ["asset"]).select("asset", "date", _r("step", 4))


def ewma_path(spark: SparkSession, d: str) -> DataFrame:
    return steps.ewma(steps.clean_steps(shipments(spark, d), KEY), KEY).select(*KEY, "date", _r("sigma", 3))


def ewma_last_sigma(spark: SparkSession, d: str) -> DataFrame:
    return steps.ewma(steps.clean_steps(fx(spark, d), KEY), KEY).groupBy(*KEY).agg(F.round(F.max_by("sigma", "date"), 6).alias("sigma"))


def rolling_drift(spark: SparkSession, d: str) -> DataFrame:
    return steps.rolling_drift(steps.clean_steps(shipments(spark, d), KEY), KEY).select(*KEY, "date", F.round(F.col("drift") + 1e-9, 6).alias("drift"))


def zscore_clipped(spark: SparkSession, d: str) -> DataFrame:
    z = steps.innovations(steps.clean_steps(shipments(spark, d), KEY), KEY)
    return z.groupBy(*KEY).agg(F.count("z").alias("n"), F.round(F.avg("z"), 4).alias("mean_z"), F.round(F.stddev_samp("z"), 4).alias("sd_z"), F.round(F.max(F.abs("z")), 4).alias("max_z"))


def regime_sigma_drift(spark: SparkSession, d: str) -> DataFrame:
    return steps.regime(steps.clean_steps(fx(spark, d), KEY), KEY).select(*KEY, "n_steps", _r("sigma_full"), _r("sigma_now"), _r("drift"))


def mean_reversion_phi(spark: SparkSession, d: str) -> DataFrame:
    return steps.mean_reversion(shipments(spark, d), KEY).select(*KEY, "n", _r("phi_hat"), _r("t", 4), _r("phi"))


def recency_crisis_weights(spark: SparkSession, d: str) -> DataFrame:
    z = steps.innovations(steps.clean_steps(shipments(spark, d), KEY), KEY).groupBy("unit", "date").agg(F.max(F.abs("z")).alias("z"))
    w = steps.start_weights(z, ["unit"])
    return w.groupBy("unit").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight") * 1000, 6).alias("most"), F.round(F.min("weight") * 1000, 6).alias("least"))


def month_steps(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "task_cards").select("card_id", F.col("asof").try_cast("date").alias("day"))
    return cards.select("card_id", steps.month_index(F.col("day")).alias("month"), F.date_format("day", "yyyy-MM").alias("period"))


def horizon_steps_rounding(spark: SparkSession, d: str) -> DataFrame:
    """Months in a horizon of days (halves to even, at least one), and whether a panel's own count overrides the declared one."""
    h = table(spark, d, "task_cards").select("card_id", F.explode("horizons").alias("horizon"), "n_assets")
    months = F.greatest(F.lit(1), F.bround(F.col("horizon") / 21.0).cast("int"))
    counted = F.col("horizon") * (F.col("n_assets") % 3 + 1)
    ratio = F.greatest(counted, F.col("horizon")) / F.greatest(F.least(counted, F.col("horizon")), F.lit(1))
    return h.select("card_id", "horizon", months.alias("months"), F.when(ratio >= 2, counted).otherwise(F.col("horizon")).alias("m0_steps"))


def overlapping_changes(spark: SparkSession, d: str) -> DataFrame:
    return steps.overlapping_changes(fx(spark, d), KEY, 21).select(*KEY, "n", _r("sd_h"), "n_apart")


def transfer_flag(spark: SparkSession, d: str) -> DataFrame:
    return steps.transfer(fx(spark, d), KEY, 60)


def aligned_steps_inner(spark: SparkSession, d: str) -> DataFrame:
    a = steps.aligned(steps.clean_steps(fx(spark, d), KEY), ["unit"])
    return a.groupBy("unit").agg(F.count("*").alias("n_rows"), F.count_distinct("date").alias("n_dates"), F.round(F.sum("step"), 6).alias("total"))


def aligned_steps_outer_zero(spark: SparkSession, d: str) -> DataFrame:
    a = steps.aligned(steps.clean_steps(fx(spark, d), KEY), ["unit"], outer=True)
    return a.groupBy("unit").agg(F.count("*").alias("n_rows"), F.count_if(F.col("step") == 0).alias("n_zero"), F.round(F.sum("step"), 6).alias("total"))


def asset_moments_samp_pop(spark: SparkSession, d: str) -> DataFrame:
    return steps.moments(steps.clean_steps(fx(spark, d), KEY), KEY).select(*KEY, "n", _r("mean"), _r("sd_samp"), _r("sd_pop"))


def asset_corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return steps.correlations(steps.aligned(steps.clean_steps(shipments(spark, d), KEY), ["unit"]), ["unit"]).select("unit", "a", "b", "n", _r("corr"), _r("cov", 0))


def panel_mean_gap(spark: SparkSession, d: str) -> DataFrame:
    return steps.mean_gap(fx(spark, d), KEY).select(*KEY, "n_gaps", _r("mean_gap"))


def monthly_horizon_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Horizons of the monthly order panel mapped to steps; the second spelling of one period is a month off."""
    p = monthly(spark, d).select(F.lit("orders").alias("unit"), "asset", "date")
    last = p.groupBy("unit", "asset").agg(F.max("date").alias("last"))
    cells = last.select("unit", "asset", "last", F.explode(F.array(*map(F.lit, (-1, 1, 3, 6, 9)))).alias("horizon"))
    first = cells.where("horizon != 9").select("unit", "asset", "horizon", F.date_format(F.add_months("last", F.col("horizon")), "yyyy-MM").alias("period"))
    off = F.when(F.col("asset") == "5-LOW", 1).otherwise(0)
    second = cells.where("horizon = 3").select("unit", "asset", "horizon", F.date_format(F.add_months("last", F.col("horizon") + off), "yyyy-MM").alias("period"))
    months = last.select("unit", "asset", steps.month_index(F.col("last")).alias("last_month"))
    return steps.monthly_horizons(cells, first.unionByName(second), months)


def monthly_path_gate(spark: SparkSession, d: str) -> DataFrame:
    check = steps.monthly_check(monthly(spark, d), ["asset"]).select(F.col("asset").alias("unit"), "is_monthly")
    codes = monthly_horizon_mapping(spark, d).where("horizon in (1, 3)").select(F.col("asset").alias("unit"), "code")
    return steps.monthly_gate(check, codes)


QUERIES = {
    f.__name__: f
    for f in (
        panel_asof_series, panel_first_wins, panel_late_rows, panel_profile, strict_instant_cutoff, asof_resolution, value_at_dates, locf_fill,
        business_day_offset, cross_unit_leak_join, targets_present_missing, steps_level_gap_trailing300, steps_gap_full_history, steps_log_return,
        return_panel_tripwire, cadence_by_asset, dense_daily_flag, monthly_series_check, monthly_consecutive_steps, ewma_path, ewma_last_sigma,
        rolling_drift, zscore_clipped, regime_sigma_drift, mean_reversion_phi, recency_crisis_weights, month_steps, horizon_steps_rounding,
        overlapping_changes, transfer_flag, aligned_steps_inner, aligned_steps_outer_zero, asset_moments_samp_pop, asset_corr_matrix, panel_mean_gap, monthly_horizon_mapping, monthly_path_gate,
    )
}


def gaps(panel_name: str, name: str = "g") -> str:
    """SQL of a panel's differences and gaps."""
    return f"""{name} AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY unit, asset) AS n, date_diff('day', lag(date) OVER w, date) AS gap,
  value - lag(value) OVER w AS step, row_number() OVER (PARTITION BY unit, asset ORDER BY date DESC) AS back FROM {panel_name} WINDOW w AS (PARTITION BY unit, asset ORDER BY date)),
{name}m AS (SELECT unit, asset, median(gap) FILTER (back <= 300) AS m300, median(gap) AS m FROM {name} GROUP BY 1, 2),
{name}s AS (SELECT g.unit, g.asset, g.date, g.step FROM {name} g JOIN {name}m m ON g.unit = m.unit AND g.asset = m.asset
  WHERE g.step IS NOT NULL AND NOT (g.n >= 3 AND m300 > 0 AND g.gap > greatest(10 * m300, 5)))"""


def sigmas(steps_name: str, name: str = "e") -> str:
    """SQL of the volatility: the recursion written out as a weighted sum over the steps before."""
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY unit, asset ORDER BY date) AS k, count(*) OVER (PARTITION BY unit, asset) AS n,
  stddev_pop(step) OVER (PARTITION BY unit, asset) AS sd FROM {steps_name}),
{name} AS (SELECT a.unit, a.asset, a.date, a.step, a.k, a.n, CASE WHEN max(a.n) < 3 THEN max(a.sd)
    ELSE greatest(sqrt(sum(CASE WHEN b.k = 1 THEN 1.0 ELSE 0.06 END * pow(0.94, a.k - b.k) * b.step * b.step)), 0.3 * max(a.sd)) END AS sigma
  FROM {name}0 a JOIN {name}0 b ON a.unit = b.unit AND a.asset = b.asset AND b.k <= a.k AND b.k > a.k - 700 GROUP BY 1, 2, 3, 4, 5, 6)"""


DRIFTS = """w AS (SELECT *, least(252, greatest(n // 3, 10)) AS width FROM e0),
dr AS (SELECT a.unit, a.asset, a.date, CASE WHEN a.k >= 10 THEN avg(b.step) END AS drift FROM w a JOIN w b ON a.unit = b.unit AND a.asset = b.asset AND b.k <= a.k AND b.k > a.k - a.width
  GROUP BY a.unit, a.asset, a.date, a.k)"""
ZS = """med AS (SELECT unit, asset, median(step) AS m FROM e0 GROUP BY 1, 2),
z AS (SELECT e.unit, e.asset, e.date, greatest(-8.0, least(8.0, (e.step - coalesce(dr.drift, m)) / nullif(e.sigma, 0))) AS z
  FROM e JOIN dr USING (unit, asset, date) JOIN med USING (unit, asset))"""

ORACLES = {
    "panel_asof_series": with_ctes(FX, select="""SELECT unit, asset, max(date) AS last_date, count(*) AS n_obs, round(arg_max(value, date), 6) AS anchor
        FROM fx JOIN task_cards ON unit = card_id WHERE date <= try_cast("asof" AS date) GROUP BY 1, 2"""),
    "panel_first_wins": f"""WITH r AS (SELECT 'panel_' || lower(l_linestatus) AS panel_id, l_returnflag AS asset, CAST(l_shipdate AS date) AS date, l_extendedprice AS value,
        row_number() OVER (PARTITION BY l_linestatus, l_returnflag, CAST(l_shipdate AS date) ORDER BY l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) AS i
        FROM lineitem WHERE CAST(l_shipdate AS date) <= DATE '{CUTOFF}')
        SELECT panel_id, asset, date, round(value, 2) AS value FROM r WHERE i = 1 AND panel_id = (SELECT min(panel_id) FROM r q WHERE q.asset = r.asset)""",
    "panel_late_rows": with_ctes(FX, select="""SELECT unit, count(*) AS n_rows, count(*) FILTER (date > d) AS n_late, count(DISTINCT CASE WHEN date > d THEN asset END) AS n_late_assets,
        count(*) FILTER (date IS NULL) AS n_undated FROM fx JOIN (SELECT card_id, try_cast("asof" AS date) AS d FROM task_cards) ON unit = card_id GROUP BY 1"""),
    "panel_profile": with_ctes(FX, select="SELECT unit, count(*) AS n_rows, count(DISTINCT asset) AS n_assets, min(date) AS first_date, max(date) AS last_date FROM fx GROUP BY 1"),
    "strict_instant_cutoff": r"""WITH t AS (SELECT "timestamp" AS t FROM corpus_index), p AS (SELECT t,
        regexp_extract(t, '^(\d{4}-\d{2}-\d{2})[Tt](\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?([Zz]|[+-]\d{2}:\d{2})$', ['d','h','m','s','f','z']) AS r FROM t),
        q AS (SELECT t, CASE WHEN r.d <> '' AND NOT t LIKE '%-00:00' AND try_cast(r.h AS INT) < 24 AND try_cast(r.m AS INT) < 60 AND try_cast(r.s AS INT) < 60 THEN
            date_diff('day', DATE '1970-01-01', try_cast(r.d AS date)) * 86400 + try_cast(r.h AS INT) * 3600 + try_cast(r.m AS INT) * 60 + try_cast(r.s AS INT)
            - CASE WHEN upper(r.z) = 'Z' THEN 0 ELSE (try_cast(substr(r.z, 2, 2) AS INT) * 60 + try_cast(substr(r.z, 5, 2) AS INT)) * CASE WHEN r.z LIKE '-%' THEN -60 ELSE 60 END END END AS sec,
            r.f AS f, CASE WHEN regexp_matches(t, '^\d{4}-\d{2}-\d{2}$') THEN try_cast(t AS date) END AS d FROM p)
        SELECT CASE WHEN d IS NOT NULL THEN d > DATE '2018-06-30' ELSE sec >= 1530403200 END AS late, count(*) AS n, count(sec) AS n_instants, max(sec) AS last_second,
        CAST(sum(CASE WHEN sec IS NOT NULL THEN CAST(rpad(f, 9, '0') AS BIGINT) END) AS BIGINT) AS nanos FROM q GROUP BY 1""",
    "asof_resolution": """SELECT card_id, least(DATE '2016-12-31', try_cast("asof" AS date)) AS resolved FROM task_cards""",
    "value_at_dates": with_ctes(FX, select="""SELECT p.unit, p.asset, p.at, round(f.value, 6) AS found FROM (SELECT DISTINCT unit, asset, CAST(date_trunc('quarter', date) AS date) AS at FROM fx) p
        ASOF LEFT JOIN fx f ON p.unit = f.unit AND p.asset = f.asset AND p.at >= f.date"""),
    "locf_fill": with_ctes(FX, """s AS (SELECT unit, asset, min(date) AS a, max(date) AS b FROM fx GROUP BY 1, 2), o AS (SELECT CAST(obs_day AS date) AS date FROM market_days WHERE is_open),
        g AS (SELECT s.unit, s.asset, o.date, fx.value FROM s JOIN o ON o.date BETWEEN a AND b LEFT JOIN fx ON fx.unit = s.unit AND fx.asset = s.asset AND fx.date = o.date),
        f AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY unit, asset ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v FROM g),
        h AS (SELECT *, count(*) FILTER (v IS NULL) OVER (PARTITION BY unit, date) AS absent FROM f)""",
        select="SELECT unit, asset, count(*) AS n_days, count(*) FILTER (value IS NULL AND v IS NOT NULL) AS n_carried, round(sum(v), 4) AS total FROM h WHERE absent < 2 GROUP BY 1, 2"),
    "business_day_offset": """WITH m AS (SELECT CAST(obs_day AS date) AS day FROM market_days), b AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM
          (SELECT CAST(unnest(range(TIMESTAMP '2007-12-01', TIMESTAMP '2026-06-01', INTERVAL 1 DAY)) AS date) AS day) WHERE isodow(day) < 6),
        k AS (SELECT m.day, max(b.i) AS i FROM m JOIN b ON b.day <= m.day GROUP BY 1)
        SELECT k.day, x.day AS h1, y.day AS h5, z.day AS h21 FROM k JOIN b x ON x.i = k.i + 1 JOIN b y ON y.i = k.i + 5 JOIN b z ON z.i = k.i + 21""",
    "cross_unit_leak_join": with_ctes(FX, """p AS (SELECT unit, asset, date, round(value, 3) AS value FROM fx), l AS (SELECT unit, asset, max(date) AS date, arg_max(value, date) AS value FROM p GROUP BY 1, 2)""",
        select="""SELECT unit, count(*) AS n_outcomes, count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE p.asset = l.asset AND p.date = l.date AND p.value = l.value AND p.unit <> l.unit)) AS n_found FROM l GROUP BY 1"""),
    "targets_present_missing": with_ctes(FX, select="""SELECT unit, count(DISTINCT asset) AS n_present, (SELECT count(DISTINCT asset) FROM fx) - count(DISTINCT asset) AS n_missing,
        string_agg(DISTINCT asset, ',' ORDER BY asset) AS present FROM fx GROUP BY 1"""),
    "steps_level_gap_trailing300": with_ctes(FX, gaps("fx"), select="SELECT unit, asset, count(*) AS n_steps, round(sum(step), 6) AS total, round(max(abs(step)), 6) AS largest FROM gs GROUP BY 1, 2"),
    "steps_gap_full_history": with_ctes(FX, gaps("fx"), select="""SELECT unit, asset, count(*) AS n, count(*) FILTER (n >= 3 AND m > 0 AND gap > greatest(10 * m, 5)) AS n_holes, CAST(max(gap) AS INT) AS widest
        FROM g JOIN gm USING (unit, asset) GROUP BY 1, 2"""),
    "steps_log_return": with_ctes(RETURNS, select="SELECT asset, date, round(ln(1 + value), 6) AS step FROM returns"),
    "return_panel_tripwire": with_ctes(RETURNS, select="SELECT asset, round(median(abs(value)), 6) AS median_abs, median(abs(value)) >= 0.2 AS refused FROM returns GROUP BY 1"),
    "cadence_by_asset": with_ctes(SHIPMENTS, MONTHLY, """b AS (SELECT unit || asset AS asset, date FROM shipments UNION ALL SELECT asset, date FROM monthly),
        g AS (SELECT asset, date, date_diff('day', lag(date) OVER (PARTITION BY asset ORDER BY date), date) AS gap FROM b),
        pm AS (SELECT asset, median(c) AS pm FROM (SELECT asset, date_trunc('month', date) AS m, count(*) AS c FROM b GROUP BY 1, 2) GROUP BY 1)""",
        select="""SELECT asset, count(*) AS n, median(gap) AS median_gap, CASE WHEN count(*) >= 5 AND median(gap) > 20 THEN 'monthly' ELSE 'daily' END AS cadence,
        coalesce(count(*) >= 30 AND median(gap) > 0 AND median(gap) <= 3 AND max(pm) >= 8, false) AS dense_daily FROM g JOIN pm USING (asset) GROUP BY 1"""),
    "dense_daily_flag": with_ctes(FX, gaps("fx"), "pm AS (SELECT unit, asset, median(c) AS pm FROM (SELECT unit, asset, date_trunc('month', date) AS m, count(*) AS c FROM fx GROUP BY 1, 2, 3) GROUP BY 1, 2)",
        select="""SELECT unit, asset, coalesce(count(*) >= 30 AND median(gap) > 0 AND median(gap) <= 3 AND max(pm) >= 8, false) AS dense_daily,
        CASE WHEN count(*) >= 5 AND median(gap) > 20 THEN 'monthly' ELSE 'daily' END AS cadence FROM g JOIN pm USING (unit, asset) GROUP BY 1, 2"""),
    "monthly_series_check": with_ctes(MONTHLY, """m AS (SELECT asset, year(date) * 12 + month(date) - 1 AS m FROM monthly), q AS (SELECT asset, m, m - lag(m) OVER (PARTITION BY asset ORDER BY m) AS g FROM m)""",
        select="""SELECT asset, count(*) AS n, count(DISTINCT m) AS n_months, median(g) AS median_month_gap, coalesce(count(*) >= 3 AND count(*) = count(DISTINCT m) AND median(g) = 1, false) AS is_monthly
        FROM q GROUP BY 1"""),
    "monthly_consecutive_steps": with_ctes(MONTHLY, select="""SELECT asset, date, round(step, 4) AS step FROM (SELECT asset, date, value - lag(value) OVER w AS step, lag(date) OVER w AS p
        FROM monthly WINDOW w AS (PARTITION BY asset ORDER BY date)) WHERE date_diff('month', p, date) = 1"""),
    "ewma_path": with_ctes(SHIPMENTS, gaps("shipments"), sigmas("gs"), select="SELECT unit, asset, date, round(sigma, 3) AS sigma FROM e"),
    "ewma_last_sigma": with_ctes(FX, gaps("fx"), sigmas("gs"), select="SELECT unit, asset, round(arg_max(sigma, date), 6) AS sigma FROM e GROUP BY 1, 2"),
    "rolling_drift": with_ctes(SHIPMENTS, gaps("shipments"), sigmas("gs"), DRIFTS, select="SELECT unit, asset, date, round(drift + 1e-9, 6) AS drift FROM dr"),
    "zscore_clipped": with_ctes(SHIPMENTS, gaps("shipments"), sigmas("gs"), DRIFTS, ZS,
        select="SELECT unit, asset, count(z) AS n, round(avg(z), 4) AS mean_z, round(stddev_samp(z), 4) AS sd_z, round(max(abs(z)), 4) AS max_z FROM z GROUP BY 1, 2"),
    "regime_sigma_drift": with_ctes(FX, gaps("fx"), sigmas("gs"), """r AS (SELECT unit, asset, count(*) AS n, arg_max(sigma, date) AS last, avg(step) AS mean,
        CASE WHEN count(*) > 5 THEN stddev_samp(step) ELSE arg_max(sigma, date) END AS sd FROM e GROUP BY 1, 2)""",
        select="""SELECT unit, asset, n AS n_steps, round(sd, 6) AS sigma_full, round(greatest(sd, least(3 * sd, last)), 6) AS sigma_now,
        round(greatest(-0.8 * sd, least(0.8 * sd, 0.7 * mean)), 6) AS drift FROM r"""),
    "mean_reversion_phi": with_ctes(SHIPMENTS, """r AS (SELECT unit, asset, count(*) OVER (PARTITION BY unit, asset) AS obs, value - lag(value) OVER w AS x,
        lag(value) OVER w - median(value) OVER (PARTITION BY unit, asset) AS d FROM shipments WINDOW w AS (PARTITION BY unit, asset ORDER BY date)),
        f AS (SELECT unit, asset, max(obs) AS obs, count(*) AS n, covar_samp(x, d) / var_pop(d) AS b, var_pop(d) AS v, avg(x) AS xm FROM r WHERE x IS NOT NULL GROUP BY 1, 2),
        s AS (SELECT unit, asset, max(f.obs) AS obs, max(n) AS n, max(-b) AS phi_hat, max(v) AS v, sum(pow(x - xm - b * d, 2)) AS ss FROM r JOIN f USING (unit, asset) WHERE x IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT *, phi_hat / (sqrt(ss / greatest(n - 2, 1)) / (sqrt(v) * sqrt(n))) AS t FROM s)""",
        select="""SELECT unit, asset, n, round(phi_hat, 6) AS phi_hat, round(t, 4) AS t,
        round(CASE WHEN obs >= 260 AND n >= 250 AND phi_hat > 0.003 AND phi_hat < 0.12 AND t >= 2.2 THEN least(phi_hat / 2, 0.05) ELSE 0.0 END, 6) AS phi FROM t"""),
    "recency_crisis_weights": with_ctes(SHIPMENTS, gaps("shipments"), sigmas("gs"), DRIFTS, ZS, """zm AS (SELECT unit, date, max(abs(z)) AS z FROM z GROUP BY 1, 2),
        b AS (SELECT *, count(*) OVER p AS n, pow(0.5, (row_number() OVER (PARTITION BY unit ORDER BY date DESC) - 1) / 750.0) AS r FROM zm WINDOW p AS (PARTITION BY unit)),
        bar AS (SELECT unit, greatest(2.5, quantile_cont(z, 0.9)) AS bar FROM zm GROUP BY 1),
        c AS (SELECT unit, (0.6 * r / sum(r) OVER (PARTITION BY unit) + 0.4 / n) * CASE WHEN z > bar THEN 1.8 ELSE 1.0 END AS w FROM b JOIN bar USING (unit)),
        f AS (SELECT unit, w / sum(w) OVER (PARTITION BY unit) AS w FROM c)""",
        select="SELECT unit, count(*) AS n, round(sum(w), 6) AS total, round(max(w) * 1000, 6) AS most, round(min(w) * 1000, 6) AS least FROM f GROUP BY 1"),
    "month_steps": """SELECT card_id, CAST(year(d) * 12 + month(d) - 1 AS INT) AS month, strftime(d, '%Y-%m') AS period FROM (SELECT card_id, try_cast("asof" AS date) AS d FROM task_cards)""",
    "horizon_steps_rounding": """WITH h AS (SELECT card_id, unnest(horizons) AS horizon, n_assets FROM task_cards), c AS (SELECT *, horizon * (n_assets % 3 + 1) AS k FROM h)
        SELECT card_id, horizon, CAST(greatest(1, round_even(horizon / 21.0, 0)) AS INT) AS months,
        CASE WHEN greatest(k, horizon) / greatest(least(k, horizon), 1) >= 2 THEN k ELSE horizon END AS m0_steps FROM c""",
    "overlapping_changes": with_ctes(FX, select="""SELECT unit, asset, count(*) AS n, round(stddev_samp(c), 6) AS sd_h, count(*) FILTER (rn % 21 = 0) AS n_apart FROM
        (SELECT unit, asset, value - lag(value, 21) OVER w AS c, row_number() OVER w AS rn FROM fx WINDOW w AS (PARTITION BY unit, asset ORDER BY date)) WHERE c IS NOT NULL GROUP BY 1, 2"""),
    "transfer_flag": with_ctes(FX, gaps("fx"), select="SELECT unit, asset, CAST(arg_max_null(gap, date) AS INT) AS last_gap, coalesce(arg_max_null(gap, date) > 60, false) AS is_transfer FROM g GROUP BY 1, 2"),
    "panel_mean_gap": with_ctes(FX, gaps("fx"), select="""SELECT unit, asset, count(*) AS n_gaps, round(avg(gap), 6) AS mean_gap FROM g JOIN gm USING (unit, asset)
        WHERE gap IS NOT NULL AND NOT (n >= 3 AND m > 0 AND gap > greatest(10 * m, 5)) GROUP BY 1, 2"""),
    "monthly_horizon_mapping": with_ctes(MONTHLY, select="""SELECT 'orders' AS unit, asset, horizon, CASE WHEN horizon IN (1, 6) OR (horizon = 3 AND asset <> '5-LOW') THEN horizon END AS steps,
        CASE WHEN horizon = 9 THEN 'missing' WHEN horizon = 3 AND asset = '5-LOW' THEN 'conflict' WHEN horizon = -1 THEN 'not_after' END AS code
        FROM (SELECT DISTINCT asset FROM monthly), (SELECT unnest([-1, 1, 3, 6, 9]) AS horizon)"""),
    "monthly_path_gate": with_ctes(MONTHLY, """m AS (SELECT asset, year(date) * 12 + month(date) - 1 AS m FROM monthly), q AS (SELECT asset, m, m - lag(m) OVER (PARTITION BY asset ORDER BY m) AS g FROM m)""",
        select="""SELECT asset AS unit, CASE WHEN asset = '5-LOW' THEN 'refused' WHEN coalesce(count(*) >= 3 AND count(*) = count(DISTINCT m) AND median(g) = 1, false) THEN 'monthly' ELSE 'daily' END AS path FROM q GROUP BY 1"""),
    "aligned_steps_inner": with_ctes(FX, gaps("fx"), """k AS (SELECT unit, count(DISTINCT asset) AS a FROM gs GROUP BY 1), f AS (SELECT gs.* FROM gs JOIN k USING (unit) QUALIFY count(*) OVER (PARTITION BY unit, date) = a)""",
        select="SELECT unit, count(*) AS n_rows, count(DISTINCT date) AS n_dates, round(sum(step), 6) AS total FROM f GROUP BY 1"),
    "aligned_steps_outer_zero": with_ctes(FX, gaps("fx"), """f AS (SELECT d.unit, d.date, a.asset, coalesce(gs.step, 0.0) AS step FROM (SELECT DISTINCT unit, date FROM gs) d JOIN (SELECT DISTINCT unit, asset FROM gs) a ON d.unit = a.unit
        LEFT JOIN gs ON gs.unit = d.unit AND gs.date = d.date AND gs.asset = a.asset)""",
        select="SELECT unit, count(*) AS n_rows, count(*) FILTER (step = 0) AS n_zero, round(sum(step), 6) AS total FROM f GROUP BY 1"),
    "asset_moments_samp_pop": with_ctes(FX, gaps("fx"), select="SELECT unit, asset, count(step) AS n, round(avg(step), 6) AS mean, round(stddev_samp(step), 6) AS sd_samp, round(stddev_pop(step), 6) AS sd_pop FROM gs GROUP BY 1, 2"),
    "asset_corr_matrix": with_ctes(SHIPMENTS, gaps("shipments"), """k AS (SELECT unit, count(DISTINCT asset) AS a FROM gs GROUP BY 1), f AS (SELECT gs.* FROM gs JOIN k USING (unit) QUALIFY count(*) OVER (PARTITION BY unit, date) = a)""",
        select="""SELECT x.unit, x.asset AS a, y.asset AS b, count(*) AS n, round(corr(x.step, y.step), 6) AS corr, round(covar_samp(x.step, y.step), 0) AS cov
        FROM f x JOIN f y ON x.unit = y.unit AND x.date = y.date AND x.asset < y.asset GROUP BY 1, 2, 3"""),
}
