"""Series to steps: gap-aware differences, cadence, volatility, drift and start weights.

Input is a panel (by..., date DATE, value DOUBLE) with one row a series and day. ``by`` names the series; a series
has at most a row a day, so window partitions are bounded by the calendar. Null values give null steps; NaN must
have been made null at the source; a series of one row has no steps; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAILY_LAMBDA, MONTHLY_LAMBDA = 0.94, 0.80
#: Steps after which the sums behind the volatility restart; 0.80 to the power of -BLOCK is still a double.
BLOCK = 2048


def _over(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("date")


def with_gaps(panel: DataFrame, by: Sequence[str]) -> DataFrame:
    """panel with gap (days since the row before), rn and back (numbers from the start and the end) and n."""
    w, whole = _over(by), Window.partitionBy(*by)
    return panel.select(*by, "date", "value").select(
        "*",
        F.datediff("date", F.lag("date").over(w)).alias("gap"),
        (F.col("value") - F.lag("value").over(w)).alias("step"),
        F.row_number().over(w).alias("rn"),
        F.count("*").over(whole).alias("n"),
    ).withColumn("back", F.col("n") - F.col("rn") + 1)


def trailing_rows(rows: DataFrame, by: Sequence[str], n: int = 300) -> DataFrame:
    """The last ``n`` rows of each series by date; a shorter series whole."""
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("date")))
    return rows.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")


def gap_limits(panel: DataFrame, by: Sequence[str], trailing: int | None = None, factor: float = 10.0, floor: float = 5.0) -> DataFrame:
    """with_gaps and ``hole``: a gap of more than max(factor x median gap, floor) days. The median is over the last
    ``trailing`` gaps, or all. Series of fewer than three rows, or with a median of zero, have no holes."""
    rows = with_gaps(panel, by)
    inside = F.col("gap").isNotNull() & (F.lit(True) if trailing is None else F.col("back") <= trailing)
    median = F.median(F.when(inside, F.col("gap"))).over(Window.partitionBy(*by))
    limit = F.greatest(median * factor, F.lit(floor))
    return rows.withColumn("hole", F.coalesce((F.col("n") >= 3) & (median > 0) & (F.col("gap") > limit), F.lit(False)))


def clean_steps(panel: DataFrame, by: Sequence[str], trailing: int | None = 300, log_return: bool = False) -> DataFrame:
    """(by..., date, step): first differences, or log1p of simple returns, without those that end a hole."""
    rows = gap_limits(panel, by, trailing).where(~F.col("hole"))
    step = F.log1p("value") if log_return else F.col("step")
    return rows.select(*by, "date", step.alias("step")).where("step is not null")


def log_return_steps(panel: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., date, step): log1p of simple returns; a return of -1 or less, or an infinite one, raises."""
    v = F.col("value")
    guarded = F.when((v <= -1) | (F.abs(v) == float("inf")), F.raise_error(F.lit("a simple return of -1 or less, or infinite"))).otherwise(F.log1p(v))
    return panel.select(*by, "date", guarded.cast("double").alias("step"))


def cadence(panel: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., n, median_gap, cadence, dense_daily): monthly where the median gap is over 20 days, known from five rows on;
    densely daily from 30 rows on with a median gap in (0, 3] and a median of eight or more rows a month."""
    rows = with_gaps(panel, by)
    months = rows.groupBy(*by, F.trunc("date", "MM").alias("month")).agg(F.count("*").alias("c"))
    per_month = months.groupBy(*by).agg(F.median("c").alias("per_month"))
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.median("gap").alias("median_gap"))
    dense = (F.col("n") >= 30) & (F.col("median_gap") > 0) & (F.col("median_gap") <= 3) & (F.col("per_month") >= 8)
    kind = F.when((F.col("n") >= 5) & (F.col("median_gap") > 20), "monthly").otherwise("daily")
    return g.join(per_month, list(by)).select(*by, "n", "median_gap", kind.alias("cadence"), F.coalesce(dense, F.lit(False)).alias("dense_daily"))


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def monthly_check(panel: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., n, n_months, median_month_gap, is_monthly): months all different, three rows or more, a median month gap of one."""
    w = _over(by)
    rows = panel.select(*by, "date", "value", month_index(F.col("date")).alias("m"))
    rows = rows.withColumn("d", F.col("m") - F.lag("m").over(w))
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("m").alias("n_months"), F.median("d").alias("median_month_gap"))
    ok = (F.col("n") >= 3) & (F.col("n") == F.col("n_months")) & (F.col("median_month_gap") == 1)
    return g.select("*", F.coalesce(ok, F.lit(False)).alias("is_monthly"))


def monthly_steps(panel: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., date, step): differences of consecutive months only."""
    w = _over(by)
    m = month_index(F.col("date"))
    rows = panel.select(*by, "date", (F.col("value") - F.lag("value").over(w)).alias("step"), (m - F.lag(m).over(w)).alias("d"))
    return rows.where("d = 1").select(*by, "date", "step")


def ewma(steps: DataFrame, by: Sequence[str], decay: float = DAILY_LAMBDA, floor: float = 0.3) -> DataFrame:
    """(by..., date, step, sigma): s2_1 = x_1^2, s2_t = decay s2_(t-1) + (1-decay) x_t^2, its root at least ``floor``
    population standard deviations; a series of fewer than three steps has the deviation throughout.

    In closed form the recursion is a running sum of x^2 / decay^position, which windows add up row by row. Positions
    restart every ``BLOCK`` steps, in two ways half a block apart, and each step takes the sum that has at least
    half a block behind it, so that no power overflows and what is forgotten is below the precision of a double.
    """
    w, whole = _over(by), Window.partitionBy(*by)
    rows = steps.select(*by, "date", "step", F.row_number().over(w).alias("rn"), F.stddev_pop("step").over(whole).alias("sd"), F.count("*").over(whole).alias("n"))
    x2 = F.pow("step", F.lit(2)) * F.when(F.col("rn") == 1, 1.0).otherwise(1 - decay)
    for name, ahead in (("a", 0), ("b", BLOCK // 2)):
        rows = rows.withColumn(f"{name}_block", F.floor((F.col("rn") - 1 + ahead) / BLOCK)).withColumn(f"{name}_at", (F.col("rn") - 1 + ahead) % BLOCK)
        position = F.pow(F.lit(decay), F.col(f"{name}_at"))
        total = F.sum(x2 / position).over(Window.partitionBy(*by, f"{name}_block").orderBy("date"))
        rows = rows.withColumn(f"{name}_s2", total * position)
    s2 = F.when((F.col("a_block") == 0) | (F.col("a_at") >= BLOCK // 2), F.col("a_s2")).otherwise(F.col("b_s2"))
    sigma = F.when(F.col("n") < 3, F.col("sd")).otherwise(F.greatest(F.sqrt(s2), floor * F.col("sd")))
    return rows.select(*by, "date", "step", sigma.alias("sigma"))


def rolling_drift(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., date, step, drift): trailing mean over min(252, max(n/3, 10)) steps, from ten of them on.

    Steps are numbered in units of their series' width, so one range frame, a width long, serves all series.
    """
    w, whole = _over(by), Window.partitionBy(*by)
    rows = steps.select(*by, "date", "step", F.row_number().over(w).alias("rn"), F.count("*").over(whole).alias("n"))
    width = F.least(F.lit(252.0), F.greatest(F.floor(F.col("n") / 3).cast("double"), F.lit(10.0)))
    rows = rows.withColumn("at", F.col("rn") / width)
    # 251/252 of a width back is inside, a whole width isn't; the Python window takes whole numbers only.
    mean = F.expr(f"avg(step) OVER (PARTITION BY {', '.join(f'`{k}`' for k in by)} ORDER BY at RANGE BETWEEN 0.998D PRECEDING AND CURRENT ROW)")
    return rows.select(*by, "date", "step", F.when(F.col("rn") >= 10, mean).alias("drift"))


def innovations(steps: DataFrame, by: Sequence[str], clip: float = 8.0) -> DataFrame:
    """(by..., date, step, sigma, z): steps less their drift (their median where there is none) over sigma, clipped."""
    keys = [*by, "date", "step"]
    both = ewma(steps, by).join(rolling_drift(steps, by), keys)
    centre = F.coalesce("drift", F.median("step").over(Window.partitionBy(*by)))
    z = (F.col("step") - centre) / F.nullif("sigma", F.lit(0.0))
    return both.select(*keys, "sigma", F.greatest(F.lit(-clip), F.least(F.lit(clip), z)).alias("z"))


def regime(steps: DataFrame, by: Sequence[str], log_return: bool = False) -> DataFrame:
    """(by..., n_steps, sigma_full, sigma_now, drift): the last sigma within one and three full deviations, and the mean step,
    for levels shrunk to 0.7 and held within 0.8 deviations."""
    rows = ewma(steps, by).groupBy(*by).agg(F.count("*").alias("n_steps"), F.stddev_samp("step").alias("sd"), F.max_by("sigma", "date").alias("last"), F.avg("step").alias("mean"))
    sd = F.when(F.col("n_steps") > 5, F.col("sd")).otherwise(F.col("last"))
    now = F.greatest(sd, F.least(3.0 * sd, F.col("last")))
    drift = F.col("mean") if log_return else F.greatest(-0.8 * sd, F.least(0.8 * sd, 0.7 * F.col("mean")))
    return rows.select(*by, "n_steps", sd.alias("sigma_full"), now.alias("sigma_now"), drift.alias("drift"))


def mean_reversion(panel: DataFrame, by: Sequence[str], min_obs: int = 260) -> DataFrame:
    """(by..., n, phi_hat, t, phi): regression of changes on the distance to the median; the pull applied is half of it, at
    most 0.05, where 0.003 < phi_hat < 0.12 and t >= 2.2 on ``min_obs`` rows or more. The slope divides a sample
    covariance by a population variance."""
    w, whole = _over(by), Window.partitionBy(*by)
    rows = panel.select(*by, "date", "value", F.median("value").over(whole).alias("med"), F.count("*").over(whole).alias("obs"))
    rows = rows.select(*by, "obs", (F.col("value") - F.lag("value").over(w)).alias("x"), (F.lag("value").over(w) - F.col("med")).alias("d")).where("x is not null and d is not null")
    g = rows.groupBy(*by).agg(
        F.max("obs").alias("obs"), F.count("*").alias("n"), F.covar_samp("x", "d").alias("c"), F.var_pop("d").alias("v"), F.var_pop("x").alias("vx"), F.covar_pop("x", "d").alias("cp")
    )
    b = F.col("c") / F.nullif("v", F.lit(0.0))
    ss = F.col("n") * (F.col("vx") - 2 * b * F.col("cp") + b * b * F.col("v")) + F.lit(0.0)
    # residuals are about the mean change, not about the mean distance
    g = g.join(rows.groupBy(*by).agg(F.avg("d").alias("dm")), list(by))
    ss = ss + F.col("n") * b * b * F.col("dm") * F.col("dm")
    se = F.sqrt(ss / F.greatest(F.col("n") - 2, F.lit(1))) / (F.sqrt("v") * F.sqrt("n"))
    out = g.select(*by, "obs", "n", (-b).alias("phi_hat"), ((-b) / F.nullif(se, F.lit(0.0))).alias("t"))
    holds = (F.col("obs") >= min_obs) & (F.col("n") >= 250) & (F.col("phi_hat") > 0.003) & (F.col("phi_hat") < 0.12) & (F.col("t") >= 2.2)
    return out.select(*by, "n", "phi_hat", "t", F.when(holds, F.least(F.col("phi_hat") / 2, F.lit(0.05))).otherwise(0.0).alias("phi"))


def start_weights(z: DataFrame, by: Sequence[str], half_life: float = 750.0, mix: float = 0.6, boost: float = 0.8) -> DataFrame:
    """(by..., date, weight): recency and uniform weights mixed, raised by ``boost`` on days whose |z| exceeds max(2.5, its 90th
    percentile), summing to one. z: (by..., date, z), z the largest of the day's assets."""
    w, whole = _over(by), Window.partitionBy(*by)
    rows = z.select(*by, "date", F.abs("z").alias("z"), F.count("*").over(whole).alias("n"), F.row_number().over(w).alias("rn"))
    rows = rows.withColumn("r", F.pow(F.lit(0.5), (F.col("n") - F.col("rn")) / half_life)).withColumn("bar", F.greatest(F.lit(2.5), F.percentile("z", F.lit(0.9)).over(whole)))
    base = mix * F.col("r") / F.sum("r").over(whole) + (1 - mix) / F.col("n")
    rows = rows.withColumn("b", base * F.when(F.col("z") > F.col("bar"), 1 + boost).otherwise(1.0))
    return rows.select(*by, "date", (F.col("b") / F.sum("b").over(whole)).alias("weight"))


def overlapping_changes(panel: DataFrame, by: Sequence[str], h: int) -> DataFrame:
    """(by..., n, sd_h, n_apart): changes over h rows, their deviation, and how many don't overlap."""
    w = _over(by)
    rows = panel.select(*by, (F.col("value") - F.lag("value", h).over(w)).alias("c"), F.row_number().over(w).alias("rn")).where("c is not null")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp("c").alias("sd_h"), F.count_if(F.col("rn") % h == 0).alias("n_apart"))


def transfer(panel: DataFrame, by: Sequence[str], days: int = 900) -> DataFrame:
    """(by..., last_gap, is_transfer): an early window and one late row, seen by a last gap of more than ``days``."""
    return with_gaps(panel, by).groupBy(*by).agg(F.max_by("gap", "date").alias("last_gap")).select("*", F.coalesce(F.col("last_gap") > days, F.lit(False)).alias("is_transfer"))


def aligned(steps: DataFrame, unit: Sequence[str], outer: bool = False) -> DataFrame:
    """steps (unit..., asset, date, step) of the dates on which every asset of the unit has one; ``outer`` keeps all dates
    and fills absent steps with zero. Long form: no pivot, so any number of assets."""
    unit = list(unit)
    have = steps.where("step is not null").select(*unit, "asset", "date", "step")
    if outer:
        grid = have.select(*unit, "date").distinct().join(have.select(*unit, "asset").distinct(), unit)
        return grid.join(have, [*unit, "asset", "date"], "left").select(*unit, "asset", "date", F.coalesce("step", F.lit(0.0)).alias("step"))
    n_assets = have.groupBy(*unit).agg(F.count_distinct("asset").alias("a"))
    counted = have.withColumn("k", F.count("*").over(Window.partitionBy(*unit, "date")))
    return counted.join(n_assets, unit).where("k = a").select(*unit, "asset", "date", "step")


def moments(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., n, mean, sd_samp, sd_pop); the two deviations are never mixed."""
    return steps.groupBy(*by).agg(F.count("step").alias("n"), F.avg("step").alias("mean"), F.stddev_samp("step").alias("sd_samp"), F.stddev_pop("step").alias("sd_pop"))


def correlations(steps: DataFrame, unit: Sequence[str]) -> DataFrame:
    """(unit..., a, b, n, corr, cov) for pairs of a unit's assets on shared dates, a < b."""
    unit = list(unit)
    left = steps.select(*unit, "date", F.col("asset").alias("a"), F.col("step").alias("x"))
    right = steps.select(*unit, "date", F.col("asset").alias("b"), F.col("step").alias("y"))
    pairs = left.join(right, [*unit, "date"]).where("a < b")
    return pairs.groupBy(*unit, "a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr"), F.covar_samp("x", "y").alias("cov"))


def stressed(steps: DataFrame, by: Sequence[str], min_steps: int = 30) -> DataFrame:
    """(by..., s75): third quartile of the volatility path of series with ``min_steps`` steps or more."""
    g = ewma(steps, by).groupBy(*by).agg(F.count("*").alias("n"), F.percentile("sigma", F.lit(0.75)).alias("s75"))
    return g.where(F.col("n") >= min_steps).select(*by, "s75")


def basket(panel: DataFrame, unit: Sequence[str], ends: DataFrame, trailing: int | None = 300) -> DataFrame:
    """(unit..., ratio, basket): medians over a unit's assets of sigma now over sigma at or before the unit's ``end`` (series of 120
    rows or more; within 0.5 and 3), and of sigma now over |last value| (60 or more).

    Series whose median |value| is under 0.5 are returns, not levels: their values are the steps.
    """
    unit = list(unit)
    by = [*unit, "asset"]
    kind = panel.groupBy(*by).agg(F.count("*").alias("obs"), (F.median(F.abs("value")) < 0.5).alias("is_return"), F.max_by("value", "date").alias("last"))
    level = clean_steps(panel, by, trailing)
    both = level.join(kind, by).where("not is_return").unionByName(panel.select(*by, "date", F.col("value").alias("step")).where("step is not null").join(kind, by).where("is_return"))
    path = ewma(both.select(*by, "date", "step"), by).join(kind, by).join(ends.select(*unit, "end"), unit)
    now = path.groupBy(*by).agg(F.max_by("sigma", "date").alias("now"), F.max_by(F.when(F.col("date") <= F.col("end"), F.col("sigma")), F.when(F.col("date") <= F.col("end"), F.col("date"))).alias("was"), F.max("obs").alias("obs"), F.max("last").alias("last"))
    ratio = F.when((F.col("obs") >= 120) & (F.col("was") > 0), F.greatest(F.lit(0.5), F.least(F.lit(3.0), F.col("now") / F.col("was"))))
    relative = F.when((F.col("obs") >= 60) & (F.col("last") != 0), F.col("now") / F.abs("last"))
    return now.groupBy(*unit).agg(F.median(ratio).alias("ratio"), F.median(relative).alias("basket"))


def mean_gap(panel: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., n_gaps, mean_gap): mean days between rows, holes left out."""
    rows = gap_limits(panel, by).where(F.col("gap").isNotNull() & ~F.col("hole"))
    return rows.groupBy(*by).agg(F.count("*").alias("n_gaps"), F.avg("gap").alias("mean_gap"))


def monthly_horizons(cells: DataFrame, periods: DataFrame, last: DataFrame) -> DataFrame:
    """(unit, asset, horizon, steps, code): months from an asset's last observation to the month that a cell's periods name.

    cells: (unit, asset, horizon), the planned grid; periods: (unit, asset, horizon, period YYYY-MM), several spellings a cell
    allowed; last: (unit, asset, last_month), month indexes. code: ``missing`` without a period, ``unreadable``, ``conflict`` where
    spellings disagree, ``not_after`` where the month isn't after the last one, else NULL; steps is NULL with any code.
    """
    key = ["unit", "asset", "horizon"]
    month = F.concat("period", F.lit("-01")).try_cast("date")
    ok = F.col("period").rlike(r"^\d{4}-\d{2}$") & month.isNotNull()
    named = periods.select(*key, F.when(ok, month_index(month)).alias("m"))
    g = named.groupBy(*key).agg(F.count("*").alias("n"), F.count("m").alias("read"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    rows = cells.select(*key).join(g, key, "left").join(last, ["unit", "asset"], "left")
    steps_ = F.col("lo") - F.col("last_month")
    code = (
        F.when(F.col("n").isNull(), "missing").when(F.col("read") < F.col("n"), "unreadable").when(F.col("lo") != F.col("hi"), "conflict").when(F.coalesce(steps_, F.lit(0)) <= 0, "not_after")
    )
    return rows.select(*key, F.when(code.isNull(), steps_).alias("steps"), code.alias("code"))


def monthly_gate(check: DataFrame, horizons: DataFrame) -> DataFrame:
    """(unit, path): ``monthly`` where all series of a unit are monthly and all its horizons have steps, ``refused`` where periods
    conflict, else ``daily``. check: (unit, is_monthly) a series; horizons: (unit, code) a cell."""
    m = check.groupBy("unit").agg(F.every("is_monthly").alias("monthly"))
    h = horizons.groupBy("unit").agg(F.count("code").alias("bad"), F.count_if(F.col("code") == "conflict").alias("conflicts"))
    path = F.when(F.col("conflicts") > 0, "refused").when(F.col("monthly") & (F.col("bad") == 0), "monthly").otherwise("daily")
    return m.join(h, "unit").select("unit", path.alias("path"))


def continuation(panel: DataFrame, by: Sequence[str], order: str, ahead: Sequence[int], every: int = 1) -> DataFrame:
    """(by..., order, steps, anchor, realized): what came ``steps`` rows after an origin, for every ``every``-th row of a series as
    origin and each of ``ahead``; origins without that many rows behind them give none. One window a series."""
    w = Window.partitionBy(*by).orderBy(order)
    later = F.array(*(F.struct(F.lit(int(s)).alias("steps"), F.lead("value", int(s)).over(w).alias("realized"), F.lead(F.lit(1), int(s)).over(w).alias("there")) for s in ahead))
    rows = panel.select(*by, order, F.col("value").alias("anchor"), (F.row_number().over(w) - 1).alias("_i"), later.alias("_later"))
    rows = rows.where(F.col("_i") % every == 0).select(*by, order, "anchor", F.explode("_later").alias("x"))
    return rows.where("x.there is not null").select(*by, order, "x.steps", "anchor", "x.realized")
