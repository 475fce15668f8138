"""The verbs end to end: forecast units from panels by a walk or by bootstrapped innovations, calibrate the latter on a unit's own past,
and score draws against a roster; all units in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from quantloom.operators import grid, overlay, scores, simulate, steps
from quantloom.session import written

KEY = ["unit", "asset"]


def forecast(panel: DataFrame, targets: DataFrame, n_draws: int = 500, seed: int = 1, log_return: bool = False) -> DataFrame:
    """Draws (unit, asset, horizon, draw, value) of the reference walk for all units at once.

    panel: (unit, asset, date, value) cut at its as-of date; targets: (unit, asset, horizon, steps). Steps are aligned on
    the dates that all of a unit's assets have. For returns, the walk sums log1p of returns from zero. A target without a
    model comes out as a walk with twice the unit's median deviation from one.
    """
    key = ["unit", "asset"]
    s = steps.clean_steps(panel, key, None, log_return)
    aligned = steps.aligned(s, ["unit"])
    m = steps.moments(aligned, key)
    last = panel.groupBy(*key).agg((F.lit(0.0) if log_return else F.max_by("value", "date")).alias("anchor"))
    models = m.join(last, key).select(*key, "anchor", F.col("mean").alias("drift"), F.col("sd_samp").alias("sd"))
    absent = simulate.synthetic_models(targets.select(*key).distinct(), models.withColumn("sigma", F.col("sd")))
    models = models.unionByName(absent.select(*key, "anchor", F.lit(0.0).alias("drift"), F.col("sigma").alias("sd")))
    loads = simulate.factors(steps.correlations(aligned, ["unit"]))
    cells = targets.join(models, key).select(*key, "horizon", "anchor", (F.col("drift") * F.col("steps") / F.col("horizon")).alias("drift"), (F.col("sd") * F.sqrt(F.col("steps") / F.col("horizon"))).alias("sd"))
    own = cells.select(*key).distinct().join(loads.select(*key).distinct(), key, "left_anti").select(*key, F.col("asset").alias("other"), F.lit(1.0).alias("load"))
    return simulate.correlated_walk(cells, loads.unionByName(own), n_draws, seed)


def bootstrap_models(panel: DataFrame, targets: DataFrame) -> DataFrame:
    """Models (unit, asset, anchor, sigma, drift, phi, log_return) of the targets' assets: sigma and drift of the present regime, pull
    to the mean, last value as anchor; an asset without history walks from one with twice its unit's median sigma."""
    s = steps.clean_steps(panel, KEY)
    last = panel.groupBy(*KEY).agg(F.max_by("value", "date").alias("anchor"))
    own = steps.regime(s, KEY).join(steps.mean_reversion(panel, KEY), KEY, "left").join(last, KEY)
    own = own.select(*KEY, "anchor", F.col("sigma_now").alias("sigma"), "drift", F.coalesce("phi", F.lit(0.0)).alias("phi"))
    absent = simulate.synthetic_models(targets.select(*KEY).distinct(), own).select(*KEY, "anchor", "sigma", F.lit(0.0).alias("drift"), F.lit(0.0).alias("phi"))
    return own.join(targets.select(*KEY).distinct(), KEY, "left_semi").unionByName(absent).withColumn("log_return", F.lit(False))


def forecast_bootstrap(
    panel: DataFrame,
    targets: DataFrame,
    n_draws: int = 500,
    seed: int = 1,
    block: float = 8.0,
    corrections: DataFrame | None = None,
    adjustments: DataFrame | None = None,
    families: DataFrame | None = None,
) -> DataFrame:
    """Draws (unit, asset, horizon, draw, value) by a block bootstrap of standardized innovations, all units at once.

    panel: (unit, asset, date, value) cut at its as-of date; targets: (unit, asset, horizon, steps). A day's innovations are taken for
    all of a unit's assets together. Then, each if given: ``corrections`` (unit, asset, horizon, shift_sd, scale_lo, scale_hi),
    ``adjustments`` as :func:`overlay.adjusted` takes them, and the prior of ``families`` (unit, family) for the units without any
    adjustment. A unit without history gives no draws.
    """
    z = written(steps.innovations(steps.clean_steps(panel, KEY), KEY).select(*KEY, "date", "z"))
    w = steps.start_weights(z.groupBy("unit", "date").agg(F.max(F.abs("z")).alias("z")), ["unit"])
    w = w.select("unit", "date", (F.row_number().over(Window.partitionBy("unit").orderBy("date")) - 1).alias("row"), "weight")
    ahead = sorted(r.steps for r in targets.select("steps").distinct().collect())  # a few numbers of steps
    if not ahead:
        return targets.select(*KEY, "horizon", F.lit(0).alias("draw"), F.lit(0.0).alias("value")).limit(0)
    w = written(w)
    picks = simulate.bootstrap_rows(w, n_draws, ahead[-1], block, seed)
    rows = z.join(w.select("unit", "date", "row"), ["unit", "date"]).select(*KEY, "row", "z")
    paths = simulate.bootstrap_paths(picks, rows, bootstrap_models(panel, targets), ahead, seed).withColumnRenamed("horizon", "steps")
    draws = paths.join(targets.select(*KEY, "horizon", "steps"), [*KEY, "steps"]).select(*KEY, "horizon", "draw", "value")
    if corrections is not None:
        draws = overlay.corrected(draws, corrections)
    if families is not None:
        prior = families if adjustments is None else families.join(adjustments.select("unit").distinct(), "unit", "left_anti")
        draws = overlay.family_prior(draws, prior)
    return draws if adjustments is None else overlay.adjusted(draws, adjustments)


def calibration(panel: DataFrame, targets: DataFrame, n_draws: int = 200, seed: int = 1, block: float = 8.0) -> DataFrame:
    """(unit, asset, horizon, n, shift_sd, scale_lo, scale_hi): the correction that a unit's own past asks for.

    At up to 14 pseudo-origins, rows of the unit's days, the bootstrap is fitted to what came before and its draws are set against what
    came ``steps`` days after. An origin is a unit of its own, so all of them run in one job; a unit's history is copied 14 times
    at most. Cells with fewer than eight outcomes get the identity.
    """
    days = panel.select("unit", "date").distinct()
    days = days.select("unit", "date", (F.row_number().over(Window.partitionBy("unit").orderBy("date")) - 1).alias("i"))
    most = targets.groupBy("unit").agg(F.max("steps").alias("most"))
    ends = days.groupBy("unit").agg(F.count("*").cast("int").alias("n")).join(most, "unit")
    origins = ends.select("unit", F.explode(simulate.pseudo_origins(F.col("n"), F.col("most"))).alias("origin"))
    handle = F.concat_ws("@", "unit", "origin").alias("handle")
    numbered = panel.join(days, ["unit", "date"])
    past = numbered.join(origins, "unit").where("i <= origin").select(handle, "asset", "date", "value").withColumnRenamed("handle", "unit")
    cells = targets.join(origins, "unit")
    past = written(past)  # read by every part of the models
    draws = forecast_bootstrap(past, cells.select(handle, "asset", "horizon", "steps").withColumnRenamed("handle", "unit"), n_draws, seed, block)
    came = numbered.select(*KEY, F.col("i").alias("at"), "value")
    realized = cells.withColumn("at", F.col("origin") + F.col("steps")).join(came, [*KEY, "at"]).select(handle, "asset", "horizon", "value").withColumnRenamed("handle", "unit")
    pits = scores.pit(draws, realized).withColumn("unit", F.regexp_replace("unit", "@[0-9]+$", ""))
    return scores.correction(pits, [*KEY, "horizon"]).select(*KEY, "horizon", "n", "shift_sd", F.col("scale").alias("scale_lo"), F.col("scale").alias("scale_hi"))


def score(draws: DataFrame, realized: DataFrame, roster: DataFrame, scales: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(units, mean): each roster unit's code or parts and composite, and the roster's mean. A unit whose draws fail a check, or that
    has none, is a row with a code and costs the failure score.

    roster: (unit, asset, horizon, n_draws), the planned cells. The checks are two aggregates over the draws.
    """
    gate = grid.draw_gate(draws).select("unit", F.col("code").alias("gate"))
    cells = grid.occupancy(draws, roster)
    off = F.when((F.col("duplicates") > 0) | (F.col("missing") > 0) | (F.col("extra") > 0), "grid")
    checks = roster.select("unit").distinct().join(gate, "unit", "left").join(cells.select("unit", off.alias("off")), "unit", "left")
    checks = checks.select("unit", F.when(F.col("gate").isNull() & F.col("off").isNull(), F.lit(None)).otherwise(F.coalesce("gate", "off")).alias("code"))
    good = draws.join(checks.where("code is null").select("unit"), "unit", "left_semi")
    units = checks.join(scores.composite(good, realized, scales), "unit", "left")
    units = units.withColumn("code", F.coalesce("code", F.when(F.col("composite").isNull(), "no_score")))
    return units, grid.roster_mean(roster.select("unit").distinct(), units.where("code is null").select("unit", F.col("composite").alias("score")))
