"""Transforms of draws about the centre of their cell.

draws: (unit, asset, horizon, draw, value). Medians and deviations are those of the cell; the number of a cell's draws
is bounded by contract, and so are the windows. A cell without an adjustment comes out as it went in. Null parts of an
adjustment have their neutral value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL = ["unit", "asset", "horizon"]


def _clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    return F.greatest(F.lit(low) if isinstance(low, float) else low, F.least(F.lit(high) if isinstance(high, float) else high, x))


def _centre(draws: DataFrame, *more: str) -> DataFrame:
    w = Window.partitionBy(*CELL, *more)
    return draws.withColumn("med", F.median("value").over(w)).withColumn("sd", F.stddev_pop("value").over(w)).withColumn("mean", F.avg("value").over(w))


def corrected(draws: DataFrame, corrections: DataFrame, by: list[str] = CELL) -> DataFrame:
    """Affine correction about the median: deviations times scale_hi or scale_lo, plus shift_sd deviations.

    corrections: (by..., shift_sd, scale_lo, scale_hi). Cells without spread stay.
    """
    rows = _centre(draws).join(corrections, by, "left")
    dev = F.col("value") - F.col("med")
    scaled = dev * F.when(dev > 0, F.coalesce("scale_hi", F.lit(1.0))).otherwise(F.coalesce("scale_lo", F.lit(1.0)))
    moved = F.col("med") + scaled + F.coalesce("shift_sd", F.lit(0.0)) * F.col("sd")
    return rows.select(*CELL, "draw", F.when(F.col("sd") > 0, moved).otherwise(F.col("value")).alias("value"))


def adjusted(draws: DataFrame, adjustments: DataFrame, vol: tuple[float, float] = (0.7, 1.6), drift_cap: float = 1.5, skew_cap: float = 0.5) -> DataFrame:
    """Overlay: skew stretches one side, vol scales about the median, drift in basis points of the anchor shifts by at most
    ``drift_cap`` deviations. The row of a cell's own horizon holds before the asset's row without one.

    adjustments: (unit, asset, horizon or NULL, scale, drift_bp, vol_scale, skew), scale the size of a whole.
    """
    parts = ["drift_bp", "vol_scale", "skew"]
    base = adjustments.where("horizon is null").select("unit", "asset", F.lit(True).alias("_any"), F.col("scale").alias("_s"), *(F.col(p).alias(f"b_{p}") for p in parts))
    own = adjustments.where("horizon is not null").select(*CELL, F.lit(True).alias("_own"), F.col("scale").alias("_t"), *(F.col(p).alias(f"o_{p}") for p in parts))
    rows = _centre(draws).join(base, ["unit", "asset"], "left").join(own, CELL, "left")
    scale = F.coalesce("_t", "_s", F.lit(1.0))
    drift = F.when(F.col("_own"), F.coalesce("o_drift_bp", F.lit(0.0))).otherwise(F.coalesce("b_drift_bp", F.lit(0.0)))
    v = _clamp(F.coalesce("o_vol_scale", "b_vol_scale", F.lit(1.0)), *vol)
    k = _clamp(F.coalesce("o_skew", "b_skew", F.lit(0.0)), -skew_cap, skew_cap)
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    shift = _clamp(scale * drift / 1e4, -drift_cap * sd, drift_cap * sd)
    dev = F.col("value") - F.col("med")
    dev = dev * F.when(dev > 0, 1 + k).otherwise(1 - k)
    touched = F.col("_any").isNotNull() | F.col("_own").isNotNull()
    return rows.select(*CELL, "draw", F.when(touched, F.col("med") + dev * v + shift).otherwise(F.col("value")).alias("value"))


def mixed_scenarios(draws: DataFrame, scenarios: DataFrame, shifts: DataFrame) -> DataFrame:
    """Scenario mixture: up to three branches take the first round(p n) draws each, in order, and move about the median of
    their own branch. n is the number of the cell's own draws, so a unit whose cells are whole has each draw in one branch.

    scenarios: (branch 1.., p, vol); shifts: (branch, asset, k). The branches are few rows.
    """
    kept = scenarios.where("branch <= 3").select("branch", F.nanvl(F.coalesce("p", F.lit(0.0)), F.lit(0.0)).alias("p"), _clamp(F.coalesce("vol", F.lit(1.0)), 0.8, 2.0).alias("vol"))
    listed = kept.agg(F.sort_array(F.collect_list(F.struct("branch", "p", "vol"))).alias("b")).first().b
    cell = Window.partitionBy(*CELL)
    whole = draws.withColumn("cell_sd", F.stddev_pop("value").over(cell)).withColumn("n", F.count("*").over(cell))
    branch, vol, lo = F.lit(0), F.lit(1.0), F.lit(0)
    for b in listed:
        hi = lo + F.bround(F.lit(min(max(b.p, 0.0), 1.0)) * F.col("n")).cast("int")
        inside = (F.col("draw") >= lo) & (F.col("draw") < hi)
        branch, vol, lo = F.when(inside, b.branch).otherwise(branch), F.when(inside, b.vol).otherwise(vol), hi
    rows = _centre(whole.withColumn("branch", branch).withColumn("vol", vol), "branch").join(shifts, ["branch", "asset"], "left")
    sd = F.when(F.col("cell_sd") > 0, F.col("cell_sd")).otherwise(1.0)
    moved = F.col("med") + (F.col("value") - F.col("med")) * F.col("vol") + F.col("k") * sd
    return rows.select(*CELL, "draw", F.when(F.coalesce("k", F.lit(0.0)) != 0, moved).otherwise(F.col("value")).alias("value"))


def two_scalar(draws: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Two-scalar adjustment about the mean: vol in [0.5, 2], drift within three deviations. adjustments: (unit, asset, shift, vol)."""
    rows = _centre(draws).join(adjustments, ["unit", "asset"], "left")
    v = _clamp(F.coalesce("vol", F.lit(1.0)), 0.5, 2.0)
    shift = _clamp(F.coalesce("shift", F.lit(0.0)), -3.0 * F.col("sd"), 3.0 * F.col("sd"))
    return rows.select(*CELL, "draw", (F.col("mean") + (F.col("value") - F.col("mean")) * v + shift).alias("value"))


#: Family, volatility and skew of the prior for units without text.
FAMILY_PRIOR = [("F4", 2.2, -0.35), ("F2", 1.5, -0.15)]


def family_prior(draws: DataFrame, families: DataFrame) -> DataFrame:
    """The prior of a unit's family applied as an overlay with wide volatility. families: (unit, family)."""
    spark = draws.sparkSession
    prior = spark.createDataFrame(FAMILY_PRIOR, "family string, vol_scale double, skew double")
    assets = draws.select("unit", "asset").distinct()
    rows = assets.join(families, "unit").join(F.broadcast(prior), "family")
    adj = rows.select("unit", "asset", F.lit(None).cast("int").alias("horizon"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("drift_bp"), "vol_scale", "skew")
    return adjusted(draws, adj, vol=(0.8, 2.4))
