"""Draw generators. Every random number is a function of (seed, draw, step, asset), so a draw is the same under any
partitioning and after any retry; parity with other generators is one of distribution, not of streams.

Moments are aggregated by Spark; only matrices of a unit's few assets come to the driver or into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.functions.rng import normal, uniform
from quantloom.operators import steps

#: The seeds by which the five named adapters differ.
ADAPTER_SEEDS = {"theta_arima": 1, "chronos": 11, "timesfm": 22, "lag_llama": 33, "moirai": 44}
#: Fixed value: a pool of so many sigmas or fewer isn't drawn from.
MIN_POOL = 30


def draw_ids(cells: DataFrame, n_draws: int) -> DataFrame:
    """Each row of ``cells`` n_draws times, with its number as ``draw``; generated in the row, without a join."""
    return cells.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))


def adapter_walk(moments: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """(unit, asset, horizon, draw, value): anchor + drift h + sd sqrt(h) Z, assets independent.

    moments: (unit, asset, horizon, anchor, drift, sd, n). sd is at least max(1e-4 |anchor|, 1e-6); without history
    (n = 0 or null) the walk has unit steps from zero.
    """
    known = F.coalesce(F.col("n"), F.lit(0)) > 0
    anchor = F.when(known, F.coalesce("anchor", F.lit(0.0))).otherwise(0.0)
    sd = F.when(known, F.greatest(F.coalesce("sd", F.lit(0.0)), 1e-4 * F.abs(anchor), F.lit(1e-6))).otherwise(1.0)
    drift = F.when(known, F.coalesce("drift", F.lit(0.0))).otherwise(0.0)
    z = normal(F.lit(seed), F.col("draw"), F.col("horizon"), F.col("asset"))
    rows = draw_ids(moments, n_draws)
    return rows.select("unit", "asset", "horizon", "draw", (anchor + drift * F.col("horizon") + sd * F.sqrt("horizon") * z).alias("value"))


def repaired_factor(corr: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """Lower factor of a correlation matrix: NaN becomes 0, the diagonal 1, eigenvalues at least ``least``."""
    c = np.nan_to_num(np.asarray(corr, float), nan=0.0, posinf=0.0, neginf=0.0)
    c = (c + c.T) / 2
    np.fill_diagonal(c, 1.0)
    values, vectors = np.linalg.eigh(c)
    c = (vectors * np.maximum(values, least)) @ vectors.T
    scale = np.sqrt(np.diag(c))
    return np.linalg.cholesky(c / np.outer(scale, scale))


def factors(correlations: DataFrame) -> DataFrame:
    """(unit, asset, other, load): the repaired lower factor of each unit's correlations (unit, a, b, corr), a <= b.

    One small matrix a unit; units are factored in parallel.
    """

    def factor(part: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(part["a"]) | set(part["b"]))
        at = {k: i for i, k in enumerate(names)}
        c = np.eye(len(names))
        for a, b, r in zip(part["a"], part["b"], part["corr"]):
            c[at[a], at[b]] = c[at[b], at[a]] = r if a != b else 1.0
        low = repaired_factor(c)
        i, j = np.tril_indices(len(names))
        return pd.DataFrame({"unit": part["unit"].iloc[0], "asset": [names[k] for k in i], "other": [names[k] for k in j], "load": low[i, j]})

    return correlations.groupBy("unit").applyInPandas(factor, "unit string, asset string, other string, load double")


def correlated_walk(moments: DataFrame, loads: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """(unit, asset, horizon, draw, value): as :func:`adapter_walk` but with correlated innovations, fresh at each horizon.

    loads: (unit, asset, other, load). An asset's loads lie in one array, so its innovation is a sum within the row.
    """
    arrays = loads.groupBy("unit", "asset").agg(F.collect_list(F.struct("other", "load")).alias("l"))
    rows = draw_ids(moments.join(arrays, ["unit", "asset"], "left"), n_draws)
    z = F.aggregate("l", F.lit(0.0), lambda a, x: a + x["load"] * normal(F.lit(seed), F.col("draw"), F.col("horizon"), x["other"]))
    return rows.select("unit", "asset", "horizon", "draw", (F.col("anchor") + F.col("drift") * F.col("horizon") + F.col("sd") * F.sqrt("horizon") * F.coalesce(z, F.lit(0.0))).alias("value"))


def monthly_walk(moments: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """(unit, asset, horizon, draw, value): one shock a calendar month and asset, shared by all horizons that lie beyond it.

    moments: (unit, asset, horizon (months), last_month, anchor, drift, sd). The path is summed up to the furthest month
    and read at each horizon.
    """
    by_asset = moments.groupBy("unit", "asset", "last_month", "anchor", "drift", "sd").agg(F.sort_array(F.collect_set("horizon")).alias("hs"))
    rows = draw_ids(by_asset, n_draws)
    shocks = F.transform(F.sequence(F.lit(1), F.array_max("hs")), lambda m: normal(F.lit(seed), F.col("draw"), F.col("last_month") + m, F.col("asset")))
    rows = rows.withColumn("z", shocks).withColumn("horizon", F.explode("hs"))
    total = F.aggregate(F.slice("z", F.lit(1), F.col("horizon")), F.lit(0.0), lambda a, x: a + x)
    return rows.select("unit", "asset", "horizon", "draw", (F.col("anchor") + F.col("drift") * F.col("horizon") + F.col("sd") * total).alias("value"))


def covariance_draws(moments: DataFrame, covariances: DataFrame, n_draws: int, seed: int, ridge: float = 1.1e-9) -> DataFrame:
    """(unit, asset, horizon, draw, value) of the text-blind baseline: mean anchor + s drift, covariance min(s_i, s_j) cov_ij over a
    unit's cells sorted by asset and horizon, drawn through one factor a unit. ``ridge`` is added to the variances. A unit without
    cells has no rows; one whose matrix holds no covariances (infinite, or of a negative horizon) has null values, which the draw gate refuses."""

    def factor(key: tuple, cells: pd.DataFrame, cov: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["asset", "horizon"]).reset_index(drop=True)
        pair = {(a, b): c for a, b, c in zip(cov["a"], cov["b"], cov["cov"])}
        k = len(cells)
        s = np.empty((k, k))
        for i in range(k):
            for j in range(k):
                a, b = sorted((cells.asset[i], cells.asset[j]))
                s[i, j] = min(cells.horizon[i], cells.horizon[j]) * pair.get((a, b), 0.0)
        s += np.eye(k) * ridge
        if np.isfinite(s).all() and (np.diag(s) > 0).all():
            sd = np.sqrt(np.diag(s))  # factored as correlations, so that a wide asset leaves the others' digits alone
            values, vectors = np.linalg.eigh(s / np.outer(sd, sd))
            low = sd[:, None] * vectors * np.sqrt(np.maximum(values, 0))
        else:
            low = np.full((k, k), np.nan)
        loads = pd.Series(list(low), dtype=object)  # an empty list of arrays would count as numbers
        return pd.DataFrame({"unit": key[0], "asset": cells.asset, "horizon": cells.horizon, "mean": cells.anchor + cells.horizon * cells.drift, "loads": loads})

    schema = "unit string, asset string, horizon int, mean double, loads array<double>"
    covariances = covariances.select(F.col("unit").alias("_unit"), "a", "b", "cov")  # both may come from one relation
    rows = moments.groupBy("unit").cogroup(covariances.groupBy("_unit")).applyInPandas(factor, schema)
    # a row a unit and draw, so that its normals are made once for all cells
    units = rows.groupBy("unit").agg(F.collect_list(F.struct("asset", "horizon", "mean", "loads")).alias("cells"))
    z = F.transform(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: normal(F.lit(seed), F.col("draw"), i, F.col("unit")))
    rows = draw_ids(units, n_draws).withColumn("z", z).select("unit", "draw", "z", F.explode("cells").alias("c"))
    sum_ = F.aggregate(F.zip_with("c.loads", "z", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return rows.select("unit", "c.asset", "c.horizon", "draw", (F.col("c.mean") + sum_).alias("value"))


def gaussian_floor(panel: DataFrame, horizons: DataFrame, n_draws: int, seed: int, trailing: int = 300) -> DataFrame:
    """(unit, asset, horizon, draw, value): the Gaussian floor, anchor + drift s plus the sum of s correlated steps, one path a
    draw for all horizons.

    panel: (unit, asset, date, value) up to the as-of; horizons: (unit, asset, horizon), steps ahead. Mean, population
    deviation and correlation are those of the last ``trailing`` steps, paired by date; assets with 20 common dates or fewer
    are independent. A series without steps walks with unit steps, one of a single row or none from zero.
    """
    key = ["unit", "asset"]
    s = steps.trailing_rows(steps.clean_steps(panel, key), key, trailing)
    last = panel.groupBy(*key).agg(F.count("*").alias("rows"), F.max_by("value", "date").alias("last"))
    cells = horizons.select(*key, F.greatest("horizon", F.lit(1)).alias("s"), "horizon").join(steps.moments(s, key), key, "left").join(last, key, "left")
    pairs = steps.correlations(steps.aligned(s, ["unit"]), ["unit"]).withColumn("corr", F.when(F.col("n") > 20, F.col("corr")).otherwise(0.0))
    loads = factors(pairs)
    assets = cells.select(*key).distinct()
    loads = loads.unionByName(assets.join(loads, key, "left_anti").select(*key, F.col("asset").alias("other"), F.lit(1.0).alias("load")))
    # sums of correlated steps are loads of sums: a path an asset and draw, read at the unit's horizons
    walks = loads.select("unit", "other").distinct().join(cells.groupBy("unit").agg(F.sort_array(F.collect_set("s")).alias("ss")), "unit")
    z = F.transform(F.sequence(F.lit(1), F.array_max("ss")), lambda t: normal(F.lit(seed), F.col("draw"), t, F.col("other")))
    walks = draw_ids(walks, n_draws).withColumn("z", z).select("unit", "other", "draw", "z", F.explode("ss").alias("s"))
    walks = walks.select("unit", "other", "draw", "s", F.aggregate(F.slice("z", F.lit(1), F.col("s")), F.lit(0.0), lambda a, x: a + x).alias("w"))
    moves = walks.join(loads, ["unit", "other"]).groupBy(*key, "s", "draw").agg(F.sum(F.col("load") * F.col("w")).alias("w"))
    anchor = F.when(F.col("rows") >= 2, F.coalesce("last", F.lit(0.0))).otherwise(0.0)
    sd = F.when(F.col("n") > 0, F.greatest("sd_pop", F.lit(1e-6))).otherwise(1.0)
    value = anchor + F.coalesce("mean", F.lit(0.0)) * F.col("s") + sd * F.col("w")
    return cells.join(moves, [*key, "s"]).select(*key, "horizon", "draw", value.alias("value"))


def bootstrap_rows(weights: DataFrame, n_draws: int, n_steps: int, block: float, seed: int) -> DataFrame:
    """(unit, draw, t, row): row numbers of a stationary block bootstrap. A block starts at the first step and with chance
    1/block at each later one, at a row drawn by weight; else the row after the last one follows, in a circle.

    weights: (unit, row 0.., weight). A start is found by inverse distribution in the unit's sorted cumulative array,
    which has a number a day; no join of draws with rows takes place.
    """
    by = Window.partitionBy("unit").orderBy("row")
    cum = weights.select("unit", "row", F.sum("weight").over(by).alias("c"))
    arrays = cum.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("row", "c"))).alias("w"))
    arrays = arrays.select("unit", F.size("w").alias("n"), F.transform("w", lambda x: x["c"]).alias("c"))

    def start(t: Column) -> Column:
        """Where a block opens, the number of cumulated weights up to a uniform, by halving; the array stays in the draw's row."""
        u, v = uniform(F.lit(seed), F.col("draw"), t, F.lit("block")), uniform(F.lit(seed), F.col("draw"), t, F.lit("start"))
        at = v * F.element_at("c", F.lit(-1))

        def halve(a: Column, _: Column) -> Column:
            mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
            below = (a["lo"] < a["hi"]) & (F.get("c", mid) <= at)
            return F.struct(F.when(below, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(below, a["hi"]).otherwise(F.least(mid, a["hi"])).alias("hi"))

        found = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.col("n") + 1)).cast("int")), F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi")), halve, lambda a: a["lo"])
        return F.when((t == 0) | (u >= 1 - 1 / block), F.least(found, F.col("n") - 1))

    starts = F.transform(F.sequence(F.lit(0), F.lit(n_steps - 1)), start)
    rows = draw_ids(arrays, n_draws).select("unit", "draw", "n", F.posexplode(starts).alias("t", "start"))
    path = Window.partitionBy("unit", "draw").orderBy("t")
    opened, at = F.last("start", ignorenulls=True).over(path), F.last(F.when(F.col("start").isNotNull(), F.col("t")), ignorenulls=True).over(path)
    return rows.select("unit", "draw", "t", ((opened + F.col("t") - at) % F.col("n")).cast("int").alias("row"))


def bootstrap_paths(picks: DataFrame, z: DataFrame, models: DataFrame, horizons: Sequence[int], seed: int, min_rows: int = 5) -> DataFrame:
    """(unit, asset, horizon, draw, value): paths of the picked days' innovations, joint over assets, read at the horizons.

    picks: (unit, draw, t, row); z: (unit, asset, row, z); models: (unit, asset, anchor, sigma, drift, phi, log_return) and, if
    need be, sigma_pool ARRAY<DOUBLE>. A step is z sigma + drift, for returns log1p of it; each value keeps 1-phi of the path
    before. An asset without ``min_rows`` innovations draws standard normals instead. An asset with a pool of more than
    ``MIN_POOL`` sigmas draws one of them a draw, each with a chance in proportion to its size.
    """
    count = z.groupBy("unit", "asset").agg(F.count("z").alias("n_z"))
    models = models.join(count, ["unit", "asset"], "left")
    rows = picks.join(models.select("unit", "asset", "n_z"), "unit").join(z, ["unit", "asset", "row"], "left")
    own = F.when(F.coalesce("n_z", F.lit(0)) < min_rows, normal(F.lit(seed), F.col("draw"), F.col("t"), F.col("asset"))).otherwise(F.coalesce("z", F.lit(0.0)))
    path = rows.groupBy("unit", "asset", "draw").agg(F.sort_array(F.collect_list(F.struct("t", own.alias("z")))).alias("p"))
    path = path.join(models, ["unit", "asset"]).withColumn("sigma", _pooled_sigma(seed) if "sigma_pool" in models.columns else F.col("sigma"))
    path = path.select("unit", "asset", "draw", "p", "anchor", "sigma", "drift", "phi", "log_return", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))

    def step(s: Column) -> Column:
        x = s["z"] * F.col("sigma") + F.col("drift")
        return F.when(F.col("log_return"), F.log1p(F.greatest(x, F.lit(-0.999999)))).otherwise(x)

    end = F.aggregate(F.slice("p", F.lit(1), F.col("horizon")), F.lit(0.0), lambda a, s: a * (1 - F.col("phi")) + step(s))
    return path.select("unit", "asset", "horizon", "draw", (F.col("anchor") + end).alias("value"))


def _pooled_sigma(seed: int) -> Column:
    """The first sigma of the pool at which its running sum passes a uniform share of the whole; sigma itself without a pool."""
    pool = F.filter("sigma_pool", lambda x: x > 0)
    total = F.aggregate(pool, F.lit(0.0), lambda a, x: a + x)
    at = uniform(F.lit(seed), F.col("draw"), F.lit("sigma"), F.col("asset")) * total
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("s"))
    found = F.aggregate(pool, start, lambda a, x: F.struct((a["c"] + x).alias("c"), F.coalesce(a["s"], F.when(a["c"] + x > at, x)).alias("s")))
    return F.coalesce(F.when(F.size("sigma_pool") > MIN_POOL, found["s"]), F.col("sigma"))


def pseudo_origins(n: Column, furthest: Column, keep: int = 14) -> Column:
    """Row numbers from max(n/5, 40) to n - furthest - 1, max(furthest + 2, 8) apart, the last ``keep`` of them."""
    first, last = F.greatest(F.floor(n / 5), F.lit(40)).cast("int"), (n - furthest - 2).cast("int")
    every = F.when(last >= first, F.sequence(first, last, F.greatest(furthest + 2, F.lit(8)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.slice(every, F.greatest(F.size(every) - keep + 1, F.lit(1)), keep)


def synthetic_models(roster: DataFrame, models: DataFrame) -> DataFrame:
    """(unit, asset, anchor, sigma) for roster assets without a model: anchor 1 and twice the unit's median sigma."""
    missing = roster.join(models, ["unit", "asset"], "left_anti")
    context = models.groupBy("unit").agg(F.median("sigma").alias("s"))
    return missing.join(context, "unit", "left").select("unit", "asset", F.lit(1.0).alias("anchor"), (2 * F.coalesce("s", F.lit(0.5))).alias("sigma"))


def transfer_scale(models: DataFrame, beta: float = 1.5) -> DataFrame:
    """models (unit, asset, anchor, sigma, s75, basket, ratio) with ``sigma_out``: max(sigma, s75, floor) times the basket's
    ratio, at most four times; floor is 0.8 beta basket |anchor|, or sigma where basket or anchor is zero."""
    floor = F.when((F.coalesce("basket", F.lit(0.0)) == 0) | (F.col("anchor") == 0), F.col("sigma")).otherwise(0.8 * beta * F.col("basket") * F.abs("anchor"))
    base = F.greatest("sigma", F.coalesce("s75", F.lit(0.0)), floor)
    return models.withColumn("sigma_out", F.least(base * F.greatest(F.coalesce("ratio", F.lit(1.0)), F.lit(1.0)), 4.0 * base))
