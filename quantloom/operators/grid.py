"""Exact grids of draws, coded refusals and rosters.

A participant's fault becomes a row with a code and counts; an organizer's fault raises. Nothing is averaged,
dropped or filled to make a grid complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAILURE_SCORE = 4.0


class OrganizerFault(RuntimeError):
    """The evaluation's own inputs are wrong; no result may be published."""


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def occupancy(draws: DataFrame, grid: DataFrame) -> DataFrame:
    """(unit, cells, duplicates, missing, extra): keys (draw, cell) that occur more than once, keys of the grid that
    don't occur, and rows outside the grid. grid: (unit, asset, horizon, n_draws), a row for each declared cell.

    The missing keys are counted per cell from distinct draws, so the full grid of draws is never laid out.
    """
    keys = draws.groupBy("unit", "asset", "horizon", "draw").agg(F.count("*").alias("n"))
    cells = keys.groupBy("unit", "asset", "horizon").agg(
        F.sum((F.col("n") > 1).cast("int")).alias("dup"), F.sum("n").alias("rows"), F.count_if(F.col("draw") >= 0).alias("distinct"), F.max("draw").alias("top")
    )
    both = grid.join(cells, ["unit", "asset", "horizon"], "full_outer")
    declared = F.col("n_draws").isNotNull()
    return both.groupBy("unit").agg(
        F.count_if(declared).alias("cells"),
        F.sum(F.when(declared, F.coalesce("dup", F.lit(0))).otherwise(0)).alias("duplicates"),
        F.sum(F.when(declared, F.greatest(F.col("n_draws") - F.coalesce("distinct", F.lit(0)), F.lit(0))).otherwise(0)).alias("missing"),
        F.sum(F.when(declared, F.lit(0)).otherwise(F.col("rows"))).alias("extra"),
    )


def draw_gate(draws: DataFrame, min_draws: int = 200, max_draws: int = 20_000) -> DataFrame:
    """(unit, code, n_rows, n_draws, non_finite, negative): one aggregate of every count that the gate looks at, and
    the code of the first check that fails, NULL when none does."""
    counts = draws.groupBy("unit").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("draw").alias("n_draws"),
        F.count_if(~_finite(F.col("value"))).alias("non_finite"),
        F.count_if(F.col("draw").isNull() | (F.col("draw") < 0)).alias("negative"),
    )
    code = (
        F.when(~F.col("n_draws").between(min_draws, max_draws), "draw_count")
        .when(F.col("negative") > 0, "draw_range")
        .when(F.col("non_finite") > 0, "non_finite")
    )
    return counts.select("unit", code.alias("code"), "n_rows", "n_draws", "non_finite", "negative")


def declared_grid(pairs: DataFrame) -> DataFrame:
    """(unit, equal, duplicates, missing, extra) of declared against planned id arrays: order and multiplicity matter.

    pairs: (unit, declared ARRAY, planned ARRAY). A null array counts as empty.
    """
    d, p = (F.coalesce(c, F.array().cast("array<string>")) for c in ("declared", "planned"))
    return pairs.select(
        "unit",
        (d == p).alias("equal"),
        (F.size(d) - F.size(F.array_distinct(d))).alias("duplicates"),
        F.size(F.array_except(p, d)).alias("missing"),
        F.size(F.array_except(d, p)).alias("extra"),
    )


def label_codes(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """rows with ``code``, the position of their label in ``labels`` (label, code); NULL for unknown ones, to be counted and refused."""
    return rows.join(labels.select(F.col("label").alias(column), "code"), column, "left")


def flatten_realized(realized: DataFrame, grid: DataFrame) -> DataFrame:
    """(unit, values): realized values in the grid's order (cell_idx); a cell without one is NULL in its place."""
    rows = grid.join(realized, ["unit", "asset", "horizon"], "left")
    ordered = F.sort_array(F.collect_list(F.struct("cell_idx", "value")))
    return rows.groupBy("unit").agg(ordered.alias("v")).select("unit", F.transform("v", lambda x: x["value"]).alias("values"))


def roster_mean(roster: DataFrame, scores: DataFrame, low: float = 0.0, high: float = FAILURE_SCORE) -> DataFrame:
    """(n_units, n_failed, mean_score) over the whole roster: scores are clipped, a unit without one costs the failure score.

    roster: (unit), scores: (unit, score). Scored units outside the roster don't count; see :func:`roster_accounts`.
    """
    rows = roster.select("unit").join(scores.select("unit", "score"), "unit", "left")
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), F.when(_finite(F.col("score")), F.col("score"))))
    kept = F.when(_finite(F.col("score")), clipped).otherwise(FAILURE_SCORE)
    return rows.agg(F.count("*").alias("n_units"), F.count_if(~_finite(F.col("score"))).alias("n_failed"), F.avg(kept).alias("mean_score"))


def roster_accounts(roster: DataFrame, scores: DataFrame) -> DataFrame:
    """(missing, extra, duplicate): roster units without a row, rows outside the roster, units with several rows."""
    rows = scores.groupBy("unit").agg(F.count("*").alias("n"))
    both = roster.select("unit", F.lit(1).alias("listed")).distinct().join(rows, "unit", "full_outer")
    return both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("listed").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("duplicate"))


def require_accounts(accounts: DataFrame) -> None:
    """Raise unless the roster's accounts are clean; one row comes to the driver."""
    row = accounts.first()
    if row.missing or row.extra or row.duplicate:
        raise OrganizerFault(f"roster and rows differ: {row.asDict()}")


def valid_scales(scales: DataFrame) -> DataFrame:
    """scales (unit, marginal, joint, tail) with ``valid``, and non-positive or non-finite parts replaced by 1."""
    parts = ["marginal", "joint", "tail"]
    good = {k: _finite(F.col(k)) & (F.col(k) > 0) for k in parts}
    every = good["marginal"] & good["joint"] & good["tail"]
    return scales.select("unit", *(F.when(good[k], F.col(k)).otherwise(1.0).alias(k) for k in parts), F.coalesce(every, F.lit(False)).alias("valid"))


def commitment(digests: DataFrame) -> DataFrame:
    """(n_units, digest): SHA-256 over the canonical JSON object of units and their digests, keys in order.

    All digests meet in one text by definition; a roster is a list of cards, not data.
    """
    pairs = F.sort_array(F.collect_list(F.struct("unit", "digest")))
    text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), p["unit"], F.lit('":"'), p["digest"], F.lit('"'))), ","), F.lit("}"))
    return digests.agg(F.count("*").alias("n_units"), F.sha2(text, 256).alias("digest"))


def group_bootstrap(scores: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, mean): means over resampled groups, for a confidence interval over cards that share a group.

    scores: (grp, score). Groups, not rows, are resampled: the weight of a group in a replicate is the number of
    its hits among as many draws as there are groups, taken from a counter-based uniform.
    """
    from quantloom.functions.rng import uniform

    groups = scores.groupBy("grp").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    order = Window.partitionBy(F.lit(1)).orderBy("grp")  # a row for each group
    groups = groups.withColumn("i", F.row_number().over(order) - 1).withColumn("g", F.count("*").over(Window.partitionBy(F.lit(1))))
    spread = groups.select("i", "g", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    picks = spread.select("replicate", F.floor(uniform(F.lit(seed), F.col("replicate"), F.col("i")) * F.col("g")).cast("int").alias("i"))
    return picks.join(groups.select("i", "s", "n"), "i").groupBy("replicate").agg((F.sum("s") / F.sum("n")).alias("mean"))


def incomplete_draws(draws: DataFrame) -> DataFrame:
    """(unit, n_draws, n_incomplete): draws that lack some cell that their unit's other draws have."""
    cells = draws.groupBy("unit").agg(F.count_distinct("asset", "horizon").alias("cells"))
    per = draws.groupBy("unit", "draw").agg(F.count_distinct("asset", "horizon").alias("have"))
    return per.join(cells, "unit").groupBy("unit").agg(F.count("*").alias("n_draws"), F.count_if(F.col("have") < F.col("cells")).alias("n_incomplete"))


def evidence(roster: DataFrame, digests: DataFrame) -> DataFrame:
    """(n_units, n_without): roster units without a digest (unit, digest); any such unit is an organizer's fault."""
    rows = roster.select("unit").join(digests.groupBy("unit").agg(F.max("digest").alias("digest")), "unit", "left")
    return rows.agg(F.count("*").alias("n_units"), F.count_if(F.col("digest").isNull()).alias("n_without"))
