"""Scores of forecasts given as draws against one realized value a cell.

draws: (unit, asset, horizon, draw, value); realized: (unit, asset, horizon, value). A cell is (unit, asset,
horizon). Draws are matched to realized values by an inner join on the cell: cells without an outcome or without
draws have no score. Null and NaN values must be refused beforehand (see grid.draw_gate); nulls are ignored by the
aggregates. Empty tables give empty results; other columns are ignored.

The number of draws of a cell is bounded by contract (20,000), and so are the partitions of windows over a cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.session import written

CELL = ["unit", "asset", "horizon"]
LEVELS = (0.01, 0.05, 0.95, 0.99)
WEIGHTS = {"marginal": 0.5, "joint": 0.3, "tail": 0.2}


def _matched(draws: DataFrame, realized: DataFrame) -> DataFrame:
    return draws.select(*CELL, "draw", "value").join(realized.select(*CELL, F.col("value").alias("y")), CELL)


def crps(draws: DataFrame, realized: DataFrame) -> DataFrame:
    """(cell, n_draws, crps): E|X-y| - E|X-X'|/2 by the sorted identity, one sort a cell instead of all pairs."""
    ranked = draws.where("value is not null").withColumn("i", F.row_number().over(Window.partitionBy(*CELL).orderBy("value")))
    sums = ranked.join(realized.select(*CELL, F.col("value").alias("y")), CELL).groupBy(*CELL).agg(
        F.count("*").alias("n_draws"),
        F.avg(F.abs(F.col("value") - F.col("y"))).alias("miss"),
        F.sum(F.col("value") * F.col("i")).alias("vi"),
        F.sum("value").alias("v"),
    )
    n = F.col("n_draws")
    return sums.select(*CELL, "n_draws", (F.col("miss") - (2 * F.col("vi") - (n + 1) * F.col("v")) / (n * n)).alias("crps"))


def quantiles(draws: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """(cell, level, q): linearly interpolated exact quantiles."""
    qs = draws.groupBy(*CELL).agg(F.percentile("value", F.array(*map(F.lit, levels))).alias("qs"))
    pairs = F.arrays_zip(F.array(*map(F.lit, levels)).alias("level"), F.col("qs").alias("q"))
    return qs.select(*CELL, F.explode(pairs).alias("p")).select(*CELL, F.col("p")["level"].alias("level"), F.col("p")["q"].alias("q"))


def pinball(draws: DataFrame, realized: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """(cell, level, q, loss): a(y-q) where y >= q, else (1-a)(q-y)."""
    y, q, a = F.col("y"), F.col("q"), F.col("level")
    rows = quantiles(draws, levels).join(realized.select(*CELL, F.col("value").alias("y")), CELL)
    return rows.select(*CELL, "level", "q", F.when(y >= q, a * (y - q)).otherwise((1 - a) * (q - y)).alias("loss"))


def tail_pinball(draws: DataFrame, realized: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """(unit, tail): mean over levels of the mean loss over cells."""
    by_level = pinball(draws, realized, levels).groupBy("unit", "level").agg(F.avg("loss").alias("loss"))
    return by_level.groupBy("unit").agg(F.avg("loss").alias("tail"))


def tail_coverage(draws: DataFrame, realized: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """(unit, coverage): sum over levels of |share of cells with y <= q - level|."""
    rows = quantiles(draws, levels).join(realized.select(*CELL, F.col("value").alias("y")), CELL)
    shares = rows.groupBy("unit", "level").agg(F.avg((F.col("y") <= F.col("q")).cast("int")).alias("share"))
    return shares.groupBy("unit").agg(F.sum(F.abs(F.col("share") - F.col("level"))).alias("coverage"))


def variogram(draws: DataFrame, realized: DataFrame, p: float = 0.5) -> DataFrame:
    """(unit, joint): sum over ordered pairs of cells of (|y_i-y_j|^p - E|x_i-x_j|^p)^2; 0 for a single cell.

    The cells of a draw come together in one array, whose size the grid bounds; its pairs are formed in the row.
    """
    cell = F.struct("asset", "horizon", "value", "y")
    rows = _matched(draws, realized).groupBy("unit", "draw").agg(F.sort_array(F.collect_list(cell)).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    flat = rows.select("unit", F.explode(pairs).alias("p"))

    def field(side: str, name: str) -> Column:
        return F.col("p")[side][name]

    keys = [field(s, k).alias(f"{s}_{k}") for s in "ab" for k in ("asset", "horizon")]
    x = F.pow(F.abs(field("a", "value") - field("b", "value")), p)
    y = F.pow(F.abs(field("a", "y") - field("b", "y")), p)
    means = flat.groupBy("unit", *keys).agg(F.avg(x).alias("x"), F.max(y).alias("y"))
    per_unit = means.groupBy("unit").agg((2 * F.sum(F.pow(F.col("y") - F.col("x"), 2))).alias("joint"))
    return draws.select("unit").distinct().join(per_unit, "unit", "left").select("unit", F.coalesce("joint", F.lit(0.0)).alias("joint"))


def _packed(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows to a row a batch, cell and block of draws, its numbers as bytes: a shuffle of them moves little more than the values."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            draw, x, y = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("draw", "value", "y"))
            code = draw // block - draw.min() // block
            for k in CELL:
                names = rows.column(k).dictionary_encode()
                code = code * len(names.dictionary) + names.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            ends = [*np.flatnonzero(np.diff(code[order])) + 1, len(order)]
            parts = [order[a:b] for a, b in zip([0, *ends], ends)]
            heads = rows.take(pa.array([p[0] for p in parts]))
            yield pa.RecordBatch.from_pydict({
                **{k: heads.column(k) for k in CELL},
                "block": pa.array([draw[p[0]] // block for p in parts], pa.int64()),
                "draws": pa.array([(draw[p] % block).astype(np.int32).tobytes() for p in parts], pa.binary()),
                "xs": pa.array([x[p].tobytes() for p in parts], pa.binary()),
                "ys": pa.array([y[p].tobytes() for p in parts], pa.binary()),
            })

    return pack


def _distances(a: np.ndarray, b: np.ndarray | None = None, tile: int = 256) -> float:
    """The sum of the distances of all rows of ``a`` to all of ``b``, or, without ``b``, among themselves; by tiles that stay in the cache."""
    other, centre = a if b is None else b, a.mean(0)
    a, other = a - centre, other - centre
    left = np.column_stack([a, (a**2).sum(1), np.ones(len(a))])
    right = np.vstack([-2 * other.T, np.ones(len(other)), (other**2).sum(1)])
    sums, room = [], np.empty(tile * tile)
    for i in range(0, len(a), tile):
        for j in range(0 if b is not None else i, len(other), tile):
            p, q = left[i : i + tile], right[:, j : j + tile]
            d = room[: len(p) * q.shape[1]].reshape(len(p), q.shape[1])
            for least in (None, 0.0):  # rows that agree may come out below zero: only then are the squares bounded
                np.matmul(p, q, out=d)
                if least is not None:
                    np.maximum(d, least, out=d)
                if b is None and i == j:
                    np.fill_diagonal(d, 0.0)
                with np.errstate(invalid="ignore"):
                    total = float(np.sqrt(d, out=d).sum())
                if not np.isnan(total):
                    break
            sums.append(total * (2 if b is None and i != j else 1))
    return math.fsum(sums)


def _matrices(key: tuple, part: pa.Table) -> pa.Table:
    """A block's draws as matrices, one for each number of cells that draws have, with the sums of its misses and distances."""
    unit, block = (k.as_py() for k in key)
    cells = list(zip(part["asset"].to_pylist(), part["horizon"].to_pylist()))
    rank = {c: i for i, c in enumerate(sorted(set(cells)))}
    draw, x, y = (np.concatenate([np.frombuffer(v.as_py(), kind) for v in part[k]]) for k, kind in (("draws", np.int32), ("xs", float), ("ys", float)))
    at = np.repeat([rank[c] for c in cells], [len(v.as_py()) // 4 for v in part["draws"]])
    order = np.lexsort((y, x, at, draw))
    x, y = x[order], y[order]
    _, counts = np.unique(draw, return_counts=True)
    of_row = np.repeat(counts, counts)
    out = []
    for k in np.unique(counts):
        v, w = x[of_row == k].reshape(-1, k), y[of_row == k].reshape(-1, k)
        out.append({"unit": unit, "block": block, "cells": int(k), "n": len(v), "miss": float(np.sqrt(((v - w) ** 2).sum(1)).sum()), "spread": _distances(v), "x": v.tobytes()})
    return pa.Table.from_pylist(out, MATRICES)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pairs in batches:
        sums = []
        for k, a, b in zip(pairs.column("cells").to_pylist(), pairs.column("x"), pairs.column("x2")):
            sums.append(2 * _distances(*(np.frombuffer(v.as_buffer(), float).reshape(-1, k) for v in (a, b))))
        yield pa.RecordBatch.from_pydict({"unit": pairs.column("unit").cast(pa.string()), "spread": pa.array(sums, pa.float64())})


MATRICES = pa.schema([("unit", pa.string()), ("block", pa.int64()), ("cells", pa.int32()), ("n", pa.int64()), ("miss", pa.float64()), ("spread", pa.float64()), ("x", pa.binary())])


def energy(draws: DataFrame, realized: DataFrame, block: int = 32768) -> DataFrame:
    """(unit, n_draws, energy): E||X-y|| - E||X-X'||/2 over the draws that have every cell.

    All pairs of a unit's draws count by definition. Draws are laid out once, in matrices of ``block`` draws, and written to the
    checkpoint folder; a unit of one matrix is done then. The matrices of larger units are paired by a Cartesian product, whose
    tasks read them where they lie: nothing is copied for each pair, and no task holds more than its share of two matrices.
    """
    rows = _matched(draws, realized).where("draw is not null")
    rows = rows.select(F.col("unit").cast("string"), F.col("asset").cast("string"), F.col("horizon").cast("long"), F.col("draw").cast("long"), F.col("value").cast("double"), F.col("y").cast("double"))
    packs = rows.mapInArrow(_packed(block), "unit string, asset string, horizon long, block long, draws binary, xs binary, ys binary")
    made = written(packs.groupBy("unit", "block").applyInArrow(_matrices, "unit string, block long, cells int, n long, miss double, spread double, x binary"))
    units = made.groupBy("unit").agg(F.max("cells").alias("cells"))
    whole = made.join(F.broadcast(units), ["unit", "cells"])
    sums = whole.select("unit", "n", "miss", "spread")
    several = whole.groupBy("unit").agg(F.count("*").alias("blocks")).where("blocks > 1").select("unit")
    if not several.isEmpty():
        large = whole.join(F.broadcast(several), "unit")
        a, b = large.select("unit", "cells", "block", "x"), large.select(F.col("unit").alias("unit2"), F.col("block").alias("block2"), F.col("x").alias("x2"))
        pairs = a.hint("shuffle_replicate_nl").join(b, F.expr("unit = unit2 and block < block2")).select("unit", "cells", "x", "x2")
        between = pairs.mapInArrow(_between, "unit string, spread double")
        sums = sums.unionByName(between.select("unit", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("miss"), "spread"))
    total = sums.groupBy("unit").agg(F.sum("n").alias("n_draws"), F.sum("miss").alias("miss"), F.sum("spread").alias("spread"))
    return total.select("unit", "n_draws", F.when(F.col("n_draws") > 0, F.col("miss") / F.col("n_draws") - F.col("spread") / (2 * F.col("n_draws") * F.col("n_draws"))).alias("energy"))


def composite(draws: DataFrame, realized: DataFrame, scales: DataFrame | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(unit, cells, marginal, joint, tail, composite): the weighted sum of CRPS, variogram and tail loss, each over its scale.

    scales: (unit, marginal, joint, tail), 1 where absent. A unit of one cell has no joint part: its weights are those of
    marginal and tail, renormalized.
    """
    marginal = crps(draws, realized).groupBy("unit").agg(F.count("*").alias("cells"), F.avg("crps").alias("marginal"))
    parts = marginal.join(variogram(draws, realized), "unit").join(tail_pinball(draws, realized), "unit")
    one = {f"s_{k}": F.lit(1.0) for k in weights}
    if scales is not None:
        parts = parts.join(scales.select("unit", *(F.col(k).alias(f"s_{k}") for k in weights)), "unit", "left")
        one = {f"s_{k}": F.coalesce(f"s_{k}", F.lit(1.0)) for k in weights}
    m, j, t = (F.lit(weights[k]) * F.col(k) / one[f"s_{k}"] for k in ("marginal", "joint", "tail"))
    both = weights["marginal"] + weights["tail"]
    return parts.select("unit", "cells", "marginal", "joint", "tail", F.when(F.col("cells") == 1, (m + t) / both).otherwise(m + j + t).alias("composite"))


def pit(draws: DataFrame, realized: DataFrame) -> DataFrame:
    """(cell, pit, in50, in90): share of draws at or below the outcome, and whether central intervals hold it."""
    rows = _matched(draws, realized).groupBy(*CELL).agg(
        F.avg((F.col("value") <= F.col("y")).cast("int")).alias("pit"),
        F.percentile("value", F.array(*map(F.lit, (0.05, 0.25, 0.75, 0.95)))).alias("q"),
        F.max("y").alias("y"),
    )
    y, q = F.col("y"), F.col("q")
    return rows.select(*CELL, "pit", y.between(q[1], q[2]).cast("int").alias("in50"), y.between(q[0], q[3]).cast("int").alias("in90"))


def correction(pits: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., n, shift_sd, scale): affine correction from probability integral transforms; the identity below eight of them."""
    n, w = F.col("n"), F.col("n") / (F.col("n") + 8.0)
    rows = pits.groupBy(*by).agg(F.count("pit").alias("n"), F.percentile("pit", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    shift = F.greatest(F.lit(-0.45), F.least(F.lit(0.45), -2.0 * w * (F.col("q")[1] - 0.5)))
    scale = F.greatest(F.lit(0.75), F.least(F.lit(1.45), 1.0 + w * ((F.col("q")[2] - F.col("q")[0]) / 0.5 - 1.0)))
    return rows.select(*by, "n", F.when(n < 8, 0.0).otherwise(shift).alias("shift_sd"), F.when(n < 8, 1.0).otherwise(scale).alias("scale"))


def registry() -> Iterator[str]:
    """Names of the tail metrics that can be chosen."""
    return iter(TAIL_METRICS)


TAIL_METRICS = {"pinball": tail_pinball, "coverage": tail_coverage}
