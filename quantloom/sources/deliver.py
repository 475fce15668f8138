"""Sinks: draws, their side files, and public results."""

from __future__ import annotations

import glob
import json
import os
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.grid import OrganizerFault


def write_draws(draws: DataFrame, path: str) -> None:
    """One file of (draw INT, asset, horizon INT, value), zstd, put in place by a rename; null or non-finite values are refused.

    A unit's draws are bounded by contract (20,000 of 20 cells), so they fit one file.
    """
    v = F.col("value")
    if not draws.where(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).isEmpty():
        raise ValueError("draws must be finite")
    folder = tempfile.mkdtemp(prefix=".draws-", dir=os.path.dirname(os.path.abspath(path)))
    try:
        rows = draws.select(F.col("draw").cast("int"), "asset", F.col("horizon").cast("int"), F.col("value").cast("double")).orderBy("asset", "horizon", "draw")
        rows.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/out")
        os.replace(glob.glob(f"{folder}/out/*.parquet")[0], path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def write_units(draws: DataFrame, path: str) -> None:
    """Draws of many units as a table partitioned by unit: one shuffle puts a unit's rows into one file."""
    draws.repartition("unit").write.mode("overwrite").option("compression", "zstd").partitionBy("unit").parquet(path)


def write_meta(path: str, unit: str, asof: str, assets: Sequence[str], horizons: Sequence[int], n_draws: int, target: str) -> None:
    meta = {"unit_id": unit, "asof": asof, "representation": "samples", "asset_ids": list(assets), "horizons": list(horizons), "n_draws": n_draws, "target": target}
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(meta, f, indent=1)
    os.replace(f"{path}.tmp", path)


def write_rationale(path: str, unit: str, cells: DataFrame) -> None:
    """A short report from a unit's cell statistics (asset, horizon, median, sd), a row for each cell."""
    rows = cells.orderBy("asset", "horizon").collect()
    lines = [f"# {unit}", "", "| asset | horizon | median | sd |", "|---|---|---|---|"]
    lines += [f"| {r.asset} | {r.horizon} | {r['median']:.6g} | {r.sd:.6g} |" for r in rows]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def write_deliverable(folder: str, draws: DataFrame, unit: str, asof: str, assets: Sequence[str], horizons: Sequence[int], n_draws: int, target: str) -> None:
    """The three files of a forecast; left-over temporary files are removed."""
    os.makedirs(folder, exist_ok=True)
    for stale in glob.glob(f"{folder}/*.tmp"):
        os.remove(stale)
    write_draws(draws, f"{folder}/forecast.parquet")
    write_meta(f"{folder}/forecast_meta.json", unit, asof, assets, horizons, n_draws, target)
    cells = draws.groupBy("asset", "horizon").agg(F.median("value").alias("median"), F.stddev_pop("value").alias("sd"))
    write_rationale(f"{folder}/forecast_rationale.md", unit, cells)


def write_public(folder: str, mean: DataFrame, units: DataFrame) -> None:
    """scores.json with the aggregate's one row, and details.jsonl with the failures (unit, code, counts) only, written anew each time.

    A roster is a list of cards; its failures are collected.
    """
    row = mean.first()
    if row is None:
        raise OrganizerFault("there is no aggregate to publish")
    os.makedirs(folder, exist_ok=True)
    failures = units.where("code is not null").orderBy("unit").collect()
    with open(f"{folder}/details.jsonl", "w", encoding="utf-8") as f:
        f.writelines(json.dumps({"unit": r.unit, "code": r.code}) + "\n" for r in failures)
    with open(f"{folder}/scores.json", "w", encoding="utf-8") as f:
        json.dump(row.asDict(), f)


def write_report(rows: DataFrame, path: str, order: Sequence[str]) -> None:
    """A tab-separated report in order; arrays are joined by commas."""
    flat = rows.select(*(F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes))
    flat.orderBy(*order).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)
