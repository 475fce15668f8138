"""Bounded reads of small files that others have written: sizes and footers are looked at before any content."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import stat
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


#: The closed list of refusals.
CODES = frozenset(
    """missing_file irregular_file oversize bad_json bad_parquet duplicate_columns row_groups columns rows unpacked row_count types file_set
    blank_rationale schema binding grid target_dates""".split()
)


class Refusal(ValueError):
    """A participant's fault: a code from a closed list and counts, nothing of the content."""

    def __init__(self, code: str, **counts: int):
        if code not in CODES:
            raise TypeError("a refusal's code is on the list")
        if any(not isinstance(n, int) or isinstance(n, bool) or n < 0 for n in counts.values()):
            raise TypeError("a refusal carries counts only")
        self.code, self.counts = code, counts
        super().__init__(f"{code} {counts}" if counts else code)


@dataclass(frozen=True)
class Limits:
    """Ceilings on what is read."""

    json_bytes: int = 256 * 1024
    text_bytes: int = 1024 * 1024
    parquet_bytes: int = 64 * 1024 * 1024
    parquet_unpacked: int = 2 * 1024**3
    row_groups: int = 64
    rows: int = 5_000_000
    columns: int = 8
    min_draws: int = 200
    max_draws: int = 20_000


@dataclass(frozen=True)
class Footer:
    rows: int
    columns: tuple[str, ...]
    row_groups: int
    unpacked: int


def regular_file(path: str, most: int) -> int:
    """Size of a regular file with one name; links, special files, further hard links and larger files are refused."""
    try:
        s = os.lstat(path)
    except FileNotFoundError as e:
        raise Refusal("missing_file") from e
    if not stat.S_ISREG(s.st_mode) or s.st_nlink != 1:
        raise Refusal("irregular_file")
    if s.st_size > most:
        raise Refusal("oversize", size=s.st_size)
    return s.st_size


def read_object(path: str, limits: Limits = Limits()) -> dict:
    """A JSON object in UTF-8."""
    regular_file(path, limits.json_bytes)
    try:
        with open(path, encoding="utf-8") as f:
            value = json.load(f)
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as e:
        raise Refusal("bad_json") from e
    if not isinstance(value, dict):
        raise Refusal("bad_json")
    return value


def has_content(path: str, limits: Limits = Limits()) -> bool:
    """Whether a text has anything but white space; read piece by piece."""
    regular_file(path, limits.text_bytes)
    with open(path, encoding="utf-8", errors="replace") as f:
        return any(piece.strip() for piece in iter(lambda: f.read(65_536), ""))


def footer(path: str, limits: Limits = Limits()) -> Footer:
    """Facts of a Parquet file's footer within the ceilings; no page is read."""
    regular_file(path, limits.parquet_bytes)
    try:
        meta = pq.ParquetFile(path).metadata
    except Exception as e:
        raise Refusal("bad_parquet") from e
    names = tuple(meta.schema.column(i).path for i in range(meta.num_columns))
    unpacked = sum(meta.row_group(i).total_byte_size for i in range(min(meta.num_row_groups, limits.row_groups)))
    facts = Footer(meta.num_rows, names, meta.num_row_groups, unpacked)
    if len(set(names)) != len(names):
        raise Refusal("duplicate_columns")
    for code, have, most in (
        ("row_groups", facts.row_groups, limits.row_groups),
        ("columns", len(names), limits.columns),
        ("rows", facts.rows, limits.rows),
        ("unpacked", facts.unpacked, limits.parquet_unpacked),
    ):
        if have > most:
            raise Refusal(code, found=have, most=most)
    return facts


def read_draws(spark: SparkSession, path: str, cells: int, n_draws: int, limits: Limits = Limits()) -> DataFrame:
    """Draws of a file whose footer has exactly the columns draw, asset, horizon and value and a row for each draw and cell."""
    facts = footer(path, limits)
    if set(facts.columns) != {"draw", "asset", "horizon", "value"}:
        raise Refusal("columns", found=len(facts.columns), most=4)
    if facts.rows != cells * n_draws:
        raise Refusal("row_count", found=facts.rows, expected=cells * n_draws)
    df = spark.read.parquet(path).select("draw", "asset", "horizon", "value")
    kinds = dict(df.dtypes)
    if kinds["draw"] not in ("int", "bigint") or kinds["horizon"] not in ("int", "bigint") or kinds["value"] not in ("float", "double"):
        raise Refusal("types")
    return df


def read_realized(spark: SparkSession, path: str) -> DataFrame:
    """asset, horizon and value of a realized table; its other columns are never selected."""
    return spark.read.parquet(path).select("asset", "horizon", "value")


def read_card(path: str) -> dict:
    """A card's TOML."""
    with open(path, "rb") as f:
        return tomllib.load(f)


def as_of(card: dict) -> str:
    """The forecast's as-of date, else the data cutoff; a text that is no ISO date raises."""
    for table, key in (("forecast", "asof"), ("provenance", "data_cutoff")):
        if value := card.get(table, {}).get(key):
            return dt.date.fromisoformat(str(value)).isoformat()
    raise KeyError("the card has neither an as-of date nor a data cutoff")


def grid_of(card: dict) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """Assets and horizons of a card's targets: each once, horizons positive whole numbers."""
    targets = card["targets"]
    assets, horizons = tuple(targets.get("asset_ids", targets.get("assets", ()))), tuple(targets["horizons"])
    if len(set(assets)) != len(assets) or len(set(horizons)) != len(horizons) or not assets or not horizons:
        raise ValueError("a grid's assets and horizons are unique and not empty")
    if any(isinstance(h, bool) or not isinstance(h, int) or h <= 0 for h in horizons):
        raise ValueError("horizons are positive whole numbers")
    return assets, horizons


def check_deliverable(folder: str, card: dict, limits: Limits = Limits()) -> dict[str, int]:
    """Gates on a deliverable, cheap ones first: exactly three regular files, metadata bound to the card by
    as-of date, unit and target, target dates after the as-of, its declared grid equal to
    the card's in order and multiplicity, the footer's row count. Returns counts, or raises the first refusal."""
    names = sorted(os.listdir(folder))
    if names != ["forecast.parquet", "forecast_meta.json", "forecast_rationale.md"]:
        raise Refusal("file_set", found=len(names))
    meta = read_object(f"{folder}/forecast_meta.json", limits)
    if not has_content(f"{folder}/forecast_rationale.md", limits):
        raise Refusal("blank_rationale")
    n = meta.get("n_draws")
    if meta.get("representation") != "samples" or isinstance(n, bool) or not isinstance(n, int) or not limits.min_draws <= n <= limits.max_draws:
        raise Refusal("schema")
    if meta.get("asof") != as_of(card) or meta.get("unit_id") != card["task"]["id"]:
        raise Refusal("binding")
    if (planned := card["targets"].get("target_type")) is not None and meta.get("target") != planned:
        raise Refusal("binding")
    early = sum(dt.date.fromisoformat(str(x)) <= dt.date.fromisoformat(as_of(card)) for x in card["targets"].get("target_dates", ()))
    if early:
        raise Refusal("target_dates", found=early)
    assets, horizons = grid_of(card)
    for key, planned in (("asset_ids", assets), ("horizons", horizons)):
        declared = tuple(meta.get(key, ()))
        if declared != planned:
            counts = {"duplicates": len(declared) - len(set(declared)), "missing": len(set(planned) - set(declared)), "extra": len(set(declared) - set(planned))}
            raise Refusal("grid", **counts)
    facts = footer(f"{folder}/forecast.parquet", limits)
    if facts.rows != n * len(assets) * len(horizons):
        raise Refusal("row_count", found=facts.rows, expected=n * len(assets) * len(horizons))
    return {"n_draws": n, "cells": len(assets) * len(horizons), "rows": facts.rows}


def check_manifest(folder: str, entries: Iterable[dict]) -> dict[str, int]:
    """Counts of a manifest's entries (path, sha256): matching, differing and absent files, and files without an entry."""
    out, named = {"matching": 0, "differing": 0, "absent": 0, "unlisted": 0}, set()
    for e in entries:
        named.add(e["path"])
        path = os.path.join(folder, e["path"])
        if not os.path.isfile(path):
            out["absent"] += 1
            continue
        digest = hashlib.sha256()
        with open(path, "rb") as f:
            for piece in iter(lambda: f.read(1 << 20), b""):
                digest.update(piece)
        out["matching" if digest.hexdigest() == e["sha256"] else "differing"] += 1
    for at, _, files in os.walk(folder):
        out["unlisted"] += sum(os.path.relpath(os.path.join(at, f), folder) not in named for f in files)
    return out
