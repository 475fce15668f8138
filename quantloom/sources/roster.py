"""The evaluation's own inputs: the plan with its roster, the bundle of scales, and what makes a result rankable.

All of it is the organizer's; anything wrong raises :class:`OrganizerFault` and no score is made. Messages carry counts only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import grid
from quantloom.operators.grid import OrganizerFault
from quantloom.sources.bounded import Limits, Refusal, grid_of, read_object

#: File names, the mode that ranks, and the keys of a scale.
PLAN, SCALE, REALIZED = "evaluation_plan.json", "ref_scale.json", "realized.parquet"
RANKED, UNRANKED = "ref_scale", "raw_unrankable"
PARTS = ("marginal", "joint", "tail")


@dataclass(frozen=True)
class Plan:
    """A plan's roster (unit, assets, horizons, cell_count) in its order, its mode and the digest that its scales must have."""

    roster: DataFrame
    mode: str | None
    commitment: str | None


def read_plan(spark: SparkSession, folder: str, limits: Limits = Limits(json_bytes=64 << 20)) -> Plan:
    """The plan of a folder. An absent or unreadable one, one without units (a public commitment), and one whose units are
    not unique or whose grids contradict their own count are faults."""
    try:
        raw = read_object(f"{folder}/{PLAN}", limits)
    except Refusal as e:
        raise OrganizerFault(f"the plan can't be read: {e.code}") from e
    units = (raw.get("roster") or {}).get("expected_units")
    if not isinstance(units, list) or not units:
        raise OrganizerFault("the plan has no units: absent roster or a public commitment")
    try:
        rows = [(i, u["unit_handle"], list(map(str, u["grid"]["assets"])), list(map(int, u["grid"]["horizons"])), int(u["grid"]["cell_count"])) for i, u in enumerate(units)]
    except (KeyError, TypeError, ValueError) as e:
        raise OrganizerFault("a unit of the plan has no readable grid") from e
    roster = spark.createDataFrame(rows, "place int, unit string, assets array<string>, horizons array<int>, cell_count int")
    bad = bad_grids(roster).first()
    if any(bad.asDict().values()):
        raise OrganizerFault(f"grids of the plan: {bad.asDict()}")
    norm = raw.get("normalization") or {}
    return Plan(roster, norm.get("mode"), norm.get("ref_scale_commitment"))


def bad_grids(roster: DataFrame) -> DataFrame:
    """(repeated_units, repeated_ids, bad_horizons, bad_counts) of a roster (unit, assets, horizons, cell_count): one row."""
    a, h = F.size("assets"), F.size("horizons")
    each = roster.groupBy("unit").agg(
        F.count("*").alias("n"),
        F.max((F.size(F.array_distinct("assets")) < a) | (F.size(F.array_distinct("horizons")) < h)).alias("ids"),
        F.max(F.coalesce(F.exists("horizons", lambda x: x.isNull() | (x <= 0)), F.lit(True)) | (a < 1) | (h < 1)).alias("low"),
        F.max(~F.col("cell_count").eqNullSafe(a * h)).alias("count"),
    )
    return each.agg(F.count_if(F.col("n") > 1).alias("repeated_units"), F.count_if("ids").alias("repeated_ids"), F.count_if("low").alias("bad_horizons"), F.count_if("count").alias("bad_counts"))


def planned_cells(roster: DataFrame) -> DataFrame:
    """(unit, asset, horizon, cell_idx) of a roster's grids, assets outermost; generated in the row, without a join."""
    rows = roster.select("unit", "horizons", F.posexplode("assets").alias("i", "asset"))
    rows = rows.select("unit", "asset", "i", F.size("horizons").alias("n"), F.posexplode("horizons").alias("j", "horizon"))
    return rows.select("unit", "asset", "horizon", (F.col("i") * F.col("n") + F.col("j")).alias("cell_idx"))


def read_scale_files(spark: SparkSession, root: str, limits: Limits = Limits()) -> DataFrame:
    """(unit, digest, body, n_bytes) of the scale files ``root``/unit/reference; a file above the ceiling has no body."""
    files = spark.read.format("binaryFile").load(f"{root}/*/reference/{SCALE}")
    unit = F.element_at(F.split("path", "/"), -3)
    body = F.when(F.col("length") <= limits.json_bytes, F.col("content").cast("string"))
    return files.select(unit.alias("unit"), F.sha2("content", 256).alias("digest"), body.alias("body"), F.col("length").alias("n_bytes"))


def scale_accounts(roster: DataFrame, scales: DataFrame) -> DataFrame:
    """(n_units, absent, unlisted, unreadable, bad_parts): one row on a bundle (unit, digest, body) against a roster (unit, cell_count).

    A scale is a JSON object whose marginal and tail, and joint where the unit has several cells, are positive numbers.
    Files of equal names are equal here; two scales of one unit count as unlisted.
    """
    part = {k: F.get_json_object("body", f"$.{k}").try_cast("double") for k in PARTS}
    good = {k: grid._finite(c) & (c > 0) for k, c in part.items()}
    read = scales.groupBy("unit").agg(F.count("*").alias("n"), F.min("body").alias("body"))
    both = roster.select("unit", "cell_count").join(read, "unit", "full_outer")
    one = F.col("cell_count") == 1
    listed, there = F.col("cell_count").isNotNull(), F.col("n").isNotNull()
    parts = good["marginal"] & good["tail"] & (good["joint"] | one)
    readable = F.coalesce(F.trim("body").startswith("{") & F.json_object_keys("body").isNotNull(), F.lit(False))
    return both.agg(
        F.count_if(listed).alias("n_units"),
        F.count_if(listed & ~there).alias("absent"),
        F.count_if((~listed & there) | (F.col("n") > 1)).alias("unlisted"),
        F.count_if(listed & there & ~readable).alias("unreadable"),
        F.count_if(listed & there & readable & ~F.coalesce(parts, F.lit(False))).alias("bad_parts"),
    )


def verified_scales(plan: Plan, scales: DataFrame) -> DataFrame:
    """(unit, marginal, joint, tail) of a bundle that is the plan's: the mode ranks, files and roster are equal sets, every scale
    is good, and the digest over all files is the plan's. joint is NULL for a unit of one cell. All is checked before any
    participant's file is opened; else a fault."""
    if plan.mode != RANKED or not plan.commitment:
        raise OrganizerFault("the plan doesn't rank: no mode or no digest of scales")
    row = scale_accounts(plan.roster, scales).first().asDict()
    if any(v for k, v in row.items() if k != "n_units"):
        raise OrganizerFault(f"the scales aren't the roster's: {row}")
    if grid.commitment(scales.select("unit", "digest")).first().digest != plan.commitment:
        raise OrganizerFault("the scales' digest isn't the plan's")
    one = plan.roster.select("unit", (F.col("cell_count") == 1).alias("one"))
    part = {k: F.get_json_object("body", f"$.{k}").try_cast("double") for k in PARTS}
    joint = F.when(~F.col("one"), part["joint"])
    return scales.join(one, "unit").select("unit", part["marginal"].alias("marginal"), joint.alias("joint"), part["tail"].alias("tail"))


def rankability(rows: DataFrame) -> DataFrame:
    """(n_units, raw, by_card, rankable): one row on unit rows (unit, mode, grid_source). Every unit must be scored by its scale and
    graded on the plan's grid; no units are not rankable."""
    raw, card = F.count_if(~F.col("mode").eqNullSafe(RANKED)), F.count_if(~F.col("grid_source").eqNullSafe("plan"))
    counts = rows.agg(F.count("*").alias("n_units"), raw.alias("raw"), card.alias("by_card"))
    return counts.select("*", ((F.col("n_units") > 0) & (F.col("raw") == 0) & (F.col("by_card") == 0)).alias("rankable"))


def require_rankable(rows: DataFrame) -> None:
    """Raise unless the unit rows are rankable."""
    row = rankability(rows).first()
    if not row.rankable:
        raise OrganizerFault(f"not rankable: {row.asDict()}")


@dataclass(frozen=True)
class Context:
    """What a unit is graded by: its grid, where that is from (plan or card), the mode, and the folder with the outcome."""

    assets: tuple[str, ...]
    horizons: tuple[int, ...]
    grid_source: str
    mode: str
    reference: str | None


def context(card: dict | None, entry: dict | None = None, unit_folder: str | None = None, mode: str | None = None) -> Context:
    """The plan's entry (unit_handle, grid) decides the grid where there is one, else the card, which never ranks. Without either,
    or with a mode that the grid's source doesn't allow, a fault."""
    if entry is not None:
        if not isinstance(entry.get("grid"), dict):
            raise OrganizerFault("the plan's entry has no grid")
        assets, horizons = grid_of({"targets": entry["grid"]})
        if int(entry["grid"].get("cell_count", -1)) != len(assets) * len(horizons):
            raise OrganizerFault("the plan's grid contradicts its count")
        source = "plan"
    elif card is not None:
        (assets, horizons), source = grid_of(card), "card"
    else:
        raise OrganizerFault("neither a plan's entry nor a card: no grid")
    mode = mode or (RANKED if source == "plan" else UNRANKED)
    if source == "plan" and mode != RANKED:
        raise OrganizerFault("a unit of the plan is scored by its scale")
    return Context(assets, horizons, source, mode, f"{unit_folder}/reference" if unit_folder else None)
