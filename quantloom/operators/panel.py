"""Panels of dated values: as-of cutoffs, look-ahead scans, calendars, and series chosen across panels.

A panel is (panel_id, asset, date DATE, value DOUBLE), possibly with further key columns. Null dates are never
at or before a cutoff; null values are kept unless a function says otherwise; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: an RFC 3339 instant with up to nine digits of a second.
INSTANT = r"^(\d{4}-\d{2}-\d{2})[Tt](\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?([Zz]|[+-]\d{2}:\d{2})$"


def as_of(panel: DataFrame, cutoff: Column, date: str = "date") -> DataFrame:
    """Rows dated at or before the cutoff; a literal cutoff is pushed into the scan."""
    return panel.where(F.col(date) <= cutoff)


def first_panel_series(panel: DataFrame, cutoff: Column) -> DataFrame:
    """(panel_id, asset, date, value): for each asset the first panel, by name, that has rows at or before the cutoff;
    of several rows of a day the one with the largest ``row_no`` (the last in the file)."""
    seen = as_of(panel, cutoff)
    chosen = seen.groupBy("asset").agg(F.min("panel_id").alias("panel_id"))
    rows = seen.join(chosen, ["asset", "panel_id"])
    return rows.groupBy("panel_id", "asset", "date").agg(F.max_by("value", "row_no").alias("value"))


def series_as_written(panel: DataFrame, cutoff: Column) -> DataFrame:
    """Every row at or before the cutoff of the first panel, by name, that has the asset there; several rows of a day all stay."""
    seen = as_of(panel, cutoff)
    return seen.join(seen.groupBy("asset").agg(F.min("panel_id").alias("panel_id")), ["asset", "panel_id"])


def chosen_units(units: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Units whose name matches a pattern, the first ``limit`` by name."""
    chosen = units.where(F.col("unit").rlike(pattern)).distinct()
    return chosen if limit is None else chosen.orderBy("unit").limit(limit)


def last_values(panel: DataFrame, cutoff: Column, by: Sequence[str] = ("asset",)) -> DataFrame:
    """(by..., last_date, n_obs, anchor): the value at each series' last date at or before the cutoff."""
    return as_of(panel, cutoff).groupBy(*by).agg(F.max("date").alias("last_date"), F.count("*").alias("n_obs"), F.max_by("value", "date").alias("anchor"))


def look_ahead(panel: DataFrame, cutoffs: DataFrame, by: str) -> DataFrame:
    """(by, n_rows, n_late, n_late_assets, n_undated): rows dated after their unit's cutoff (by, asof), counted, never cut."""
    late = F.col("date") > F.col("asof")
    rows = panel.join(cutoffs.select(by, "asof"), by)
    return rows.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(late).alias("n_late"),
        F.count_distinct(F.when(late, F.col("asset"))).alias("n_late_assets"),
        F.count_if(F.col("date").isNull()).alias("n_undated"),
    )


def instant(text: Column) -> Column:
    """Struct (seconds BIGINT, nanos INT) since 1970 of an RFC 3339 text, NULL for others and for the offset -00:00;
    Spark's timestamps end at microseconds."""
    part = [F.regexp_extract(text, INSTANT, i) for i in range(7)]
    day = F.when(text.rlike(INSTANT) & ~text.endswith("-00:00"), part[1]).try_cast("date")
    h, m, s = (F.nullif(p, F.lit("")).try_cast("bigint") for p in part[2:5])
    away = F.when(F.upper(part[6]) == "Z", 0).otherwise(
        (F.nullif(F.substring(part[6], 2, 2), F.lit("")).try_cast("bigint") * 60 + F.nullif(F.substring(part[6], 5, 2), F.lit("")).try_cast("bigint"))
        * F.when(part[6].startswith("-"), -60).otherwise(60)
    )
    ok = (h < 24) & (m < 60) & (s < 60)
    seconds = F.when(ok, F.unix_date(day).cast("bigint") * 86_400 + h * 3600 + m * 60 + s - away)
    return F.when(seconds.isNotNull(), F.struct(seconds.alias("seconds"), F.rpad(part[5], 9, "0").cast("int").alias("nanos")))


def strictly_late(text: Column, cutoff_day: Column) -> Column:
    """Whether a timestamp text lies after the end of the cutoff's UTC day; a date alone counts as the end of its day.
    NULL for texts that are neither."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).try_cast("date")
    end = (F.unix_date(cutoff_day).cast("bigint") + 1) * 86_400
    at = instant(text)
    return F.when(day.isNotNull(), day > cutoff_day).otherwise(at["seconds"] >= end)


def resolved_as_of(cli: Column, *card: Column) -> Column:
    """The earlier of the caller's date and the card's first date; either may be null."""
    return F.least(cli, F.coalesce(*card))


def value_at(panel: DataFrame, points: DataFrame, by: Sequence[str]) -> DataFrame:
    """points (by..., at) with ``found``, the series' value at or before ``at``: a backward as-of join by one sort of both
    sides per series, without pairing rows."""
    keys = list(by)
    left = points.select(*keys, F.col("at").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_v"))
    right = panel.where("value is not null").select(*keys, F.col("date").alias("_t"), F.lit(0).alias("_side"), F.col("value").cast("double").alias("_v"))
    before = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("found", F.last("_v", ignorenulls=True).over(before))
    return both.where("_side = 1").select(*keys, F.col("_t").alias("at"), "found")


def carried_forward(panel: DataFrame, days: DataFrame, by: Sequence[str], reach: int = 3, unit: Sequence[str] = ("unit",), most_missing: int = 1) -> DataFrame:
    """(by..., date, value, carried): every day of ``days`` (date, n: its number) between a series' first and last, a
    missing value taken from at most ``reach`` days before. A day on which more than ``most_missing`` of a unit's series, within
    their own first and last, still have none is left out for all of them."""
    keys = list(by)
    span = panel.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    grid = span.select(*keys, F.explode(F.sequence("a", "b")).alias("date")).join(F.broadcast(days.select("date")), "date")
    rows = grid.join(panel.select(*keys, "date", "value"), [*keys, "date"], "left")
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-reach, 0)
    filled = rows.select(*keys, "date", F.last("value", ignorenulls=True).over(w).alias("value"), F.col("value").isNull().alias("carried"))
    missing = F.count_if(F.col("value").isNull()).over(Window.partitionBy(*unit, "date"))
    return filled.withColumn("_missing", missing).where(F.col("_missing") <= most_missing).drop("_missing")


def business_day(day: Column, h: int) -> Column:
    """The h-th weekday after a day, from the day of the week alone; holidays aren't known here."""
    weekday = F.weekday(day)
    start = F.when(weekday >= 5, F.date_sub(day, weekday - 4)).otherwise(day)
    at = F.weekday(start) + F.lit(h)
    return F.date_add(start, (F.floor(at / 5) * 7 + at % 5 - F.weekday(start)).cast("int"))


def profile(panel: DataFrame, by: str) -> DataFrame:
    """(by, n_rows, n_assets, first_date, last_date)."""
    return panel.groupBy(by).agg(F.count("*").alias("n_rows"), F.count_distinct("asset").alias("n_assets"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def leaked_outcomes(realized: DataFrame, panels: DataFrame) -> DataFrame:
    """(unit, n_outcomes, n_found): outcomes (unit, asset, date, value) that stand, value for value, in another unit's panel."""
    rows = panels.select(F.col("unit").alias("_other"), "asset", "date", "value").distinct()
    hits = realized.join(rows, ["asset", "date", "value"]).where("_other != unit").select("unit", "asset", "date", "value").distinct()
    counts = hits.groupBy("unit").agg(F.count("*").alias("n_found"))
    total = realized.groupBy("unit").agg(F.count("*").alias("n_outcomes"))
    return total.join(counts, "unit", "left").select("unit", "n_outcomes", F.coalesce("n_found", F.lit(0)).alias("n_found"))
