"""Irregular readings onto a regular grid of open days.

Each series' readings are reduced to one closing reading a day, the calendar
between its first and last day is laid out by exploding the gaps between
neighbouring readings, and every open day without a reading is estimated by a
local polynomial regression whose kernel has compact support: only readings at
most ``reach`` calendar days away carry weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.functions.calendar import day_number


def closing_readings(
    readings: DataFrame,
    series: Sequence[str],
    date: str = "date",
    value: str = "value",
    order: Sequence[str] = ("ingested_at", "reading_id"),
    low: float = -5.0,
    high: float = 30.0,
) -> DataFrame:
    """One row (series..., day, reading, n_rows) for each series and calendar day with a usable reading.

    Usable: finite, non-null, strictly between ``low`` and ``high``, on a day that exists.
    The reading written last in the day stands for it; equal date texts are
    settled by the columns of ``order``, so copies of a row change nothing.
    """
    v = F.col(value)
    usable = readings.select(*series, F.col(date), v.alias("reading"), day_number(F.col(date)).alias("day"), *order).where(
        ~F.isnan("reading") & (F.col("reading") > low) & (F.col("reading") < high) & F.col("day").isNotNull()
    )
    text = F.trim(date)
    clock = F.regexp_replace(F.when(F.substring(text, 5, 1).rlike("[0-9]"), F.substring(text, 9, 30)).otherwise(F.substring(text, 11, 30)), "[^0-9]", "")
    return usable.groupBy(*series, "day").agg(
        F.max_by("reading", F.struct(clock.alias("c"), *order, F.col("reading"))).alias("reading"), F.count("*").alias("n_rows")
    )


def _local_fit(near: Column, degree: int, reach: int) -> dict[str, Column]:
    """Weighted least squares about the grid day, from structs (d, y); Epanechnikov weights 1-(d/(reach+1))^2."""
    zero = F.lit(0.0)
    start = F.struct(*(zero.alias(k) for k in ("s0", "s1", "s2", "t0", "t1", "q")), *((zero.alias(k) for k in ("s3", "s4", "t2")) if degree == 2 else ()))

    def add(a: Column, p: Column) -> Column:
        u = p["d"] / F.lit(float(reach + 1))
        w = F.lit(1.0) - u * u
        parts = [
            (a["s0"] + w).alias("s0"),
            (a["s1"] + w * u).alias("s1"),
            (a["s2"] + w * u * u).alias("s2"),
            (a["t0"] + w * p["y"]).alias("t0"),
            (a["t1"] + w * u * p["y"]).alias("t1"),
            (a["q"] + w * w).alias("q"),
        ]
        if degree == 2:
            parts += [(a["s3"] + w * u * u * u).alias("s3"), (a["s4"] + w * u * u * u * u).alias("s4"), (a["t2"] + w * u * u * p["y"]).alias("t2")]
        return F.struct(*parts)

    m = F.aggregate(near, start, add)
    det1 = m["s0"] * m["s2"] - m["s1"] * m["s1"]
    line = (m["s2"] * m["t0"] - m["s1"] * m["t1"]) / F.nullif(det1, F.lit(0.0))
    mean = m["t0"] / F.nullif(m["s0"], F.lit(0.0))
    fit = {0: mean, 1: F.when(det1 > 1e-9 * m["s0"] * m["s0"], line).otherwise(mean)}.get(degree)
    if degree == 2:
        a, b, c = m["s2"] * m["s4"] - m["s3"] * m["s3"], m["s2"] * m["s3"] - m["s1"] * m["s4"], m["s1"] * m["s3"] - m["s2"] * m["s2"]
        det2 = m["s0"] * a + m["s1"] * b + m["s2"] * c
        fit = F.when(F.abs(det2) > 1e-9 * m["s0"] * m["s0"] * m["s0"], (m["t0"] * a + m["t1"] * b + m["t2"] * c) / F.nullif(det2, F.lit(0.0))).otherwise(
            F.when(det1 > 1e-9 * m["s0"] * m["s0"], line).otherwise(mean)
        )
    return {"fit": fit, "support": m["s0"] * m["s0"] / F.nullif(m["q"], F.lit(0.0))}


def regular_grid(
    readings: DataFrame,
    calendar: DataFrame,
    series: Sequence[str] = ("card_id", "panel_id", "asset"),
    reach: int = 10,
    degree: int = 1,
    min_support: float = 2.0,
    **closing,
) -> DataFrame:
    """Rows (series..., obs_day DATE, n_rows, value, support, status), one for each open day of ``calendar``
    from the day of a series' first usable reading to that of its last.

    status: ``observed`` (value is the day's closing reading), ``filled`` (value is the local fit; its
    effective support, (sum w)^2 / sum w^2, is at least ``min_support``) or ``missing`` (support too small;
    value is NULL). Readings on closed days give support but no row. Defined results: null or unusable
    values and unreadable dates count as absent; null series columns are values like any other; repeated rows
    change n_rows only; an empty table gives an empty result; other columns of the input are ignored.

    Shuffles: one on (series, day) after map-side aggregation, one on series of at most a row a day. A
    series' rows in a task are bounded by the days of the calendar. ``calendar`` (obs_day, is_open) has a row a
    day, so its broadcast is bounded by the years covered, not by the data.
    """
    series = list(series)
    keys = [f"_k{i}" for i in range(len(series))]
    daily = closing_readings(readings, series, **closing).select(*(F.col(s).alias(k) for s, k in zip(series, keys)), "day", "reading", "n_rows")
    span = calendar.select(day_number(F.col("obs_day")).alias("day"), "is_open").where("is_open and day is not null").select("day").distinct()
    first, last = span.agg(F.min("day"), F.max("day")).first()
    if first is None:
        first, last = 0, -1
    by = Window.partitionBy(*keys).orderBy("day")
    # From each reading to the day before the next one: the reading itself, then the days without any.
    ahead = F.lead("day").over(by)
    until = F.when(ahead.isNotNull(), F.least(ahead - 1, F.lit(last)))
    since = F.greatest(F.col("day") + 1, F.lit(first))
    holes = F.when(until >= since, F.sequence(since, until)).otherwise(F.array().cast("array<int>"))
    laid = daily.withColumn("_d", F.concat(F.array("day"), holes)).select(*keys, F.explode("_d").alias("at"), "day", "reading", "n_rows")
    seen = F.col("at") == F.col("day")
    laid = laid.join(F.broadcast(span.select(F.col("day").alias("at"), F.lit(True).alias("open"))), "at", "left").where(F.col("open") | seen)
    near = Window.partitionBy(*keys).orderBy("at").rangeBetween(-reach, reach)
    around = F.collect_list(F.when(seen, F.struct(F.col("at").alias("x"), F.col("reading").alias("y")))).over(near)
    out = laid.withColumn("_near", around).where("open")
    offsets = F.transform("_near", lambda p: F.struct((p["x"] - F.col("at")).cast("double").alias("d"), p["y"].alias("y")))
    fit = _local_fit(F.when(~seen, offsets), degree, reach)
    out = out.select(*keys, "at", seen.alias("seen"), "reading", "n_rows", fit["fit"].alias("fit"), F.coalesce(fit["support"], F.lit(0.0)).alias("s"))
    enough = F.col("s") >= min_support
    return out.select(
        *(F.col(k).alias(s) for k, s in zip(keys, series)),
        F.date_from_unix_date("at").alias("obs_day"),
        F.when(F.col("seen"), F.col("n_rows")).otherwise(F.lit(0)).cast("bigint").alias("n_rows"),
        F.when(F.col("seen"), F.col("reading")).when(enough, F.col("fit")).alias("value"),
        F.when(~F.col("seen"), F.col("s")).alias("support"),
        F.when(F.col("seen"), "observed").when(enough, "filled").otherwise("missing").alias("status"),
    )


def unread_days(readings: DataFrame, calendar: DataFrame, series: Sequence[str] = ("card_id", "panel_id", "asset"), **grid) -> DataFrame:
    """The grid's open days without a usable reading, filled or marked: rows (series..., obs_day ISO text)."""
    days = regular_grid(readings, calendar, series, **grid).where(F.col("status") != "observed")
    return days.select(*series, F.col("obs_day").cast("string").alias("obs_day"))
