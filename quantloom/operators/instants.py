"""Mixed timestamp spellings and time zones to one instant in UTC.

Texts are parsed to local microseconds by built-in expressions. Those without
an offset of their own are joined as of their local time to zone-offset
intervals: two matching intervals mean that the wall-clock time occurs twice,
none that it is skipped, one gives the offset.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.session import written

DAY_US = 86_400_000_000

#: Abbreviations and their offsets in minutes. BST is British Summer Time, IST that of India, CST that of North America.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540, "AWST": 480,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240,
    "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}

#: Month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_CLOCK = r"(?:[T\s,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?)?"
_CLOCK_BASIC = r"(?:[T\s]+(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?())?"
_ZONE = r"\s*(?:([+-]\d{2}:?(?:\d{2})?)|([A-Za-z]{1,5})(?![A-Za-z/]))?\s*(?:\[?([A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)\]?)?$"
_NAME = r"([A-Za-z]{3,9})"
_WEEKDAY = r"(?:[A-Za-z]{3,9},?\s+)?"

#: Spellings: groups of the date's three parts, in the order named, then hour, minute, second, fraction, half of day, offset, abbreviation, zone.
SPELLINGS = {
    "ymd": r"^(\d{4})-(\d{1,2})-(\d{1,2})" + _CLOCK + _ZONE,
    "basic": r"^(\d{4})(\d{2})(\d{2})" + _CLOCK_BASIC + _ZONE,
    "dotted": r"^(\d{1,2})\.(\d{1,2})\.(\d{4})" + _CLOCK + _ZONE,
    "slashed": r"^(\d{1,2})/(\d{1,2})/(\d{4})" + _CLOCK + _ZONE,
    "slashed_ymd": r"^(\d{4})/(\d{1,2})/(\d{1,2})" + _CLOCK + _ZONE,
    "day_name": r"^" + _WEEKDAY + r"(\d{1,2})[\s-]+" + _NAME + r"\.?,?[\s-]+(\d{4})" + _CLOCK + _ZONE,
    "name_day": r"^" + _WEEKDAY + _NAME + r"\.?\s+(\d{1,2}),?\s+(\d{4})" + _CLOCK + _ZONE,
}


def _utc_seconds(year: int, month: int = 1, day: int = 1) -> int:
    return (dt.date(year, month, day).toordinal() - _EPOCH_DAY) * 86_400


_EPOCH_DAY = dt.date(1970, 1, 1).toordinal()
_UTC_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
_EARLIEST, _LATEST = _utc_seconds(1, 1, 3), _utc_seconds(9999, 12, 29)


def _year_intervals(name: str, year: int) -> list[tuple[int, int, int]] | None:
    """(local_from, local_to, offset), in local seconds and in order, of the offsets that a zone has in a year and three days
    before and after; None for an unknown zone. A change is found to the second between the ends of a day."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None

    def offset(at: int) -> int:
        return int((_UTC_EPOCH + dt.timedelta(seconds=at)).astimezone(zone).utcoffset().total_seconds())

    begin = max(_utc_seconds(year) - 3 * 86_400, _EARLIEST)
    end = min(_utc_seconds(year, 12, 31) + 4 * 86_400, _LATEST)
    rows, since, last = [], begin - 3 * 86_400, offset(begin)
    for at in range(begin, end, 86_400):
        if (now := offset(at + 86_400)) != last:
            lo, hi = at, at + 86_400  # the change lies in (lo, hi]
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == last else (lo, mid)
            rows.append((since + last, hi + last, last))
            since, last = hi, now
    rows.append((since + last, end + 3 * 86_400 + last, last))
    return rows


_INTERVALS = pa.list_(pa.struct([("local_from", pa.int64()), ("local_to", pa.int64()), ("offset", pa.int64())]))


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(z, y, x) for z, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (x := _year_intervals(z, y)) is not None]
        intervals = pa.array([[dict(zip(("local_from", "local_to", "offset"), i)) for i in x] for *_, x in rows], _INTERVALS)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), intervals], ["zone", "year", "intervals"])


def zone_years(places: DataFrame) -> DataFrame:
    """Zone-offset intervals exploded over local years: for each different (zone, year) of ``places`` a row (zone, year,
    intervals), made by the tasks from the time zone database, whose last rule holds for all later years. Years are 1 to 9999.
    Unknown zones give no row. There are at most as many rows as zones times years, whatever the number of places."""
    pairs = places.select("zone", F.col("year").cast("int").alias("year")).where("zone is not null and year between 1 and 9999").distinct()
    return pairs.mapInArrow(_intervals, "zone string, year int, intervals array<struct<local_from: bigint, local_to: bigint, offset: bigint>>")


PART_NAMES = ("a", "b", "c", "hour", "minute", "second", "fraction", "half", "offset", "abbr", "zone")


def _parts(text: Column) -> Column:
    """The spelling's name and the eleven parts of the first spelling that matches, as an array of texts; NULL when none does."""

    def of(kind: str) -> Column:
        marked = F.regexp_replace(text, SPELLINGS[kind], kind + "".join(f"|${i}" for i in range(1, 12)))
        return F.when(text.rlike(SPELLINGS[kind]), F.split(marked, "[|]", -1))

    return F.coalesce(*(of(k) for k in SPELLINGS))


def _computed(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """``keep`` and ``value`` as column ``name``. Made by a generator, past which the optimizer moves no
    predicate, so the expressions behind the value are evaluated once and not copied into filters."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def to_instants(entries: DataFrame, issuers: DataFrame, key: str = "entry_id", text: str = "timestamp", issuer: str = "issuer") -> DataFrame:
    """Rows (entry_id, instant_utc, status), one for each entry whose text names a real calendar time.

    An offset, zone or abbreviation in the text holds; otherwise the wall clock is in the zone of the issuer
    (``issuers``: issuer, tz_name, day_first), or UTC with the day first where the issuer is null or unknown.
    status: ``offset`` (written in the text), ``epoch`` (a bare number), ``unique``, ``ambiguous`` (two
    instants, the earlier is given) or ``nonexistent`` (skipped, with the offset from before the change). Defined
    results: null, empty and unreadable texts, impossible dates and unknown zones give no row; repeated entries
    give repeated rows; an empty table an empty result; other columns are ignored.

    Of the entries nothing is shuffled but the different zones and years, each once a task: issuers (a fixed dimension
    table, whose size is that of the institutions) are broadcast, and so are zone years while they are small, which Spark
    decides by their size. The parsed entries are written once, as numbers, for these two uses.
    """
    who = issuers.select(F.col("issuer").alias("_issuer"), F.col("tz_name").alias("_tz"), F.col("day_first").alias("_day_first")).where("_issuer is not null").dropDuplicates(["_issuer"])
    rows = entries.select(F.col(key).alias("_key"), F.trim(F.regexp_replace(F.col(text), r"[\s ]+", " ")).alias("_text"), F.col(issuer).alias("_of")).where("_text is not null and _text != ''")
    rows = rows.join(F.broadcast(who), F.col("_of") == F.col("_issuer"), "left")

    number = F.when(F.col("_text").rlike(r"^\d{10,18}$"), F.col("_text").try_cast("bigint"))
    lo, hi = (int(dt.datetime(y, 1, 1, tzinfo=dt.timezone.utc).timestamp()) for y in (2009, 2027))
    epoch = F.coalesce(*(F.when((number >= lo * unit) & (number < hi * unit), number * (1_000_000 // unit)) for unit in (1, 1_000, 1_000_000)))

    rows = rows.withColumn("_number", number.isNotNull()).withColumn("_epoch", epoch)
    rows = _computed(rows, "_p", F.when(~F.col("_number"), _parts(F.col("_text"))), "_key", "_epoch", "_tz", "_day_first")
    p = {n: F.col("_p")[i] for i, n in enumerate(("kind", *PART_NAMES))}
    kind, a, b, c = p["kind"], p["a"], p["b"], p["c"]
    month_of = F.lower(F.substring(F.when(kind == "day_name", b).otherwise(a), 1, 3))
    named = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), month_of).cast("string")
    day_first = F.coalesce(F.col("_day_first"), F.lit(True)) | (kind == "dotted")
    ymd = kind.isin("ymd", "basic", "slashed_ymd")
    year = F.when(ymd, a).otherwise(c)
    month = F.when(ymd, b).when(kind.isin("day_name", "name_day"), named).when(day_first, b).otherwise(a)
    day = F.when(ymd, c).when(kind == "day_name", a).when(kind == "name_day", b).when(day_first, a).otherwise(b)
    date = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")

    def num(x: Column) -> Column:
        return F.coalesce(F.nullif(x, F.lit("")).try_cast("bigint"), F.lit(0))

    h, half = num(p["hour"]), F.lower(p["half"])
    hour = F.when(half == "", h).when(h.between(1, 12), F.pmod(h, F.lit(12)) + F.when(half == "p", 12).otherwise(0))
    minute, second = num(p["minute"]), num(p["second"])
    fraction = num(F.rpad(F.substring(p["fraction"], 1, 6), 6, "0"))
    in_day = F.when((hour < 24) & (minute < 60) & (second < 60), ((hour * 60 + minute) * 60 + second) * 1_000_000 + fraction)
    local = F.unix_date(date).cast("bigint") * DAY_US + in_day

    digits = F.regexp_replace(p["offset"], "[^0-9]", "")
    spelled = (num(F.substring(digits, 1, 2)) * 60 + num(F.substring(digits, 3, 2))) * F.when(p["offset"].startswith("-"), -60).otherwise(60)
    abbreviations = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    short = F.upper(p["abbr"])
    own = F.when(p["offset"] != "", spelled).when(p["abbr"] != "", abbreviations[short] * 60)
    marked = (p["offset"] != "") | (p["abbr"] != "")
    zone = F.when(p["zone"] != "", p["zone"]).otherwise(F.coalesce(F.col("_tz"), F.lit("UTC")))
    own_zone = F.struct(local.alias("local"), own.alias("own"), marked.alias("marked"), F.when(~marked, zone).alias("zone"))
    rows = _computed(rows, "_w", own_zone, "_key", "_epoch").select("_key", "_epoch", "_w.*")
    rows = rows.where("_epoch is not null or (local is not null and (not marked or own is not null))")

    seconds = F.floor(F.col("local") / 1_000_000)
    days = F.floor(F.col("local") / DAY_US).cast("int")
    rows = written(rows.withColumn("year", F.when(F.col("_epoch").isNull() & ~F.col("marked"), F.year(F.date_from_unix_date(days)))))
    rows = rows.join(written(zone_years(rows)), ["zone", "year"], "left")
    match = F.filter("intervals", lambda x: (x["local_from"] <= seconds) & (seconds < x["local_to"]))
    before = F.filter("intervals", lambda x: x["local_to"] <= seconds)
    both = F.struct(F.transform(match, lambda x: x["offset"]).alias("fits"), F.try_element_at(before, F.lit(-1))["offset"].alias("before"))
    rows = _computed(rows, "_o", both, "_key", "_epoch", "local", "own", "marked")
    fits = F.col("_o.fits")
    offset = F.when(F.col("marked"), F.col("own")).when(F.size(fits) > 0, F.array_max(fits)).otherwise(F.col("_o.before"))
    status = (
        F.when(F.col("_epoch").isNotNull(), "epoch")
        .when(F.col("marked"), "offset")
        .otherwise(F.when(F.size(fits) > 1, "ambiguous").when(F.size(fits) == 1, "unique").otherwise("nonexistent"))
    )
    known = _computed(rows, "us", F.coalesce("_epoch", F.col("local") - offset * 1_000_000), "_key", status.alias("status")).where("us is not null")
    within = F.pmod("us", F.lit(DAY_US))
    date_text = F.date_from_unix_date(F.floor(F.col("us") / DAY_US).cast("int")).cast("string")

    def two(unit: int, size: int) -> Column:
        return F.lpad((F.floor(within / unit) % size).cast("string"), 2, "0")

    clock = F.concat(two(3_600_000_000, 24), F.lit(":"), two(60_000_000, 60), F.lit(":"), two(1_000_000, 60), F.lit("."), F.lpad((within % 1_000_000).cast("string"), 6, "0"))
    return known.select(F.col("_key").alias(key), F.concat(date_text, F.lit("T"), clock, F.lit("Z")).alias("instant_utc"), "status")
