import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from quantloom.operators.instants import to_instants

ISSUERS = [("NY", "New York", "America/New_York", False), ("BE", "Berlin", "Europe/Berlin", True), ("AK", "Auckland", "Pacific/Auckland", True)]

CASES = [
    ("2018-05-25 10:30", "NY", "2018-05-25T14:30:00.000000Z", "unique"),
    ("2021-11-07 01:30:00", "NY", "2021-11-07T05:30:00.000000Z", "ambiguous"),
    ("2021-03-14T02:30", "NY", "2021-03-14T07:30:00.000000Z", "nonexistent"),
    ("2021-03-28T02:30:00.123456789", "BE", "2021-03-28T01:30:00.123456Z", "nonexistent"),
    ("04/05/2018 04:09", "NY", "2018-04-05T08:09:00.000000Z", "unique"),
    ("04/05/2018 04:09", "BE", "2018-05-04T02:09:00.000000Z", "unique"),
    ("04/05/2018 04:09", None, "2018-05-04T04:09:00.000000Z", "unique"),
    ("29.09.2015 00:06", "NY", "2015-09-29T04:06:00.000000Z", "unique"),
    ("28/08/2015 22:35", "NY", None, None),
    ("1700588728", "NY", "2023-11-21T17:45:28.000000Z", "epoch"),
    ("1397617096687", "NY", "2014-04-16T02:58:16.687000Z", "epoch"),
    ("1611553129231779", None, "2021-01-25T05:38:49.231779Z", "epoch"),
    ("9999999999", None, None, None),
    ("20160922T210041Z", "NY", "2016-09-22T21:00:41.000000Z", "offset"),
    ("  20120914 025628 ", "BE", "2012-09-14T00:56:28.000000Z", "unique"),
    ("20120914", None, "2012-09-14T00:00:00.000000Z", "unique"),
    ("2017-08-31T04:21:35+05:30[Asia/Kolkata]", "NY", "2017-08-30T22:51:35.000000Z", "offset"),
    ("2013-10-15 19:07:24 Asia/Kolkata", "NY", "2013-10-15T13:37:24.000000Z", "unique"),
    ("2023-11-22 06:32:23 America/New_York", "BE", "2023-11-22T11:32:23.000000Z", "unique"),
    ("2013-08-14 06:07:29+01", "NY", "2013-08-14T05:07:29.000000Z", "offset"),
    ("2025-01-06 11:16:45+0100", "NY", "2025-01-06T10:16:45.000000Z", "offset"),
    ("Sun, 11 Sep 2016 22:05:20 -0430", "NY", "2016-09-12T02:35:20.000000Z", "offset"),
    ("Apr 5, 2015 12:56 AM NZDT", "NY", "2015-04-04T11:56:00.000000Z", "offset"),
    ("October 18, 2023 12:23 pm", "AK", "2023-10-17T23:23:00.000000Z", "unique"),
    ("14 March 2017 13:07 EDT", "BE", "2017-03-14T17:07:00.000000Z", "offset"),
    ("2022-10-18", "AK", "2022-10-17T11:00:00.000000Z", "unique"),
    ("2023-02-30", "NY", None, None),
    ("0000-00-00", "NY", None, None),
    ("2021-13-05T10:00:00Z", "NY", None, None),
    ("2021-10-05T24:10:00Z", "NY", None, None),
    ("pending", "NY", None, None),
    ("", "NY", None, None),
    (None, "NY", None, None),
    ("2020-01-01 10:00 QQQ", "NY", None, None),
    ("2020-01-01 10:00:00 Mars/Base", "NY", None, None),
]


def table(spark, cases):
    return spark.createDataFrame([(i, t, s, "clash", 3) for i, (t, s) in enumerate(cases)], "entry_id long, timestamp string, issuer string, zone string, year int")


def issuers(spark):
    return spark.createDataFrame(ISSUERS, "issuer string, issuer_name string, tz_name string, day_first boolean")


def test_spellings(spark):
    got = {r.entry_id: (r.instant_utc, r.status) for r in to_instants(table(spark, [c[:2] for c in CASES]), issuers(spark)).collect()}
    for i, (text, issuer, instant, status) in enumerate(CASES):
        assert got.get(i, (None, None)) == (instant, status), (text, issuer)


@pytest.mark.parametrize("zone, issuer", [("America/New_York", "NY"), ("Europe/Berlin", "BE"), ("Pacific/Auckland", "AK")])
def test_every_half_hour_around_changes(spark, zone, issuer):
    start = [dt.datetime(2019, 3, 9), dt.datetime(2019, 3, 30), dt.datetime(2019, 4, 6), dt.datetime(2019, 9, 28), dt.datetime(2019, 10, 26), dt.datetime(2019, 11, 2)]
    local = [s + dt.timedelta(minutes=30 * k) for s in start for k in range(110)]
    got = {r.entry_id: r.instant_utc for r in to_instants(table(spark, [(x.strftime("%Y-%m-%d %H:%M"), issuer) for x in local]), issuers(spark)).collect()}
    for i, x in enumerate(local):
        want = x.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(dt.timezone.utc)
        assert got[i] == want.strftime("%Y-%m-%dT%H:%M:%S.%fZ"), x


def test_all_years_and_zones_against_the_time_zone_database(spark):
    import random
    import zoneinfo

    draw, cases, want = random.Random(1), [("2045-07-01 12:00 Europe/London", None)], ["2045-07-01T11:00:00.000000Z"]
    zones = sorted(z for z in zoneinfo.available_timezones() if z.count("/") == 1 and not z.startswith(("Etc", "posix", "right")))
    for _ in range(600):
        zone = draw.choice(zones)
        x = dt.datetime(draw.choice([draw.randrange(1, 9999), draw.randrange(1890, 2100)]), draw.randrange(1, 13), draw.randrange(1, 29), draw.randrange(24), draw.randrange(60))
        try:
            at = x.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(dt.timezone.utc)
        except OverflowError:
            continue
        cases.append((f"{x.year:04d}-{x.month:02d}-{x.day:02d} {x.hour:02d}:{x.minute:02d} {zone}", None))
        want.append(f"{at.year:04d}-{at.month:02d}-{at.day:02d}T{at.hour:02d}:{at.minute:02d}:{at.second:02d}.000000Z")
    got = {r.entry_id: r.instant_utc for r in to_instants(table(spark, cases), issuers(spark)).collect()}
    assert not [(c[0], got.get(i), w) for i, (c, w) in enumerate(zip(cases, want)) if got.get(i) != w]


def test_session_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = to_instants(table(spark, [("2018-05-25 10:30", "NY")]), issuers(spark)).first()
        assert got.instant_utc == "2018-05-25T14:30:00.000000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_empty(spark):
    assert to_instants(table(spark, [("x", "y")]).limit(0), issuers(spark)).count() == 0
    assert to_instants(table(spark, [("2020-01-01", "NY")]), issuers(spark).limit(0)).first().instant_utc == "2020-01-01T00:00:00.000000Z"
