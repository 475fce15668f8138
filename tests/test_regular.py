import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from quantloom.operators.regular import regular_grid, unread_days

SCHEMA = "reading_id long, card_id string, panel_id string, asset string, date string, value double, ingested_at timestamp, day string, reading int"
T = dt.datetime(2020, 1, 1)


def calendar(spark, n=40, closed=(5, 6)):
    start = dt.date(2020, 1, 1)
    return spark.createDataFrame([((start + dt.timedelta(i)).isoformat(), i not in closed) for i in range(n)], "obs_day string, is_open boolean")


def readings(spark, rows):
    return spark.createDataFrame([(i, "c", "p", a, d, v, T, "clash", 1) for i, (a, d, v) in enumerate(rows)], SCHEMA)


def test_grid_against_brute_force(spark):
    draw = np.random.default_rng(3)
    days = sorted(draw.choice(40, 18, replace=False).tolist())
    y = {d: float(v) for d, v in zip(days, draw.normal(3, 1, len(days)))}
    text = {d: (dt.date(2020, 1, 1) + dt.timedelta(d)).isoformat() for d in range(40)}
    rows = [("A", text[d] if i % 2 else text[d].replace("-", "") + "T101500", v) for i, (d, v) in enumerate(y.items())]
    got = {r.obs_day: r for r in regular_grid(readings(spark, rows), calendar(spark), reach=4, min_support=2.0).collect()}
    expected_days = [d for d in range(days[0], days[-1] + 1) if d not in (5, 6)]
    assert sorted(got) == [dt.date(2020, 1, 1) + dt.timedelta(d) for d in expected_days]
    for d in expected_days:
        r = got[dt.date(2020, 1, 1) + dt.timedelta(d)]
        if d in y:
            assert r.status == "observed" and r.value == y[d] and r.n_rows == 1
            continue
        near = np.array([k for k in days if abs(k - d) <= 4], float)
        w = 1 - ((near - d) / 5) ** 2
        support = w.sum() ** 2 / (w**2).sum() if len(near) else 0.0
        assert abs((r.support or 0.0) - support) < 1e-9
        if support < 2:
            assert r.status == "missing" and r.value is None
        else:
            x = np.stack([np.ones(len(near)), near - d], 1)
            target = np.array([y[int(k)] for k in near])
            fit = np.linalg.lstsq(x * np.sqrt(w)[:, None], target * np.sqrt(w), rcond=None)[0][0]
            assert r.status == "filled" and abs(r.value - fit) < 1e-8


def test_quadratic_is_exact_on_a_parabola(spark):
    day = lambda d: (dt.date(2020, 1, 1) + dt.timedelta(d)).isoformat()
    rows = [("A", day(d), 1 + 0.1 * d + 0.01 * d * d) for d in range(20) if d not in (9, 10)]
    got = {r.obs_day: r.value for r in regular_grid(readings(spark, rows), calendar(spark, closed=()), degree=2).collect()}
    for d in (9, 10):
        assert abs(got[dt.date(2020, 1, 1) + dt.timedelta(d)] - (1 + 0.1 * d + 0.01 * d * d)) < 1e-6


def test_unusable_values_copies_and_ties(spark, rows):
    data = [
        ("A", "2020-01-01", 1.0),
        ("A", "2020-01-02", None),
        ("A", "2020-01-03", float("nan")),
        ("A", "2020-01-04", 30.0),
        ("A", "2020-01-08T09:00:00", 2.0),
        ("A", "2020-01-08 16:00", 5.0),
        ("A", "20200108T1200", 3.0),
        ("A", "not a date", 4.0),
        ("A", "2020-02-31", 4.0),
        (None, "2020-01-02", 1.5),
    ]
    r = readings(spark, data)
    found = rows(unread_days(r.unionByName(r), calendar(spark)).select("asset", "obs_day"))
    assert found == [("A", f"2020-01-0{d}") for d in (2, 3, 4, 5)]
    grid = regular_grid(r.unionByName(r), calendar(spark))
    assert grid.where("asset = 'A' and obs_day = '2020-01-08'").first().value == 5.0
    assert grid.where("asset is null").count() == 1


def test_readings_outside_the_calendar_bound_the_series(spark, rows):
    data = [("A", "1900-05-05", 1.0), ("A", "2020-01-03", 2.0), ("A", "2300-01-01", 3.0)]
    found = unread_days(readings(spark, data), calendar(spark, 10, closed=(1,)))
    assert found.count() == 8


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert unread_days(empty, calendar(spark)).count() == 0
    some = readings(spark, [("A", "2020-01-01", 1.0), ("A", "2020-01-05", 1.0)])
    assert unread_days(some, calendar(spark).where(F.lit(False))).count() == 0
