import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import panel, steps

D0 = dt.date(2020, 1, 1)


def series(spark, values, days=None, name="x"):
    days = days or [D0 + dt.timedelta(i) for i in range(len(values))]
    return spark.createDataFrame([(name, d, v if v is None else float(v), "clash") for d, v in zip(days, values)], "asset string, date date, value double, step string").select("asset", "date", "value")


def test_hole_of_a_daily_series_is_dropped(spark):
    days = [D0 + dt.timedelta(i) for i in range(7)] + [dt.date(2030, 1, 1)]
    s = series(spark, [1.0, 2, 3, 4, 5, 6, 7, 500], days)
    for trailing in (300, None):
        got = [r.step for r in steps.clean_steps(s, ["asset"], trailing).collect()]
        assert got == [1.0] * 6


def test_monthly_series_has_no_holes(spark):
    s = series(spark, [float(i) for i in range(12)], [dt.date(2020, m, 1) for m in range(1, 13)])
    assert steps.clean_steps(s, ["asset"]).count() == 11
    c = steps.cadence(s, ["asset"]).first()
    assert c.cadence == "monthly" and not c.dense_daily and steps.monthly_check(s, ["asset"]).first().is_monthly


def test_look_ahead_cut(spark):
    s = series(spark, [1.0, 2.0, 3.0, 99.0], [D0, D0 + dt.timedelta(1), D0 + dt.timedelta(2), dt.date(2020, 6, 1)])
    r = panel.last_values(s, F.lit("2020-01-03").cast("date")).first()
    assert (r.n_obs, r.anchor) == (3, 3.0)
    late = panel.look_ahead(s.withColumn("unit", F.lit("u")), spark.createDataFrame([("u", dt.date(2020, 1, 3))], "unit string, asof date"), "unit").first()
    assert (late.n_rows, late.n_late, late.n_late_assets) == (4, 1, 1)


def test_volatility_recursion_over_block_borders(spark):
    x = np.random.default_rng(4).normal(size=5000)
    rows = steps.ewma(series(spark, [0.0, *np.cumsum(x).tolist()]).transform(lambda s: steps.clean_steps(s, ["asset"])), ["asset"]).orderBy("date").collect()
    step = np.array([r.step for r in rows])
    s2, want = step[0] ** 2, []
    for i, v in enumerate(step):
        s2 = s2 if i == 0 else 0.94 * s2 + 0.06 * v * v
        want.append(max(math.sqrt(s2), 0.3 * step.std()))
    assert np.allclose([r.sigma for r in rows], want, rtol=1e-10)


def test_short_series(spark):
    s = series(spark, [1.0, 3.0])
    assert steps.clean_steps(s, ["asset"]).first().step == 2.0
    assert steps.ewma(steps.clean_steps(s, ["asset"]), ["asset"]).first().sigma == 0.0
    assert steps.clean_steps(series(spark, [1.0]), ["asset"]).count() == 0
    assert steps.regime(steps.clean_steps(series(spark, []), ["asset"]), ["asset"]).count() == 0
    assert steps.mean_reversion(s, ["asset"]).first().phi == 0.0


def test_pull_of_a_reverting_series(spark):
    draw, v = np.random.default_rng(0), [0.0]
    for _ in range(900):
        v.append(v[-1] * 0.95 + draw.normal())
    r = steps.mean_reversion(series(spark, v), ["asset"]).first()
    assert 0.02 < r.phi_hat < 0.1 and r.t > 2.2 and r.phi == pytest.approx(min(r.phi_hat / 2, 0.05))


def test_impossible_returns_raise(spark):
    with pytest.raises(Exception, match="simple return"):
        steps.log_return_steps(series(spark, [0.1, -1.0]), ["asset"]).collect()
    assert steps.log_return_steps(series(spark, [None, 0.5]), ["asset"]).where("step is null").count() == 1


def test_alignment(spark):
    two = series(spark, [1.0, 2, 3, 4]).unionByName(series(spark, [1.0, 3, 5], [D0, D0 + dt.timedelta(1), D0 + dt.timedelta(3)], "y")).withColumn("unit", F.lit("u"))
    s = steps.clean_steps(two, ["unit", "asset"])
    assert sorted(r.date.day for r in steps.aligned(s, ["unit"]).collect()) == [2, 2, 4, 4]
    outer = steps.aligned(s, ["unit"], outer=True)
    assert outer.count() == 6 and outer.where("step = 0").count() == 1


def test_instants_to_the_nanosecond(spark):
    texts = ["2020-06-30T23:59:59.999999999Z", "2020-07-01T00:00:00.000000000Z", "2020-06-30", "2020-07-01", "2020-06-30T20:00:00-05:00", "2020-06-30T10:00:00-00:00", "soon", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", panel.strictly_late(F.col("t"), F.lit("2020-06-30").cast("date")).alias("late"), panel.instant(F.col("t")).alias("at"))
    got = {r.i: r.late for r in df.collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: True, 5: None, 6: None, 7: None}
    assert df.where("i = 0").first().at.nanos == 999999999


def test_value_at_ties_and_before_the_first(spark):
    s = series(spark, [1.0, None, 3.0])
    points = spark.createDataFrame([("x", D0 - dt.timedelta(1)), ("x", D0), ("x", D0 + dt.timedelta(1)), ("x", D0 + dt.timedelta(9))], "asset string, at date")
    assert [r.found for r in panel.value_at(s, points, ["asset"]).orderBy("at").collect()] == [None, 1.0, 1.0, 3.0]


def test_first_panel_and_last_row_of_a_day(spark):
    rows = [("b", "x", D0, 1.0, 1), ("a", "x", D0, 2.0, 1), ("a", "x", D0, 3.0, 2), ("a", "y", D0 + dt.timedelta(400), 5.0, 1), ("b", "y", D0, 4.0, 1)]
    df = spark.createDataFrame(rows, "panel_id string, asset string, date date, value double, row_no int")
    got = sorted((r.panel_id, r.asset, r.value) for r in panel.first_panel_series(df, F.lit("2020-02-01").cast("date")).collect())
    assert got == [("a", "x", 3.0), ("b", "y", 4.0)]


def test_days_of_a_common_outage_are_left_out(spark):
    day = lambda i: dt.date(2024, 1, i)
    rows = [(u, a, day(i), float(i)) for u, a in (("u", "A"), ("u", "B"), ("u", "C"), ("v", "A")) for i in range(1, 13) if (i != 9 if a == "C" else i in (1, 2, 8, 9, 10, 11, 12))]
    p = spark.createDataFrame(rows, "unit string, asset string, date date, value double")
    days = spark.createDataFrame([(day(i),) for i in range(1, 13)], "date date")
    got = {}
    for r in panel.carried_forward(p, days, ["unit", "asset"]).collect():
        got.setdefault((r.unit, r.asset), {})[r.date.day] = (r.value, r.carried)
    # A and B of u are both missing on 6 and 7, three days after the last value; of v only one series is
    assert all(sorted(got["u", a]) == [1, 2, 3, 4, 5, 8, 9, 10, 11, 12] for a in "ABC") and sorted(got["v", "A"]) == list(range(1, 13))
    assert got["u", "A"][5] == (2.0, True) and got["u", "C"][9] == (8.0, True) and got["v", "A"][6] == (None, True)
