import datetime as dt

import numpy as np
import pytest

from quantloom.plans import verbs

CELLS = "unit string, asset string, horizon int, steps int"


@pytest.fixture(scope="module")
def panel(spark):
    draw, rows = np.random.default_rng(0), []
    for unit in ("u", "v"):
        path = np.cumsum(draw.normal(0, 1, (160, 2)), axis=0) + 50
        rows += [(unit, a, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(path[i, k])) for i in range(160) for k, a in enumerate("AB")]
    return spark.createDataFrame(rows, "unit string, asset string, date date, value double")


def test_bootstrap_end_to_end(spark, panel):
    targets = spark.createDataFrame([(u, a, h, h) for u in ("u", "v") for a in ("A", "B", "C") for h in (2, 5)], CELLS)
    draws = verbs.forecast_bootstrap(panel, targets, n_draws=60, seed=2)
    rows = draws.collect()
    assert len(rows) == 2 * 3 * 2 * 60 and all(np.isfinite(r.value) for r in rows)
    spread = {h: np.std([r.value for r in rows if r.unit == "u" and r.asset == "A" and r.horizon == h]) for h in (2, 5)}
    assert 0 < spread[2] < spread[5] < 20
    again = {(r.unit, r.asset, r.horizon, r.draw): r.value for r in verbs.forecast_bootstrap(panel.repartition(7), targets, n_draws=60, seed=2).collect()}
    assert all(abs(again[r.unit, r.asset, r.horizon, r.draw] - r.value) < 1e-9 for r in rows)
    assert verbs.forecast_bootstrap(panel, targets.limit(0), 10).count() == 0
    wide = verbs.forecast_bootstrap(panel, targets, 60, 2, families=spark.createDataFrame([("u", "F4")], "unit string, family string"))
    values = [r.value for r in wide.collect() if r.unit == "u" and r.asset == "A" and r.horizon == 5]
    assert np.std(values) > 1.5 * spread[5]


def test_calibration_on_the_past(spark, panel):
    targets = spark.createDataFrame([("u", "A", 2, 2), ("u", "B", 5, 5), ("w", "A", 2, 2)], CELLS)
    got = {(r.unit, r.asset, r.horizon): r for r in verbs.calibration(panel, targets, n_draws=30).collect()}
    assert set(got) == {("u", "A", 2), ("u", "B", 5)}
    for r in got.values():
        assert 8 <= r.n <= 14 and -0.45 <= r.shift_sd <= 0.45 and 0.75 <= r.scale_lo == r.scale_hi <= 1.45
