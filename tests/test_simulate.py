import datetime
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions.rng import normal, uniform, unit_seed
from quantloom.operators import overlay, simulate, steps

MOM = "unit string, asset string, horizon int, anchor double, drift double, sd double, n int"


def test_counter_based_numbers(spark):
    df = spark.range(20000).select(uniform(F.lit(1), F.col("id")).alias("u"), normal(F.lit(1), F.col("id")).alias("z"))
    r = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("z"), F.stddev("z")).first()
    assert 0 <= r[0] and r[1] < 1 and abs(r[2] - 0.5) < 0.01 and abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.02
    assert df.repartition(7).agg(F.sum("z")).first()[0] == pytest.approx(df.agg(F.sum("z")).first()[0])


def test_seed_of_a_name(spark):
    name = "unit-one"
    got = spark.createDataFrame([(name,)], "s string").select(unit_seed(F.col("s")).alias("s")).first().s
    assert got == (zlib.crc32(name.encode()) & 0x7FFFFFFF) ^ 0x5EED


def test_walk_scales_with_the_root_of_the_horizon(spark):
    m = spark.createDataFrame([("u", "A", h, 100.0, 0.5, 2.0, 99) for h in (4, 64)] + [("u", "B", 9, None, None, None, 0)], MOM)
    w = simulate.adapter_walk(m, 4000, 11).groupBy("asset", "horizon").agg(F.avg("value").alias("m"), F.stddev("value").alias("s")).collect()
    got = {(r.asset, r.horizon): (r.m, r.s) for r in w}
    assert abs(got["A", 4][0] - 102) < 0.3 and abs(got["A", 64][0] - 132) < 1.2
    assert abs(got["A", 4][1] - 4) < 0.2 and abs(got["A", 64][1] - 16) < 0.8 and abs(got["B", 9][1] - 3) < 0.2


def test_correlated_walk(spark):
    m = spark.createDataFrame([("u", a, 1, 0.0, 0.0, 1.0, 99) for a in "AB"], MOM)
    loads = simulate.factors(spark.createDataFrame([("u", "A", "B", -0.6)], "unit string, a string, b string, corr double"))
    w = simulate.correlated_walk(m, loads, 4000, 1).groupBy("draw").pivot("asset", ["A", "B"]).agg(F.first("value"))
    assert abs(w.select(F.corr("A", "B")).first()[0] + 0.6) < 0.05


def test_repair_of_a_matrix_that_is_none():
    low = simulate.repaired_factor(np.array([[1, 0.9, np.nan], [0.9, 1, 0.9], [np.nan, 0.9, 1]]))
    c = low @ low.T
    assert np.allclose(np.diag(c), 1) and np.linalg.eigvalsh(c).min() > -1e-12


def test_monthly_paths_share_their_shocks(spark):
    m = spark.createDataFrame([("u", "A", h, 600, 0.0, 0.0, 1.0) for h in (1, 3)], "unit string, asset string, horizon int, last_month int, anchor double, drift double, sd double")
    w = simulate.monthly_walk(m, 4000, 3).groupBy("draw").pivot("horizon", [1, 3]).agg(F.first("value"))
    assert abs(w.select(F.corr("1", "3")).first()[0] - (1 / 3) ** 0.5) < 0.05


def test_covariance_draws(spark):
    m = spark.createDataFrame([("u", a, h, 1.0, 0.1, 0.0, 9) for a in "AB" for h in (5, 20)], MOM)
    cov = spark.createDataFrame([("u", "A", "A", 0.04), ("u", "B", "B", 0.09), ("u", "A", "B", 0.03)], "unit string, a string, b string, cov double")
    w = simulate.covariance_draws(m, cov, 5000, 7).groupBy("draw").pivot("asset", ["A", "B"]).agg(F.max(F.when(F.col("horizon") == 20, F.col("value"))))
    r = w.select(F.var_samp("A"), F.covar_samp("A", "B"), F.avg("A")).first()
    assert abs(r[0] - 0.8) < 0.06 and abs(r[1] - 0.6) < 0.06 and abs(r[2] - 3) < 0.05


def test_a_wide_asset_leaves_the_others_alone(spark):
    m = spark.createDataFrame([("u", a, 1, 1.0, 0.0, 0.0, 9) for a in "AB"], MOM)
    cov = spark.createDataFrame([("u", "A", "A", 1e8), ("u", "B", "B", 1e-6), ("u", "A", "B", 0.0)], "unit string, a string, b string, cov double")
    r = simulate.covariance_draws(m, cov, 2000, 7).where("asset = 'B'").agg(F.stddev("value")).first()
    assert abs(r[0] - 1e-3) < 1e-4


def test_blocks_follow_in_a_circle(spark):
    w = spark.createDataFrame([("u", i, float(i == 8)) for i in range(10)], "unit string, row int, weight double")
    rows = simulate.bootstrap_rows(w, 200, 12, 4.0, 5).orderBy("draw", "t").collect()
    path = np.array([r.row for r in rows]).reshape(200, 12)
    assert (path[:, 0] == 8).all()
    follows = (path[:, 1:] - path[:, :-1]) % 10 == 1
    assert ((path[:, 1:] == 8) | follows).all() and 0.6 < follows.mean() < 0.9


def test_paths_of_an_asset_without_innovations_are_wide(spark):
    picks = simulate.bootstrap_rows(spark.createDataFrame([("u", i, 1.0) for i in range(30)], "unit string, row int, weight double"), 800, 10, 8.0, 5)
    z = spark.createDataFrame([("u", "A", i, 1.0) for i in range(30)], "unit string, asset string, row int, z double")
    models = spark.createDataFrame([("u", "A", 10.0, 2.0, 0.5, 0.0, False), ("u", "B", 0.0, 1.0, 0.0, 0.0, False)], "unit string, asset string, anchor double, sigma double, drift double, phi double, log_return boolean")
    got = {r.asset: (r.m, r.s) for r in simulate.bootstrap_paths(picks, z, models, (10,), 5).groupBy("asset").agg(F.avg("value").alias("m"), F.stddev("value").alias("s")).collect()}
    assert abs(got["A"][0] - 35) < 1e-9 and got["A"][1] < 1e-9 and abs(got["B"][1] - 10**0.5) < 0.3


def test_sigmas_of_a_pool_are_drawn_by_their_size(spark):
    picks = spark.createDataFrame([("u", i, t, t) for i in range(2000) for t in range(2)], "unit string, draw int, t int, row int")
    z = spark.createDataFrame([("u", a, i, 1.0) for a in "ABC" for i in range(9)], "unit string, asset string, row int, z double")
    pool = [1.0] * 30 + [10.0] * 3
    models = [("u", "A", 5.0, 2.0, 0.0, 0.0, False, pool), ("u", "B", 5.0, 2.0, 0.0, 0.0, False, pool[:30]), ("u", "C", 5.0, 2.0, 0.0, 0.0, False, None)]
    models = spark.createDataFrame(models, "unit string, asset string, anchor double, sigma double, drift double, phi double, log_return boolean, sigma_pool array<double>")
    rows = simulate.bootstrap_paths(picks, z, models, (1, 2), 5).collect()
    got = {(a, h): {r.draw: r.value - 5 for r in rows if (r.asset, r.horizon) == (a, h)} for a in "ABC" for h in (1, 2)}
    assert set(got["A", 1].values()) == {1.0, 10.0} and all(got["A", 2][i] == 2 * x for i, x in got["A", 1].items())  # one sigma a draw
    assert abs(sum(x == 10 for x in got["A", 1].values()) / 2000 - 0.5) < 0.04
    assert set(got["B", 1].values()) == {2.0} == set(got["C", 1].values())


def test_transfer_scale_with_a_zero_anchor(spark):
    m = spark.createDataFrame([("u", "A", 0.0, 1.0, None, 0.2, 2.0), ("u", "B", 10.0, 1.0, 3.0, 0.0, 9.0)], "unit string, asset string, anchor double, sigma double, s75 double, basket double, ratio double")
    got = {r.asset: r.sigma_out for r in simulate.transfer_scale(m).collect()}
    assert got == {"A": 2.0, "B": 12.0}


def test_overlay_keeps_the_order_of_draws(spark):
    draws = spark.createDataFrame([("u", "A", 1, i, float(i)) for i in range(101)] + [("u", "B", 1, i, 5.0) for i in range(3)], "unit string, asset string, horizon int, draw int, value double")
    adj = spark.createDataFrame([("u", "A", None, 1000.0, 50.0, 9.0, 0.1)], "unit string, asset string, horizon int, scale double, drift_bp double, vol_scale double, skew double")
    out = [r.value for r in overlay.adjusted(draws, adj).where("asset = 'A'").orderBy("draw").collect()]
    assert out == sorted(out) and abs(out[50] - 55) < 1e-9 and abs(out[100] - (50 + 50 * 1.1 * 1.6 + 5)) < 1e-9
    assert {r.value for r in overlay.adjusted(draws, adj).where("asset = 'B'").collect()} == {5.0}
    corr = spark.createDataFrame([("u", "B", 1, 0.4, 2.0, 2.0)], "unit string, asset string, horizon int, shift_sd double, scale_lo double, scale_hi double")
    assert {r.value for r in overlay.corrected(draws, corr).where("asset = 'B'").collect()} == {5.0}


def test_branches_take_their_share_of_any_number_of_draws(spark):
    rows = [("u", "A", 1, i, float(i % 7)) for i in range(3000)] + [("u", "A", 2, i, float(i % 7)) for i in range(10)]
    draws = spark.createDataFrame(rows, "unit string, asset string, horizon int, draw int, value double")
    s = spark.createDataFrame([(1, 0.25, 1.5), (2, 0.1, 3.0), (3, None, None)], "branch int, p double, vol double")
    k = spark.createDataFrame([(b, "A", v) for b, v in ((1, 100.0), (2, -100.0), (3, 500.0))], "branch int, asset string, k double")
    out = overlay.mixed_scenarios(draws, s, k).collect()
    for h, n1, n2 in ((1, 750, 300), (2, 2, 1)):  # halves go to the even number
        up, down = ({r.draw for r in out if r.horizon == h and side * r.value > 50} for side in (1, -1))
        assert up == set(range(n1)) and down == set(range(n1, n1 + n2))


def _two_regimes(n_old: int, n_new: int):
    """Steps of +5 and then of +1 and -1 in turn about 0.5 a day, by asset."""
    day = datetime.date(2010, 1, 1)
    rows = []
    for asset, sign in (("A", 1.0), ("B", -1.0)):
        value = 100.0
        for i in range(n_old + n_new):
            value += sign * (5.0 if i < n_old else 0.5 + (-1) ** i)
            rows.append(("c1", asset, day + datetime.timedelta(i), value))
    return rows


def test_last_rows_of_a_series(spark):
    p = spark.createDataFrame(_two_regimes(50, 310) + [("c2", "A", datetime.date(2010, 1, 1), 1.0)], "unit string, asset string, date date, value double")
    got = {(r.unit, r.asset): (r.n, str(r.d)) for r in steps.trailing_rows(p, ["unit", "asset"]).groupBy("unit", "asset").agg(F.count("*").alias("n"), F.min("date").alias("d")).collect()}
    assert got == {("c1", "A"): (300, "2010-03-02"), ("c1", "B"): (300, "2010-03-02"), ("c2", "A"): (1, "2010-01-01")}


def test_baseline_is_of_the_last_rows_before_the_as_of(spark, tmp_path):
    from quantloom.plans import sim_queries

    rows = _two_regimes(400, 320)
    cut = rows[719][2]
    later = [("c1", a, cut + datetime.timedelta(i), 9999.0 * i) for a in "AB" for i in (1, 2)]
    g10 = [(u, a, str(t), v + 5000.0) for u, a, t, v in rows + later]
    spark.createDataFrame(g10, "card_id string, asset string, date string, value double").write.parquet(f"{tmp_path}/g10_daily.parquet")
    spark.createDataFrame([("c1", str(cut), [4])], "card_id string, asof string, horizons array<int>").write.parquet(f"{tmp_path}/task_cards.parquet")
    got = {r.asset: r for r in sim_queries.m0_draws(spark, str(tmp_path)).collect()}
    anchors = {a: v + 5000.0 for u, a, t, v in rows if t == cut}
    for asset, sign in (("A", 1.0), ("B", -1.0)):
        assert got[asset].n == 500 and abs(got[asset].sd_value - 2) < 0.25
        assert abs(got[asset].mean_value - (anchors[asset] + sign * 2)) < 0.4


def test_baseline_of_cards_without_cells_or_finite_covariances(spark, tmp_path):
    from quantloom.plans import sim_queries

    def day(i):
        return str(datetime.date(2020, 1, 1) + datetime.timedelta(i))

    g10 = [("whole", a, day(i), 10.0 + i % 3 + (a == "B") * i) for a in "AB" for i in range(6)]
    g10 += [("one step", a, day(i), 10.0 + i) for a in "AB" for i in range(2)] + [("no horizons", a, day(i), 10.0 + i) for a in "AB" for i in range(6)]
    g10 += [("vast", a, day(i), 1e200 if i == 3 else 10.0 + i) for a in "AB" for i in range(6)]
    cards = [("whole", "2021-01-01", [1, 5]), ("one step", "2021-01-01", [1]), ("no horizons", "2021-01-01", None), ("vast", "2021-01-01", [1])]
    spark.createDataFrame(g10, "card_id string, asset string, date string, value double").write.parquet(f"{tmp_path}/g10_daily.parquet")
    spark.createDataFrame(cards, "card_id string, asof string, horizons array<int>").write.parquet(f"{tmp_path}/task_cards.parquet")
    got = {(r.unit, r.asset, r.horizon): r for r in sim_queries.m0_draws(spark, str(tmp_path)).collect()}
    assert set(got) == {("whole", a, h) for a in "AB" for h in (1, 5)} | {("vast", a, 1) for a in "AB"}
    for (unit, _, _), r in got.items():
        assert r.n == 500 and (r.mean_value is None) == (r.sd_value is None) == (unit == "vast")


def test_gaussian_floor(spark):
    p = spark.createDataFrame(_two_regimes(400, 320), "unit string, asset string, date date, value double")
    h = spark.createDataFrame([("c1", a, n) for a in "AB" for n in (4, 16)] + [("c1", "C", 4)], "unit string, asset string, horizon int")
    out = simulate.gaussian_floor(p, h, 3000, 1)
    w = out.groupBy("draw").pivot("horizon", [4, 16]).agg(*(F.max(F.when(F.col("asset") == a, F.col("value"))).alias(a) for a in "ABC"))
    last = {r.asset: r.v for r in p.groupBy("asset").agg(F.max_by("value", "date").alias("v")).collect()}
    r = w.select(F.avg("4_A"), F.stddev("4_A"), F.stddev("16_A"), F.corr("4_A", "16_A"), F.corr("16_A", "16_B"), F.avg("16_B"), F.avg("4_C"), F.stddev("4_C")).first()
    assert abs(r[0] - last["A"] - 2) < 0.2 and abs(r[1] - 2) < 0.1 and abs(r[2] - 4) < 0.2 and abs(r[3] - 0.5) < 0.05
    assert r[4] < -0.99 and abs(r[5] - last["B"] + 8) < 0.3 and abs(r[6]) < 0.2 and abs(r[7] - 2) < 0.1
