import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import grid, scores
from quantloom.plans.verbs import score

CELLS = [("A", 1), ("A", 5), ("B", 1), ("B", 5)]


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(2)
    x = {("u", a, h): 1 + 0.25 * draw.normal(size=300) for a, h in CELLS} | {("one", "A", 1): draw.normal(size=300)}
    y = {k: float(draw.normal()) for k in x}
    draws = spark.createDataFrame([(*k, i, float(v)) for k, vs in x.items() for i, v in enumerate(vs)], "unit string, asset string, horizon int, draw int, value double")
    realized = spark.createDataFrame([(*k, v) for k, v in y.items()], "unit string, asset string, horizon int, value double")
    return x, y, draws, realized


def pairwise(v, y):
    return np.abs(v - y).mean() - np.abs(v[:, None] - v[None, :]).mean() / 2


def test_crps_is_the_pairwise_form(data):
    x, y, draws, realized = data
    for r in scores.crps(draws, realized).collect():
        k = (r.unit, r.asset, r.horizon)
        assert abs(r.crps - pairwise(x[k], y[k])) < 1e-12 and r.n_draws == 300


def test_pinball_and_coverage(data):
    x, y, draws, realized = data
    want = [[(a * (y[k] - q) if y[k] >= q else (1 - a) * (q - y[k])) for k in x if k[0] == "u" for q in [np.quantile(x[k], a)]] for a in scores.LEVELS]
    got = {r.unit: r.tail for r in scores.tail_pinball(draws, realized).collect()}
    assert abs(got["u"] - np.mean([np.mean(w) for w in want])) < 1e-12
    cover = sum(abs(np.mean([y[k] <= np.quantile(x[k], a) for k in x if k[0] == "u"]) - a) for a in scores.LEVELS)
    assert abs({r.unit: r.coverage for r in scores.tail_coverage(draws, realized).collect()}["u"] - cover) < 1e-12


def test_variogram_energy_and_single_cell(data):
    x, y, draws, realized = data
    keys = [k for k in x if k[0] == "u"]
    want = sum((abs(y[a] - y[b]) ** 0.5 - (np.abs(x[a] - x[b]) ** 0.5).mean()) ** 2 for a in keys for b in keys)
    joint = {r.unit: r.joint for r in scores.variogram(draws, realized).collect()}
    assert abs(joint["u"] - want) < 1e-10 and joint["one"] == 0
    m = np.stack([x[k] for k in keys], 1)
    energy = np.linalg.norm(m - np.array([y[k] for k in keys]), axis=1).mean() - np.linalg.norm(m[:, None] - m[None], axis=2).mean() / 2
    got = {r.unit: r.energy for r in scores.energy(draws, realized).collect()}
    assert abs(got["u"] - energy) < 1e-6 and abs(got["one"] - pairwise(x["one", "A", 1], y["one", "A", 1])) < 1e-6
    c = {r.unit: r for r in scores.composite(draws, realized).collect()}
    assert abs(c["one"].composite - (0.5 * c["one"].marginal + 0.2 * c["one"].tail) / 0.7) < 1e-12


def test_published_weights():
    parts = {"marginal": 0.3979101787880598, "joint": 0.007893839159323549, "tail": 0.06635287209486329}
    assert abs(sum(scores.WEIGHTS[k] * v for k, v in parts.items()) - 0.21459381556079962) < 1e-12
    assert abs((0.5 * 0.8933158850733317 + 0.2 * 0.04122276275639351) / 0.7 - 0.6498607072684922) < 1e-12


def test_roster_scoring_never_rewards_failure(spark, data):
    _, _, draws, realized = data
    plan = spark.createDataFrame([("u", a, h, 300) for a, h in CELLS] + [("one", "A", 1, 300), ("gone", "A", 1, 300)], "unit string, asset string, horizon int, n_draws int")
    units, mean = score(draws, realized, plan)
    got = {r.unit: r for r in units.collect()}
    assert got["gone"].code and got["u"].code is None
    m = mean.first()
    assert m.n_units == 3 and m.n_failed == 1 and abs(m.mean_score * 3 - (min(4, got["u"].composite) + min(4, got["one"].composite) + 4)) < 1e-9
    broken = draws.where("not (unit = 'u' and draw = 7 and asset = 'B' and horizon = 5)")
    broken = broken.unionByName(draws.where("unit = 'u' and draw = 8 and asset = 'B' and horizon = 5"))  # an omission made up for by a copy
    again, mean2 = score(broken, realized, plan)
    assert {r.unit: r.code for r in again.collect()}["u"] == "grid" and mean2.first().mean_score >= m.mean_score


def test_occupancy_and_accounts(spark):
    d = spark.createDataFrame([("u", "A", 1, 0), ("u", "A", 1, 0), ("u", "A", 1, 1), ("u", "X", 1, 0)], "unit string, asset string, horizon int, draw int")
    g = spark.createDataFrame([("u", "A", 1, 3), ("u", "B", 1, 3)], "unit string, asset string, horizon int, n_draws int")
    r = grid.occupancy(d, g).first()
    assert (r.cells, r.duplicates, r.missing, r.extra) == (2, 1, 4, 1)
    accounts = grid.roster_accounts(spark.createDataFrame([("a",), ("b",)], "unit string"), spark.createDataFrame([("b",), ("b",), ("c",)], "unit string"))
    assert tuple(accounts.first()) == (1, 1, 1)
    with pytest.raises(grid.OrganizerFault):
        grid.require_accounts(accounts)


def test_clip_and_failure_cost(spark):
    roster = spark.createDataFrame([(f"u{i}",) for i in range(6)], "unit string")
    s = lambda rows: spark.createDataFrame(rows, "unit string, score double")
    assert grid.roster_mean(roster, s([(f"u{i}", 0.0) for i in range(5)] + [("u5", 100.0)])).first().mean_score == pytest.approx(4 / 6)
    assert grid.roster_mean(roster, s([(f"u{i}", 0.0) for i in range(5)])).first().mean_score == pytest.approx(4 / 6)
    assert grid.roster_mean(roster, s([("u0", float("nan"))])).first().n_failed == 6


def test_empty_draws(spark, data):
    _, _, draws, realized = data
    none = draws.limit(0)
    assert scores.crps(none, realized).count() == 0 and scores.tail_pinball(none, realized).count() == 0 and scores.energy(none, realized).count() == 0


def test_energy_copies_no_draw_for_its_pairs(data):
    """Many small blocks against all pairs at once; some draws lack a cell, and two agree."""
    x, y, draws, realized = data
    kept = draws.where("not (unit = 'u' and asset = 'B' and horizon = 5 and draw % 50 = 7)")
    kept = kept.where("draw != 299").unionByName(kept.where("draw = 11").withColumn("draw", F.lit(1000)))
    df = scores.energy(kept, realized, block=16)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "shuffle_replicate_nl" in plan
    got = {r.unit: r for r in df.collect()}
    for unit, lacking in (("u", range(7, 300, 50)), ("one", ())):
        keys = [k for k in x if k[0] == unit]
        m = np.stack([x[k] for k in keys], 1)
        m = np.concatenate([np.delete(m, [*lacking, 299], axis=0), m[11:12]])
        want = np.linalg.norm(m - np.array([y[k] for k in keys]), axis=1).mean() - np.linalg.norm(m[:, None] - m[None], axis=2).mean() / 2
        assert got[unit].n_draws == len(m) and abs(got[unit].energy - want) < 1e-6
