import datetime as dt

import numpy as np

from quantloom.operators.spikes import SpikeRules, flag_series, implausible_readings

SCHEMA = "reading_id long, card_id string, panel_id string, asset string, date string, value double, ingested_at timestamp, first boolean, v double"
T = dt.datetime(2020, 1, 1)


def brute(values):
    """Indexes of the cases of one series, straight from their definition."""
    bad = {i for i, v in enumerate(values) if not np.isfinite(v) or v <= 0}
    ok = [i for i in range(len(values)) if i not in bad]
    x = [float(np.log(values[i])) for i in ok]
    moves = [abs(b - a) for a, b in zip(x, x[1:])]
    m = float(np.median(moves)) if moves else float("nan")
    out = set(bad)
    run = [0]
    for k in range(1, len(x) + 1):
        if k < len(x) and moves[k - 1] < 0.02 * m:
            run.append(k)
            continue
        if len(run) >= 8:
            out |= {ok[j] for j in run[1:]}
        run = [k]
    for size in (1, 2, 3):
        for k in range(1, len(x) - size):
            group, a, b = x[k : k + size], x[k - 1], x[k + size]
            if all(g - max(a, b) > 15 * m for g in group) or all(min(a, b) - g > 15 * m for g in group):
                out |= {ok[k + j] for j in range(size)}
    return out


def wild(draw, n):
    x = np.cumsum(draw.standard_t(3, n) * 0.004)
    v = np.exp(x) * draw.choice([1.0, 100.0])
    v = np.round(v, int(draw.integers(1, 5)))
    for _ in range(int(draw.integers(0, 6))):
        at, size = int(draw.integers(0, n)), int(draw.integers(1, 5))
        v[at : at + size] *= np.exp(draw.choice([-1, 1]) * draw.uniform(0.02, 2))
    if draw.random() < 0.5:
        at = int(draw.integers(0, n))
        v[at : at + int(draw.integers(5, 14))] = v[at]
    if draw.random() < 0.3:
        v[int(draw.integers(0, n)) :] *= 1.6  # a change of level for good
    for bad in (0.0, -1.0, np.inf, np.nan):
        if draw.random() < 0.2:
            v[int(draw.integers(0, n))] = bad
    return v


def test_batches_of_series_against_brute_force():
    draw = np.random.default_rng(11)
    series = [wild(draw, int(draw.integers(1, 120))) for _ in range(400)]
    first = np.concatenate([np.arange(len(s)) == 0 for s in series])
    kind, _ = flag_series(np.concatenate(series), first, SpikeRules())
    at = 0
    for s in series:
        assert set(np.flatnonzero(kind[at : at + len(s)])) == brute(s)
        at += len(s)


def test_candidates_come_from_the_sparse_part():
    v = np.exp(np.cumsum(np.random.default_rng(1).normal(0, 0.01, 80)))
    v[40] *= 3
    kind, score = flag_series(v, np.arange(80) == 0, SpikeRules())
    assert kind[40] == 3 and score[40] > 15 and (np.delete(score, range(36, 45)) < score[40]).all()
    nothing, _ = flag_series(v, np.arange(80) == 0, SpikeRules(sparse_moves=1e9))
    assert nothing[40] == 0


def test_series_across_arrow_batches(spark):
    draw = np.random.default_rng(5)
    data, expected, i = [], set(), 0
    for k in range(12):
        v = wild(draw, 60)
        hits = brute(v)
        for j, x in enumerate(v):
            day = (dt.date(2019, 1, 1) + dt.timedelta(j)).isoformat()
            data.append((i, f"c{k % 3}", None if k == 4 else "g", f"a{k}", day if j % 2 else day + "T10:00:00", float(x), T, True, 0.0))
            if j in hits and not np.isnan(x):
                expected.add(i)
            i += 1
    df = spark.createDataFrame(data, SCHEMA)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = implausible_readings(df.unionByName(df), defaults={"panel_id": "g"})
        ids = [r.reading_id for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    nan = {r[0] for r in data if np.isnan(r[5])}
    assert len(ids) == len(set(ids)) and set(ids) - nan == expected


def test_nulls_and_empty(spark):
    rows = [(1, "c", "p", "a", None, 1.0, T, None, None), (None, "c", "p", "a", "2020-01-01", -1.0, T, None, None), (2, None, None, None, "2020-01-01", -1.0, None, None, None), (3, "c", "p", "a", "2020-01-02", None, T, None, None)]
    got = implausible_readings(spark.createDataFrame(rows, SCHEMA))
    assert [(r.reading_id, r.kind) for r in got.collect()] == [(2, "range")]
    assert implausible_readings(spark.createDataFrame([], SCHEMA)).count() == 0
