import hashlib
import json

import pytest

from quantloom.operators.grid import OrganizerFault, commitment
from quantloom.sources import panels, roster


def unit(name, assets=("A", "B"), horizons=(1, 5), count=None):
    return {"unit_handle": name, "grid": {"assets": list(assets), "horizons": list(horizons), "cell_count": len(assets) * len(horizons) if count is None else count}}


def put(folder, units, **norm):
    (folder / roster.PLAN).write_text(json.dumps({"roster": {"expected_units": units}, "normalization": norm}))
    return str(folder)


def scale(folder, name, body):
    at = folder / name / "reference"
    at.mkdir(parents=True)
    (at / roster.SCALE).write_text(body)
    return hashlib.sha256(body.encode()).hexdigest()


def test_plan_and_its_grid(spark, tmp_path):
    plan = roster.read_plan(spark, put(tmp_path, [unit("u2"), unit("u1", ("X",), (3,))], mode="ref_scale", ref_scale_commitment="d"))
    assert (plan.mode, plan.commitment) == ("ref_scale", "d")
    got = roster.planned_cells(plan.roster).orderBy("unit", "cell_idx").collect()
    assert [tuple(r) for r in got] == [("u1", "X", 3, 0), ("u2", "A", 1, 0), ("u2", "A", 5, 1), ("u2", "B", 1, 2), ("u2", "B", 5, 3)]


@pytest.mark.parametrize("units", [[], [unit("a"), unit("a")], [unit("a", ("A", "A"))], [unit("a", horizons=(0,))], [unit("a", count=9)], [{"unit_handle": "a"}]])
def test_faults_of_a_plan(spark, tmp_path, units):
    with pytest.raises(OrganizerFault):
        roster.read_plan(spark, put(tmp_path, units))


def test_absent_plan(spark, tmp_path):
    with pytest.raises(OrganizerFault):
        roster.read_plan(spark, str(tmp_path))


def test_scales_of_a_roster(spark, tmp_path):
    digests = {"u1": scale(tmp_path, "u1", '{"marginal": 1.0, "tail": 2.0}'), "u2": scale(tmp_path, "u2", '{"marginal": 1.0, "joint": 0.5, "tail": 2.0}')}
    files = roster.read_scale_files(spark, str(tmp_path))
    assert {r.unit: r.digest for r in files.collect()} == digests
    want = commitment(spark.createDataFrame(list(digests.items()), "unit string, digest string")).first().digest
    units = [unit("u1", ("X",), (3,)), unit("u2")]
    plan = roster.read_plan(spark, put(tmp_path, units, mode="ref_scale", ref_scale_commitment=want))
    assert sorted(tuple(r) for r in roster.verified_scales(plan, files).select("unit", "marginal", "tail").collect()) == [("u1", 1.0, 2.0), ("u2", 1.0, 2.0)]
    for change in ({"mode": "raw_unrankable", "ref_scale_commitment": want}, {"mode": "ref_scale", "ref_scale_commitment": "x"}):
        with pytest.raises(OrganizerFault):
            roster.verified_scales(roster.read_plan(spark, put(tmp_path, units, **change)), files)
    scale(tmp_path, "u3", '{"marginal": -1, "tail": 2.0}')
    scale(tmp_path, "u4", "not json")
    more = roster.read_plan(spark, put(tmp_path, [*units, unit("u3"), unit("u4"), unit("u5")], mode="ref_scale", ref_scale_commitment=want))
    assert roster.scale_accounts(more.roster, roster.read_scale_files(spark, str(tmp_path))).first().asDict() == {"n_units": 5, "absent": 1, "unlisted": 0, "unreadable": 1, "bad_parts": 1}
    assert roster.scale_accounts(plan.roster, roster.read_scale_files(spark, str(tmp_path))).first().unlisted == 2


def test_rankability(spark):
    rows = spark.createDataFrame([("a", "ref_scale", "plan"), ("b", None, "card")], "unit string, mode string, grid_source string")
    assert roster.rankability(rows).first().asDict() == {"n_units": 2, "raw": 1, "by_card": 1, "rankable": False}
    roster.require_rankable(rows.where("unit = 'a'"))
    for bad in (rows, rows.limit(0)):
        with pytest.raises(OrganizerFault):
            roster.require_rankable(bad)


def test_context():
    card = {"targets": {"asset_ids": ["A"], "horizons": [1]}}
    assert roster.context(card, unit_folder="/u") == roster.Context(("A",), (1,), "card", "raw_unrankable", "/u/reference")
    assert roster.context(card, unit("u")).grid_source == "plan"
    for args in ((None,), (card, {"grid": None}), (card, unit("u", count=1)), (card, unit("u"), None, "raw_unrankable")):
        with pytest.raises(OrganizerFault):
            roster.context(*args)


def test_last_row_of_a_day_wins_whatever_the_partitions(spark, tmp_path):
    import datetime as dt

    import pandas as pd

    from quantloom.operators import panel

    pd.DataFrame({"asset": ["x"] * 6, "date": ["2020-01-01"] * 6, "value": [1.0, 5.0, 3.0, 9.0, 2.0, 4.0]}).to_parquet(tmp_path / "p.parquet")
    rows = panels.read_panels(spark, str(tmp_path))
    from pyspark.sql import functions as F

    for df in (rows, rows.repartition(5, "value")):
        assert panel.first_panel_series(df, F.lit(dt.date(2021, 1, 1))).first().value == 4.0
    assert panel.series_as_written(rows, F.lit(dt.date(2021, 1, 1))).count() == 6


def test_corpus_names_are_paths_and_folders_expand(spark, tmp_path):
    for at, text in (("a", "one"), ("b", "two words")):
        (tmp_path / "texts" / at).mkdir(parents=True)
        (tmp_path / "texts" / at / "same.txt").write_text(text)
    (tmp_path / "i.json").write_text(json.dumps({"documents": [{"doc_id": "1", "file": "texts/a/same.txt"}, {"doc_id": "2", "file": "b/same.txt"}]}))
    texts = str(tmp_path / "texts")
    assert {r.doc_id: r.text for r in panels.read_corpus(spark, str(tmp_path / "i.json"), texts).collect()} == {"1": "one", "2": "two words"}
    assert {r.doc_id: r.text for r in panels.read_corpus(spark, str(tmp_path / "none.json"), texts).collect()} == {"a/same.txt": "one", "b/same.txt": "two words"}
    assert sorted(r.n_bytes for r in panels.text_targets(spark, texts, texts + "/a/same.txt").collect()) == [3, 9]
