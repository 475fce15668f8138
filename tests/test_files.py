import json
import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quantloom.operators import corpus
from quantloom.operators.declutter import Refused, clean, declutter
from quantloom.sources import bounded, deliver, panels
from quantloom.sources.bounded import Refusal

CARD = {"task": {"id": "u1"}, "forecast": {"asof": "2020-06-30"}, "targets": {"asset_ids": ["A", "B"], "horizons": [1, 5]}}


@pytest.fixture
def unit(spark, tmp_path):
    draws = spark.range(200).select(F.col("id").alias("draw"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("asset"))
    draws = draws.select("draw", "asset", F.explode(F.array(F.lit(1), F.lit(5))).alias("horizon")).withColumn("value", F.col("draw") * 0.1)
    deliver.write_deliverable(str(tmp_path / "out"), draws, "u1", "2020-06-30", ["A", "B"], [1, 5], 200, "level")
    return tmp_path / "out"


def test_a_good_deliverable_passes(spark, unit):
    assert bounded.check_deliverable(str(unit), CARD) == {"n_draws": 200, "cells": 4, "rows": 800}
    df = bounded.read_draws(spark, str(unit / "forecast.parquet"), 4, 200)
    assert df.count() == 800 and df.columns == ["draw", "asset", "horizon", "value"]
    assert pq.ParquetFile(unit / "forecast.parquet").metadata.row_group(0).column(0).compression == "ZSTD"


@pytest.mark.parametrize(
    "change, code",
    [
        (lambda u: (u / "extra.txt").write_text("x"), "file_set"),
        (lambda u: (u / "forecast_rationale.md").write_text(" \n\t"), "blank_rationale"),
        (lambda u: (u / "forecast_meta.json").write_text("[1]"), "bad_json"),
        (lambda u: (u / "forecast_meta.json").write_text(" " * 300_000), "oversize"),
        (lambda u: edit(u, n_draws=10), "schema"),
        (lambda u: edit(u, n_draws=True), "schema"),
        (lambda u: edit(u, asof="2020-07-01"), "binding"),
        (lambda u: edit(u, horizons=[5, 1]), "grid"),
        (lambda u: edit(u, asset_ids=["A", "A"]), "grid"),
        (lambda u: edit(u, n_draws=201), "row_count"),
        (lambda u: (os.rename(u / "forecast.parquet", u.parent / "f"), os.symlink(u.parent / "f", u / "forecast.parquet")), "irregular_file"),
        (lambda u: (u / "forecast.parquet").write_bytes(b"PAR1"), "bad_parquet"),
    ],
)
def test_one_edit_is_refused(unit, change, code):
    change(unit)
    with pytest.raises(Refusal) as e:
        bounded.check_deliverable(str(unit), CARD)
    assert e.value.code == code


def edit(unit, **fields):
    path = unit / "forecast_meta.json"
    path.write_text(json.dumps(json.loads(path.read_text()) | fields))


def test_footer_ceilings(tmp_path):
    path = str(tmp_path / "x.parquet")
    pq.write_table(pa.table({f"c{i}": [1, 2, 3] for i in range(9)}), path)
    with pytest.raises(Refusal, match="columns"):
        bounded.footer(path)
    pq.write_table(pa.table({"c": list(range(70))}), path, row_group_size=1)
    with pytest.raises(Refusal, match="row_groups"):
        bounded.footer(path)
    with pytest.raises(Refusal, match="rows"):
        bounded.footer(path, bounded.Limits(rows=5, row_groups=100))


def test_infinite_draws_are_not_written(spark, tmp_path):
    with pytest.raises(ValueError):
        deliver.write_draws(spark.createDataFrame([(0, "A", 1, float("inf"))], "draw int, asset string, horizon int, value double"), str(tmp_path / "f.parquet"))


def test_public_results_and_report(spark, tmp_path):
    mean = spark.createDataFrame([(2, 1, 2.5)], "n_units int, n_failed int, mean_score double")
    units = spark.createDataFrame([("a", None), ("b", "grid")], "unit string, code string")
    deliver.write_public(str(tmp_path), mean, units)
    assert json.loads((tmp_path / "scores.json").read_text())["mean_score"] == 2.5 and (tmp_path / "details.jsonl").read_text().count("\n") == 1
    deliver.write_report(units, str(tmp_path / "r"), ["unit"])
    deliver.write_units(spark.createDataFrame([("a", 1.0)], "unit string, value double"), str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).first().unit == "a"


def test_panels_of_a_folder(spark, tmp_path):
    pd.DataFrame({"asset_id": ["x", "y"], "date": ["2020-01-01", "2020-07-01T00:00:00"], "value": [1.0, float("nan")]}).to_parquet(tmp_path / "p_daily.parquet")
    rows = panels.read_panels(spark, str(tmp_path / "none"), str(tmp_path)).orderBy("asset").collect()
    assert [(r.panel_id, r.asset, r.value) for r in rows] == [("p_daily", "x", 1.0), ("p_daily", "y", None)]
    assert panels.as_of_panels(spark, str(tmp_path), "2020-06-30").count() == 1
    with pytest.raises(FileNotFoundError):
        panels.read_panels(spark, str(tmp_path / "none"))
    wide = spark.createDataFrame([("2020-01-01", 1.0, None)], "date string, a double, b double")
    assert [tuple(r) for r in panels.long_form(wide, ["date"], {"a": "A"}).collect()] == [("2020-01-01", "A", 1.0)]


def test_corpus_of_a_folder(spark, tmp_path):
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "a.txt").write_text("one\ntwo")
    (tmp_path / "i.json").write_text(json.dumps({"card_id": "c", "documents": [{"doc_id": "1", "timestamp": "2020-01-01", "file": "a.txt"}, {"doc_id": "2", "path": "text/b.txt"}]}))
    got = panels.read_corpus(spark, str(tmp_path / "i.json"), str(tmp_path / "text")).orderBy("doc_id").collect()
    assert got[0].text == "one\ntwo" and got[1].text is None and got[1].file == "text/b.txt"


def test_manifest(tmp_path):
    import hashlib

    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("y")
    entries = [{"path": "a", "sha256": hashlib.sha256(b"x").hexdigest()}, {"path": "c", "sha256": ""}]
    assert bounded.check_manifest(str(tmp_path), entries) == {"matching": 1, "differing": 0, "absent": 1, "unlisted": 1}


def test_card(tmp_path):
    (tmp_path / "card.toml").write_text('[task]\nid = "u"\n[provenance]\ndata_cutoff = "2020-01-02"\n[targets]\nasset_ids = ["A"]\nhorizons = [1]\n')
    card = bounded.read_card(str(tmp_path / "card.toml"))
    assert bounded.as_of(card) == "2020-01-02" and bounded.grid_of(card) == (("A",), (1,))
    with pytest.raises(ValueError):
        bounded.grid_of({"targets": {"assets": ["A"], "horizons": [True]}})


PROSE = "The committee judged that activity had continued to expand at a moderate pace over the period.\n"


def test_untouched_text_is_the_same_bytes():
    text = "a\r\n" + PROSE
    assert clean(text, "x.txt") == (text, [], [])


def test_separators_footer_and_dateline():
    page = PROSE * 20 + "Back to top\n\n" + PROSE * 40 + "Return to top\nJune 3, 2020\nHome | About\nFreedom of Information\n"
    out, fired, _ = clean(page, "x.txt")
    assert fired == ["footer(dateline kept)", "separators(-1)"] and out.endswith("June 3, 2020\n") and "Freedom" not in out
    assert clean(out, "x.txt")[0] == out


def test_navigation_cut_and_front_matter():
    page = "Skip to Content\nmenu\n" + "Beige Book - June 3, 2020\nPDF\n\nNational Summary text\nOverall Economic Activity\n" + PROSE * 40 + "\nLast Modified Date: June 3, 2020\nfoot\n"
    out, fired, _ = clean(page, "x.txt")
    assert fired[0] == "nav-head(beige-book)" and "PDF" not in out and "menu" not in out and "foot\n" not in out


def test_guards():
    with pytest.raises(Refused):
        clean("Skip to Content\nTHE EMPLOYMENT SITUATION\n" + PROSE * 40 + "Connect With BLS\nOverall Economic Activity\n" + PROSE, "x.txt")
    with pytest.raises(Refused):
        clean("﻿" + PROSE * 10 + "﻿short page\n", "x.txt")


def test_reissue_notes():
    text = "(NOTE: This release was reissued on Friday, June 5, 2020 to correct (some) tables.)\n\n" + PROSE + "1 The table was reissued on June 6, 2020.\n" + PROSE
    out, fired, notes = clean(text, "cpi_2020-06-03.txt")
    assert fired == ["reissue-notes(-1)", "reissue-footnotes(-1)"] and len(notes) == 2 and out == PROSE + PROSE
    assert clean(text, "cpi_2020-07-03.txt")[1] == [] and clean(text, "other.txt")[1] == []


def test_declutter_states(spark):
    rows = [("a.txt", None, 1), ("b.txt", PROSE, 1), (None, PROSE + "Back to top\n" + PROSE, 1), ("c.txt", "", 1)]
    got = declutter(spark.createDataFrame(rows, "file string, body_text string, status int"))
    assert sorted((str(r.file), r.status) for r in got.collect()) == [("None", "cleaned"), ("a.txt", "null"), ("b.txt", "unchanged"), ("c.txt", "unchanged")]


def test_admission_ties_blanks_and_copies(spark):
    import datetime as dt

    d = dt.date(2020, 1, 1)
    rows = [("u", 1, "Same  text", d), ("u", 2, "same text ", d), ("u", 3, " \n", d), ("u", 4, None, d), ("u", 5, "late", dt.date(2020, 2, 1)), ("u", 6, "undated", None), ("u", 7, "other", d)]
    docs = spark.createDataFrame(rows, "unit string, doc_id long, text string, stamp date")
    cut = spark.createDataFrame([("u", dt.date(2020, 1, 15))], "unit string, asof date")
    assert [(r.doc_id, r["rank"]) for r in corpus.admissible(docs, cut).orderBy("rank").collect()] == [(7, 1), (2, 2)]
    r = corpus.reading_list(docs, cut, keep=2).first()
    assert (r.n_undated, r.n_late, r.n_blank, r.n_over_budget, r.n_read) == (1, 1, 2, 1, 2)


def test_reply_parsing(spark):
    replies = [("u", 'so: {"assets": {"A": {"drift_bp": 5, "per_horizon": {"21": {"skew": 0.1}}}}} done'), ("v", "no object"), ("w", "}{"), ("x", None)]
    got = corpus.adjustments(spark.createDataFrame(replies, "unit string, content string")).collect()
    assert sorted((r.unit, r.asset, r.horizon or 0, r.drift_bp, r.skew) for r in got) == [("u", "A", 0, 5.0, None), ("u", "A", 21, None, 0.1)]


def test_stream_of_events(spark, tmp_path):
    from quantloom.streaming.late import daily_means, late_counts

    src = "ts timestamp, event_type string, value double"
    spark.createDataFrame([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 11:00:00", "a", 3.0), ("2024-01-09 00:00:00", "b", None)], "ts string, event_type string, value double").select(
        F.col("ts").cast("timestamp"), "event_type", "value"
    ).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src).parquet(str(tmp_path / "in"))
    q = daily_means(stream).writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.asset, r.n, r["mean"]) for r in spark.table("means").collect()} == {("a", 2, 2.0), ("b", 1, None)}
    assert late_counts(spark.read.parquet(str(tmp_path / "in")), "2024-01-05").first().n_late == 1


def test_core_does_not_import_llm():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "quantloom")
    for at, _, files in os.walk(root):
        if os.path.basename(at) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "quantloom.llm" not in open(os.path.join(at, f)).read(), f
