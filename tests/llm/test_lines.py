from collections import defaultdict

import numpy as np
import pytest

from quantloom.llm import lines as module
from quantloom.llm.linegraph import boilerplate_blocks, connected_components, repeated_lines, without_repeated_lines

FILES = "file string, body_text string, node string"
INDEX = "file string, source string, line_no int"


def brute(files, index, least=6):
    source = {f: s.strip().lower() for f, s, _ in index if s is not None}
    key = lambda x: "".join(c for c in x.casefold() if c.isalpha())
    where, places = defaultdict(set), []
    for f, t, _ in files:
        for i, x in enumerate((t or "").split("\n"), 1):
            if f in source and t is not None and len(key(x)) >= 12:
                where[source[f], key(x)].add(f)
                places.append((f, i, key(x)))
    return sorted({(f, i) for f, i, k in places if len(where[source[f], k]) >= least})


def make():
    draw = np.random.default_rng(0)
    pool = ["Alle Rechte vorbehalten – Straße", "ALLE RECHTE VORBEHALTEN STRASSE", "Share this page with a colleague", "share  this page (4) with a colleague.", "Back to top", "Short one", "Mentions légales du site"]
    files, index = [], []
    for i in range(40):
        lines = [str(x) for x in draw.choice(pool, 4)] + [f"unique line number {chr(97 + i % 26)}{chr(97 + i // 26)} of this file", ""]
        files.append((f"f{i}", "\r\n".join(lines), "clash"))
        index += [(f"f{i}", f" Source {'A' if i % 3 else 'b'}".upper() if i % 2 else f"source {'a' if i % 3 else 'B'} ", 0), (f"f{i}", None, 0)][: 1 + i % 2]
    return [*files, ("null", None, "x"), ("alone", pool[2], "x")], [*index, ("gone", "source a", 0), ("none", None, 0)]


@pytest.mark.parametrize("most", ["10485760", "-1"])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(module, "BROADCAST_BYTES", int(most))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    files, index = make()
    got = repeated_lines(spark.createDataFrame(files, FILES), spark.createDataFrame(index, INDEX))
    assert sorted((r.file, r.line_no) for r in got.collect()) == brute(files, index)


def test_copies_of_a_file_are_one_file(spark):
    files = [(f"f{i}", "the same long line of text", "") for i in range(5)]
    index = [(f"f{i}", "s", 0) for i in range(5)]
    df = spark.createDataFrame(files * 3, FILES)
    assert repeated_lines(df, spark.createDataFrame(index, INDEX)).count() == 0
    assert repeated_lines(df, spark.createDataFrame(index, INDEX), min_files=5).count() == 15


def test_lines_that_follow_each_other_are_a_block(spark):
    block = ["first boilerplate line", "second boilerplate line", "third boilerplate line"]
    files = [(f"f{i}", "\n".join([f"own text of number {chr(97 + i)} here", *block, f"more own text {chr(97 + i)} here", "a line that stands alone"]), "") for i in range(8)]
    index = [(f"f{i}", "s", 0) for i in range(8)]
    fs, ix = spark.createDataFrame(files, FILES), spark.createDataFrame(index, INDEX)
    got = repeated_lines(fs, ix).where("file = 'f0'").orderBy("line_no").collect()
    assert [r.line_no for r in got] == [2, 3, 4, 6] and len({r.block for r in got[:3]}) == 1 and got[3].block != got[0].block
    blocks = boilerplate_blocks(fs, ix).groupBy("block").count().collect()
    assert sorted(r["count"] for r in blocks) == [1, 3] and {r.block for r in blocks} == {r.block for r in got}
    clean = without_repeated_lines(fs, ix).where("file = 'f0'").first()
    assert clean.body_text == "own text of number a here\nmore own text a here" and clean.n_removed == 4


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(299) if i != 120] + [(7, 3)], "x long, y long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    got = {r.node: r.block for r in connected_components(edges).collect()}
    assert got == {i: 0 if i <= 120 else 121 for i in range(300)}


def test_empty(spark):
    assert repeated_lines(spark.createDataFrame([], FILES), spark.createDataFrame([], INDEX)).count() == 0
