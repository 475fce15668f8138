import numpy as np
import pytest

from quantloom.llm.mixture import TOKENIZER, mix, pivotal

DOCS = "doc_id long, text string, source string, tokens string, share int"
GOALS = "source string, target_share double, max_repeats int, tokens int"


def test_pivotal_keeps_tokens_and_expectations():
    draw = np.random.default_rng(0)
    tokens = draw.integers(5, 400, 40).astype(float)
    share = draw.uniform(0, 1, 40)
    mean = np.zeros(40)
    for k in range(3000):
        out, left = pivotal(share, tokens, np.random.default_rng(k))
        whole = np.delete(out, left) if left >= 0 else out
        assert set(np.unique(whole)) <= {0.0, 1.0}
        assert abs((out * tokens).sum() - (share * tokens).sum()) < 1e-6
        mean += out
    assert np.abs(mean / 3000 - share).max() < 0.05


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        source = "big" if i % 3 else "mid_Size" if i % 2 else " TINY " if i < 60 else "other"
        rows.append((i, " ".join(["word"] * int(draw.integers(1, 60))), source, "clash", 1))
    rows += [(9001, None, "big", "", 0), (9002, "", "big", "", 0), (9003, "text", None, "", 0), (None, "two words", "big", "", 0), (5, "repeated id", "big", "", 0)]
    goals = [("big", 0.5, 1, 0), ("mid-size", 0.3, 3, 0), ("tiny", 0.15, 2, 0), ("none", 0.05, 4, 0), (None, 0.1, 1, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(goals, GOALS)


@pytest.mark.parametrize("chunk, fan", [(20_000, 2_000), (50, 3)])
def test_shares_caps_and_tree(spark, data, chunk, fan):
    docs, goals = data
    copies, shares = mix(docs, goals, chunk_rows=chunk, fan_in=fan)
    got = {r.source: r for r in shares.collect()}
    cap = {"big": 1, "mid-size": 3, "tiny": 2, "none": 4}
    rows = copies.collect()
    assert all(1 <= r.copies <= cap[r.source] * r.n_rows for r in rows)
    assert {r.doc_id for r in rows}.isdisjoint({9001, 9002, 9003})
    total = sum(r.available_tokens for r in got.values())
    for name in ("big", "mid-size"):
        r = got[name]
        want = min(cap[name] * r.available_tokens, total * r.target_share)
        assert abs(r.tokens - want) <= 60
    assert got["tiny"].tokens == 2 * got["tiny"].available_tokens and got["none"].tokens == 0
    assert abs(sum(r.reached_share for r in got.values()) - 1) < 1e-9
    assert sum(r.tokens * r.copies for r in rows) == sum(r.tokens for r in got.values())
    again = {(r.doc_id, r.tokens): r.copies for r in mix(docs.repartition(7), goals, chunk_rows=chunk, fan_in=fan)[0].collect()}
    assert again == {(r.doc_id, r.tokens): r.copies for r in rows}


def test_a_given_total_and_empty_tables(spark, data):
    docs, goals = data
    shares = {r.source: r for r in mix(docs, goals, total_tokens=3000)[1].collect()}
    assert abs(shares["big"].tokens - 1500) <= 60 and abs(shares["tiny"].tokens - 450) <= 60
    copies, none = mix(docs.limit(0), goals)
    assert copies.count() == 0 and {r.tokens for r in none.collect()} == {0}
    assert TOKENIZER.endswith(".tiktoken")


def test_copies_of_one_document_are_counted_first(spark):
    docs = [(7, "the same words again", "a", "", 0)] * 400 + [(i, "other words here", "b", "", 0) for i in range(400)]
    goals = spark.createDataFrame([("a", 0.25, 1, 0), ("b", 0.75, 2, 0)], GOALS)
    rows = mix(spark.createDataFrame(docs, DOCS), goals, chunk_rows=50, fan_in=3)[0].collect()
    a = [r for r in rows if r.source == "a"]
    total = 400 * (a[0].tokens + [r for r in rows if r.source == "b"][0].tokens)
    assert len(a) == 1 and a[0].n_rows == 400 and abs(a[0].copies * a[0].tokens - total / 4) <= a[0].tokens
