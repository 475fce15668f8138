import numpy as np

from quantloom.llm import leak
from quantloom.llm.leak import leaked_passages, without_passages, words_of

DOCS = "doc_id long, text string, item_id long, words string"
ITEMS = "item_id long, item_text string, doc_id long"


def brute(docs, items, n=13):
    out = set()
    for i, t, _, _ in docs:
        if t is None or i is None:
            continue
        w = words_of(t)
        for j, x, _ in items:
            g = words_of(x or "")
            size = min(n, len(g))
            grams = {tuple(g[k : k + size]) for k in range(len(g) - size + 1)} if size else set()
            if any(tuple(w[k : k + size]) in grams for k in range(len(w) - size + 1)):
                out.add((i, j))
    return sorted(out)


def make():
    draw = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(draw.choice(vocabulary, n))
    items = [(j, text(int(draw.integers(1, 40))), 0) for j in range(30)] + [(90, "", 0), (91, None, 0), (92, "ÄÖÜ !", 0), (5, "w1 w2 w3", 0)]
    docs = []
    for i in range(120):
        t = text(int(draw.integers(0, 60)))
        if i % 3 == 0:
            g = items[int(draw.integers(0, 30))][1].split()
            a = int(draw.integers(0, max(1, len(g) - 5)))
            t += " … " + ", ".join(g[a : a + int(draw.integers(10, 20))]).upper() + "! " + text(5)
        docs.append((i, t, 0, "x"))
    return [*docs, (500, None, 0, ""), (501, "", 0, ""), (None, docs[0][1], 0, "")], items


def test_against_brute_force(spark):
    docs, items = make()
    got = leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).select("doc_id", "item_id")
    assert sorted(map(tuple, got.collect())) == brute(docs, items)


def test_a_set_too_large_to_be_sent_gives_the_same(spark, rows, monkeypatch):
    docs, items = make()
    args = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    sent = rows(leaked_passages(*args))
    monkeypatch.setattr(leak, "BROADCAST_WORDS", 10)
    for bits in (28, 8):  # a filter that nearly all windows pass changes nothing
        monkeypatch.setattr(leak, "FILTER_BITS", bits)
        assert rows(leaked_passages(*args)) == sent


def test_ten_megabytes_of_items(spark):
    draw = np.random.default_rng(6)
    vocabulary = np.array([f"v{k:x}" for k in range(30_000)])
    items = [(j, " ".join(vocabulary[draw.integers(0, 30_000, 2000)])) for j in range(1000)]
    assert sum(len(t) for _, t in items) > 9_000_000
    docs = [(i, f"{i} own words " + " ".join(items[7 * i][1].split()[100 : 111 + i % 4]) + " end") for i in range(100)]
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    found = leaked_passages(docs_df, items_df).select("doc_id", "item_id", "first_word", "end_word", "n_windows").collect()
    assert sorted(map(tuple, found)) == [(i, 7 * i, 3, 14 + i % 4, i % 4 - 1) for i in range(100) if i % 4 >= 2]
    clean = {r.doc_id: r for r in without_passages(docs_df, items_df).collect()}
    assert all(clean[i].text == (f"{i} own words  end" if i % 4 >= 2 else docs[i][1]) for i in range(100))


def test_windows_do_not_cross_documents(spark):
    item = " ".join(f"x{k}" for k in range(13))
    halves = item.split()
    docs = spark.createDataFrame([(1, " ".join(halves[:7]), 0, ""), (2, " ".join(halves[7:]), 0, ""), (3, "pre " + item + " post", 0, ""), (3, "pre " + item + " post", 0, "")], DOCS).coalesce(1)
    items = spark.createDataFrame([(1, item, 0)], ITEMS)
    got = leaked_passages(docs, items).collect()
    assert [(r.doc_id, r.first_word, r.end_word, r.n_windows) for r in got] == [(3, 1, 14, 1)]
    clean = {r.doc_id: r.text for r in without_passages(docs, items).collect()}
    assert clean[3] == "pre  post" and clean[1] == " ".join(halves[:7])


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a b", 0)], ITEMS)
    assert leaked_passages(none, items).count() == 0
    assert leaked_passages(spark.createDataFrame([(1, "a b", 0, "")], DOCS), items.limit(0)).count() == 0


def test_cutting_with_a_set_too_large_to_be_sent(spark, rows, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(words[20 * i : 20 * i + 20])) for i in range(8)]
    texts = ["start " + " ".join(words[10:75]) + " end", "nothing", None, " ".join(words[20:40]) + " İ kept " + " ".join(words[100:120])]
    docs = spark.createDataFrame([(i % 3 if i else None, t) for i, t in enumerate(texts + texts)], "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, item_text string")
    one = rows(without_passages(docs, it))
    assert sum(r[2] for r in one) > 0
    monkeypatch.setattr(leak, "BROADCAST_WORDS", 10)
    assert rows(without_passages(docs, it)) == one
    monkeypatch.undo()
    assert rows(without_passages(docs, it.limit(0))) == sorted(((i % 3 if i else None, t, 0) for i, t in enumerate(texts + texts)), key=repr)
