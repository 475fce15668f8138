import numpy as np
import pytest

from quantloom.llm import lines
from quantloom.llm.template import furniture_lines, main_body

FILES = "file string, body_text string, source string, host string"
INDEX = "file string, source string, body_text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda sigma".split()


def sites(spark, n_sites=6, n_pages=12):
    """Pages with a head, sections, a teaser block, a foot, and recurring notes among their own paragraphs."""
    draw, files, index, want = np.random.default_rng(1), [], [], set()

    def own():
        return " ".join(draw.choice(WORDS, 14)) + f" {draw.choice(WORDS)}{chr(97 + draw.integers(26))}{chr(97 + draw.integers(26))}{chr(97 + draw.integers(26))}."

    for s in range(n_sites):
        name = "site" + chr(97 + s) * 3
        teasers = [own()[:-1] for _ in range(5)]
        for p in range(n_pages):
            lines = [(x, True) for x in ("Skip to content", "* Menu", "Home | News | Data portal", "About us")]
            lines.append((f"Home > News > May 20{p:02d}", True))
            lines += [(own()[:-1], False), (f"By the press desk of {name} bank", False), (own(), False)]
            if draw.random() < 0.7:
                lines += [("Related content", True), *((t, True) for t in draw.choice(teasers, 3, replace=False))]
            lines += [(own(), False), ("All figures are seasonally adjusted.", False), (own(), False), ("", False)]
            lines += [(f"Last updated: {p}/2020", True), (f"  © 20{p:02d} {name} bank\t", True), ("Privacy", True)]
            file = f"{name}_{p}.txt"
            files.append((file, "\n".join(x for x, _ in lines), "clash", "clash"))
            index.append((file, f" {name.upper()} bank (press)" if p % 3 else None, "clash"))
            want |= {(file, i + 1) for i, (_, f) in enumerate(lines) if f}
    files.append((files[0][0].replace("_0", "_copy"), files[0][1], None, None))
    want |= {(files[-1][0], n) for f, n in list(want) if f == files[0][0]}
    return spark.createDataFrame(files, FILES), spark.createDataFrame(index, INDEX), want


@pytest.mark.parametrize("most", ["10485760", "-1"])
def test_furniture_of_sites(spark, monkeypatch, most):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", int(most))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    files, index, want = sites(spark)
    got = {(r.file, r.line_no) for r in furniture_lines(files, index).collect()}
    hit = len(got & want)
    assert hit / len(got) > 0.97 and hit / len(want) > 0.93
    body = main_body(files, index).where("file = 'siteaaa_1.txt'").first()
    assert "press desk" in body.body_text and "Skip to content" not in body.body_text and body.n_removed > 6


def test_nulls_empty_and_repeated(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    files = spark.createDataFrame([("a_1", None, "", ""), (None, "x", "", ""), ("a_2", "", "", ""), ("a_3", "one line", "", ""), ("a_3", "one line", "", "")], FILES)
    index = spark.createDataFrame([("a_1", "A", "")], INDEX)
    assert furniture_lines(files, index).count() == 0
    assert main_body(files, index).count() == 5
    assert furniture_lines(files.limit(0), index.limit(0)).count() == 0


def test_subtrees_that_recur_on_nearly_all_pages(spark):
    """A line alone in the text, a block of two, a long section path; and a byline and notes on fewer pages, which stay."""
    draw, files, want = np.random.default_rng(3), [], set()
    own = lambda: " ".join(draw.choice(WORDS, 12)) + " " + "".join(chr(97 + x) for x in draw.integers(0, 26, 6)) + "."
    path = "Home > " + " > ".join(["News"] * 3) + " > "
    for p in range(60):
        lines = [(path + " ".join(draw.choice(WORDS, 80)), True)] if p % 2 else []
        lines += [(own(), False), *([("By the press desk", False)] if p % 2 else []), (own(), False), ("Share this article with a friend", True), (own(), False), ("", False)]
        lines += [("We value your privacy", True), ("Accept all cookies", True), ("", False)] if p % 3 else [("", False)]
        lines += [(own(), False), ("This site uses cookies to work", True), (own(), False), *([("Figures are rounded", False)] if p % 3 == 0 else []), (own(), False)]
        lines += [("* * *", False), ("Home", True), ("--- 1 2 3 ---", True), ("News", True), ("© 2020", True)]
        files.append((f"f{p}.txt", "\n".join(x for x, _ in lines), "", ""))
        want |= {(f"f{p}.txt", i + 1) for i, (x, f) in enumerate(lines) if f and x}
    index = [(f, "one site (press)", "") for f, *_ in files] + [("f0.txt", None, "")]
    got = {(r.file, r.line_no) for r in furniture_lines(spark.createDataFrame(files, FILES), spark.createDataFrame(index, INDEX)).collect()}
    text = {(f, i + 1): x for f, t, *_ in files for i, x in enumerate(t.split("\n"))}
    assert not {text[k] for k in want - got} and not {text[k] for k in got - want}


def test_a_files_own_source_is_its_host(spark):
    from quantloom.llm.template import _hosts

    files = spark.createDataFrame([("a_1", "x", "", ""), ("a_2", "x", "", ""), ("a_3", "x", "", ""), ("b_1", "x", "", "")], FILES)
    index = spark.createDataFrame([("a_1", "First (desk)", ""), ("a_2", "Second", "")], INDEX)
    assert {r.file: r.host for r in _hosts(files, index).collect()} == {"a_1": "first", "a_2": "second", "a_3": "second", "b_1": "b"}
