"""Site template removal: the main body of pages without the furniture of their sites.

A page is a tree: the page, its blocks between blank lines, their lines, and the
labels of a line that separators divide. Every subtree is hashed and counted per
host. Subtrees that recur on most pages of a host are deleted: blocks from half
of the pages on, single lines from nine tenths on, section paths label by label.
A line that recurs on fewer pages may be furniture or a byline, dateline, heading
or note: it is deleted where its occurrences hang on other template lines or on
the edge of the page, and kept where it stands among the page's own text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.lines import at_hand, file_sources, letters
from quantloom.session import written


@dataclass(frozen=True)
class TemplateRules:
    """Shares of a host's pages and attachments from which on a subtree is template. The shares hold for hosts of
    ``host_pages`` pages or more; the attachments were set on a tenth of the test pages, by inspection."""

    #: Share of the pages of a host from which on a line, or a block of two lines or more, is deleted whatever stands around it.
    line_share: float = 0.9
    block_share: float = 0.5
    host_pages: int = 30
    #: Least attachment to the template, from 0 (always among the page's own text) to 1 (always among template).
    attached: float = 0.35
    #: The same for lines that only one host has and that end as a sentence does: links and buttons seldom do.
    attached_sentence: float = 0.6
    rounds: int = 3
    #: Weight, in occurrences, of what other hosts' pages say about the same line.
    prior: int = 30
    #: Hosts from which on a line is known in a host too small to show recurrence, of fewer than ``host_pages`` pages.
    known_hosts: int = 5
    #: Pages of a host in which a label must occur to count as one of its sections.
    label_pages: int = 2


_EDGE = 1  # the key of the page's edge
_SEPARATOR = r"\s[>»/|·›→]\s"
_LABEL, _FIRST_LABEL = r"^[^>»/|·›→]*\p{L}[^>»/|·›→]*$", r"^[^\p{L}]*\p{L}[^>»/|·›→]*$"


def _joined(rows: DataFrame, key: str, side: DataFrame, *spread: str) -> DataFrame:
    """rows with the columns of ``side`` (key, ...) where their key has any. Keys 0 and 1, no letters and the page's edge, are
    in no side; as they are in many rows, a hash of the columns ``spread`` takes their place in the join."""
    at = F.when(F.col(key).isin(0, _EDGE), F.xxhash64(*spread, F.lit(key))).otherwise(F.col(key))
    return rows.withColumn("_at", at).join(side.withColumnRenamed(key, "_at"), "_at", "left").drop("_at")


def _hosts(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files (file, host, site, text). The host is the file's own source without a bracketed section; of a file without a
    source that of files whose names begin with the same word; else that word. site is the host in letters."""
    prefix = F.substring_index("file", "_", 1)
    own = file_sources(index).where("source is not null").select("file", F.regexp_replace("source", r"\s*\([^)]*\)\s*$", "").alias("own"))
    own = written(own)
    near = written(own.groupBy(prefix.alias("prefix")).agg(F.max("own").alias("near")))
    pages = files.where("file is not null").select("file", F.col("body_text").alias("text"), prefix.alias("prefix"))
    pages = pages.join(at_hand(own), "file", "left").join(at_hand(near), "prefix", "left")
    host = F.coalesce("own", "near", "prefix")
    return pages.select("file", "text", F.lower(host).alias("host"), letters(host).alias("site"))


def _elements(pages: DataFrame) -> DataFrame:
    """Pages (file, host, page, elements, blocks, labels). elements: the visible lines in order as structs of number, key in
    its host (0 without letters), key with the host's name masked, and whether a full stop ends it. blocks: the
    runs of two lines with letters or more, as structs of the lines without letters before the run and its key. labels:
    the number of each line divided by separators with the keys of its parts. page: a hash of the letters of all
    lines, equal for copies of a page."""
    word = letters(F.substring_index("host", " ", 1))
    visible = lambda x: (x["k"] != "") | x["line"].rlike(r"[^\s\p{Z}\p{Cf}]")
    every = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line"), letters(x).alias("k")))
    rows = pages.where("text is not null").withColumn("every", every).withColumn("word", word)
    rows = rows.withColumn("lines", F.filter("every", visible))

    def element(x: Column) -> Column:
        masked = F.replace(F.replace(x["k"], F.col("site"), F.lit("@")), F.col("word"), F.lit("@"))
        return F.struct(
            x["no"].cast("bigint").alias("no"),
            F.when(x["k"] == "", F.lit(0)).otherwise(F.xxhash64("host", x["k"])).cast("bigint").alias("k"),
            F.xxhash64(masked).alias("g"),
            x["line"].rlike(r"[.!?…]\W*$").alias("stop"),
        )

    parted = F.filter("lines", lambda x: x["line"].rlike(_SEPARATOR))
    parts = F.transform(parted, lambda x: F.struct(x["no"].alias("no"), F.split(x["line"], _SEPARATOR).alias("parts")))
    divided = F.filter(parts, lambda x: F.element_at(x["parts"], 1).rlike(_FIRST_LABEL) & F.forall(F.slice(x["parts"], 2, F.size(x["parts"])), lambda p: p.rlike(_LABEL)))
    labels = F.transform(divided, lambda x: F.struct(x["no"].cast("bigint").alias("no"), F.transform(x["parts"], lambda s: F.xxhash64("host", letters(s))).alias("parts")))
    keys = F.split(F.regexp_replace(F.array_join(F.transform("every", lambda x: x["k"]), "\n"), r"^\n+|\n+$", ""), r"\n{2,}", -1)
    blocks = F.filter(F.arrays_zip(_block_numbers("lines", "").alias("block"), keys.alias("keys")), lambda x: F.contains(x["keys"], F.lit("\n")))
    blocks = F.transform(blocks, lambda x: F.struct(x["block"].alias("block"), F.xxhash64("host", x["keys"]).alias("h")))
    whole = F.xxhash64(F.transform("lines", lambda x: x["k"]))
    return rows.select("file", "host", whole.alias("page"), F.transform("lines", element).alias("elements"), blocks.alias("blocks"), labels.alias("labels"))


def _numbered(lines: str, none: object) -> Column:
    """The lines with letters as structs of number and block: the lines without letters before them, one number a run."""
    return F.transform(F.filter(lines, lambda x: x["k"] != none), lambda x, i: F.struct(x["no"].alias("no"), (x["no"] - i).cast("bigint").alias("block")))


def _block_numbers(lines: str, none: object) -> Column:
    return F.array_distinct(F.transform(_numbered(lines, none), lambda x: x["block"]))


def _sizes(pages: DataFrame) -> DataFrame:
    """Hosts with the number of their files and of their different pages."""
    each = pages.groupBy("host", "page").agg(F.count("*").alias("n"))
    return each.groupBy("host").agg(F.sum("n").alias("n_files"), F.count("*").alias("n_host"))


def _recurring_blocks(pages: DataFrame, rules: TemplateRules) -> DataFrame:
    """Lines (file, line_no) of the blocks of two lines or more that recur on ``block_share`` of their host's pages."""
    blocks = pages.select("file", "host", "page", F.explode("blocks").alias("b")).select("file", "host", "page", "b.*")
    counts = blocks.select("host", "page", "h").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where("n > 1")
    sizes = _sizes(pages).where(F.col("n_host") >= rules.host_pages)
    most = written(counts.join(sizes, "host").where(F.col("n") >= rules.block_share * F.col("n_host")).select("h"))
    found = blocks.join(at_hand(most), "h", "left_semi").groupBy("file").agg(F.collect_set("block").alias("found"))
    lines = pages.join(at_hand(written(found)), "file").select("file", "found", F.explode(_numbered("elements", 0)).alias("x"))
    return lines.where(F.array_contains("found", F.col("x.block"))).select("file", F.col("x.no").alias("line_no"))


def _recurring(pages: DataFrame) -> DataFrame:
    """Elements (k, g, share t of the host's pages, pages n_host of the host) on two or more different pages of their host."""
    sizes = _sizes(pages)  # copies of a page count on both sides of a share
    once = pages.select("host", "page", F.explode(F.array_distinct(F.transform("elements", lambda x: F.struct(x["k"].alias("k"), x["g"].alias("g"))))).alias("e"))
    counts = once.where("e.k != 0").groupBy("e.k").agg(F.min("e.g").alias("g"), F.count("*").alias("n"), F.min("page").alias("p"), F.max("page").alias("q"), F.min(F.xxhash64("host")).alias("h"))
    counts = counts.where("p != q")
    return counts.join(sizes.select(F.xxhash64("host").alias("h"), "n_files", "n_host"), "h").select("k", "g", F.least(F.col("n") / F.col("n_files"), F.lit(1.0)).alias("t"), "n_host")


def _contexts(pages: DataFrame, recurring: DataFrame) -> DataFrame:
    """Counts c of (k, before, after): a recurring element and the keys of the visible lines on either side, be they recurring or not."""
    size = F.size("elements")

    def at(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(_EDGE).cast("bigint")).otherwise(F.get("elements", i - 1)["k"])
        after = F.when(i == size - 1, F.lit(_EDGE).cast("bigint")).otherwise(F.get("elements", i + 1)["k"])
        return F.struct(x["k"].alias("k"), before.alias("before"), after.alias("after"))

    rows = pages.select(F.explode(F.transform("elements", at)).alias("e")).select("e.*").where("k != 0")
    rows = rows.join(at_hand(recurring.select("k")), "k", "left_semi")
    return rows.groupBy("k", "before", "after").agg(F.count("*").alias("c"))


def _attachment(contexts: DataFrame, recurring: DataFrame, rules: TemplateRules) -> tuple[DataFrame, DataFrame]:
    """(t by k, t by g): an element's attachment is the mean, over its occurrences, of the larger attachment of its two
    neighbours; the page's edge has 1, a line of the page's own 0. It starts as the share of pages and is drawn
    towards the mean of the same line at other hosts."""
    t = recurring
    for _ in range(rules.rounds):
        known = at_hand(t.select("k", "t"))
        rows = contexts
        for s, other in (("before", "after"), ("after", "before")):
            rows = _joined(rows, s, known.select(F.col("k").alias(s), F.col("t").alias(f"w_{s}")), "k", other)
            rows = rows.withColumn(f"w_{s}", F.when(F.col(s) == _EDGE, 1.0).otherwise(F.coalesce(f"w_{s}", F.lit(0.0))))
        own = rows.groupBy("k").agg(F.sum(F.col("c") * F.greatest("w_before", "w_after")).alias("x"), F.sum("c").alias("m"))
        own = written(own.join(at_hand(recurring.select("k", "g")), "k"))
        pooled = own.groupBy("g").agg((F.sum("x") / F.sum("m")).alias("mean"), F.sum("m").alias("n"), F.count("*").alias("hosts"))
        weight = F.least(F.col("n"), F.lit(rules.prior))
        t = written(own.join(at_hand(written(pooled)), "g").select("k", "g", ((F.col("x") + weight * F.col("mean")) / (F.col("m") + weight)).alias("t"), "hosts"))
    return t, pooled


def furniture_lines(files: DataFrame, index: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """Rows (file, line_no), one for each visible line of a page that is not main body.

    ``files`` (file, body_text), lines numbered from 1 over the text split at each line feed; ``index`` (file,
    source) names the hosts, and files without an entry belong to the host whose files begin with the same word.
    Elements are compared by their letters alone, so digits, case, bullets and spaces don't matter; copies of a page
    count as one page. Defined results: null texts and null files give nothing; blank lines never come out; a
    host's only page keeps all lines that other hosts don't have; repeated rows give repeated results; empty
    tables an empty result; other columns are ignored.

    A visible line without letters is deleted where the nearest lines with letters on either side are, or the one and
    the page's edge. Shuffled are 64-bit hashes, pre-aggregated per task, never texts. Tables of hashes are joined
    as Spark sees fit by their size in bytes: broadcast while small, else shuffled.
    """
    pages = written(_elements(_hosts(files, index)))
    recurring = written(_recurring(pages))
    contexts = written(_contexts(pages, recurring))
    t, pooled = _attachment(contexts, recurring, rules)
    often = recurring.where((F.col("t") >= rules.line_share) & (F.col("n_host") >= rules.host_pages)).select("k", F.lit(True).alias("often"))
    decided = written(t.join(often, "k", "left").select("k", "t", "hosts", F.coalesce("often", F.lit(False)).alias("often")))
    known = written(pooled.where((F.col("hosts") >= rules.known_hosts) & (F.col("mean") >= rules.attached)).select("g"))
    bar = F.when((F.col("hosts") < rules.known_hosts) & F.col("stop"), rules.attached_sentence).otherwise(rules.attached)
    rows = pages.select("file", F.explode("elements").alias("e")).select("file", "e.no", "e.k", "e.stop")
    whole = _joined(rows, "k", at_hand(decided), "file", "no").where((F.col("t") >= bar) | F.col("often")).select("file", F.col("no").alias("line_no"))
    small = _sizes(pages).where(F.col("n_host") < rules.host_pages).select("host")
    elsewhere = pages.join(small, "host", "left_semi").select("file", F.explode("elements").alias("e")).select("file", "e.no", "e.g")
    elsewhere = elsewhere.join(at_hand(known), "g", "left_semi").select("file", F.col("no").alias("line_no"))
    bare = _without_letters(pages, decided, rules)
    return whole.unionByName(elsewhere).unionByName(bare).unionByName(_recurring_blocks(pages, rules)).unionByName(_section_paths(pages, rules)).distinct()


def _without_letters(pages: DataFrame, decided: DataFrame, rules: TemplateRules) -> DataFrame:
    """Visible lines (file, line_no) without letters between template lines, or between one and the page's edge."""
    rows = pages.where(F.exists("elements", lambda x: x["k"] == 0)).withColumn("lettered", F.filter("elements", lambda x: x["k"] != 0))
    bare = rows.select("file", "lettered", F.explode(F.filter("elements", lambda x: x["k"] == 0)).alias("x"))
    before = F.try_element_at(F.filter("lettered", lambda y: y["no"] < F.col("x.no")), F.lit(-1))["k"]
    after = F.try_element_at(F.filter("lettered", lambda y: y["no"] > F.col("x.no")), F.lit(1))["k"]
    edge = F.lit(_EDGE).cast("bigint")
    places = bare.select("file", F.col("x.no").alias("line_no"), F.coalesce(before, edge).alias("before"), F.coalesce(after, edge).alias("after"))
    places = places.where(f"before != {_EDGE} or after != {_EDGE}")
    template = decided.where((F.col("t") >= rules.attached) | F.col("often")).select("k", F.lit(True).alias("is"))
    for side in ("before", "after"):
        places = _joined(places, side, template.select(F.col("k").alias(side), "is"), "file", "line_no").where(F.col("is") | (F.col(side) == _EDGE)).drop("is")
    return places.select("file", "line_no")


def _section_paths(pages: DataFrame, rules: TemplateRules) -> DataFrame:
    """Lines whose parts, but the last, are labels that recur in their host: the path of sections to the page."""
    paths = pages.select("file", "page", F.explode("labels").alias("l")).select("file", "page", "l.no", F.posexplode("l.parts").alias("i", "part"), F.size("l.parts").alias("n"))
    lines = pages.select("page", F.explode("elements").alias("e")).select(F.col("e.k").alias("part"), "page")
    parts = paths.select("part").distinct()
    places = paths.select("part", "page").unionByName(lines.join(at_hand(written(parts)), "part", "left_semi"))
    counts = places.distinct().groupBy("part").count().where(F.col("count") >= rules.label_pages).select("part")
    heads = paths.where("i < n - 1").join(at_hand(written(counts)).withColumn("label", F.lit(True)), "part", "left")
    full = heads.groupBy("file", "no").agg(F.every(F.coalesce("label", F.lit(False))).alias("all"))
    return full.where("all").select("file", F.col("no").alias("line_no"))


def main_body(files: DataFrame, index: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """Rows (file, body_text, n_removed): every page without the lines of :func:`furniture_lines`. Null texts stay null.

    The numbers of the lines to cut are a small table beside the texts; while it is small enough to be broadcast no
    text is shuffled, beyond that each text once, by file.
    """
    taken = written(furniture_lines(files, index, rules).groupBy("file").agg(F.collect_set("line_no").alias("taken")))
    kept = F.filter(F.split("body_text", "\n", -1), lambda line, i: ~F.array_contains("taken", (i + 1).cast("bigint")))
    rows = files.select("file", "body_text").join(at_hand(taken), "file", "left")
    return rows.select("file", F.when(F.col("taken").isNull(), F.col("body_text")).otherwise(F.array_join(kept, "\n")).alias("body_text"), F.coalesce(F.size("taken"), F.lit(0)).alias("n_removed"))
