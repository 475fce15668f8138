"""Lines repeated across the documents of one source.

A source's lines form a weighted graph: a node's weight is the number of the
source's files with the line, an edge's the number with one line right after
the other. Nodes and edges of high support are kept; the connected components
are the boilerplate blocks, and every occurrence of their lines is taken out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.lines import at_hand, file_sources, letters
from quantloom.session import written


def _hashed(files: DataFrame, index: DataFrame, min_letters: int) -> DataFrame:
    """Rows (file, nodes), the listed files with a source: for each line in order its node, NULL where it doesn't count.

    A node is a 64-bit hash of source and letters, so that two of n different lines share one with a chance of n^2
    in 2^65. Only hashes are joined, shuffled and written, never texts.
    """
    sources = written(file_sources(index).where("source is not null"))
    keys = F.transform(F.split("body_text", "\n", -1), letters)
    hashes = F.transform(keys, lambda k: F.when(F.length(k) >= min_letters, F.xxhash64(k)))
    rows = files.select("file", hashes.alias("hashes")).where("file is not null and hashes is not null").join(at_hand(sources), "file")
    return written(rows.select("file", F.transform("hashes", lambda h: F.when(h.isNotNull(), F.xxhash64("source", h))).alias("nodes")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, block): for each node of ``edges`` (x, y) the least node that it is connected to.

    Each round offers a node, and the node that it points to, the least grandparent among its neighbours, and then
    shortens every path by half (the FastSV scheme), so about log L rounds settle a chain of length L; they end when
    nothing changes. Each round is a table in the shared folder; no component is ever gathered in a task or on
    the driver. Offers are merged before they are shuffled, so a giant component's root gets one a task.
    """
    both = written(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x != y").distinct())
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("least")).select("node", F.least("node", "least").alias("block")))
    while True:
        over = labels.select(F.col("node").alias("at"), F.col("block").alias("grand"))
        known = labels.join(over, labels["block"] == over["at"]).select("node", "block", "grand")
        offers = both.join(known.select(F.col("node").alias("y"), F.col("grand").alias("offer")), "y").groupBy("x").agg(F.min("offer").alias("offer"))
        near = known.join(offers, known["node"] == offers["x"]).select("node", "block", F.least("grand", "offer").alias("offer"))
        hooks = near.groupBy(F.col("block").alias("root")).agg(F.min("offer").alias("hook"))
        after = near.join(hooks, near["node"] == hooks["root"], "left").select("node", F.col("block").alias("was"), F.least("block", "offer", "hook").alias("block"))
        after = written(after)
        labels = after.select("node", "block")
        if after.where("was != block").isEmpty():
            return labels


def boilerplate_blocks(files: DataFrame, index: DataFrame, min_files: int = 6, min_letters: int = 12) -> DataFrame:
    """Rows (block, node, n_files), a row for each line of a boilerplate block: the kept lines of a source, in blocks by the
    kept edges; a kept line without a kept edge is a block of its own. The block's name is its least node."""
    return _blocks(_hashed(files, index, min_letters), min_files)


def _blocks(rows: DataFrame, min_files: int) -> DataFrame:
    kept = written(_supports(rows, min_files))
    joined = connected_components(_edges(rows, kept, min_files))
    return written(kept.join(joined, "node", "left").select(F.coalesce("block", "node").alias("block"), "node", "n_files"))


def repeated_lines(files: DataFrame, index: DataFrame, min_files: int = 6, min_letters: int = 12) -> DataFrame:
    """Rows (file, line_no, node, block): every occurrence of the lines of :func:`boilerplate_blocks`, that is, every place
    of a line that stands in at least ``min_files`` different files of its source.

    Lines are the same if their letters are, ignoring case; those with fewer than ``min_letters`` letters don't count.
    ``files`` (file, body_text) with lines numbered from 1 over the text split at each line feed; ``index`` (file,
    source). Defined results: files without an index entry or without any source, null texts and null files
    give nothing; a file that occurs in several rows is one file; a line repeated within a file counts once but
    comes out at each of its places; empty tables give an empty result; other columns are ignored.

    Support is counted over all documents after map-side distinct counts, so a line found in a third of all
    files sends one partial count a task. Tables of nodes are joined as Spark sees fit by their size in bytes: broadcast
    while small, else shuffled, where AQE splits a hot node's rows.
    """
    rows = _hashed(files, index, min_letters)
    blocks = _blocks(rows, min_files)
    places = rows.select("file", F.posexplode("nodes").alias("i", "node")).where("node is not null")
    return places.join(at_hand(blocks), "node").select("file", (F.col("i") + 1).cast("bigint").alias("line_no"), "node", "block")


def _supports(rows: DataFrame, min_files: int) -> DataFrame:
    """Nodes (node, n_files) in at least ``min_files`` files. A line's places in one row are made one within the row; only
    where a file occurs in two rows must they be made one across rows."""
    once = rows.select("file", F.explode(F.array_distinct(F.array_compact("nodes"))).alias("node"))
    again = rows.groupBy("file").count().where("count > 1")
    once = once if again.isEmpty() else once.select("node", F.xxhash64("file")).distinct()
    return once.groupBy("node").agg(F.count("*").alias("n_files")).where(F.col("n_files") >= min_files)


def _edges(rows: DataFrame, kept: DataFrame, min_files: int) -> DataFrame:
    """Kept edges (x, y, n_files) between kept nodes: an edge's weight is the number of files in which one line that counts
    comes right after the other."""
    run = F.array_compact("nodes")
    pairs = F.zip_with(F.slice(run, 1, F.greatest(F.size(run) - 1, F.lit(0))), F.slice(run, 2, F.greatest(F.size(run) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    steps = rows.where(F.size(run) > 1).select("file", F.explode(F.array_distinct(pairs)).alias("e")).select("file", "e.*").where("x != y")
    for side in ("x", "y"):
        steps = steps.join(at_hand(kept.select(F.col("node").alias(side))), side, "left_semi")
    again = rows.groupBy("file").count().where("count > 1")
    steps = steps if again.isEmpty() else steps.distinct()
    return steps.groupBy("x", "y").agg(F.count("*").alias("n_files")).where(F.col("n_files") >= min_files)


def without_repeated_lines(files: DataFrame, index: DataFrame, **found) -> DataFrame:
    """Rows (file, body_text, n_removed): the texts of all files without the lines of :func:`repeated_lines`.

    Files without such lines come out as they are, null texts as null. The numbers of the lines to cut are a small table
    beside the texts; while it is small enough to be broadcast no text is shuffled, beyond that each text once, by file.
    """
    places = repeated_lines(files, index, **found)
    taken = written(places.groupBy("file").agg(F.collect_set("line_no").alias("taken")))
    kept = F.filter(F.split("body_text", "\n", -1), lambda line, i: ~F.array_contains("taken", (i + 1).cast("bigint")))
    rows = files.select("file", "body_text").join(at_hand(taken), "file", "left")
    return rows.select("file", F.when(F.col("taken").isNull(), F.col("body_text")).otherwise(F.array_join(kept, "\n")).alias("body_text"), F.coalesce(F.size("taken"), F.lit(0)).alias("n_removed"))
