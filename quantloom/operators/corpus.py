"""Dated documents: admission before a cutoff, coverage of an index, and the assembly of prompts.

documents: (unit, doc_id, text, stamp DATE). A null or blank text is never admitted, a null stamp is undated. Ties in
time are settled by doc_id. Windows are over one unit's documents; for units of unbounded size the selection is
made twice, the first time within salted parts, so that no part of a hot unit is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def strip_all(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def dedupe_key(text: Column, chars: int = 400) -> Column:
    """The first characters of a text in lower case with white space collapsed: the feature's own rule for equal documents."""
    return F.substring(F.regexp_replace(F.lower(strip_all(text)), r"\s+", " "), 1, chars)


def newest(rows: DataFrame, by: str, keep: int, order: list[Column], salts: int = 16) -> DataFrame:
    """The first ``keep`` rows of each group by ``order``, with their rank. Parts of a group are cut to ``keep`` rows first."""
    part = Window.partitionBy(by, "_salt").orderBy(*order)
    few = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).withColumn("_i", F.row_number().over(part)).where(F.col("_i") <= keep).drop("_i", "_salt")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= keep)


def admissible(documents: DataFrame, cutoffs: DataFrame, keep: int = 14) -> DataFrame:
    """(unit, doc_id, stamp, rank): each unit's newest documents dated at or before its cutoff (unit, asof), one for each
    :func:`dedupe_key`, newest first and by doc_id downwards."""
    rows = documents.join(cutoffs, "unit").where((F.col("stamp") <= F.col("asof")) & (F.length(strip_all(F.col("text"))) > 0))
    best = rows.groupBy("unit", F.xxhash64(dedupe_key(F.col("text"))).alias("k"), F.crc32(dedupe_key(F.col("text")).cast("binary")).alias("c")).agg(F.max(F.struct("stamp", "doc_id")).alias("m"))
    flat = best.select("unit", "m.stamp", "m.doc_id")
    return newest(flat, "unit", keep, [F.col("stamp").desc(), F.col("doc_id").desc()]).select("unit", "doc_id", "stamp", "rank")


def reading_list(documents: DataFrame, cutoffs: DataFrame, keep: int = 8, chars: int = 6000) -> DataFrame:
    """(unit, n_undated, n_late, n_blank, n_over_budget, n_read, n_chars): what of a unit's documents is read and why not the rest;
    of a document that is read, the first ``chars`` characters."""
    rows = documents.join(cutoffs, "unit").select(
        "unit", "doc_id", "stamp", F.length(F.substring("text", 1, chars)).alias("n"),
        F.when(F.col("stamp").isNull(), "undated").when(F.col("stamp") > F.col("asof"), "late").when(F.coalesce(F.length(strip_all(F.col("text"))), F.lit(0)) == 0, "blank").otherwise("fit").alias("state"),
    )
    counts = rows.groupBy("unit").agg(*(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("undated", "late", "blank", "fit")))
    read = newest(rows.where("state = 'fit'"), "unit", keep, [F.col("stamp").desc(), F.col("doc_id").desc()]).groupBy("unit").agg(F.count("*").alias("n_read"), F.sum("n").alias("n_chars"))
    both = counts.join(read, "unit", "left")
    n_read = F.coalesce("n_read", F.lit(0))
    return both.select("unit", "n_undated", "n_late", "n_blank", (F.col("n_fit") - n_read).alias("n_over_budget"), n_read.alias("n_read"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def coverage(index: DataFrame, files: DataFrame) -> DataFrame:
    """(n_indexed, n_files, n_absent, n_unindexed): files that the index names and that aren't there, and the other way round."""
    named = index.select("file").where("file is not null").distinct().withColumn("named", F.lit(True))
    there = files.select("file").where("file is not null").distinct().withColumn("there", F.lit(True))
    both = named.join(there, "file", "full_outer")
    return both.agg(
        F.count("named").alias("n_indexed"), F.count("there").alias("n_files"), F.count_if(F.col("there").isNull()).alias("n_absent"), F.count_if(F.col("named").isNull()).alias("n_unindexed")
    )


def canonical_path(path: Column) -> Column:
    """A relative path without empty, . or .. parts and without back slashes; NULL for any other."""
    bad = path.rlike(r"(^|/)(\.{0,2})(/|$)") | path.contains("\\") | (path == "")
    return F.when(~bad, path)


def prose_chars(text: Column, least: int = 60) -> Column:
    """Characters on lines of at least ``least`` characters once stripped."""
    sizes = F.transform(F.split(text, "\n", -1), lambda x: F.length(strip_all(x)))
    return F.aggregate(F.filter(sizes, lambda n: n >= least), F.lit(0), lambda a, n: a + n)


def unix_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def prompts(documents: DataFrame, selected: DataFrame, chars: int = 3500) -> DataFrame:
    """(unit, n_docs, prompt): the selected documents (unit, doc_id, rank) of a unit, in order, cut to ``chars`` each. A prompt
    holds few documents by the selection's limit."""
    rows = selected.join(documents.select("doc_id", "text"), "doc_id")
    piece = F.concat(F.lit("## "), F.col("doc_id").cast("string"), F.lit("\n"), F.substring("text", 1, chars))
    joined = rows.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("rank", piece.alias("p")))).alias("ps"))
    return joined.select("unit", F.size("ps").alias("n_docs"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n").alias("prompt"))


REPLY = "assets MAP<STRING, STRUCT<drift_bp: DOUBLE, vol_scale: DOUBLE, skew: DOUBLE, why: STRING, per_horizon: MAP<STRING, STRUCT<drift_bp: DOUBLE, vol_scale: DOUBLE, skew: DOUBLE>>>>, scenarios ARRAY<STRUCT<p: DOUBLE, vol: DOUBLE, label: STRING, shifts_sd: MAP<STRING, DOUBLE>>>"


def reply_object(content: Column) -> Column:
    """The JSON object in a reply: from its first opening brace to its last closing one, NULL without both."""
    first, last = F.instr(content, "{"), F.length(content) - F.instr(F.reverse(content), "}") + 1
    return F.when((first > 0) & (F.instr(content, "}") > 0) & (last > first), F.substring(content, first, last - first + 1))


def adjustments(replies: DataFrame) -> DataFrame:
    """(unit, asset, horizon, drift_bp, vol_scale, skew) from replies (unit, content): the asset's row (horizon NULL) and its
    horizons' own. Texts that hold no JSON object give nothing."""
    parsed = replies.select("unit", F.from_json(reply_object(F.col("content")), REPLY).alias("r"))
    assets = parsed.select("unit", F.explode("r.assets").alias("asset", "a"))
    fields = ["drift_bp", "vol_scale", "skew"]
    base = assets.select("unit", "asset", F.lit(None).cast("int").alias("horizon"), *(F.col(f"a.{f}").alias(f) for f in fields))
    own = assets.select("unit", "asset", F.explode("a.per_horizon").alias("h", "o")).select("unit", "asset", F.col("h").try_cast("int").alias("horizon"), *(F.col(f"o.{f}").alias(f) for f in fields))
    return base.unionByName(own)
