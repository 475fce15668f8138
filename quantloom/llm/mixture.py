"""Mixing sources to target weights by pivotal dependent rounding.

A document's expected number of copies is its source's target tokens over its
available tokens, at most the source's cap. The whole part is kept; the
fractional parts are rounded in pairs: mass, weighted by tokens, moves between
two documents at random until one of them is whole, so that expectations and
the source's tokens stay what they were. What is left of a chunk is one
fractional document; those are combined level by level in a reduction tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.session import written

#: Fixed value: the pre-tokenization pattern of the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def source_name(source: Column) -> Column:
    """Spellings of one source: letter case, outer spaces and _ for - don't matter."""
    return F.translate(F.lower(F.trim(F.regexp_replace(source, r"^\s+|\s+$", ""))), "_", "-")


def _count(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    import tiktoken

    with open(tokenizer, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    for b in batches:
        counts = [len(encode(t)) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["doc_id", "source", "tokens"])


def token_counts(documents: DataFrame, sources: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (doc_id, source, tokens) of the documents with text in one of ``sources`` (source)."""
    listed = sources.select(source_name(F.col("source")).alias("source")).where("source is not null").distinct()
    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").where("text is not null and text != ''")
    rows = rows.join(F.broadcast(listed), "source").select(F.col("doc_id").cast("bigint"), "source", "text")
    return rows.mapInArrow(lambda b: _count(b, tokenizer), "doc_id bigint, source string, tokens bigint").where("tokens > 0")


def pivotal(share: np.ndarray, tokens: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds ``share`` (fractions of 0..1) in order. Returns the shares, all 0 or 1 but at most one, and that one's place or -1."""
    share = share.astype(float).copy()
    u = draw.random(len(share))
    open_at = -1
    for j in range(len(share)):
        if share[j] <= 1e-12 or share[j] >= 1 - 1e-12:
            share[j] = round(share[j])
            continue
        if open_at < 0:
            open_at = j
            continue
        i, a, b = open_at, tokens[open_at], tokens[j]
        up = min((1 - share[i]) * a, share[j] * b)  # mass that can move from j to i
        down = min(share[i] * a, (1 - share[j]) * b)  # from i to j
        moved = up if u[j] * (up + down) < down else -down
        share[i] += moved / a
        share[j] -= moved / b
        left = [k for k in (i, j) if 1e-9 < share[k] < 1 - 1e-9]
        for k in (i, j):
            if k not in left:
                share[k] = round(share[k])
        open_at = left[0] if left else -1
    return share, open_at


def _round_chunks(key: tuple, part: pa.Table, seed: int) -> pa.Table:
    """One chunk: fractional documents become 0 or 1; one may stay fractional. Order and draws depend on the keys alone."""
    part = part.sort_by([("r", "ascending"), ("doc_id", "ascending"), ("tokens", "ascending")])
    draw = np.random.default_rng([seed, int(key[1].as_py()) & 0xFFFFFFFF, int(pc.sum(part["tokens"]).as_py()) & 0xFFFFFFFF])
    share, _ = pivotal(part["share"].to_numpy(), part["tokens"].to_numpy(), draw)
    return part.set_column(part.schema.get_field_index("share"), "share", pa.array(share))


SCHEMA = "doc_id bigint, source string, tokens bigint, n_rows bigint, whole bigint, share double, r bigint, chunk bigint"


def _rounded(rows: DataFrame, seed: int) -> DataFrame:
    return rows.groupBy("source", "chunk").applyInArrow(lambda key, part: _round_chunks(key, part, seed), SCHEMA)


def mix(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    tokenizer: str = TOKENIZER,
    seed: int = 17,
    chunk_rows: int = 20_000,
    fan_in: int = 2_000,
) -> tuple[DataFrame, DataFrame]:
    """(copies, shares): rows (doc_id, source, tokens, n_rows, copies) of the documents taken, and for each row of ``targets``
    (source, target_share, max_repeats) what was reached.

    ``total_tokens`` defaults to the tokens of all documents of the listed sources. A source whose documents,
    repeated ``max_repeats`` times, don't fill its share gives all that, and its shortfall stays open; shares
    reached are of the mix's own tokens. Every other source is within one document of its target. Defined
    results: documents with null or empty text or an unlisted or null source are never taken; null doc_ids are kept;
    ``n_rows`` rows of one doc_id, source and size are one row here, whose copies are shared out among them as evenly as
    can be, so that none is used more than ``max_repeats`` times; a source without documents, or with a null share or cap, reaches
    zero; an empty table gives an empty mix; other columns are ignored.

    Repeated rows are counted first, map-side, so a document with very many copies is one row. Documents are dealt to
    chunks by a hash, so a hot source has as many chunks as it needs, and a task never sees more than about
    ``chunk_rows`` documents. Each chunk leaves one fractional document at most; ``fan_in`` of
    them meet in a chunk of the next level.
    """
    counted = written(token_counts(documents, targets, tokenizer).groupBy("doc_id", "source", "tokens").agg(F.count("*").alias("n_rows")))
    have = counted.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n_rows")).alias("available"), F.sum("n_rows").alias("n_docs"))
    goals = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    goals = goals.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    plan = goals.join(F.broadcast(have), "source", "left").collect()  # a row for each target, a stated list
    total = sum(r.available or 0 for r in plan) if total_tokens is None else total_tokens
    spark = documents.sparkSession
    rates, most = [], 1
    for r in plan:
        rate = min(float(r.max_repeats or 0), total * (r.target_share or 0.0) / r.available) if r.available else 0.0
        chunks = -(-(r.n_docs or 0) // chunk_rows) or 1
        most = max(most, chunks)
        rates.append((r.source, rate, chunks))
    rate = F.broadcast(spark.createDataFrame(rates, "source string, rate double, chunks bigint"))
    r = F.xxhash64("doc_id", "tokens", "source", F.lit(seed))
    rows = counted.join(rate, "source").where("rate > 0").withColumn("r", r)
    rate = F.col("rate") * F.col("n_rows")
    rows = rows.select("doc_id", "source", "tokens", "n_rows", F.floor(rate).cast("bigint").alias("whole"), (rate - F.floor(rate)).alias("share"), "r", F.pmod(F.col("r"), F.col("chunks")).alias("chunk"))
    done, level, at = None, rows, 0
    while True:
        level = written(_rounded(level, seed + at))
        if most <= 1:
            done = level if done is None else done.unionByName(level)
            break
        settled = level.where("share <= 0 or share >= 1")
        done = settled if done is None else done.unionByName(settled)
        most, at = -(-most // fan_in), at + 1
        level = level.where("share > 0 and share < 1").withColumn("chunk", F.pmod(F.xxhash64("r", F.lit(at)), F.lit(most)).cast("bigint"))
    # The tree's root may leave one fractional document a source: it is settled by a draw.
    last = F.pmod(F.xxhash64("r", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    copies = (F.col("whole") + F.when(F.col("share") > last, 1).otherwise(0)).alias("copies")
    taken = done.select("doc_id", "source", "tokens", "n_rows", copies).where("copies > 0")
    used = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("copies"))
    per_target = goals.join(F.broadcast(have), "source", "left").join(F.broadcast(used), "source", "left")
    all_tokens = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy(F.lit(1)))  # a row for each target
    shares = per_target.select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("available", F.lit(0)).alias("available_tokens"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("tokens") / F.nullif(all_tokens, F.lit(0)), F.lit(0.0)).alias("reached_share"),
    )
    return taken, shares
