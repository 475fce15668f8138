"""Lines of texts, their keys, and the source of a file, shared by the operators on page furniture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letters(line: Column) -> Column:
    """The letters of any alphabet, in order, without case; ß and ss are one, as they are in capitals."""
    return F.regexp_replace(F.replace(F.lower(line), F.lit("ß"), F.lit("ss")), r"[^\p{L}]+", "")


def source_key(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def file_sources(index: DataFrame) -> DataFrame:
    """Rows (file, source), one for each listed file: the non-null source among its entries, NULL where all are null."""
    rows = index.select(F.col("file"), source_key(F.col("source")).alias("source")).where("file is not null")
    return rows.groupBy("file").agg(F.max("source").alias("source"))


#: Bytes of a table in the shared folder up to which it is broadcast: at most some 100 MB in memory.
BROADCAST_BYTES = 32 << 20


def at_hand(df: DataFrame) -> DataFrame:
    """A side of a join, broadcast where the size of its files, as the planner knows it, is within BROADCAST_BYTES. A larger
    one is left to the planner, which joins it by a sorted shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
