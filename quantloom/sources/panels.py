"""Panels from Parquet directories, in long or wide layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.calendar import iso_day


def read_panels(spark: SparkSession, *folders: str) -> DataFrame:
    """(panel_id, asset, date DATE, value DOUBLE, row_no) of every Parquet file in the first folder that has any; row_no orders the
    rows as the files have them.

    The panel is named by its file's stem. Asset columns may be called asset or asset_id; dates may be DATE, TIMESTAMP or
    ISO text, of which the day counts. NaN becomes NULL; a row without a readable date has a NULL one.
    """
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
            break
    else:
        raise FileNotFoundError(f"no Parquet file in {', '.join(folders)}")
    raw = spark.read.option("mergeSchema", "true").parquet(f"{folder}/*.parquet")
    names = [c for c in ("asset", "asset_id") if c in raw.columns]
    if not names or "value" not in raw.columns or "date" not in raw.columns:
        raise ValueError(f"a panel has asset (or asset_id), date and value; this has {raw.columns}")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1)
    value = F.col("value").cast("double")
    return raw.select(
        stem.alias("panel_id"),
        F.coalesce(*map(F.col, names)).alias("asset"),
        iso_day(F.col("date").cast("string")).alias("date"),
        F.when(~F.isnan(value), value).alias("value"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("row_no"),
    )


def as_of_panels(spark: SparkSession, unit: str, asof: str) -> DataFrame:
    """Panels of a unit's folder, or of its folder panels, without rows after the as-of day."""
    return read_panels(spark, unit, f"{unit}/panels").where(F.col("date") <= F.lit(asof).cast("date"))


def long_form(wide: DataFrame, keys: Sequence[str], names: dict[str, str] | None = None) -> DataFrame:
    """(keys..., asset, value) of a table with a column an asset; ``names`` renames assets, nulls are left out."""
    values = [c for c in wide.columns if c not in keys]
    rows = wide.unpivot(list(keys), values, "asset", "value").where("value is not null")
    if not names:
        return rows
    renamed = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return rows.withColumn("asset", F.coalesce(renamed[F.col("asset")], F.col("asset")))


def read_corpus(spark: SparkSession, index: str, texts: str) -> DataFrame:
    """(doc_id, stamp text, source, doc_type, file, text) of a JSON index and its text files; a file that isn't there has a
    NULL text. A file is named by its path from the folder of texts, which may begin with that folder's own name, so equal names
    in two folders are two files. Without an index every text is a document of its own, without a time."""
    schema = "card_id STRING, asof STRING, documents ARRAY<STRUCT<doc_id: STRING, timestamp: STRING, source: STRING, doc_type: STRING, file: STRING, path: STRING>>"
    folder = texts.rstrip("/")
    own = folder.rsplit("/", 1)[-1]
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    name = F.substring_index(path, f"{folder.split(':', 1)[-1]}/", -1)
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(name.alias("_name"), F.col("value").alias("text"))
    at = spark._jvm.org.apache.hadoop.fs.Path(index)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        absent = [F.lit(None).cast("string").alias(c) for c in ("timestamp", "source", "doc_type")]
        return files.select(F.col("_name").alias("doc_id"), *absent, F.col("_name").alias("file"), "text")
    docs = spark.read.schema(schema).option("multiLine", "true").json(index).select(F.explode("documents").alias("d")).select("d.*")
    docs = docs.withColumn("file", F.coalesce("file", "path")).drop("path")
    inner = F.when(F.startswith("file", F.lit(f"{own}/")), F.substring("file", len(own) + 2, 1 << 20)).otherwise(F.col("file"))
    return docs.join(files, inner == F.col("_name"), "left").drop("_name")


def text_targets(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, n_bytes) of the text files that paths name: a file is itself, a folder every .txt file below it; each once."""
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(p).select("path", F.col("length").alias("n_bytes")) for p in paths]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
