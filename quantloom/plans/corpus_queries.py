"""Queries of corpus selection, cleaning and parsing, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import corpus
from quantloom.operators.declutter import declutter
from quantloom.session import table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.col("card_id").alias("unit"), "doc_id", "text", F.to_date("published_at").alias("stamp")).where("unit is not null")


def _cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task_cards").select(F.col("card_id").alias("unit"), F.col("asof").try_cast("date").alias("asof"))


def docs_admissible_dedup_topk(spark: SparkSession, d: str) -> DataFrame:
    return corpus.admissible(_documents(spark, d), _cutoffs(spark, d))


def docs_newest_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.reading_list(_documents(spark, d), _cutoffs(spark, d))


def corpus_index_coverage(spark: SparkSession, d: str) -> DataFrame:
    return corpus.coverage(table(spark, d, "corpus_index"), table(spark, d, "corpus_files"))


def index_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus_index").select(corpus.canonical_path(F.concat(F.lit("text/"), F.coalesce("file", F.lit("../x")))).alias("path"))
    return rows.agg(F.count("*").alias("n"), F.count("path").alias("n_canonical"))


def doc_prose_chars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", corpus.prose_chars(F.col("text")).alias("prose"))


def doc_line_normalise(spark: SparkSession, d: str) -> DataFrame:
    text = corpus.unix_lines(F.col("body_text"))
    return table(spark, d, "corpus_files").select("file", F.md5(text).alias("digest"), F.size(F.split(text, "\n", -1)).alias("n_lines"))


def doc_drop_separator_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are nothing but a link to the top of the page, counted; the cleaner takes them out."""
    lines = F.split("body_text", "\n", -1)
    return table(spark, d, "corpus_files").select("file", F.size(F.filter(lines, lambda x: x.rlike(r"(?i)^[ \t]*(return|back) to top[ \t\r]*$"))).alias("n_separators"))


def page_clean(spark: SparkSession, d: str) -> DataFrame:
    c = declutter(table(spark, d, "corpus_files"))
    return c.select("file", "status", F.array_join("rules", ",").alias("rules"), F.length("body_text").alias("n_chars"))


def page_shrink_guard(spark: SparkSession, d: str) -> DataFrame:
    return declutter(table(spark, d, "corpus_files")).groupBy("status").agg(F.count("*").alias("n_files"))


def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    p = corpus.prompts(docs, corpus.admissible(docs, _cutoffs(spark, d)))
    return p.select("unit", "n_docs", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


def unit_census(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "task_cards")
    return c.groupBy("category", F.coalesce("target_type", F.lit("unknown")).alias("target_type")).agg(
        F.count("*").alias("n_cards"), F.sum(F.size("horizons")).alias("n_horizons"), F.sum("n_assets").alias("n_assets"), F.count_if((F.col("n_assets") * F.size("horizons")) == 1).alias("n_single")
    )


def json_props_scalar(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("largest"))


def adjustment_reply_parse(spark: SparkSession, d: str) -> DataFrame:
    """Replies made of the events' values: prose around a JSON object with an asset's row and one horizon of its own."""
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("unit"), F.concat(
        F.lit('Here it is: {"assets": {"'), "event_type", F.lit('": {"drift_bp": '), F.col("value").cast("string"), F.lit(', "per_horizon": {"21": {"vol_scale": 1.25}}}}} and so on')
    ).alias("content"))
    a = corpus.adjustments(e)
    return a.groupBy("asset", "horizon").agg(F.count("*").alias("n"), F.round(F.sum("drift_bp"), 2).alias("drift"), F.round(F.avg("vol_scale"), 2).alias("vol"))


def metadata_binding(spark: SparkSession, d: str) -> DataFrame:
    """Cards whose title, as-of date or targets a deliverable would have to match; and whether targets lie after the as-of date."""
    c = table(spark, d, "task_cards").withColumn("cut", F.col("asof").try_cast("date"))
    dates = F.transform("horizons", lambda h: F.date_add("cut", h))
    late = F.forall(dates, lambda x: x > F.col("cut"))
    months = F.floor(F.months_between(F.array_min(dates), "cut"))
    return c.select("card_id", F.col("cut").isNotNull().alias("dated"), late.alias("targets_after"), months.cast("int").alias("least_months"))


QUERIES = {
    f.__name__: f
    for f in (
        docs_admissible_dedup_topk, docs_newest_counts, corpus_index_coverage, index_paths, doc_prose_chars, doc_line_normalise, doc_drop_separator_lines,
        page_clean, page_shrink_guard, prompt_assembly, unit_census, json_props_scalar, adjustment_reply_parse, metadata_binding,
    )
}

_DOCS = r"""d AS (SELECT card_id AS unit, doc_id, text, CAST(published_at AT TIME ZONE 'UTC' AS date) AS stamp, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM documents WHERE card_id IS NOT NULL),
c AS (SELECT d.*, try_cast(k."asof" AS date) AS cut FROM d JOIN task_cards k ON k.card_id = d.unit)"""
_ADMITTED = r"""a AS (SELECT unit, doc_id, stamp, substr(regexp_replace(lower(s), '\s+', ' ', 'g'), 1, 400) AS k FROM c WHERE stamp <= cut AND s <> ''),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY unit, k ORDER BY stamp DESC, doc_id DESC) = 1),
t AS (SELECT unit, doc_id, stamp, row_number() OVER (PARTITION BY unit ORDER BY stamp DESC, doc_id DESC) AS rank FROM b)"""

ORACLES = {
    "docs_admissible_dedup_topk": f"WITH {_DOCS}, {_ADMITTED} SELECT unit, doc_id, stamp, rank FROM t WHERE rank <= 14",
    "docs_newest_counts": f"""WITH {_DOCS}, f AS (SELECT *, CASE WHEN stamp IS NULL THEN 'undated' WHEN stamp > cut THEN 'late' WHEN s = '' THEN 'blank' ELSE 'fit' END AS state FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY unit, state ORDER BY stamp DESC, doc_id DESC) AS i FROM f)
        SELECT unit, count(*) FILTER (state = 'undated') AS n_undated, count(*) FILTER (state = 'late') AS n_late, count(*) FILTER (state = 'blank') AS n_blank,
        count(*) FILTER (state = 'fit' AND i > 8) AS n_over_budget, count(*) FILTER (state = 'fit' AND i <= 8) AS n_read,
        CAST(coalesce(sum(length(substr(text, 1, 6000))) FILTER (state = 'fit' AND i <= 8), 0) AS BIGINT) AS n_chars FROM r GROUP BY 1""",
    "corpus_index_coverage": """WITH a AS (SELECT DISTINCT file FROM corpus_index WHERE file IS NOT NULL), b AS (SELECT DISTINCT file FROM corpus_files WHERE file IS NOT NULL)
        SELECT count(a.file) AS n_indexed, count(b.file) AS n_files, count(*) FILTER (b.file IS NULL) AS n_absent, count(*) FILTER (a.file IS NULL) AS n_unindexed FROM a FULL JOIN b ON a.file = b.file""",
    "index_paths": r"""SELECT count(*) AS n, count(*) FILTER (NOT regexp_matches(p, '(^|/)(\.{0,2})(/|$)') AND NOT contains(p, '\')) AS n_canonical FROM (SELECT 'text/' || coalesce(file, '../x') AS p FROM corpus_index)""",
    "doc_prose_chars": r"""SELECT doc_id, CAST(coalesce(list_sum(list_filter(list_transform(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda n: n >= 60)), 0) AS INT) AS prose
        FROM documents WHERE text IS NOT NULL""",
    "doc_line_normalise": """SELECT file, md5(t) AS digest, CAST(len(string_split(t, chr(10))) AS INT) AS n_lines FROM (SELECT file, replace(replace(body_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM corpus_files)""",
    "doc_drop_separator_lines": r"""SELECT file, CAST(len(list_filter(string_split(body_text, chr(10)), lambda x: regexp_matches(x, '(?i)^[ \t]*(return|back) to top[ \t\r]*$'))) AS INT) AS n_separators FROM corpus_files""",
    "prompt_assembly": f"""WITH {_DOCS}, {_ADMITTED} SELECT t.unit, CAST(count(*) AS INT) AS n_docs,
        CAST(length(string_agg('## ' || t.doc_id || chr(10) || substr(x.text, 1, 3500), chr(10) || chr(10) ORDER BY rank)) AS INT) AS n_chars,
        md5(string_agg('## ' || t.doc_id || chr(10) || substr(x.text, 1, 3500), chr(10) || chr(10) ORDER BY rank)) AS digest FROM t JOIN documents x ON x.doc_id = t.doc_id WHERE rank <= 14 GROUP BY 1""",
    "unit_census": """SELECT category, coalesce(target_type, 'unknown') AS target_type, count(*) AS n_cards, CAST(sum(len(horizons)) AS BIGINT) AS n_horizons, CAST(sum(n_assets) AS BIGINT) AS n_assets,
        count(*) FILTER (n_assets * len(horizons) = 1) AS n_single FROM task_cards GROUP BY 1, 2""",
    "json_props_scalar": """SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS largest FROM (SELECT event_type, try_cast(props->>'$.k' AS INT) AS k FROM events) GROUP BY 1""",
    "adjustment_reply_parse": """SELECT event_type AS asset, CAST(NULL AS INT) AS horizon, count(*) AS n, round(sum(value), 2) AS drift, CAST(NULL AS DOUBLE) AS vol FROM events GROUP BY 1
        UNION ALL SELECT event_type, 21, count(*), NULL, 1.25 FROM events GROUP BY 1""",
    "metadata_binding": """WITH c AS (SELECT card_id, try_cast("asof" AS date) AS cut, horizons FROM task_cards), m AS (SELECT *, cut + CAST(list_min(horizons) AS INT) AS t FROM c)
        SELECT card_id, cut IS NOT NULL AS dated, list_min(horizons) > 0 AS targets_after, CAST((year(t) - year(cut)) * 12 + month(t) - month(cut) - CASE WHEN day(t) < day(cut) AND t <> last_day(t) THEN 1
          WHEN day(t) < day(cut) AND t = last_day(t) AND cut <> last_day(cut) THEN 1 ELSE 0 END AS INT) AS least_months FROM m""",
}
