"""Queries of the plan, its scales and rankability on rosters made from the cards, and of the cleaning rules on fixed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import panel, steps
from quantloom.operators.declutter import declutter, reissue_notes
from quantloom.plans import verbs
from quantloom.plans.relations import FX, fx, shipments, with_ctes
from quantloom.session import table
from quantloom.sources import roster

_PROSE = "The committee judged that activity had continued to expand at a moderate pace over the period.\n"
#: A page for each rule, with the lines of prose between its parts.
PAGES = (
    ("plain.txt", "a\r\n", 1, ""),
    ("top.txt", "", 20, "Back to top\n\n"),
    ("footer.txt", "", 30, "Return to top\nJune 3, 2020\nHome | About\nFreedom of Information\n"),
    ("older.txt", "", 30, "Return to top\nLast update: June 3, 2020\n"),
    ("crumbs.txt", "", 30, "Return to top\nFOMC\n|\nMonetary policy\n"),
    ("book.txt", "Skip to Content\nmenu\nBeige Book - June 3, 2020\nPDF\n\nNational Summary text\nOverall Economic Activity\n", 40, "\nLast Modified Date: June 3, 2020\nfoot\n"),
    ("also.txt", "", 30, "x SEE ALSO Find out more about related content\ny\n"),
    ("votes.txt", "", 30, "\nMonetary Policy Committee voting history\nOther Monetary Policy Committee news\n"),
    ("news.txt", "", 30, "Other news\nNews // one\n"),
    ("modified.txt", "", 30, "\nLast Modified Date: June 3, 2020\n"),
    ("pages.txt", "﻿", 10, "﻿" + _PROSE * 10),
    ("short.txt", "﻿", 10, "﻿short page\n"),
    ("guard.txt", "Skip to Content\nTHE EMPLOYMENT SITUATION\n", 40, "Connect With BLS\nOverall Economic Activity\n"),
    ("cpi_2020-06-03.txt", "(NOTE: This release was reissued on Friday, June 5, 2020 to correct (some) tables.)\n\n", 5, "1 The table was reissued on June 6, 2020.\n"),
    ("empsit_2020-06-05.txt", "In (NOTE: BLS reissued this news release on June 9, 2020 again) line.\n(NOTE: This release was reissued June 4, 2020.)\n", 5, ""),
    ("none.txt", "(NOTE: This release was reissued June 4, 2020.)\n", 5, ""),
)


def _pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, a + _PROSE * n + b) for f, a, n, b in PAGES], "file string, body_text string")


def page_rules(spark: SparkSession, d: str) -> DataFrame:
    """Each cleaning rule on a page that it fires on, and the two guards."""
    c = declutter(_pages(spark))
    return c.select("file", "status", F.array_join("rules", ",").alias("rules"), F.length("body_text").alias("n_chars"), F.size("notes").alias("n_notes"))


def page_notes(spark: SparkSession, d: str) -> DataFrame:
    return reissue_notes(declutter(_pages(spark))).select("file", "note_no", "day", "action")


def _roster(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "task_cards")
    assets = F.transform(F.sequence(F.lit(1), F.greatest("n_assets", F.lit(1))), lambda i: F.concat(F.lit("A"), i.cast("string")))
    return c.select(F.col("card_id").alias("unit"), assets.alias("assets"), "horizons", (F.col("n_assets") * F.size("horizons")).alias("cell_count"), "target_type", "asset_panel", "asof")


def plan_roster(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the roster's grids by asset, with the faults of the whole roster."""
    r = _roster(spark, d)
    cells = roster.planned_cells(r).groupBy("asset").agg(F.count("*").alias("n_cells"), F.max("cell_idx").alias("last_idx"), F.sum(F.col("horizon").cast("bigint")).alias("horizons"))
    return cells.withColumn("n_bad", F.lit(sum(roster.bad_grids(r).first())))


def _scales(spark: SparkSession, d: str) -> DataFrame:
    """A scale of each card with a target type: its joint part is zero for yields, and others lack the tail."""
    r = _roster(spark, d).where("target_type is not null")
    joint = F.when(F.col("asset_panel").contains("rates"), F.lit("0.0")).otherwise(F.lit("1.5"))
    body = F.concat(F.lit('{"marginal": 1.25, "joint": '), joint, F.when(F.length("unit") % 2 == 0, F.lit(', "tail": 2.0}')).otherwise(F.lit("}")))
    return r.select("unit", body.alias("body"), F.sha2(body, 256).alias("digest"))


def scale_bundle_check(spark: SparkSession, d: str) -> DataFrame:
    return roster.scale_accounts(_roster(spark, d), _scales(spark, d))


def rankable_units(spark: SparkSession, d: str) -> DataFrame:
    """Rankability by panel: units without a target type are raw, those without an as-of date graded by their card."""
    c = table(spark, d, "task_cards")
    rows = c.select(
        "asset_panel", F.when(F.col("target_type").isNotNull(), roster.RANKED).otherwise(roster.UNRANKED).alias("mode"), F.when(F.col("asof").try_cast("date").isNotNull(), "plan").otherwise("card").alias("grid_source")
    )
    parts = [roster.rankability(part).withColumn("part", F.lit(name)) for name, part in (("all", rows), ("ranked", rows.where(F.col("mode") == roster.RANKED)))]
    return parts[0].unionByName(parts[1])


def realized_continuation(spark: SparkSession, d: str) -> DataFrame:
    """At every series' pseudo-origins the values 1, 5 and 21 rows on."""
    c = steps.continuation(fx(spark, d), ["unit", "asset"], "date", (1, 5, 21), every=50)
    return c.groupBy("unit", "asset", "steps").agg(F.count("*").alias("n"), F.round(F.sum("realized"), 4).alias("realized"), F.round(F.sum("anchor"), 4).alias("anchor"))


def series_as_written(spark: SparkSession, d: str) -> DataFrame:
    """Of two panels with an asset, the first by name that has rows before the cutoff, every row of it, also several of one day."""
    li = table(spark, d, "lineitem")
    rows = li.select(F.concat(F.lit("panel_"), F.lower("l_linestatus")).alias("panel_id"), F.col("l_returnflag").alias("asset"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("value"))
    s = panel.series_as_written(rows, F.lit("2000-06-30").cast("date"))
    return s.groupBy("panel_id", "asset").agg(F.count("*").alias("n_rows"), F.count_distinct("date").alias("n_days"), F.round(F.sum("value"), 2).alias("total"))


def units_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    return panel.chosen_units(table(spark, d, "task_cards").select(F.col("card_id").alias("unit")), "[02468]$", 20)


def _shipment_targets(spark: SparkSession, d: str) -> DataFrame:
    cells = shipments(spark, d).select("unit", "asset").distinct()
    return cells.select("unit", "asset", F.explode(F.array(F.lit(5), F.lit(21))).alias("horizon")).withColumn("steps", F.col("horizon"))


def bootstrap_forecast(spark: SparkSession, d: str) -> DataFrame:
    """The bootstrap end to end, calibrated on its past and with a family's prior: draws and spread of each cell."""
    p, t = shipments(spark, d), _shipment_targets(spark, d)
    families = t.select("unit").distinct().withColumn("family", F.lit("F2"))
    draws = verbs.forecast_bootstrap(p, t, 100, 3, corrections=verbs.calibration(p, t, 50, 3), families=families)
    return draws.groupBy("unit", "asset", "horizon").agg(F.count("*").alias("n_draws"), F.round(F.stddev_pop("value"), 2).alias("sd"))


QUERIES = {
    f.__name__: f
    for f in (bootstrap_forecast, page_rules, page_notes, plan_roster, scale_bundle_check, rankable_units, realized_continuation, series_as_written, units_by_pattern)
}
_P = len(_PROSE)
_EXPECTED = (
    ("plain.txt", "unchanged", "", 3 + _P, 0),
    ("top.txt", "cleaned", "separators(-1)", 20 * _P, 0),
    ("footer.txt", "cleaned", "footer(dateline kept)", 30 * _P + len("June 3, 2020\n"), 0),
    ("older.txt", "cleaned", "older-fed-footer", 30 * _P, 0),
    ("crumbs.txt", "cleaned", "fomc-breadcrumb-footer", 30 * _P, 0),
    ("book.txt", "cleaned", "nav-head(beige-book),beige-book-front-matter(-1 lines),nav-tail", len("Beige Book - June 3, 2020\nNational Summary text\nOverall Economic Activity\n") + 40 * _P, 0),
    ("also.txt", "cleaned", "ecb-see-also", 30 * _P + 2, 0),
    ("votes.txt", "cleaned", "boe-mpc-news", 30 * _P, 0),
    ("news.txt", "cleaned", "boe-other-news", 30 * _P, 0),
    ("modified.txt", "cleaned", "last-modified-footer", 30 * _P, 0),
    ("pages.txt", "cleaned", "page-split(2)", 20 * _P + 1, 0),
    ("short.txt", "refused", "page 2 would keep too little prose", 2 + 10 * _P + len("short page\n"), 0),
    ("guard.txt", "refused", "the end of the body would cut body text", sum(map(len, (PAGES[12][1], PAGES[12][3]))) + 40 * _P, 0),
    ("cpi_2020-06-03.txt", "cleaned", "reissue-notes(-1),reissue-footnotes(-1)", 5 * _P, 2),
    ("empsit_2020-06-05.txt", "unchanged", "", len(PAGES[14][1]) + 5 * _P, 2),
    ("none.txt", "unchanged", "", len(PAGES[15][1]) + 5 * _P, 1),
)
_ROSTER = "r AS (SELECT card_id AS unit, greatest(n_assets, 1) AS a, n_assets, horizons, target_type, asset_panel FROM task_cards)"

ORACLES = {
    "page_rules": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{s}', '{r}', {n}, {k})" for f, s, r, n, k in _EXPECTED) + ") AS t(file, status, rules, n_chars, n_notes)",
    "page_notes": """SELECT * FROM (VALUES ('cpi_2020-06-03.txt', 0, '2020-06-05', 'removed'), ('cpi_2020-06-03.txt', 1, '2020-06-06', 'removed'),
        ('empsit_2020-06-05.txt', 0, '2020-06-09', 'kept-inline'), ('empsit_2020-06-05.txt', 1, '2020-06-04', 'kept-postdated'), ('none.txt', 0, '2020-06-04', 'kept-undated')) AS t(file, note_no, day, action)""",
    "plan_roster": f"""WITH {_ROSTER}, c AS (SELECT i, j, h, len(horizons) AS n FROM (SELECT unnest(range(a)) AS i, horizons FROM r), LATERAL (SELECT unnest(range(len(horizons))) AS j, unnest(horizons) AS h))
        SELECT 'A' || (i + 1) AS asset, count(*) AS n_cells, CAST(max(i * n + j) AS INT) AS last_idx, CAST(sum(h) AS BIGINT) AS horizons,
        (SELECT CAST(count(*) FILTER (len(list_distinct(horizons)) < len(horizons)) + count(*) FILTER (len(horizons) < 1 OR list_min(horizons) <= 0) + count(*) FILTER (n_assets * len(horizons) <> a * len(horizons)) AS INT) FROM r) AS n_bad
        FROM c GROUP BY 1, n_bad""",
    "scale_bundle_check": f"""WITH {_ROSTER} SELECT count(*) AS n_units, count(*) FILTER (target_type IS NULL) AS absent, 0 AS unlisted, 0 AS unreadable,
        count(*) FILTER (target_type IS NOT NULL AND (length(unit) % 2 = 1 OR (contains(coalesce(asset_panel, ''), 'rates') AND n_assets * len(horizons) <> 1))) AS bad_parts FROM r""",
    "rankable_units": """WITH r AS (SELECT target_type IS NULL AS raw, try_cast("asof" AS date) IS NULL AS card FROM task_cards), p AS (SELECT 'all' AS part, * FROM r UNION ALL SELECT 'ranked', * FROM r WHERE NOT raw)
        SELECT part, count(*) AS n_units, count(*) FILTER (raw) AS raw, count(*) FILTER (card) AS by_card, count(*) > 0 AND count(*) FILTER (raw OR card) = 0 AS rankable FROM p GROUP BY 1""",
    "realized_continuation": with_ctes(FX, "s AS (SELECT *, row_number() OVER w - 1 AS i, unnest([1, 5, 21]) AS steps FROM fx WINDOW w AS (PARTITION BY unit, asset ORDER BY date))",
        "t AS (SELECT unit, asset, date, value, row_number() OVER (PARTITION BY unit, asset ORDER BY date) - 1 AS i FROM fx)",
        select="""SELECT s.unit, s.asset, steps, count(*) AS n, round(sum(t.value), 4) AS realized, round(sum(s.value), 4) AS anchor FROM s JOIN t ON t.unit = s.unit AND t.asset = s.asset AND t.i = s.i + steps
        WHERE s.i % 50 = 0 GROUP BY 1, 2, 3"""),
    "series_as_written": """WITH r AS (SELECT 'panel_' || lower(l_linestatus) AS panel_id, l_returnflag AS asset, CAST(l_shipdate AS date) AS date, l_extendedprice AS value FROM lineitem WHERE CAST(l_shipdate AS date) <= DATE '2000-06-30'),
        f AS (SELECT asset, min(panel_id) AS panel_id FROM r GROUP BY 1) SELECT panel_id, asset, count(*) AS n_rows, count(DISTINCT date) AS n_days, round(sum(value), 2) AS total FROM r JOIN f USING (asset, panel_id) GROUP BY 1, 2""",
    "units_by_pattern": "SELECT card_id AS unit FROM task_cards WHERE regexp_matches(card_id, '[02468]$') ORDER BY 1 LIMIT 20",
}
