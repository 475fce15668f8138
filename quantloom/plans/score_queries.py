"""Queries of scores, grids and rosters, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.operators import grid, scores
from quantloom.plans.relations import DRAWS, REALIZED, draws, realized, with_ctes
from quantloom.session import table

CELL = ["unit", "asset", "horizon"]


def _r(name: str, digits: int = 4):
    return F.round(name, digits).alias(name)


def crps_by_cell(spark: SparkSession, d: str) -> DataFrame:
    return scores.crps(draws(spark, d), realized(spark, d)).select(*CELL, "n_draws", _r("crps"))


CRPS = """crps AS (SELECT unit, asset, horizon, count(*) AS n_draws,
  avg(abs(value - y)) - sum((2 * i - n - 1) * value) / (count(*) * count(*)) AS crps
  FROM (SELECT d.*, r.value AS y, row_number() OVER (PARTITION BY d.unit, d.asset, d.horizon ORDER BY d.value) AS i,
      count(*) OVER (PARTITION BY d.unit, d.asset, d.horizon) AS n
    FROM draws d JOIN realized r ON d.unit = r.unit AND d.asset = r.asset AND d.horizon = r.horizon) GROUP BY 1, 2, 3)"""
LEVELS = "levels AS (SELECT unnest([0.01, 0.05, 0.95, 0.99]) AS level)"
QS = """qs AS (SELECT unit, asset, horizon, unnest([0.01, 0.05, 0.95, 0.99]) AS level, unnest(quantile_cont(value, [0.01, 0.05, 0.95, 0.99])) AS q
  FROM draws GROUP BY unit, asset, horizon)"""
PINBALL = """pinball AS (SELECT q.unit, q.asset, q.horizon, level, q, CASE WHEN r.value >= q THEN level * (r.value - q) ELSE (1 - level) * (q - r.value) END AS loss,
  r.value AS y FROM qs q JOIN realized r ON q.unit = r.unit AND q.asset = r.asset AND q.horizon = r.horizon)"""
TAIL = "tail AS (SELECT unit, avg(loss) AS tail FROM (SELECT unit, level, avg(loss) AS loss FROM pinball GROUP BY 1, 2) GROUP BY 1)"
JOINT = """cells AS (SELECT d.*, r.value AS y FROM draws d JOIN realized r ON d.unit = r.unit AND d.asset = r.asset AND d.horizon = r.horizon),
pairs AS (SELECT a.unit, a.asset AS a1, a.horizon AS h1, b.asset AS a2, b.horizon AS h2, avg(pow(abs(a.value - b.value), 0.5)) AS x, max(pow(abs(a.y - b.y), 0.5)) AS y
  FROM cells a JOIN cells b ON a.unit = b.unit AND a.draw = b.draw AND (a.asset < b.asset OR (a.asset = b.asset AND a.horizon < b.horizon)) GROUP BY ALL),
joint AS (SELECT unit, 2 * sum(pow(y - x, 2)) AS joint FROM pairs GROUP BY 1)"""


def pinball_by_cell(spark: SparkSession, d: str) -> DataFrame:
    return scores.pinball(draws(spark, d), realized(spark, d)).select(*CELL, "level", *(F.round(F.col(k) + 1e-6, 2).alias(k) for k in ("q", "loss")))


def tail_pinball_unit(spark: SparkSession, d: str) -> DataFrame:
    return scores.TAIL_METRICS["pinball"](draws(spark, d), realized(spark, d)).select("unit", _r("tail"))


def tail_coverage_unit(spark: SparkSession, d: str) -> DataFrame:
    return scores.TAIL_METRICS["coverage"](draws(spark, d), realized(spark, d)).select("unit", _r("coverage"))


def variogram_unit(spark: SparkSession, d: str) -> DataFrame:
    return scores.variogram(draws(spark, d), realized(spark, d)).select("unit", _r("joint", 3))


def energy_unit(spark: SparkSession, d: str) -> DataFrame:
    return scores.energy(draws(spark, d), realized(spark, d)).select("unit", "n_draws", _r("energy", 3))


def composite_unit(spark: SparkSession, d: str) -> DataFrame:
    return scores.composite(draws(spark, d), realized(spark, d), _scales(spark, d)).select("unit", "cells", _r("composite"))


def composite_single_cell(spark: SparkSession, d: str) -> DataFrame:
    """Every cell as a unit of its own: no joint part, weights renormalized."""
    one = F.concat_ws("/", *CELL).alias("unit")
    x = draws(spark, d).select(one, "asset", "horizon", "draw", "value")
    y = realized(spark, d).select(one, "asset", "horizon", "value")
    return scores.composite(x, y).select("unit", "cells", _r("composite"))


def _scales(spark: SparkSession, d: str) -> DataFrame:
    sd = draws(spark, d).groupBy("unit").agg(F.stddev_pop("value").alias("sd"))
    return sd.select("unit", F.col("sd").alias("marginal"), (F.col("sd") * 10).alias("joint"), (F.col("sd") / 10).alias("tail"))


def pit_coverage_diag(spark: SparkSession, d: str) -> DataFrame:
    return scores.pit(draws(spark, d), realized(spark, d)).select(*CELL, _r("pit", 6), "in50", "in90")


def calibration_correction(spark: SparkSession, d: str) -> DataFrame:
    pits = scores.pit(draws(spark, d), realized(spark, d))
    return scores.correction(pits, ["unit", "asset"]).union(scores.correction(pits.withColumn("asset", F.lit("*")), ["unit", "asset"])).select(
        "unit", "asset", "n", _r("shift_sd", 6), _r("scale", 6)
    )


def draw_gate_counts(spark: SparkSession, d: str) -> DataFrame:
    return grid.draw_gate(draws(spark, d))


def _declared(spark: SparkSession, d: str) -> DataFrame:
    """A grid of line numbers 1 to 8, one of which no draw has, each declared with the unit's mean number of draws."""
    cells = draws(spark, d).groupBy(*CELL).agg(F.count("*").alias("n"))
    size = cells.groupBy("unit").agg(F.floor(F.avg("n")).alias("n_draws"))
    return cells.select("unit", "asset").distinct().join(size, "unit").select("unit", "asset", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("horizon"), "n_draws").where("horizon != 7")


def grid_dup_missing_extra(spark: SparkSession, d: str) -> DataFrame:
    return grid.occupancy(draws(spark, d), _declared(spark, d))


def grid_declared_vs_plan(spark: SparkSession, d: str) -> DataFrame:
    """The cards' horizons as declared against those of their category's most frequent card."""
    cards = table(spark, d, "task_cards")
    text = F.transform("horizons", lambda h: h.cast("string"))
    plan = cards.groupBy("category").agg(F.min(F.struct("card_id", text.alias("h"))).alias("m")).select("category", F.col("m.h").alias("planned"))
    pairs = cards.join(plan, "category").select(F.col("card_id").alias("unit"), text.alias("declared"), "planned")
    return grid.declared_grid(pairs)


def draw_completeness(spark: SparkSession, d: str) -> DataFrame:
    return grid.incomplete_draws(draws(spark, d))


def roster_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Cards without any reading of the ten currencies have no evidence."""
    roster = table(spark, d, "task_cards").select(F.col("card_id").alias("unit"))
    g = table(spark, d, "g10_daily").where("card_id is not null").groupBy(F.col("card_id").alias("unit")).agg(F.max(F.md5("asset")).alias("digest"))
    return grid.evidence(roster, g)


def label_code_counts(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.createDataFrame([("A", 0), ("N", 1)], "label string, code int")
    coded = grid.label_codes(draws(spark, d), labels, "asset")
    return coded.groupBy("code").agg(F.count("*").alias("n_rows"))


def realized_flat(spark: SparkSession, d: str) -> DataFrame:
    cells = _declared(spark, d)
    order = F.dense_rank().over(Window.partitionBy("unit").orderBy("asset", "horizon"))
    flat = grid.flatten_realized(realized(spark, d), cells.withColumn("cell_idx", order))
    return flat.select("unit", F.size("values").alias("n_cells"), F.array_join(F.transform("values", lambda v: F.coalesce(F.round(v, 2).cast("decimal(18,2)").cast("string"), F.lit("null"))), ",").alias("flat"))


def _unit_scores(spark: SparkSession, d: str) -> DataFrame:
    """Nations as a roster: a score from their suppliers' balances, none where there is no supplier."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("unit")).agg((F.avg("s_acctbal") / 1000).alias("score"))
    return s


def roster_mean_clipped(spark: SparkSession, d: str) -> DataFrame:
    roster = table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"))
    return grid.roster_mean(roster, _unit_scores(spark, d)).select("n_units", "n_failed", _r("mean_score", 6))


def roster_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Cards of the reading table against the roster of cards, a row for each reading's panel."""
    roster = table(spark, d, "task_cards").select(F.col("card_id").alias("unit"))
    rows = table(spark, d, "g10_daily").select(F.col("card_id").alias("unit"), "asset").distinct()
    return grid.roster_accounts(roster, rows)


def scale_normalised_scores(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("unit")).agg(
        F.avg("s_acctbal").alias("marginal"), F.min("s_acctbal").alias("joint"), F.stddev_samp("s_acctbal").alias("tail")
    )
    return grid.valid_scales(s).select("unit", _r("marginal"), _r("joint"), _r("tail"), "valid")


def roster_commitment(spark: SparkSession, d: str) -> DataFrame:
    digests = table(spark, d, "task_cards").select(F.col("card_id").alias("unit"), F.sha2(F.concat_ws("|", "card_id", "title", "asof"), 256).alias("digest"))
    return grid.commitment(digests)


def group_bootstrap_means(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select(F.trunc("o_orderdate", "MM").alias("grp"), (F.col("o_totalprice") / 1000).alias("score"))
    return grid.group_bootstrap(s, 40, 5).select("replicate", _r("mean", 6))


def text_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Paired differences of a unit's two scores, with and without the discount."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit"))
    pairs = li.agg(F.avg("l_extendedprice").alias("a"), F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b")).withColumn("diff", F.col("b") - F.col("a"))
    return pairs.agg(F.count("*").alias("n_units"), F.round(F.avg("diff"), 4).alias("mean_diff"), F.round(F.stddev_samp("diff"), 4).alias("sd_diff"), F.count_if(F.col("diff") < 0).alias("n_better"))


QUERIES = {
    f.__name__: f
    for f in (
        crps_by_cell, pinball_by_cell, tail_pinball_unit, tail_coverage_unit, variogram_unit, energy_unit, composite_unit, composite_single_cell,
        pit_coverage_diag, calibration_correction, draw_gate_counts, grid_dup_missing_extra, grid_declared_vs_plan, draw_completeness, roster_evidence, label_code_counts, realized_flat,
        roster_mean_clipped, roster_accounts, scale_normalised_scores, roster_commitment, group_bootstrap_means, text_ablation,
    )
}

DECLARED = """cellcount AS (SELECT unit, asset, horizon, count(*) AS n FROM draws GROUP BY ALL),
declared AS (SELECT u.unit, u.asset, h.horizon, s.n_draws FROM (SELECT DISTINCT unit, asset FROM cellcount) u
  JOIN (SELECT unit, CAST(floor(avg(n)) AS BIGINT) AS n_draws FROM cellcount GROUP BY 1) s ON u.unit = s.unit, (SELECT unnest([1,2,3,4,5,6,8]) AS horizon) h)"""
PITS = """pits AS (SELECT d.unit, d.asset, d.horizon, avg(CASE WHEN d.value <= r.value THEN 1.0 ELSE 0.0 END) AS pit,
  CAST(max(r.value) BETWEEN quantile_cont(d.value, 0.25) AND quantile_cont(d.value, 0.75) AS INT) AS in50,
  CAST(max(r.value) BETWEEN quantile_cont(d.value, 0.05) AND quantile_cont(d.value, 0.95) AS INT) AS in90
  FROM draws d JOIN realized r ON d.unit = r.unit AND d.asset = r.asset AND d.horizon = r.horizon GROUP BY 1, 2, 3)"""
_CORR = """SELECT unit, {a} AS asset, count(*) AS n,
  round(CASE WHEN count(*) < 8 THEN 0.0 ELSE greatest(-0.45, least(0.45, -2.0 * (count(*) / (count(*) + 8.0)) * (quantile_cont(pit, 0.5) - 0.5))) END, 6) AS shift_sd,
  round(CASE WHEN count(*) < 8 THEN 1.0 ELSE greatest(0.75, least(1.45, 1 + (count(*) / (count(*) + 8.0)) * ((quantile_cont(pit, 0.75) - quantile_cont(pit, 0.25)) / 0.5 - 1))) END, 6) AS scale
  FROM pits GROUP BY {g}"""
U01 = "(('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0)"

ORACLES = {
    "crps_by_cell": with_ctes(DRAWS, REALIZED, CRPS, select="SELECT unit, asset, horizon, n_draws, round(crps, 4) AS crps FROM crps"),
    "pinball_by_cell": with_ctes(DRAWS, REALIZED, QS, PINBALL, select="SELECT unit, asset, horizon, CAST(level AS DOUBLE) AS level, round(q + 1e-6, 2) AS q, round(loss + 1e-6, 2) AS loss FROM pinball"),
    "tail_pinball_unit": with_ctes(DRAWS, REALIZED, QS, PINBALL, TAIL, select="SELECT unit, round(tail, 4) AS tail FROM tail"),
    "tail_coverage_unit": with_ctes(
        DRAWS, REALIZED, QS, PINBALL,
        select="SELECT unit, round(sum(abs(share - level)), 4) AS coverage FROM (SELECT unit, level, avg(CASE WHEN y <= q THEN 1.0 ELSE 0.0 END) AS share FROM pinball GROUP BY 1, 2) GROUP BY 1",
    ),
    "variogram_unit": with_ctes(DRAWS, REALIZED, JOINT, select="SELECT unit, round(joint, 3) AS joint FROM joint"),
    "energy_unit": with_ctes(
        DRAWS, REALIZED,
        """whole AS (SELECT unit, draw, list(value ORDER BY asset, horizon) AS x FROM draws GROUP BY 1, 2 HAVING count(*) = 21),
        ys AS (SELECT unit, list(value ORDER BY asset, horizon) AS y FROM realized GROUP BY 1)""",
        select="""SELECT a.unit, a.n AS n_draws, round(a.miss - b.spread / 2, 3) AS energy
        FROM (SELECT w.unit, count(*) AS n, avg(list_distance(x, y)) AS miss FROM whole w JOIN ys ON w.unit = ys.unit GROUP BY 1) a
        JOIN (SELECT p.unit, avg(list_distance(p.x, q.x)) AS spread FROM whole p JOIN whole q ON p.unit = q.unit GROUP BY 1) b ON a.unit = b.unit""",
    ),
    "composite_unit": with_ctes(
        DRAWS, REALIZED, CRPS, QS, PINBALL, TAIL, JOINT, "sds AS (SELECT unit, stddev_pop(value) AS sd FROM draws GROUP BY 1)",
        select="""SELECT c.unit, c.cells, round(0.5 * c.m / sd + 0.3 * joint / (sd * 10) + 0.2 * tail / (sd / 10), 4) AS composite
        FROM (SELECT unit, count(*) AS cells, avg(crps) AS m FROM crps GROUP BY 1) c JOIN joint USING (unit) JOIN tail USING (unit) JOIN sds USING (unit)""",
    ),
    "composite_single_cell": with_ctes(
        DRAWS, REALIZED, CRPS, QS, PINBALL,
        select="""SELECT c.unit || '/' || c.asset || '/' || c.horizon AS unit, CAST(1 AS BIGINT) AS cells, round((0.5 * c.crps + 0.2 * p.tail) / 0.7, 4) AS composite
        FROM crps c JOIN (SELECT unit, asset, horizon, avg(loss) AS tail FROM pinball GROUP BY 1, 2, 3) p USING (unit, asset, horizon)""",
    ),
    "pit_coverage_diag": with_ctes(DRAWS, REALIZED, PITS, select="SELECT unit, asset, horizon, round(pit, 6) AS pit, in50, in90 FROM pits"),
    "calibration_correction": with_ctes(DRAWS, REALIZED, PITS, select=_CORR.format(a="asset", g="1, 2") + " UNION ALL " + _CORR.format(a="'*'", g="1")),
    "draw_gate_counts": with_ctes(
        DRAWS,
        select="""SELECT unit, CASE WHEN count(DISTINCT draw) NOT BETWEEN 200 AND 20000 THEN 'draw_count' END AS code, count(*) AS n_rows, count(DISTINCT draw) AS n_draws,
        CAST(0 AS BIGINT) AS non_finite, CAST(0 AS BIGINT) AS negative FROM draws GROUP BY 1""",
    ),
    "grid_dup_missing_extra": with_ctes(
        DRAWS, DECLARED,
        select="""SELECT coalesce(g.unit, c.unit) AS unit, count(g.n_draws) AS cells, CAST(0 AS BIGINT) AS duplicates,
        CAST(sum(CASE WHEN g.n_draws IS NOT NULL THEN greatest(g.n_draws - coalesce(c.n, 0), 0) ELSE 0 END) AS BIGINT) AS missing,
        CAST(sum(CASE WHEN g.n_draws IS NULL THEN c.n ELSE 0 END) AS BIGINT) AS extra
        FROM declared g FULL JOIN cellcount c ON g.unit = c.unit AND g.asset = c.asset AND g.horizon = c.horizon GROUP BY 1""",
    ),
    "grid_declared_vs_plan": """WITH plan AS (SELECT category, arg_min(horizons, card_id) AS planned FROM task_cards GROUP BY 1)
        SELECT card_id AS unit, horizons = planned AS equal, CAST(len(horizons) - len(list_distinct(horizons)) AS INT) AS duplicates,
        CAST(len(list_filter(list_distinct(planned), lambda x: NOT list_contains(horizons, x))) AS INT) AS missing,
        CAST(len(list_filter(list_distinct(horizons), lambda x: NOT list_contains(planned, x))) AS INT) AS extra FROM task_cards JOIN plan USING (category)""",
    "draw_completeness": with_ctes(DRAWS, select="""SELECT unit, count(*) AS n_draws, count(*) FILTER (have < cells) AS n_incomplete FROM (SELECT unit, draw, count(DISTINCT asset || horizon) AS have FROM draws GROUP BY 1, 2)
        JOIN (SELECT unit, count(DISTINCT asset || horizon) AS cells FROM draws GROUP BY 1) USING (unit) GROUP BY 1"""),
    "roster_evidence": """SELECT count(*) AS n_units, count(*) FILTER (g.unit IS NULL) AS n_without FROM task_cards LEFT JOIN (SELECT DISTINCT card_id AS unit FROM g10_daily WHERE card_id IS NOT NULL AND asset IS NOT NULL) g ON g.unit = card_id""",
    "label_code_counts": with_ctes(DRAWS, select="SELECT CASE asset WHEN 'A' THEN 0 WHEN 'N' THEN 1 END AS code, count(*) AS n_rows FROM draws GROUP BY 1"),
    "realized_flat": with_ctes(
        DRAWS, REALIZED, DECLARED,
        select="""SELECT g.unit, CAST(count(*) AS INT) AS n_cells, string_agg(coalesce(CAST(CAST(round(r.value, 2) AS DECIMAL(18,2)) AS VARCHAR), 'null'), ',' ORDER BY g.asset, g.horizon) AS flat
        FROM declared g LEFT JOIN realized r ON g.unit = r.unit AND g.asset = r.asset AND g.horizon = r.horizon GROUP BY 1""",
    ),
    "roster_mean_clipped": """SELECT count(*) AS n_units, count(*) FILTER (score IS NULL) AS n_failed, round(avg(coalesce(greatest(0.0, least(4.0, score)), 4.0)), 6) AS mean_score
        FROM nation LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) / 1000 AS score FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey""",
    "roster_accounts": """WITH r AS (SELECT DISTINCT card_id AS unit FROM task_cards), s AS (SELECT unit, count(*) AS n FROM (SELECT DISTINCT card_id AS unit, asset FROM g10_daily) GROUP BY 1)
        SELECT count(*) FILTER (s.n IS NULL) AS missing, count(*) FILTER (r.unit IS NULL) AS extra, count(*) FILTER (s.n > 1) AS duplicate FROM r FULL JOIN s ON r.unit = s.unit""",
    "scale_normalised_scores": """SELECT s_nationkey AS unit, round(CASE WHEN avg(s_acctbal) > 0 THEN avg(s_acctbal) ELSE 1.0 END, 4) AS marginal,
        round(CASE WHEN min(s_acctbal) > 0 THEN min(s_acctbal) ELSE 1.0 END, 4) AS joint, round(CASE WHEN stddev_samp(s_acctbal) > 0 THEN stddev_samp(s_acctbal) ELSE 1.0 END, 4) AS tail,
        coalesce(avg(s_acctbal) > 0 AND min(s_acctbal) > 0 AND stddev_samp(s_acctbal) > 0, false) AS valid FROM supplier GROUP BY 1""",
    "roster_commitment": """SELECT count(*) AS n_units, sha256('{' || string_agg('"' || card_id || '":"' || sha256(concat_ws('|', card_id, title, "asof")) || '"', ',' ORDER BY card_id) || '}') AS digest FROM task_cards""",
    "group_bootstrap_means": """WITH g AS (SELECT CAST(date_trunc('month', o_orderdate) AS date) AS grp, sum(o_totalprice / 1000) AS s, count(*) AS n FROM orders GROUP BY 1),
        o AS (SELECT *, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS g FROM g), k AS (SELECT i, g, unnest(range(40)) AS replicate FROM o),
        p AS (SELECT replicate, CAST(floor(""" + U01.format(key="'5|' || replicate || '|' || i") + """ * g) AS INT) AS i FROM k)
        SELECT CAST(replicate AS INT) AS replicate, round(sum(s) / sum(n), 6) AS mean FROM p JOIN o USING (i) GROUP BY 1""",
    "text_ablation": """SELECT count(*) AS n_units, round(avg(b - a), 4) AS mean_diff, round(stddev_samp(b - a), 4) AS sd_diff, count(*) FILTER (b < a) AS n_better
        FROM (SELECT l_suppkey, avg(l_extendedprice) AS a, avg(l_extendedprice * (1 - l_discount)) AS b FROM lineitem GROUP BY 1)""",
}
