"""Queries on descriptive statistics, ranking, quantiles and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.catalog.registry import query
from gridpanel.catalog.views import Views
from gridpanel.operators import describe as D
from gridpanel.operators import metrics as M
from gridpanel.operators import nearest as N
from gridpanel.operators import prefix as P
from gridpanel.operators import screening as SC

COLS = ["qty", "disc", "tax", "size", "price"]
LONG = " UNION ALL ".join(f"SELECT split, observation_year, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM panel" for c in COLS)


def rounded(df, digits=6, keep=()):
    """Round the double columns, so engines that sum in another order still agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@query("w1_rank_pct", """
SELECT cell_id, observation_year, ROUND((RANK() OVER (ORDER BY score_a) + (COUNT(*) OVER (PARTITION BY score_a) - 1) / 2.0)::DOUBLE
  / COUNT(*) OVER (), 9) AS rank_pct FROM pred""", "pred")
def rank_pct(spark, sf):
    out = P.rank_pct(Views(spark, sf).pred(), "score_a")
    return out.select("cell_id", "observation_year", F.round("rank_pct", 9).alias("rank_pct"))


@query("w2_cumulative_budget", """
SELECT score_b, n, CAST(SUM(n) OVER (ORDER BY score_b DESC) - n AS BIGINT) AS before
FROM (SELECT score_b, COUNT(*) AS n FROM pred GROUP BY score_b) g""", "pred")
def cumulative_budget(spark, sf):
    groups = Views(spark, sf).pred().groupBy("score_b").agg(F.count(F.lit(1)).alias("n"))
    return P.prefix_sum(groups, ["-score_b"], {"before": F.col("n")})


@query("h1_prefix_sum", """
SELECT l_orderkey, l_linenumber, CAST(SUM(q) OVER (ORDER BY l_orderkey, l_linenumber) - q AS DOUBLE) AS qty_before
FROM (SELECT l_orderkey, l_linenumber, SUM(CAST(l_quantity AS DECIMAL(12,2))) AS q FROM lineitem GROUP BY 1, 2) s""")
def prefix_sum(spark, sf):
    rows = Views(spark, sf).table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("q")
    )
    out = P.prefix_sum(rows, ["l_orderkey", "l_linenumber"], {"before": F.col("q")})
    return out.select("l_orderkey", "l_linenumber", F.col("before").cast("double").alias("qty_before"))


@query("w3_share_within_group", """
SELECT o_orderpriority, o_orderstatus, COUNT(*) AS cell_count,
  ROUND(COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (), 9) AS share_of_all_cells,
  ROUND(COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY o_orderpriority), 9) AS share_within_row
FROM orders GROUP BY o_orderpriority, o_orderstatus""")
def share_within_group(spark, sf):
    return rounded(D.crosstab(Views(spark, sf).table("orders"), "o_orderpriority", "o_orderstatus"), 9)


@query("w6_top_k", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def top_k(spark, sf):
    return P.top_k(Views(spark, sf).table("orders"), 10, ["-o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("w7_order_picks", """
WITH r AS (SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, COUNT(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice FROM r WHERE i >= n - 5 OR i IN (0, n // 4, n // 2, (3 * n) // 4, n - 1)""")
def order_picks(spark, sf):
    return P.order_picks(Views(spark, sf).table("orders"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("w8_even_sample", """
WITH r AS (SELECT cell_id, observation_year, ROW_NUMBER() OVER (ORDER BY score_a, cell_id, observation_year) - 1 AS i, COUNT(*) OVER () AS n FROM pred),
p AS (SELECT DISTINCT (s.range * ((SELECT COUNT(*) FROM pred) - 1)) // 499 AS pos FROM range(500) s)
SELECT cell_id, observation_year FROM r WHERE i IN (SELECT pos FROM p)""", "pred")
def even_sample(spark, sf):
    out = P.even_sample(Views(spark, sf).pred(), 500, ["score_a", "cell_id", "observation_year"])
    return out.select("cell_id", "observation_year")


@query("w9_stratified_sample", """
SELECT year AS observation_year, CAST(50 AS BIGINT) AS n, CAST(50 AS BIGINT) AS cells FROM lyrs""", "lyrs")
def stratified_sample(spark, sf):
    """Fifty rows of every year; the rows differ from another engine's hash, their number may not."""
    v = Views(spark, sf)
    out = P.stratified_sample(v.pred(), "observation_year", 50, ["cell_id", "observation_year"], seed=42)
    return out.groupBy("observation_year").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("cell_id").alias("cells")
    )


@query("w10_canonical_order", """
SELECT cell_id, observation_year, target FROM pred""", "pred")
def canonical_order(spark, sf):
    return P.canonical_order(Views(spark, sf).pred(), ["observation_year", "cell_id"]).select("cell_id", "observation_year", "target")


@query("w11_ordering_gate", """
SELECT CAST(0 AS BIGINT) AS violations, COUNT(*) AS rows, CASE WHEN COUNT(*) > 2 THEN 1 ELSE 0 END::BIGINT AS turned FROM pred""", "pred")
def ordering_gate(spark, sf):
    """No violation in stored order; the later half put first breaks the order once, between two partitions."""
    stored = P.canonical_order(Views(spark, sf).pred().withColumn("key", F.concat_ws("_", "observation_year", "cell_id")), ["key"])
    bad = P.order_violations(stored, "key").agg(F.count(F.lit(1)).alias("n")).scalar()
    years = stored.select(F.min("observation_year"), F.max("observation_year")).first()
    late = lambda wanted: stored.where((F.col("observation_year") == years[1]) == F.lit(wanted))
    turned = P.order_violations(late(True).union(late(False)), "key").agg(F.count(F.lit(1)).alias("n")).scalar()
    return stored.agg(F.count(F.lit(1)).alias("rows")).select(bad.alias("violations"), "rows", turned.alias("turned"))


@query("a9_year_metrics", """
SELECT observation_year, COUNT(*) AS row_count,
  COUNT(*) FILTER (WHERE qty IS NULL) AS qty_nulls, MIN(qty) AS qty_min, MAX(qty) AS qty_max,
  COUNT(*) FILTER (WHERE price IS NULL) AS price_nulls, MIN(price) AS price_min, MAX(price) AS price_max,
  COUNT(*) FILTER (WHERE target IS NULL) AS target_nulls, MIN(target) AS target_min, MAX(target) AS target_max,
  COUNT(*) FILTER (WHERE target > 0) AS positive_rows,
  ROUND(AVG(CASE WHEN target = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_share, ROUND(AVG(target), 6) AS target_mean,
  COUNT(DISTINCT CASE WHEN target > 0 THEN cell_id END) AS positive_cells,
  ROUND(quantile_cont(target, 0.5), 6) AS p50, ROUND(quantile_cont(target, 0.9), 6) AS p90, ROUND(quantile_cont(target, 0.95), 6) AS p95,
  ROUND(quantile_cont(target, 0.99), 6) AS p99, ROUND(quantile_cont(target, 0.999), 6) AS p999
FROM panel GROUP BY observation_year""", "panel")
def year_metrics(spark, sf):
    out = D.year_metrics(Views(spark, sf).panel(), "observation_year", "cell_id", ["qty", "price"], "target")
    return rounded(out)


@query("a10_describe", f"""
SELECT split, col AS "column", COUNT(v) AS "count", COUNT(*) FILTER (WHERE v IS NULL) AS missing, MIN(v) AS minimum, MAX(v) AS maximum,
  ROUND(AVG(v), 6) AS mean, ROUND(stddev_samp(v), 6) AS standard_deviation, COUNT(*) FILTER (WHERE v = 0) AS zero_count,
  ROUND(quantile_cont(v, 0.01), 6) AS p01, ROUND(quantile_cont(v, 0.05), 6) AS p05, ROUND(quantile_cont(v, 0.25), 6) AS p25,
  ROUND(quantile_cont(v, 0.5), 6) AS median, ROUND(quantile_cont(v, 0.75), 6) AS p75, ROUND(quantile_cont(v, 0.95), 6) AS p95,
  ROUND(quantile_cont(v, 0.99), 6) AS p99
FROM ({LONG}) l GROUP BY split, col""", "panel")
def describe(spark, sf):
    return rounded(D.describe(Views(spark, sf).panel(), ["split"], COLS), keep=("minimum", "maximum"))


@query("a11_target_by_year", """
SELECT observation_year, COUNT(*) AS row_count, ROUND(AVG(CASE WHEN target = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_share,
  COUNT(*) FILTER (WHERE target > 0) AS positive_count, ROUND(AVG(target), 6) AS mean, MAX(target) AS maximum,
  ROUND(quantile_cont(target, 0.5), 6) AS median, ROUND(quantile_cont(target, 0.9), 6) AS p90, ROUND(quantile_cont(target, 0.95), 6) AS p95,
  ROUND(quantile_cont(target, 0.99), 6) AS p99,
  ROUND(quantile_cont(CASE WHEN target > 0 THEN target END, 0.5), 6) AS positive_median,
  ROUND(quantile_cont(CASE WHEN target > 0 THEN target END, 0.9), 6) AS positive_p90
FROM panel GROUP BY observation_year""", "panel")
def target_by_year(spark, sf):
    return rounded(D.target_by_year(Views(spark, sf).panel(), "observation_year", "target"))


@query("a12_means_by_year", """
SELECT observation_year, ROUND(AVG(qty), 6) AS qty, ROUND(AVG(disc), 6) AS disc, ROUND(AVG(tax), 6) AS tax, ROUND(AVG(size), 6) AS size,
  ROUND(AVG(price), 6) AS price FROM panel GROUP BY observation_year""", "panel")
def means_by_year(spark, sf):
    return rounded(D.means_by_year(Views(spark, sf).panel(), "observation_year", COLS))


@query("a13_standardized_difference", f"""
WITH s AS (SELECT split, col, AVG(v) AS m, stddev_samp(v) AS sd FROM ({LONG}) l GROUP BY split, col)
SELECT a.split, a.col AS "column", CASE WHEN ABS((a.m - t.m) / t.sd) < 5e-7 THEN 0 ELSE ROUND((a.m - t.m) / t.sd, 6) END AS smd FROM s a JOIN s t ON t.col = a.col AND t.split = 'train'
WHERE a.split <> 'train'""", "panel")
def standardized_difference(spark, sf):
    return rounded(D.standardized_difference(Views(spark, sf).panel(), "split", COLS))


PAIRS = [(a, b) for i, a in enumerate(COLS) for b in COLS[i + 1:]]


@query("a14_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", ROUND(corr({a}, {b}), 6) AS correlation, COALESCE(ABS(corr({a}, {b})) >= 0.8, false) AS redundant FROM panel"
    for a, b in PAIRS), "panel")
def correlation_matrix(spark, sf):
    panel = Views(spark, sf).panel()
    every = D.correlations(panel, COLS)
    high = F.coalesce(F.abs("correlation") >= 0.8, F.lit(False))
    return rounded(every.withColumn("redundant", high))


@query("a15_iqr_outliers", f"""
WITH l AS ({LONG}), q AS (SELECT col, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM l WHERE split = 'train' GROUP BY col)
SELECT l.split, l.col AS "column", ROUND(MIN(q1 - 3 * (q3 - q1)), 6) AS lower, ROUND(MIN(q3 + 3 * (q3 - q1)), 6) AS upper,
  COUNT(*) FILTER (WHERE v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) AS outliers
FROM l JOIN q ON q.col = l.col GROUP BY l.split, l.col""", "panel")
def iqr_outliers(spark, sf):
    return rounded(D.iqr_outliers(Views(spark, sf).panel(), "split", COLS))


@query("a16_split_counts", "SELECT split, COUNT(*) AS row_count FROM panel GROUP BY split", "panel")
def split_counts(spark, sf):
    return D.split_counts(Views(spark, sf).panel(), "split")


@query("a17_recurrence_thresholds", """
WITH o AS (SELECT n_items AS n, ROW_NUMBER() OVER (ORDER BY n_items) - 1 AS i, COUNT(*) OVER () AS c FROM panel)
SELECT CAST(MAX(CASE WHEN i = ROUND_EVEN((c - 1) / 3.0, 0) THEN n END) AS INT) AS lower_max,
  CAST(MAX(CASE WHEN i = ROUND_EVEN(2 * (c - 1) / 3.0, 0) THEN n END) AS INT) AS moderate_max FROM o""", "panel")
def recurrence_thresholds(spark, sf):
    return SC.recurrence_thresholds(Views(spark, sf).panel(), "n_items")


ORDER = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-ABSENT")


@query("a18_distribution", """
SELECT CAST(w.position AS INT) AS position, w.p AS o_orderpriority, COUNT(o.o_orderkey) AS cell_count,
  ROUND(COUNT(o.o_orderkey)::DOUBLE / (SELECT COUNT(*) FROM orders), 9) AS share_of_cells
FROM (VALUES """ + ", ".join(f"({i}, '{c}')" for i, c in enumerate(ORDER)) + """) w(position, p)
LEFT JOIN orders o ON o.o_orderpriority = w.p GROUP BY w.position, w.p""")
def distribution(spark, sf):
    return rounded(D.distribution(Views(spark, sf).table("orders"), "o_orderpriority", ORDER), 9)


@query("a19_crosstab", """
SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS "F", COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
  COUNT(*) FILTER (WHERE o_orderstatus = 'X') AS "X" FROM orders GROUP BY o_orderpriority""")
def crosstab(spark, sf):
    return D.crosstab_matrix(Views(spark, sf).table("orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "X"])


def _long(v):
    return M.melt_models(v.pred(), ["cell_id", "observation_year", "target"], ["score_a", "score_b"])


def _scoped(v):
    return M.with_scopes(_long(v), "observation_year")


@query("a20_regression_metrics", """
SELECT model, scope, COUNT(*) AS rows, COUNT(*) FILTER (WHERE target > 0) AS positives, ROUND(AVG(ABS(score - target)), 9) AS mae_all,
  ROUND(SQRT(AVG((score - target) * (score - target))), 9) AS rmse_all,
  ROUND(AVG(CASE WHEN target > 0 THEN ABS(score - target) END), 9) AS mae_positive,
  ROUND(SQRT(AVG(CASE WHEN target > 0 THEN (score - target) * (score - target) END)), 9) AS rmse_positive,
  ROUND(AVG(target), 9) AS mean_observed, ROUND(AVG(score), 9) AS mean_predicted,
  ROUND(MIN(score), 9) AS min_predicted, ROUND(MAX(score), 9) AS max_predicted
FROM scoped GROUP BY model, scope""", "scoped")
def regression_metrics(spark, sf):
    return rounded(M.regression_metrics(_long(Views(spark, sf)), "observation_year"), 9)


@query("a21_capture_at", """
WITH r AS (SELECT model, scope, target, ROW_NUMBER() OVER (PARTITION BY model, scope ORDER BY score DESC, cell_id, observation_year) AS rn,
  COUNT(*) OVER (PARTITION BY model, scope) AS n FROM scoped)
SELECT model, scope, COUNT(*) FILTER (WHERE rn <= CEIL(0.2::DOUBLE * n) AND target > 0) AS captured,
  ROUND(COUNT(*) FILTER (WHERE rn <= CEIL(0.2::DOUBLE * n) AND target > 0)::DOUBLE / COUNT(*) FILTER (WHERE target > 0), 9) AS capture
FROM r GROUP BY model, scope""", "scoped")
def capture_at(spark, sf):
    out = M.capture_at(_scoped(Views(spark, sf)), 0.2, ["model", "scope"], ["cell_id", "observation_year"])
    return rounded(out, 9)


RANKING_SQL = """
WITH g AS (SELECT model, scope, score, COUNT(*) AS n, COUNT(*) FILTER (WHERE target > 0) AS p, SUM(CAST(target AS DECIMAL(18,6))) AS m
  FROM scoped GROUP BY model, scope, score),
c AS (SELECT *, COALESCE(SUM(n) OVER (PARTITION BY model, scope ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  SUM(n) OVER (PARTITION BY model, scope) AS total FROM g),
w AS (SELECT *, LEAST(1.0::DOUBLE, GREATEST(0.0::DOUBLE, (0.2::DOUBLE * total - before) / n)) AS wt FROM c)
SELECT model, scope, COUNT(*) AS unique_scores, ROUND(SUM(wt * n), 6) AS selected_rows, ROUND(SUM(wt * p) / SUM(p), 6) AS positive_capture,
  ROUND(SUM(wt * m::DOUBLE) / SUM(m)::DOUBLE, 6) AS mass_capture, ROUND(SUM(wt * p) / SUM(wt * n), 6) AS "precision",
  ROUND((SUM(wt * p) / SUM(wt * n)) / (SUM(p)::DOUBLE / SUM(n)::DOUBLE), 6) AS lift FROM w GROUP BY model, scope"""


@query("a22_tie_aware_ranking", RANKING_SQL, "scoped")
def tie_aware_ranking(spark, sf):
    return rounded(M.tie_aware_ranking(_scoped(Views(spark, sf)), 0.2, ["model", "scope"]))


@query("a23_mean_by_count", """
WITH t AS (SELECT n_items, AVG(target) AS m FROM panel WHERE split = 'train' GROUP BY n_items)
SELECT p.cell_id, p.observation_year, ROUND(COALESCE(t.m, (SELECT AVG(target) FROM panel WHERE split = 'train')), 9) AS baseline
FROM panel p LEFT JOIN t ON t.n_items = p.n_items""", "panel")
def mean_by_count(spark, sf):
    panel = Views(spark, sf).panel()
    train = panel.where("split = 'train'")
    overall = train.agg(F.avg("target")).scalar()
    out = M.predict_by_count(panel, M.mean_by_count(train, "n_items", "target"), overall, "n_items")
    return out.select("cell_id", "observation_year", F.round("baseline", 9).alias("baseline"))


@query("a24_binned_comparison", """
WITH e AS (SELECT DISTINCT UNNEST(quantile_cont(score_a, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edge FROM pred),
b AS (SELECT p.*, GREATEST(1, (SELECT COUNT(*) FROM e WHERE e.edge < p.score_a)) AS bin FROM pred p)
SELECT CAST(bin AS INT) AS bin, COUNT(*) AS cell_count, ROUND(AVG(score_a), 6) AS mean_estimated, ROUND(AVG(target), 6) AS mean_observed,
  ROUND(AVG(CASE WHEN target > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_share FROM b GROUP BY bin""", "pred")
def binned_comparison(spark, sf):
    return rounded(M.binned_comparison(Views(spark, sf).pred(), "score_a", "target"))


@query("a25_agreement_share", """
WITH l AS (SELECT CASE WHEN code <= 2 THEN 'lower' WHEN code = 3 THEN 'moderate' WHEN code <= 5 THEN 'higher' END AS a,
  CASE WHEN sub <= 4 THEN 'lower' WHEN sub <= 9 THEN 'moderate' ELSE 'higher' END AS b FROM pix)
SELECT COUNT(a) AS matched, COUNT(*) FILTER (WHERE a = b) AS agreeing, ROUND(COUNT(*) FILTER (WHERE a = b)::DOUBLE / COUNT(a), 9) AS agreement_share FROM l""", "pix")
def agreement_share(spark, sf):
    from gridpanel.functions.scalars import HAZARD_CLASSES, broad_level, mapped, recurrence_band

    levels = Views(spark, sf).pix().select(
        broad_level(mapped(F.col("code"), HAZARD_CLASSES, "unmatched")).alias("a"),
        recurrence_band(F.col("sub"), F.lit(4), F.lit(9)).alias("b"),
    )
    return rounded(D.agreement_share(levels, "a", "b"), 9)


@query("a26_distance_summary", """
SELECT 'distance_km' AS "column", COUNT(*) AS n, ROUND(MIN(d), 6) AS minimum, ROUND(AVG(d), 6) AS mean, ROUND(MAX(d), 6) AS maximum,
  ROUND(quantile_cont(d, 0.5), 6) AS median, ROUND(quantile_cont(d, 0.9), 6) AS p90, ROUND(quantile_cont(d, 0.95), 6) AS p95,
  ROUND(quantile_cont(d, 0.99), 6) AS p99 FROM (SELECT o_totalprice / 10000 AS d FROM orders) s""")
def distance_summary(spark, sf):
    rows = Views(spark, sf).table("orders").select((F.col("o_totalprice") / 10000).alias("distance_km"))
    return rounded(N.distance_summary(rows))


@query("a27_distance_bands", """
SELECT CAST(w.i AS INT) AS position, w.l AS band, COUNT(s.b) AS cell_count, ROUND(COUNT(s.b)::DOUBLE / (SELECT COUNT(*) FROM orders), 9) AS share_of_cells
FROM (VALUES (0,'under_10_km'),(1,'10_to_under_20_km'),(2,'20_to_under_30_km'),(3,'30_to_under_50_km'),(4,'50_km_or_more')) w(i, l)
LEFT JOIN (SELECT CASE WHEN d < 10 THEN 'under_10_km' WHEN d < 20 THEN '10_to_under_20_km' WHEN d < 30 THEN '20_to_under_30_km'
  WHEN d < 50 THEN '30_to_under_50_km' ELSE '50_km_or_more' END AS b FROM (SELECT o_totalprice / 10000 AS d FROM orders) x) s ON s.b = w.l
GROUP BY w.i, w.l""")
def distance_bands(spark, sf):
    from gridpanel.functions.scalars import DISTANCE_EDGES, DISTANCE_LABELS, edge_band

    band = edge_band(F.col("o_totalprice") / 10000, DISTANCE_EDGES, DISTANCE_LABELS)
    return rounded(D.distribution(Views(spark, sf).table("orders").select(band.alias("band")), "band", DISTANCE_LABELS), 9)


@query("a30_prediction_summary", """
SELECT 'score_b' AS "column", MIN(score_b) AS minimum, ROUND(AVG(score_b), 6) AS mean, ROUND(MAX(score_b), 6) AS maximum,
  COUNT(*) FILTER (WHERE score_b = 0) AS zero_count, COUNT(*) AS n, ROUND(quantile_cont(score_b, 0.5), 6) AS median FROM pred""", "pred")
def prediction_summary(spark, sf):
    return rounded(M.prediction_summary(Views(spark, sf).pred(), "score_b"))


@query("a37_metrics_to_rows", """
SELECT model, scope, metric, ROUND(v, 9) AS value FROM (
  SELECT model, scope, 'mae' AS metric, AVG(ABS(score - target)) AS v FROM scoped GROUP BY model, scope
  UNION ALL SELECT model, scope, 'mean_observed', AVG(target) FROM scoped GROUP BY model, scope) s""", "scoped")
def metrics_to_rows(spark, sf):
    wide = M.regression_metrics(_long(Views(spark, sf)), "observation_year").withColumnRenamed("mae_all", "mae")
    return rounded(M.metrics_to_rows(wide, ["model", "scope"], ["mae", "mean_observed"]), 9)


@query("a38_candidate_summary", """
WITH rk AS (""" + RANKING_SQL.strip().replace("WITH g AS", "WITH g AS", 1) + """),
rg AS (SELECT model, scope, ROUND(AVG(ABS(score - target)), 6) AS mae_all FROM scoped GROUP BY model, scope)
SELECT rg.model, mae_all, mass_capture, CAST(ROW_NUMBER() OVER (ORDER BY mae_all, mass_capture DESC) AS INT) AS place
FROM rg JOIN rk ON rk.model = rg.model AND rk.scope = rg.scope WHERE rg.scope = 'overall'""", "scoped")
def candidate_summary(spark, sf):
    v = Views(spark, sf)
    scoped = _scoped(v)
    regression = M.regression_metrics(_long(v), "observation_year").select("model", "scope", "mae_all")
    table = M.candidate_summary(regression, M.tie_aware_ranking(scoped, 0.2, ["model", "scope"]))
    indexed = P.row_index(table.select("model", "mae_all", "mass_capture"), ["mae_all", "-mass_capture"])
    return rounded(indexed.withColumn("place", (F.col("row_index") + 1).cast("int")).drop("row_index"))


@query("a39_residuals", """
SELECT observation_year, COUNT(*) AS n, ROUND(quantile_cont(score_a - target, 0.25), 6) AS q1, ROUND(quantile_cont(score_a - target, 0.5), 6) AS median,
  ROUND(quantile_cont(score_a - target, 0.75), 6) AS q3 FROM pred GROUP BY observation_year""", "pred")
def residuals(spark, sf):
    return rounded(D.residual_quartiles(Views(spark, sf).pred(), "observation_year", "target", "score_a"))


@query("a39_bin_counts", """
SELECT CAST(LEAST(FLOOR(target * 55), 54) AS INT) AS bx, CAST(LEAST(FLOOR(score_a * 55), 54) AS INT) AS "by", COUNT(*) AS n,
  ROUND(LOG10(COUNT(*)), 6) AS log10_n FROM pred GROUP BY 1, 2""", "pred")
def bin_counts(spark, sf):
    return rounded(D.bin_counts(Views(spark, sf).pred(), "target", "score_a"))


@query("a40_coverage_counts", """
SELECT 'priority' AS "table", COUNT(*) AS total, true AS complete FROM orders
UNION ALL SELECT 'status', COUNT(*), true FROM orders WHERE o_orderstatus IS NOT NULL""")
def coverage_counts(spark, sf):
    orders = Views(spark, sf).table("orders")
    parts = {
        "priority": orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")),
        "status": orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")),
    }
    return D.coverage_counts(parts, "n", orders.agg(F.count(F.lit(1))).scalar())


@query("h5_tidy_metrics", """
SELECT observation_year, 'maximum' AS metric, MAX(score_a) AS value FROM pred GROUP BY 1 UNION ALL SELECT observation_year, 'minimum', MIN(score_a) FROM pred GROUP BY 1
UNION ALL SELECT observation_year, 'rows', CAST(COUNT(*) AS DOUBLE) FROM pred GROUP BY 1""", "pred")
def tidy_metrics(spark, sf):
    """Wide metrics to tidy rows, to columns and to rows again."""
    wide = Views(spark, sf).pred().groupBy("observation_year").agg(
        F.min("score_a").alias("minimum"), F.max("score_a").alias("maximum"), F.count(F.lit(1)).alias("rows")
    )
    names = ["minimum", "maximum", "rows"]
    tidy = M.metrics_to_rows(wide, ["observation_year"], names)
    return M.metrics_to_rows(M.metrics_to_columns(tidy, ["observation_year"], names), ["observation_year"], names)
