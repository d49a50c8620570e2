"""Queries on composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.catalog.grid_time import DESIGN
from gridpanel.catalog.models_lookup import FEATURES, KEY, SUMMARY_SQL, checked_summary
from gridpanel.catalog.publish_gates import contract_panel, published_scores
from gridpanel.catalog.registry import query
from gridpanel.catalog.stats_ranking import rounded
from gridpanel.catalog.vector import CONTEXT_SQL, TOUCH_SQL
from gridpanel.catalog.views import Views, cut_id
from gridpanel.contract import FieldRule, PanelContract
from gridpanel.operators import compare as CM
from gridpanel.operators import models as MD
from gridpanel.plans import jobs as J
from gridpanel.plans import panel as PP

HITS_SQL = """
off AS (SELECT dx.range - 3 AS dx, dy.range - 3 AS dy FROM range(7) dx, range(7) dy
  WHERE sqrt(pow(greatest(abs(dx.range - 3) - 1, 0), 2) + pow(greatest(abs(dy.range - 3) - 1, 0), 2)) <= 2),
hit AS (SELECT DISTINCT n.k, b.year FROM burn b JOIN cell s ON s.k = b.k JOIN off o ON b.share >= 0.9 JOIN cell n ON n.ix = s.ix + o.dx AND n.iy = s.iy + o.dy)"""


@query("b0_recurrence_ranking", f"""
WITH {HITS_SQL},
r AS (SELECT c.k, c.cell_id, y.year AS observation_year, CAST(COUNT(h.year) AS INT) AS events_previous_years FROM cell c CROSS JOIN lyrs y
  LEFT JOIN hit h ON h.k = c.k AND h.year BETWEEN y.year - 3 AND y.year - 1 GROUP BY 1, 2, 3),
t AS (SELECT r.*, COALESCE(b.share, 0.0::DOUBLE) AS share_next_year FROM r LEFT JOIN burn b ON b.k = r.k AND b.year = r.observation_year + 1),
m AS (SELECT events_previous_years, AVG(CAST(share_next_year AS DECIMAL(18,6)))::DOUBLE AS v FROM t WHERE observation_year <= 1997 GROUP BY 1),
e AS (SELECT t.*, COALESCE(m.v, (SELECT AVG(share_next_year) FROM t WHERE observation_year <= 1997)) AS estimate FROM t LEFT JOIN m USING (events_previous_years))
SELECT cell_id, observation_year, events_previous_years, share_next_year, ROUND(estimate, 9) AS estimate,
  ROUND((RANK() OVER (ORDER BY estimate) + (COUNT(*) OVER (PARTITION BY estimate) - 1) / 2.0)::DOUBLE / COUNT(*) OVER (), 9) AS rank_pct FROM e""", "cell burn lyrs")
def recurrence_ranking(spark, sf):
    v = Views(spark, sf)
    out = J.recurrence_ranking(
        v.cell(), v.burn(), v.cell_years(), v.years(), 1997, cell_size=1000, context=2000, window=3, threshold=0.9
    )
    return out.select(
        "cell_id", "observation_year", "events_previous_years", "share_next_year",
        F.round("estimate", 9).alias("estimate"), F.round("rank_pct", 9).alias("rank_pct"),
    )


@query("b1_build_panel", f"""
WITH {CONTEXT_SQL}, {TOUCH_SQL},
gs AS (SELECT DISTINCT CAST(FLOOR(x / 250) AS INT) AS gx, CAST(FLOOR(y / 250) AS INT) AS gy, year FROM lat),
hy AS (SELECT DISTINCT c.cell_id, gs.year FROM cell c CROSS JOIN tch w JOIN gs ON gs.gx = c.ix * 4 + w.lx AND gs.gy = c.iy * 4 + w.ly),
sh AS (SELECT CAST(FLOOR(gx / 4) AS INT) AS ix, CAST(FLOOR(gy / 4) AS INT) AS iy, year, COUNT(*) / 16.0::DOUBLE AS share FROM gs GROUP BY 1, 2, 3),
ky AS (SELECT c.*, y.year AS observation_year FROM cell c CROSS JOIN lyrs y WHERE y.year >= (SELECT MIN(year) + 3 FROM yrs)),
cv AS (SELECT CAST(FLOOR(x / 1000) AS INT) AS ix, CAST(FLOOR(y / 1000) AS INT) AS iy, COUNT(DISTINCT x * 100000 + y) / 16.0::DOUBLE AS s FROM lat WHERE code = '311' GROUP BY 1, 2),
cl AS (SELECT lat_idx, lon_idx, year, AVG(t2m_k) AS t, CASE WHEN COUNT(tp_m) > 0 THEN SUM(tp_m * CASE WHEN month IN (7, 8) THEN 31 ELSE 30 END * 1000) END AS p FROM clim GROUP BY 1, 2, 3),
near AS (SELECT * FROM (SELECT c.cell_id, s.lat_idx, s.lon_idx, ROW_NUMBER() OVER (PARTITION BY c.cell_id ORDER BY
  CASE WHEN s.lat_idx = FLOOR(c.iy / 10) AND s.lon_idx = FLOOR(c.ix / 10) THEN -1 ELSE pow(c.x0 + 500 - s.sx, 2) + pow(c.y0 + 500 - s.sy, 2) END, s.lat_idx, s.lon_idx) AS rn
  FROM cell c JOIN axis_src s ON s.valid) z WHERE rn = 1)
SELECT ky.cell_id, ky.observation_year, CAST((SELECT COUNT(*) FROM hy WHERE hy.cell_id = ky.cell_id AND hy.year BETWEEN ky.observation_year - 3 AND ky.observation_year - 1) AS INT) AS events,
  ROUND(COALESCE(sh.share, 0), 9) AS share_next_year, ROUND(COALESCE(cv.s, 0), 9) AS forest_share, ROUND(cl.t, 6) AS mean_t2m_k, ROUND(cl.p, 6) AS total_tp_m
FROM ky LEFT JOIN sh ON sh.ix = ky.ix AND sh.iy = ky.iy AND sh.year = ky.observation_year + 1 LEFT JOIN cv ON cv.ix = ky.ix AND cv.iy = ky.iy
JOIN near ON near.cell_id = ky.cell_id LEFT JOIN cl ON cl.lat_idx = near.lat_idx AND cl.lon_idx = near.lon_idx AND cl.year = ky.observation_year""", "cell lat lyrs yrs clim axis_src")
def build_panel(spark, sf):
    """Polygons, pixels and coarse climate to a panel of all years with a whole history, every cell by an id of its own."""
    v = Views(spark, sf, uncut=True)
    years = [y for y in v.labelled_years() if y >= v.years()[0] + 3]
    refs = F.array(F.lit(1990), F.lit(1994), F.lit(1998))
    cover = v.polygons().select("code", "rings", F.explode(refs).alias("ref_year"))
    # one elevation pixel per 1 km cell keeps the layer as wide as the grid
    elevation = v.cell().join(v.table("part").select(F.col("p_partkey").alias("k"), "p_retailprice"), "k").select(
        F.col("iy").alias("row"), F.col("ix").alias("col"), F.col("p_retailprice").alias("value")
    )
    panel = PP.build_panel(
        v.cell(), v.polygons().select("year", "rings"), cover, elevation, v.clim(), DESIGN, years, cell_size=1000, context=2000,
        pixel=1000, classes={"forest": ["311"]}, source_size=10000, variables=["t2m_k", "tp_m"],
    )
    return rounded(
        panel.select(
            cut_id().alias("cell_id"), "observation_year", F.col("events_previous_years").alias("events"), F.round("share_next_year", 9).alias("share_next_year"),
            F.round("forest_share", 9).alias("forest_share"), "mean_t2m_k", "total_tp_m",
        ),
        6, keep=("share_next_year", "forest_share"),
    )


@query("b2_extend_panel_back", """
SELECT observation_year, COUNT(*) AS rows, CAST(0 AS BIGINT) AS changed FROM pred GROUP BY observation_year""", "pred")
def extend_panel_back(spark, sf):
    v = Views(spark, sf)
    pred = v.pred()
    existing, early = pred.where("observation_year >= 1998"), pred.where("observation_year < 1998")
    extended = PP.extend_panel_back(early.select(*reversed(pred.columns)), existing)
    kept = [y for y in v.labelled_years() if y >= 1998]
    changed = PP.copied_unchanged(extended, existing, kept).agg(F.count(F.lit(1))).scalar()
    return extended.groupBy("observation_year").agg(F.count(F.lit(1)).alias("rows")).withColumn("changed", changed)


EDA_COLS = ["qty", "size", "price"]
EDA_LONG = " UNION ALL ".join(f"SELECT split, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM panel" for c in [*EDA_COLS, "target"])


@query("b4_run_eda", f"""
WITH l AS ({EDA_LONG}), s AS (SELECT split, col, COUNT(v) AS c, COUNT(*) - COUNT(v) AS n, AVG(v) AS m, stddev_samp(v) AS sd, quantile_cont(v, 0.5) AS md,
  quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY 1, 2),
y AS (SELECT CAST(observation_year AS VARCHAR) AS y, AVG(CASE WHEN target = 0 THEN 1.0::DOUBLE ELSE 0 END) AS z, AVG(target) AS m, quantile_cont(target, 0.5) AS md,
  quantile_cont(target, 0.99) AS p FROM panel GROUP BY 1),
o AS (SELECT l.split, l.col, COUNT(*) FILTER (WHERE v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) AS n FROM l JOIN s ON s.col = l.col AND s.split = 'train' WHERE l.col <> 'target' GROUP BY 1, 2)
SELECT "table", scope, "column", metric, CASE WHEN ABS(value) < 5e-7 THEN 0 ELSE ROUND(value, 6) END AS value FROM (
  SELECT 'standardized_difference' AS "table", a.split AS scope, a.col AS "column", 'smd' AS metric, (a.m - t.m) / t.sd AS value FROM s a JOIN s t ON t.col = a.col AND t.split = 'train'
    WHERE a.split <> 'train' AND a.col <> 'target'
  UNION ALL SELECT 'outliers', split, col, 'outliers', n::DOUBLE FROM o
  UNION ALL SELECT 'target_by_year', y, 'target', 'zero_share', z FROM y UNION ALL SELECT 'target_by_year', y, 'target', 'mean', m FROM y
  UNION ALL SELECT 'target_by_year', y, 'target', 'median', md FROM y UNION ALL SELECT 'target_by_year', y, 'target', 'p99', p FROM y
  UNION ALL SELECT 'describe', split, col, 'count', c::DOUBLE FROM s UNION ALL SELECT 'describe', split, col, 'missing', n::DOUBLE FROM s
  UNION ALL SELECT 'describe', split, col, 'median', md FROM s) u""", "panel")
def run_eda(spark, sf):
    tables = J.run_eda(Views(spark, sf).panel(), "observation_year", "split", EDA_COLS, "target")
    return rounded(J.eda_rows(tables, "split"))


@query("b5_screening", """
WITH rc AS (SELECT c.cell_id, CAST(COUNT(DISTINCT YEAR(l_shipdate)) AS INT) AS n FROM cell c LEFT JOIN lineitem l ON l_partkey = c.k AND l_quantity >= 45 GROUP BY c.cell_id),
o AS (SELECT n, ROW_NUMBER() OVER (ORDER BY n) - 1 AS i, COUNT(*) OVER () AS c FROM rc),
th AS (SELECT MAX(CASE WHEN i = ROUND_EVEN((c - 1) / 3.0, 0) THEN n END) AS lo, MAX(CASE WHEN i = ROUND_EVEN(2 * (c - 1) / 3.0, 0) THEN n END) AS mi FROM o),
n AS (SELECT cell_id, code, COUNT(*) AS c FROM pix WHERE code <= 5 GROUP BY 1, 2),
md AS (SELECT cell_id, CAST(MAX_BY(code, c * 10 + code) AS INT) AS modal FROM n GROUP BY cell_id)
SELECT CASE WHEN rc.n <= th.lo THEN 'lower' WHEN rc.n <= th.mi THEN 'moderate' ELSE 'higher' END AS historical_exposure_band,
  CASE COALESCE(md.modal, -1) WHEN 0 THEN 'null' WHEN 1 THEN 'very_low' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' WHEN 5 THEN 'very_high' ELSE 'unmatched' END AS hazard_class,
  COUNT(*) AS cell_count, ROUND(COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM rc), 9) AS share_of_all_cells, CAST(0 AS BIGINT) AS violations
FROM rc CROSS JOIN th LEFT JOIN md ON md.cell_id = rc.cell_id GROUP BY 1, 2""", "cell pix")
def screening(spark, sf):
    v = Views(spark, sf)
    hits = v.table("lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("year")).distinct()
    burnt = hits.groupBy("k").agg(F.count(F.lit(1)).cast("int").alias("n"))
    core = v.cell().join(burnt, "k", "left").select("cell_id", F.coalesce("n", F.lit(0)).alias("n"))
    tables = J.screening(core, v.pix(), v.cell(), "n", 1995, 2001)
    bad = tables["violations"].agg(F.count(F.lit(1))).scalar()
    return rounded(tables["crosstab"].drop("share_within_row").withColumn("violations", bad), 9)


# the fixture's model inputs have no nulls, so the scoring gate can pass
CYCLE = PanelContract(
    features=(FieldRule("n_items", 0.0, 100.0, integral=True), FieldRule("size", 0.0, 100.0), FieldRule("price", 0.0, 1e9), FieldRule("events", 0.0, 10.0, integral=True)),
    target=FieldRule("target", 0.0, 1.0),
    metadata=("outcome_year", "historical_fire_start_year", "historical_fire_end_year", "climate_reference_year", "land_cover_reference_year"),
)


@query("b6_annual_cycle", """
WITH l AS (SELECT COUNT(*) FILTER (WHERE observation_year <= 1997) AS development, COUNT(*) FILTER (WHERE observation_year > 1997) AS later FROM panel
  WHERE observation_year < (SELECT MAX(year) FROM lyrs))
SELECT CAST(0 AS BIGINT) AS violations, COUNT(*) AS rows, COUNT(*) AS ranked, ANY_VALUE(l.development) AS development, ANY_VALUE(l.later) AS later FROM cell, l""", "cell panel lyrs")
def annual_cycle(spark, sf):
    v = Views(spark, sf, uncut=True)  # the gates ask for a key of its own for every cell
    years = v.labelled_years()
    extra = contract_panel(v).drop("n_items", "disc", "tax", "price", "target", "cell_year_id")
    panel = v.panel().select(*KEY, *FEATURES, "target").join(extra, KEY)
    matrix = panel.where(F.col("observation_year") == years[-1]).drop("target")
    early, late = [y for y in years[:-1] if y <= 1997], [y for y in years[:-1] if y > 1997]
    blocks = [(n, panel.where(F.col("observation_year").isin(block)), block) for n, block in (("development", early), ("later", late))]
    # what the forecast needs: burns of the history and of the last outcome, climate of the input year
    last = v.table("lineitem").agg((F.year(F.max("l_shipdate"))).alias("y"))
    needs = last.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), (F.col("y") - back).alias("year")) for kind, back in (("burn", 0), ("burn", 1), ("burn", 2), ("climate", 1))])).alias("n")).select("n.*")
    has = v.burn().select(F.lit("burn").alias("kind"), "year").distinct().unionByName(v.clim().select(F.lit("climate").alias("kind"), "year").distinct()).withColumn("present", F.lit(True))
    estimator = MD.HurdleModel(FEATURES, "target", key=KEY)
    _, scores, violations, labelled = J.operational_cycle(blocks, matrix, estimator, years[-1] + 1, v.cell().select("cell_id"), CYCLE, DESIGN, "trial", needs, has)
    bad = violations.agg(F.count(F.lit(1))).scalar()
    count = lambda name: labelled.where(F.col("source") == name).agg(F.count(F.lit(1))).scalar()
    ranked = F.count_if((F.col("rank_pct") > 0) & (F.col("rank_pct") <= 1))
    told = scores.agg(F.count(F.lit(1)).alias("rows"), ranked.alias("ranked"))
    return told.select(bad.alias("violations"), "rows", "ranked", count("development").alias("development"), count("later").alias("later"))


@query("b6_select_model", SUMMARY_SQL, "panel")
def select_model(spark, sf):
    """Candidates fitted on a fixed number of rows per training year, scored on the validation years."""
    v = Views(spark, sf)
    years = v.labelled_years()
    return checked_summary(J.select_model(v.panel(), FEATURES, "target", KEY, "observation_year", [y for y in years if y <= 1997], [1998, 1999], 1500))


@query("b7_diagnostics", """
SELECT 'regression' AS "table", CONCAT(model, '|', scope) AS key, COUNT(*) AS n, ROUND(AVG(ABS(score - target)), 6) AS value FROM scoped GROUP BY 2
UNION ALL SELECT 'residuals', CAST(observation_year AS VARCHAR), COUNT(*), ROUND(quantile_cont(score_a - target, 0.5), 6) FROM pred GROUP BY 2
UNION ALL SELECT 'density', CONCAT(LEAST(FLOOR(target * 55), 54)::INT, '|', LEAST(FLOOR(score_a * 55), 54)::INT), COUNT(*), ROUND(LOG10(COUNT(*)), 6) FROM pred GROUP BY 2
UNION ALL SELECT 'bins', CAST(bin AS VARCHAR), COUNT(*), ROUND(AVG(target), 6) FROM (
  SELECT target, GREATEST(1, (SELECT COUNT(*) FROM (SELECT DISTINCT UNNEST(quantile_cont(score_a, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e FROM pred) q WHERE q.e < p.score_a)) AS bin FROM pred p) b GROUP BY bin""", "scoped pred")
def diagnostics(spark, sf):
    tables = J.diagnostics(Views(spark, sf).pred(), "observation_year", "target", ["score_a", "score_b"])
    regression = tables["regression"].select(F.lit("regression").alias("table"), F.concat_ws("|", "model", "scope").alias("key"), F.col("rows").alias("n"), F.col("mae_all").alias("value"))
    residuals = tables["residuals"].select(F.lit("residuals").alias("table"), F.col("observation_year").cast("string").alias("key"), "n", F.col("median").alias("value"))
    density = tables["density"].select(F.lit("density").alias("table"), F.concat_ws("|", "bx", "by").alias("key"), "n", F.col("log10_n").alias("value"))
    bins = tables["bins"].select(F.lit("bins").alias("table"), F.col("bin").cast("string").alias("key"), F.col("cell_count").alias("n"), F.col("mean_observed").alias("value"))
    return rounded(CM.union_parts([regression, residuals, density, bins]))


@query("b8_web_export", """SELECT cell_id, true AS feature, true AS inside FROM cell""", "cell")
def web_export(spark, sf):
    """Feature text of every cell; its first corner must lie in the longitudes and latitudes of the grid."""
    v = Views(spark, sf)
    features, _ = J.web_export(published_scores(v), v.cell(), 1000, "v1")
    schema = "type string, geometry struct<type:string,coordinates:array<array<array<double>>>>, properties struct<cell_id:string>"
    parsed = features.select(F.from_json("value", schema).alias("f"))
    corner = F.col("f.geometry.coordinates")[0][0]
    inside = corner[0].between(-8.2, -6.0) & corner[1].between(39.6, 42.0)
    return parsed.select(F.col("f.properties.cell_id").alias("cell_id"), (F.col("f.type") == "Feature").alias("feature"), inside.alias("inside"))


@query("b9_component_tables", """
SELECT 'burn' AS component, 'created' AS first, 'reused' AS second, COUNT(*) AS rows FROM burn UNION ALL SELECT 'clim', 'created', 'reused', COUNT(*) FROM clim""", "burn clim")
def component_tables(spark, sf):
    from gridpanel.sinks.publish import scratch_path

    v = Views(spark, sf)
    folder = scratch_path(spark, "components")
    parts = {"burn": v.burn(), "clim": v.clim()}
    first, second = PP.component_tables(parts, folder), PP.component_tables(parts, folder)
    counts = [
        spark.read.parquet(f"{folder}/{n}").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(n).alias("component"), F.lit(first[n]["status"]).alias("first"), F.lit(second[n]["status"]).alias("second"), "rows"
        )
        for n in parts
    ]
    return CM.union_parts(counts)
