"""Queries on models, lookups and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.catalog.registry import query
from gridpanel.catalog.stats_ranking import rounded
from gridpanel.catalog.vector import green_sql
from gridpanel.catalog.views import Views
from gridpanel.functions.scalars import parse_radii
from gridpanel.operators import lookup as L
from gridpanel.operators import metrics as M
from gridpanel.operators import models as MD
from gridpanel.operators.gates import enforce, gate_predictions
from gridpanel.session import materialize
from gridpanel.sinks.publish import scratch_path
from gridpanel.streaming import streams as ST

FEATURES = ["n_items", "size", "price", "events"]
KEY = ["cell_id", "observation_year"]


def _splits(v):
    panel = v.panel()
    return panel.where("split = 'train'"), panel.where("split = 'validation'"), panel.where("split = 'final_test'")


@query("m1_baseline_estimator", """
WITH t AS (SELECT n_items, AVG(target) AS m FROM panel WHERE split = 'train' GROUP BY n_items)
SELECT p.cell_id, p.observation_year, ROUND(COALESCE(t.m, (SELECT AVG(target) FROM panel WHERE split = 'train')), 9) AS baseline
FROM panel p LEFT JOIN t ON t.n_items = p.n_items""", "panel")
def baseline_estimator(spark, sf):
    v = Views(spark, sf)
    model = MD.BaselineByCount("n_items", "target").fit(_splits(v)[0])
    return model.transform(v.panel()).select("cell_id", "observation_year", F.round("baseline", 9).alias("baseline"))


@query("m2_hurdle_model", """
SELECT cell_id, observation_year, target, true AS in_range, true AS repeated FROM panel WHERE split = 'validation'""", "panel")
def hurdle_model(spark, sf):
    """Validation rows: the two-part score is a share, and a second fit on the same matrix gives the same."""
    train, validation, _ = _splits(Views(spark, sf))
    matrix = MD.FeatureMatrix(train, FEATURES, "target", KEY)
    models = MD.fit_hurdles(matrix, {"hurdle": MD.DEFAULTS, "again": MD.DEFAULTS})
    both = models["again"].transform(models["hurdle"].transform(validation))
    return both.select(*KEY, "target", F.col("hurdle").between(0, 1).alias("in_range"), (F.col("hurdle") == F.col("again")).alias("repeated"))


SUMMARY_SQL = """
SELECT m.model, COUNT(*) AS rows, COUNT(*) FILTER (WHERE target > 0) AS positives, ROUND(AVG(target), 9) AS mean_observed, true AS errors_fit, true AS capture_fits
FROM panel CROSS JOIN (VALUES ('current_frozen'), ('smaller_regularized_trees'), ('slower_learning'), ('larger_trees'), ('moderate_complexity')) m(model)
WHERE split = 'validation' GROUP BY m.model"""


def checked_summary(summary):
    """What of a summary of candidates does not hang on the trees: rows, observed mean, and that errors and shares are possible ones."""
    errors = F.col("mae_all").between(0, 1) & (F.col("rmse_all") >= F.col("mae_all")) & F.col("min_predicted").between(0, F.col("max_predicted")) & (F.col("max_predicted") <= 1)
    capture = F.col("mass_capture").between(0, 1)
    return summary.select("model", "rows", "positives", F.round("mean_observed", 9).alias("mean_observed"), errors.alias("errors_fit"), capture.alias("capture_fits"))


@query("m4_compare_candidates", SUMMARY_SQL, "panel")
def compare_candidates(spark, sf):
    train, validation, _ = _splits(Views(spark, sf))
    long = materialize(MD.compare_candidates(train, validation, FEATURES, "target", KEY, "observation_year"))
    scoped = M.with_scopes(long, "observation_year")
    regression = M.regression_metrics(long, "observation_year")
    return checked_summary(M.candidate_summary(regression, M.tie_aware_ranking(scoped, 0.2, ["model", "scope"])))


@query("m5_refit", """
SELECT cell_id, observation_year, true AS in_range FROM panel WHERE observation_year = (SELECT MAX(year) FROM lyrs)""", "panel lyrs")
def refit(spark, sf):
    """Fixed specification refitted on every labelled year but the last, scored on the last."""
    v = Views(spark, sf)
    years = v.labelled_years()
    model = MD.refit(v.panel(), MD.HurdleModel(FEATURES, "target", key=KEY), years[:-1])
    scored = model.transform(v.panel().where(F.col("observation_year") == years[-1]))
    return scored.select(*KEY, F.col("hurdle").between(0, 1).alias("in_range"))


@query("m6_save_load_identical", """
SELECT CAST(0 AS BIGINT) AS differences, COUNT(*) AS rows FROM panel WHERE split = 'validation'""", "panel")
def save_load_identical(spark, sf):
    from gridpanel.operators.compare import frame_differences

    v = Views(spark, sf)
    train, validation, _ = _splits(v)
    model = MD.HurdleModel(FEATURES, "target", key=KEY).fit(train)
    path = scratch_path(spark, "model")
    model.save(path, {"train_years": [y for y in v.labelled_years() if y <= 1997], "seed": MD.SEED})
    loaded, _ = MD.HurdleModelFitted.load(spark, path)
    rows = materialize(validation)
    a, b = model.transform(rows).select(*KEY, "hurdle"), loaded.transform(rows).select(*KEY, "hurdle")
    changed = frame_differences(a, b).agg(F.count(F.lit(1))).scalar()
    return a.agg(F.count(F.lit(1)).alias("rows")).select(changed.alias("differences"), "rows")


@query("m7_score", """
SELECT cell_id, CAST((SELECT MAX(year) + 1 FROM lyrs) AS INT) AS forecast_year, CAST((SELECT MAX(year) FROM lyrs) AS INT) AS prediction_input_year, true AS in_range, true AS ranked,
  'containing_source' AS assignment_method, 'trial' AS model_id, 'published' AS score_status FROM panel WHERE split = 'final_test'""", "panel lyrs")
def score(spark, sf):
    v = Views(spark, sf)
    train, _, last = _splits(v)
    model = MD.HurdleModel(FEATURES, "target", key=KEY).fit(train)
    matrix = last.withColumn("assignment_method", F.lit("containing_source"))
    scores = MD.score(model, matrix, v.labelled_years()[-1] + 1, "trial")
    ranked = (F.col("rank_pct") > 0) & (F.col("rank_pct") <= 1)
    return scores.select(
        "cell_id", "forecast_year", "prediction_input_year", F.col("estimate").between(0, 1).alias("in_range"), ranked.alias("ranked"),
        "assignment_method", "model_id", "score_status",
    )


@query("m8_frozen_test", """
WITH s AS (SELECT 'overall' AS scope, target FROM panel WHERE split = 'final_test' UNION ALL SELECT CAST(observation_year AS VARCHAR), target FROM panel WHERE split = 'final_test')
SELECT 'hurdle' AS model, scope, COUNT(*) AS rows, COUNT(*) FILTER (WHERE target > 0) AS positives, ROUND(AVG(target), 9) AS mean_observed, true AS errors_fit FROM s GROUP BY scope""", "panel")
def frozen_test(spark, sf):
    """Stored model on held-out years, never fitted there, with its metrics."""
    v = Views(spark, sf)
    train, _, held_out = _splits(v)
    years = [y for y in v.labelled_years() if y <= 1997]
    path = scratch_path(spark, "model")
    MD.HurdleModel(FEATURES, "target", key=KEY).fit(train).save(path, {"train_years": years})
    model, meta = MD.HurdleModelFitted.load(spark, path)
    scored = MD.frozen_test(model, meta, held_out, FEATURES, years)
    told = M.regression_metrics(M.melt_models(scored, ["cell_id", "observation_year", "target"], ["hurdle"]), "observation_year")
    errors = F.col("mae_all").between(0, 1) & (F.col("rmse_all") >= F.col("mae_all")) & (F.col("max_predicted") <= 1)
    return told.select("model", "scope", "rows", "positives", F.round("mean_observed", 9).alias("mean_observed"), errors.alias("errors_fit"))


@query("m9_reconcile_model_id", "SELECT cell_id, score_a AS estimate, 'second' AS model_id FROM pred WHERE observation_year = (SELECT MAX(year) FROM lyrs)", "pred")
def reconcile_model_id(spark, sf):
    from gridpanel.catalog.publish_gates import published_scores

    scores = published_scores(Views(spark, sf))
    return MD.reconcile_model_id(scores, scores.repartition(5), "second").select("cell_id", "estimate", "model_id")


@query("m11_prediction_table", """
SELECT cell_id, observation_year, observation_year + 1 AS outcome_year, target, 'score_a' AS model, score_a AS score FROM pred
UNION ALL SELECT cell_id, observation_year, observation_year + 1, target, 'score_b', score_b FROM pred""", "pred")
def prediction_table(spark, sf):
    table = MD.prediction_table(Views(spark, sf).pred(), KEY, "target", ["score_a", "score_b"], "observation_year")
    enforce(gate_predictions(table, [*KEY, "outcome_year", "target", "score_a", "score_b"], "observation_year"))
    return M.melt_models(table, [*KEY, "outcome_year", "target"], ["score_a", "score_b"])


# -------------------------------------------------------------------- lookup


def scored_cells(v):
    """Cells with an estimate, its rank and a history count."""
    k = F.col("k")
    return v.cell().select(
        "cell_id", "ix", "iy", ((k * 31 % 97).cast("double") / 97).alias("estimate"),
        (((k * 13) % 1000).cast("double") / 1000).alias("rank_pct"), (k % 11).cast("double").alias("history"),
    )


SC_SQL = """sc AS (SELECT cell_id, ix, iy, CAST(k * 31 % 97 AS DOUBLE) / 97 AS estimate, CAST((k * 13) % 1000 AS DOUBLE) / 1000 AS rank_pct,
  CAST(k % 11 AS DOUBLE) AS history FROM cell)"""


@query("p21_parse_radii", """
SELECT event_id, CASE WHEN buffers_km = '1,1' THEN 'radii must be unique' WHEN buffers_km = 'a' THEN 'radii must be comma-separated numbers' END AS error,
  CAST(CASE WHEN buffers_km = '1,3,5' THEN 3 END AS INT) AS n FROM req""", "req")
def parse_radii_query(spark, sf):
    radii, error = parse_radii(F.col("buffers_km"))
    return Views(spark, sf).req().select("event_id", error.alias("error"), F.when(radii.isNotNull(), F.size(radii)).alias("n"))


@query("j11_containing_cell", """
WITH p AS (SELECT event_id, x, y FROM req UNION ALL SELECT event_id + 1000000, FLOOR(x / 1000) * 1000, y FROM req)
SELECT p.event_id, MIN(c.cell_id) AS cell_id FROM p JOIN cell c ON p.x >= c.x0 AND p.x <= c.x0 + 1000 AND p.y >= c.y0 AND p.y <= c.y0 + 1000
GROUP BY p.event_id""", "req cell")
def containing_cell(spark, sf):
    """Requests as they are, and again moved onto the western edge of their cell."""
    v = Views(spark, sf)
    req = v.req().select("event_id", "x", "y")
    edge = req.select((F.col("event_id") + 1_000_000).alias("event_id"), (F.floor(F.col("x") / 1000) * 1000).cast("double").alias("x"), "y")
    return L.containing_cell(req.unionByName(edge), v.cell(), 1000)


def disc_sql(radii: str) -> str:
    """Weights of every cell in the 64-gon around each request point."""
    return f"""
pts AS (SELECT DISTINCT x AS px, y AS py, r.r AS radius_km FROM req CROSS JOIN (VALUES {radii}) r(r)),
cnd AS (SELECT p.*, s.cell_id, s.ix, s.iy, s.estimate, s.rank_pct, s.history FROM pts p JOIN sc s ON s.ix BETWEEN FLOOR((px - radius_km * 1000) / 1000) AND FLOOR((px + radius_km * 1000) / 1000)
  AND s.iy BETWEEN FLOOR((py - radius_km * 1000) / 1000) AND FLOOR((py + radius_km * 1000) / 1000)),
ang AS (SELECT a.range AS n, cos(2 * pi() * a.range / 64) AS ca, sin(2 * pi() * a.range / 64) AS sa, cos(2 * pi() * (a.range + 1) / 64) AS cb, sin(2 * pi() * (a.range + 1) / 64) AS sb FROM range(64) a),
eds AS (SELECT c.*, px + radius_km * 1000 * ca AS xa, py + radius_km * 1000 * sa AS ya, px + radius_km * 1000 * cb AS xb, py + radius_km * 1000 * sb AS yb FROM cnd c CROSS JOIN ang),
wg(px, py, radius_km, cell_id, estimate, rank_pct, history, w) AS (SELECT px, py, radius_km, cell_id, estimate, rank_pct, history,
  {green_sql("eds", "ix * 1000", "iy * 1000", "ix * 1000 + 1000", "iy * 1000 + 1000")} GROUP BY px, py, radius_km, cell_id, estimate, rank_pct, history)"""


@query("g15_circle_context", f"""WITH {SC_SQL}, {disc_sql("(1.0::DOUBLE)")}
SELECT px AS x, py AS y, radius_km, COUNT(*) AS cells, ROUND(SUM(w), 2) AS area FROM wg WHERE w > 1e-3 GROUP BY px, py, radius_km""", "req cell")
def circle_context(spark, sf):
    v = Views(spark, sf)
    points = v.req().select("x", "y", F.lit(1.0).alias("radius_km"))
    out = L.context_summary(points, scored_cells(v), 1000)
    return out.select("x", "y", "radius_km", F.col("intersecting_cell_count").alias("cells"), F.round(F.col("intersected_area_sq_km") * 1e6, 2).alias("area"))


@query("j12_context_summary", f"""WITH {SC_SQL}, {disc_sql("(1.0::DOUBLE), (3.0), (5.0)")}
SELECT px AS x, py AS y, radius_km, COUNT(*) AS intersecting_cell_count, ROUND(SUM(w) / 1e6, 6) AS intersected_area_sq_km, ROUND(SUM(w * estimate) / SUM(w), 6) AS mean_estimate,
  ROUND(SUM(w * rank_pct) / SUM(w), 6) AS mean_rank_pct, ROUND(SUM(CASE WHEN rank_pct > 0.8 THEN w ELSE 0 END) / SUM(w), 6) AS higher_area_share,
  ROUND(SUM(w * history) / SUM(w), 6) AS mean_history, MIN(cell_id) AS first_cell, MAX(cell_id) AS last_cell FROM wg WHERE w > 1e-3 GROUP BY px, py, radius_km""", "req cell")
def context_summary(spark, sf):
    v = Views(spark, sf)
    points = v.req().select("x", "y", F.explode(F.array(F.lit(1.0), F.lit(3.0), F.lit(5.0))).alias("radius_km"))
    out = L.context_summary(points, scored_cells(v), 1000)
    ids = F.col("cell_ids")
    return rounded(out.withColumns({"first_cell": ids[0], "last_cell": F.element_at(ids, -1)}).drop("cell_ids"))


@query("j13_model_inputs_join", """
SELECT r.event_id, c.cell_id, p.p_size, p.p_retailprice FROM req r JOIN cell c ON c.ix = FLOOR(r.x / 1000) AND c.iy = FLOOR(r.y / 1000)
JOIN part p ON p.p_partkey = c.k""", "req cell")
def model_inputs_join(spark, sf):
    v = Views(spark, sf)
    located = L.containing_cell(v.req(), v.cell(), 1000)
    inputs = v.cell().select("k", "cell_id").join(v.table("part"), F.col("k") == F.col("p_partkey")).select("cell_id", "p_size", "p_retailprice")
    return L.model_inputs_join(located, inputs).select("event_id", "cell_id", "p_size", "p_retailprice")


LOOKUP_SQL = f"""
WITH {SC_SQL}, {disc_sql("(3.0::DOUBLE)")},
st AS (SELECT r.event_id, r.x, r.y, CASE WHEN buffers_km <> '1,3,5' THEN 422 WHEN s.cell_id IS NULL THEN 404 ELSE 200 END AS status,
  CASE WHEN buffers_km = '1,3,5' THEN s.cell_id END AS cell_id, s.rank_pct FROM req r
  LEFT JOIN sc s ON s.ix = FLOOR(r.x / 1000) AND s.iy = FLOOR(r.y / 1000)),
ctx AS (SELECT px, py, SUM(w * estimate) / SUM(w) AS m, COUNT(*) AS n FROM wg WHERE w > 1e-3 GROUP BY px, py)
SELECT st.event_id, CAST(st.status AS INT) AS status, st.cell_id, CASE WHEN st.status = 200 THEN CASE WHEN st.rank_pct <= 0.5 THEN 'lower' WHEN st.rank_pct <= 0.8 THEN 'intermediate'
  ELSE 'higher' END END AS band, ROUND(ctx.m, 6) AS mean_3km, ctx.n AS cells_3km FROM st LEFT JOIN ctx ON st.status = 200 AND ctx.px = st.x AND ctx.py = st.y"""


def _flat_lookup(rows):
    middle = F.get("contexts", F.lit(1))
    return rows.select(
        "event_id", "status", "cell_id", "band", F.round(middle["mean_estimate"], 6).alias("mean_3km"), middle["intersecting_cell_count"].alias("cells_3km")
    )


@query("j16_lookup_job", LOOKUP_SQL, "req cell")
def lookup_job(spark, sf):
    """Full lookup; requests outside the grid get 404, bad radii 422."""
    v = Views(spark, sf)
    return _flat_lookup(L.lookup_job(v.req(), scored_cells(v), 1000))


@query("t1_lookup_stream", LOOKUP_SQL, "req cell")
def lookup_stream(spark, sf):
    """The same lookup over a stream of the event table."""
    v = Views(spark, sf)
    events = spark.readStream.schema(v.table("events").schema).parquet(f"{sf}/events*.parquet")
    e = F.col("event_id")
    requests = events.select(
        "event_id", (((e * 37) % 100000).cast("double") + 0.5).alias("x"), (((e * 91) % 20000).cast("double") + 0.5).alias("y"),
        F.when(e % 50 == 0, "1,1").when(e % 51 == 0, "a").otherwise("1,3,5").alias("buffers_km"),
    )
    out = scratch_path(spark, "lookup")
    ST.lookup_stream(requests, scored_cells(v), 1000, out, scratch_path(spark, "lookup-state"))
    return _flat_lookup(spark.read.parquet(out))


@query("t2_recurrence_stream", """
SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, COUNT(DISTINCT event_id) AS events, true AS hit FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2""")
def recurrence_stream(spark, sf):
    """Daily hits per user over a stream; windows the watermark has closed."""
    v = Views(spark, sf)
    schema = v.table("events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(spark, "recurrence")
    ST.write_stream(ST.recurrence_stream(events, "user_id", "event_id"), out, scratch_path(spark, "recurrence-state"))
    stored = spark.read.parquet(out)
    return stored.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("day"), "events", "hit")


@query("t3_label_arrival", """
SELECT cell_id, observation_year + 1 AS forecast_year, score_a AS score, target FROM pred WHERE observation_year + 1 IN (SELECT year FROM burn)""", "pred burn")
def label_arrival(spark, sf):
    """Outcomes stream in after the scores were published."""
    v = Views(spark, sf)
    scores = v.pred().select("cell_id", (F.col("observation_year") + 1).alias("forecast_year"), F.col("score_a").alias("score"))
    arrived = v.burn().join(v.cell().select("k", "cell_id"), "k").select("cell_id", F.col("year").alias("forecast_year"), "share")
    landing = scratch_path(spark, "outcomes")
    arrived.write.parquet(landing)
    stream = spark.readStream.schema(arrived.schema).parquet(landing)
    out = scratch_path(spark, "evaluated")
    ST.label_arrival(stream, scores, out, scratch_path(spark, "evaluated-state"))
    return spark.read.parquet(out).select("cell_id", "forecast_year", "score", "target")
