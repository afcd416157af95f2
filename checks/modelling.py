"""Models, evaluation and the composite jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza import models, sources
from cadenza.functions.calendar import week_start
from cadenza.models.pipeline import assembler
from cadenza.operators import evaluation as ev
from cadenza.operators.panel import fill_zero
from cadenza.operators.profile import histogram, semi_join_active
from cadenza.plans.correlation import correlation_report, listenability_totals
from cadenza.plans.quality import quality_report
from cadenza.plans.toplist import popular_tracks_report, toplist, toplist_job, toplist_request
from cadenza.plans.training import evaluate, train_and_evaluate
from cadenza.schemas import LABEL, MODEL_INPUTS, PREDICTION, TRACK_ATTRIBUTES
from cadenza.session import materialized, scratch_path
from checks import feature_views as fv
from checks import views as v
from checks.registry import check, q6, r6
from checks.relational import corr_sql, histogram_sql

def persistence(rows: DataFrame) -> DataFrame:
    """The predictor SQL can follow: next week is like last week."""
    return rows.withColumn(PREDICTION, F.col("lag_1"))


def split(spark, d, name: str) -> DataFrame:
    return ev.time_split(fv.feature_table(spark, d)).filter(F.col("split") == name).drop("split")


def fitted_linear(spark, d):
    return models.train_linear(split(spark, d, "train"))


def predictions(scored: DataFrame) -> DataFrame:
    return scored.select("track_id", "week", LABEL, r6(PREDICTION).alias(PREDICTION))


TEST_SCORED = f"{fv.FEATURES_L}, scored AS (SELECT *, lag_1 AS predicted_play_count FROM features WHERE week IN (126, 157))"
ALL_SCORED = f"{fv.FEATURES_L}, scored AS (SELECT *, lag_1 AS predicted_play_count FROM features)"
METRICS = f"""errors AS (SELECT avg((play_count - predicted_play_count) ** 2) AS mse,
        avg(abs(play_count - predicted_play_count)) AS mae, var_pop(play_count) AS variance FROM scored),
    metrics AS (SELECT 'rmse' AS metric, {q6('sqrt(mse)')} AS value FROM errors
        UNION ALL SELECT 'mae', {q6('mae')} FROM errors UNION ALL SELECT 'mse', {q6('mse')} FROM errors
        UNION ALL SELECT 'r2', {q6('1 - mse / variance')} FROM errors)"""


def ndcg_sql(k: int) -> str:
    """NDCG@k from row ranks: the gain of equal scores is averaged over their places."""
    return f"""ranked AS (SELECT week, play_count AS gain, predicted_play_count AS score,
        row_number() OVER (PARTITION BY week ORDER BY predicted_play_count DESC) AS place,
        row_number() OVER (PARTITION BY week ORDER BY play_count DESC) AS ideal_place FROM scored),
    ties AS (SELECT week, score, avg(gain) * sum(CASE WHEN place <= {k} THEN 1 / log2(place + 1) ELSE 0 END) AS dcg
        FROM ranked GROUP BY week, score),
    found AS (SELECT week, sum(dcg) AS dcg FROM ties GROUP BY week),
    ideal AS (SELECT week, sum(CASE WHEN ideal_place <= {k} THEN gain / log2(ideal_place + 1) ELSE 0 END) AS ideal
        FROM ranked GROUP BY week),
    ndcg AS (SELECT f.week, coalesce(dcg / nullif(ideal, 0), 0) AS ndcg FROM found f JOIN ideal i ON f.week = i.week)"""


# Evaluation

@check("time_split", f"""{fv.FEATURES_L} SELECT track_id, week, CASE WHEN week <= 94 THEN 'train' WHEN week IN (95, 125) THEN 'validation'
    WHEN week IN (126, 157) THEN 'test' END AS split FROM features""")
def time_split(spark, d):
    return ev.time_split(fv.feature_table(spark, d)).select("track_id", "week", "split")


@check("regression_metrics", f"{TEST_SCORED}, {METRICS} SELECT * FROM metrics")
def regression_metrics(spark, d):
    return ev.regression_metrics(persistence(split(spark, d, "test"))).withColumn("value", r6("value"))


@check("ndcg_at_k", f"{ALL_SCORED}, {ndcg_sql(20)} SELECT week, {q6('ndcg')} AS ndcg FROM ndcg")
def ndcg_at_k(spark, d):
    return ev.ndcg_at_k(persistence(fv.feature_table(spark, d)), 20).withColumn("ndcg", r6("ndcg"))


@check("ndcg_at_100", f"{ALL_SCORED}, {ndcg_sql(100)} SELECT week, {q6('ndcg')} AS ndcg FROM ndcg")
def ndcg_at_100(spark, d):
    return ev.ndcg_at_k(persistence(fv.feature_table(spark, d)), 100).withColumn("ndcg", r6("ndcg"))


@check("mean_ndcg", f"{TEST_SCORED}, {ndcg_sql(20)} SELECT {q6('avg(ndcg)')} AS mean_ndcg FROM ndcg")
def mean_ndcg(spark, d):
    return ev.mean_ndcg(persistence(split(spark, d, "test")), 20).withColumn("mean_ndcg", r6("mean_ndcg"))


@check("sink_metrics", f"""{TEST_SCORED}, {METRICS}, {ndcg_sql(20)} SELECT * FROM metrics
    UNION ALL SELECT 'ndcg@20', {q6('avg(ndcg)')} FROM ndcg""")
def sink_metrics(spark, d):
    path = scratch_path(spark, "metrics")
    sources.write_metrics(evaluate(persistence(split(spark, d, "test"))), path)
    return spark.read.schema("metric string, value double").json(path).withColumn("value", r6("value"))


# Models

# A least-squares fit with intercept is the one whose predictions have, over the rows it learnt from, the label's mean
# and with each input the label's mean product.  That is what SQL knows of it.

def normal(scored: DataFrame, label: str = LABEL, inputs: list[str] | None = None) -> DataFrame:
    """The mean of the prediction, and its mean product with each input, by the input's mean size."""
    terms = {"intercept": F.avg(PREDICTION)}
    for c in inputs or MODEL_INPUTS:
        terms[c] = F.coalesce(F.try_divide(F.avg(F.col(c).cast("double") * F.col(PREDICTION)), F.avg(F.abs(F.col(c).cast("double")))), F.lit(0.0))
    sums = scored.select(*[F.round(x, 4).alias(c) for c, x in terms.items()])
    return sums.unpivot([], list(terms), "term", "value")


def normal_sql(source: str, label: str = LABEL, inputs: list[str] | None = None) -> str:
    """The same of the label."""
    means = [f"SELECT 'intercept' AS term, round(avg({label}), 4) AS value FROM {source}"]
    means += [
        f"SELECT '{c}', round(coalesce(avg(CAST({c} AS DOUBLE) * {label}) / nullif(avg(abs(CAST({c} AS DOUBLE))), 0), 0), 4)"
        f" FROM {source}" for c in inputs or MODEL_INPUTS]
    return " UNION ALL ".join(means)


TRAIN = f"{fv.FEATURES_L}, train AS MATERIALIZED (SELECT * FROM features WHERE week <= 94)"
NORMAL = f"{TRAIN} {normal_sql('train')}"


@check("assemble_vector", f"""{fv.FEATURES_L} SELECT track_id, week, {', '.join(f'CAST({c} AS DOUBLE) AS v{i}' for i, c in enumerate(MODEL_INPUTS))} FROM features""")
def assemble_vector(spark, d):
    rows = sources.writers.without_vectors(assembler().transform(fv.feature_table(spark, d)))
    return rows.select("track_id", "week", *[F.col("features")[i].alias(f"v{i}") for i in range(len(MODEL_INPUTS))])


@check("train_linear", NORMAL)
def train_linear(spark, d):
    model = fitted_linear(spark, d).stages[-1]
    predicted = F.lit(float(model.intercept))
    for c, w in zip(MODEL_INPUTS, model.coefficients):
        predicted = predicted + F.lit(float(w)) * F.col(c)
    return normal(split(spark, d, "train").withColumn(PREDICTION, predicted))


@check("score_batch", NORMAL)
def score_batch(spark, d):
    return normal(models.score_batch(fitted_linear(spark, d), split(spark, d, "train")))


@check("sink_predictions_json", NORMAL)
def sink_predictions_json(spark, d):
    path = scratch_path(spark, "predictions")
    sources.write_predictions_json(models.score_batch(fitted_linear(spark, d), split(spark, d, "train")), path)
    back = spark.read.schema("predicted_play_count double, features array<double>").json(path)
    return normal(back.select(PREDICTION, *[F.col("features")[i].alias(c) for i, c in enumerate(MODEL_INPUTS)]))


@check("model_save_load", NORMAL)
def model_save_load(spark, d):
    path = scratch_path(spark, "model")
    models.save_model(fitted_linear(spark, d), path)
    return normal(models.score_batch(models.load_model(path), split(spark, d, "train")))


EARLY = f"{fv.FEATURES_L}, train AS MATERIALIZED (SELECT * FROM features WHERE week <= 100)"


@check("ols_14", f"{EARLY} {normal_sql('train')}")
def ols_14(spark, d):
    """All inputs, weeks up to 100, as in the exploratory study."""
    early = fv.feature_table(spark, d).filter("week <= 100")
    return normal(models.score_batch(models.train_ols(early, MODEL_INPUTS), early))


@check("ols_14_evaluated", f"""{fv.FEATURES_L}, late AS (SELECT *, track_id IN (SELECT track_id FROM sessions_l) AS heard FROM features WHERE week > 127)
    SELECT 'all' AS tracks, metric, true AS sound FROM (VALUES ('rmse'), ('mae'), ('mse'), ('r2'), ('ndcg@100')) m(metric) WHERE EXISTS (FROM late)
    UNION ALL SELECT 'heard', metric, true FROM (VALUES ('rmse'), ('mae'), ('mse'), ('r2'), ('ndcg@100')) m(metric) WHERE EXISTS (FROM late WHERE heard)""")
def ols_14_evaluated(spark, d):
    """Scored on the weeks after 127, for all tracks and for those that occur in the log."""
    features = fv.feature_table(spark, d)
    model = models.train_ols(features.filter("week <= 100"), MODEL_INPUTS)
    # Written once: four passes read them, and a row is dear to score.
    late = materialized(models.score_batch(model, features.filter("week > 127")).select("track_id", "week", LABEL, PREDICTION), "late")
    heard = semi_join_active(late, materialized(v.sessions_l(spark, d).select("track_id").distinct(), "played"))
    return sound(evaluate(late, 100)).withColumn("tracks", F.lit("all")).unionByName(
        sound(evaluate(heard, 100)).withColumn("tracks", F.lit("heard")))


def sound(metrics: DataFrame) -> DataFrame:
    """Whether each metric has a value it can have: errors from 0 up, shares of a whole up to 1."""
    value, name = F.col("value"), F.col("metric")
    within = F.when(name.startswith("ndcg"), value.between(0, 1)).when(name == "r2", value <= 1).otherwise(value >= 0)
    return metrics.select("metric", F.coalesce(within, F.lit(False)).alias("sound"))


LAGS = ["lag_1", "lag_2", "lag_3"]
_COV = {(a, b): f"covar_pop({a}, {b})" for a in (*LAGS, "play_count") for b in (*LAGS, "play_count")}


def _det(columns: list[list[str]]) -> str:
    (a, b, c), (e, f, g), (h, i, j) = columns
    return f"({a} * ({f} * {j} - {g} * {i}) - {e} * ({b} * {j} - {c} * {i}) + {h} * ({b} * {g} - {c} * {f}))"


def ols_ctes() -> str:
    """Three-regressor least squares by Cramer's rule on the covariances: b0 to b2 and b."""
    names = {f"c{i}{j}": _COV[LAGS[i], LAGS[j]] for i in range(3) for j in range(3)}
    names.update({f"y{i}": _COV[LAGS[i], "play_count"] for i in range(3)})
    means = ", ".join(f"avg({c}) AS m_{c}" for c in (*LAGS, "play_count"))
    columns = [[f"c{i}{j}" for i in range(3)] for j in range(3)]
    target = ["y0", "y1", "y2"]
    slopes = ", ".join(
        f"{_det([target if j == k else columns[j] for j in range(3)])} / {_det(columns)} AS b{k}" for k in range(3)
    )
    return f"""{fv.FEATURES_L}, train AS (SELECT * FROM features WHERE week > 4 AND week <= 42),
    moments AS (SELECT {', '.join(f'{e} AS {n}' for n, e in names.items())}, {means} FROM train),
    slopes AS (SELECT *, {slopes} FROM moments),
    ols AS MATERIALIZED (SELECT b0, b1, b2, m_play_count - b0 * m_lag_1 - b1 * m_lag_2 - b2 * m_lag_3 AS b FROM slopes)"""


OLS_SCORED = f"""{ols_ctes()}, scored AS MATERIALIZED (SELECT *, (SELECT b FROM ols) + (SELECT b0 FROM ols) * lag_1
    + (SELECT b1 FROM ols) * lag_2 + (SELECT b2 FROM ols) * lag_3 AS predicted_play_count
    FROM features WHERE week IN (126, 157))"""
OLS_PREDICTIONS = f"{OLS_SCORED} SELECT track_id, week, play_count, {q6('predicted_play_count')} AS predicted_play_count FROM scored"


def fit_ols(rows: DataFrame):
    return models.train_ols(rows.filter((F.col("week") > 4) & (F.col("week") <= 42)), LAGS)


@check("ols_lags", f"""{ols_ctes()} SELECT 'intercept' AS term, {q6('b')} AS value FROM ols
    UNION ALL SELECT 'lag_1', {q6('b0')} FROM ols UNION ALL SELECT 'lag_2', {q6('b1')} FROM ols
    UNION ALL SELECT 'lag_3', {q6('b2')} FROM ols""")
def ols_lags(spark, d):
    model = fit_ols(fv.feature_table(spark, d)).stages[-1]
    terms = list(zip(["intercept", *LAGS], [model.intercept, *map(float, model.coefficients)]))
    return spark.createDataFrame(terms, "term string, value double").withColumn("value", r6("value"))


@check("score_ols", OLS_PREDICTIONS)
def score_ols(spark, d):
    return predictions(models.score_batch(fit_ols(fv.feature_table(spark, d)), split(spark, d, "test")))


@check("save_load_ols", OLS_PREDICTIONS)
def save_load_ols(spark, d):
    path = scratch_path(spark, "model")
    models.save_model(fit_ols(fv.feature_table(spark, d)), path)
    return predictions(models.score_batch(models.load_model(path), split(spark, d, "test")))


@check("train_and_evaluate_ols", f"""{OLS_SCORED}, {METRICS}, {ndcg_sql(20)} SELECT * FROM metrics
    UNION ALL SELECT 'ndcg@20', {q6('avg(ndcg)')} FROM ndcg""")
def train_and_evaluate_ols(spark, d):
    path = scratch_path(spark, "ols")
    _, metrics = train_and_evaluate(fv.feature_table(spark, d), fit_ols, output=path)
    return metrics.withColumn("value", r6("value"))


@check("sink_predictions_ols", OLS_PREDICTIONS)
def sink_predictions_ols(spark, d):
    path = scratch_path(spark, "ols")
    train_and_evaluate(fv.feature_table(spark, d), fit_ols, output=path)
    written = spark.read.schema("track_id bigint, week bigint, play_count double, predicted_play_count double")
    return predictions(written.json(f"{path}/predictions"))


@check("toplist_ols", f"""{OLS_SCORED}, best AS (SELECT track_id, predicted_play_count FROM scored WHERE week = 126
        ORDER BY predicted_play_count DESC, track_id LIMIT 50)
    SELECT CAST(row_number() OVER (ORDER BY predicted_play_count DESC, b.track_id) AS BIGINT) AS rank, b.track_id, name,
        {q6('predicted_play_count')} AS predicted_play_count
    FROM best b LEFT JOIN tracks t ON b.track_id = t.track_id""")
def toplist_ols(spark, d):
    features = fv.feature_table(spark, d)
    top = toplist(features, v.tracks(spark, d), 126, 50, fit_ols(features))
    return top.withColumn(PREDICTION, r6(PREDICTION))


@check("ols_single_lag", f"""{fv.FEATURES_L} SELECT {q6('regr_slope(play_count, lag_1)')} AS slope,
    {q6('regr_intercept(play_count, lag_1)')} AS intercept, CAST(regr_count(play_count, lag_1) AS BIGINT) AS n
    FROM features WHERE week <= 100""")
def ols_single_lag(spark, d):
    line = models.ols_single_lag(fv.feature_table(spark, d).filter("week <= 100"))
    return line.withColumns({"slope": r6("slope"), "intercept": r6("intercept")})


# Of boosted trees SQL knows the rows they must score, the parameters a search may draw, and that they are no worse than the mean.

@check("train_gbt", f"""{TRAIN} SELECT week, count(*) AS n, count(*) AS n_finite, sum(play_count) AS label_sum, true AS no_worse_than_mean
    FROM train GROUP BY week""")
def train_gbt(spark, d):
    train = split(spark, d, "train")
    scored = models.score_batch(models.train_gbt(train), train).select("week", LABEL, PREDICTION)
    finite = F.abs(PREDICTION) < float("inf")
    # The rows are scored once: error and variance of all weeks are put together from sums by week.
    by_week = scored.groupBy("week").agg(
        F.count("*").alias("n"), F.count_if(finite).alias("n_finite"), F.sum(LABEL).alias("label_sum"),
        F.sum((F.col(LABEL) - F.col(PREDICTION)) ** 2).alias("errors"), F.sum(F.col(LABEL) ** 2).alias("squares"))

    def mean(sums: str) -> Column:
        weeks = W.partitionBy()  # one row per week
        return F.sum(sums).over(weeks) / F.sum("n").over(weeks)

    # trees that find nothing to split predict the mean of a sample
    no_worse = mean("errors") <= 1.01 * (mean("squares") - mean("label_sum") ** 2)
    return by_week.withColumn("no_worse_than_mean", no_worse).drop("errors", "squares")


@check("train_and_evaluate_gbt", f"""{fv.FEATURES_L} SELECT metric, true AS sound
    FROM (VALUES ('rmse'), ('mae'), ('mse'), ('r2'), ('ndcg@20')) m(metric) WHERE EXISTS (FROM features WHERE week IN (126, 157))""")
def train_and_evaluate_gbt(spark, d):
    _, metrics = train_and_evaluate(fv.feature_table(spark, d), models.train_gbt, output=scratch_path(spark, "gbt"))
    return sound(metrics)


@check("tune_gbt", "SELECT CAST(i AS INT) AS trial, true AS in_space, true AS sound FROM range(20) t(i)")
def tune_gbt(spark, d):
    trials = models.tune_gbt(split(spark, d, "train"), split(spark, d, "validation"), parallelism=8)
    drawn = F.from_json("params", ", ".join(
        f"{name} {'string' if isinstance(choice, list) else 'double'}" for name, choice in models.trees.SEARCH_SPACE.items()))
    inside = F.lit(True)
    for name, choice in models.trees.SEARCH_SPACE.items():
        value = F.col("drawn")[name]
        inside = inside & (value.isin(*choice) if isinstance(choice, list) else value.between(*choice))
    return trials.withColumn("drawn", drawn).select(
        "trial", inside.alias("in_space"), ((F.col("mse") >= 0) & (F.col("mse") < float("inf"))).alias("sound"))


@check("best_params_store", f"""SELECT param, true AS in_space FROM (VALUES {', '.join(f"('{p}')" for p in models.trees.SEARCH_SPACE)}) p(param)""")
def best_params_store(spark, d):
    path = scratch_path(spark, "best-params")
    sets = split(spark, d, "train"), split(spark, d, "validation")
    found = models.best_or_tuned(*sets, path, parallelism=8)
    params = models.best_or_tuned(*sets, path)
    assert params == found
    inside = {
        name: params[name] in choice if isinstance(choice, list) else choice[0] <= params[name] <= choice[1]
        for name, choice in models.trees.SEARCH_SPACE.items()}
    return spark.createDataFrame(list(inside.items()), "param string, in_space boolean")


# Composite jobs

@check("build_features", f"{fv.FEATURES_L} SELECT * REPLACE ({q6('lag_playtime_ratio')} AS lag_playtime_ratio) FROM features")
def build_features(spark, d):
    return fv.features_l(spark, d).withColumn("lag_playtime_ratio", r6("lag_playtime_ratio"))


@check("build_features_events", f"{fv.FEATURES_E} SELECT * REPLACE ({q6('lag_playtime_ratio')} AS lag_playtime_ratio) FROM features")
def build_features_events(spark, d):
    return fv.features_e(spark, d).withColumn("lag_playtime_ratio", r6("lag_playtime_ratio"))


@check("train_and_evaluate", f"""{fv.FEATURES_L} SELECT metric, true AS sound
    FROM (VALUES ('rmse'), ('mae'), ('mse'), ('r2'), ('ndcg@20')) m(metric) WHERE EXISTS (FROM features WHERE week IN (126, 157))""")
def train_and_evaluate_(spark, d):
    _, metrics = train_and_evaluate(
        fv.feature_table(spark, d), models.train_linear, output=scratch_path(spark, "linear")
    )
    return sound(metrics)


TOPLIST_DAY = week_start(126, v.ANCHOR_L).strftime("%Y-%m-%d")


@check("toplist", f"""{fv.FEATURES_L}, best AS (SELECT track_id, lag_1 AS predicted_play_count FROM features WHERE week = 126
        ORDER BY lag_1 DESC, track_id LIMIT 50)
    SELECT CAST(row_number() OVER (ORDER BY predicted_play_count DESC, b.track_id) AS BIGINT) AS rank, b.track_id, name, predicted_play_count
    FROM best b LEFT JOIN tracks t ON b.track_id = t.track_id""")
def toplist_(spark, d):
    request = toplist_request({"tracks_num": 50, "date": TOPLIST_DAY}, v.ANCHOR_L)
    return toplist(
        fv.feature_table(spark, d), v.tracks(spark, d), request["week"], request["tracks_num"], persistence
    )


LISTED = f"{v.with_views('tracks')} SELECT CAST(i + 1 AS BIGINT) AS rank, true AS known, true AS in_order FROM range(50) t(i) WHERE i < (SELECT count(*) FROM tracks)"


def listed(spark, d, arguments: dict, trained: dict) -> DataFrame:
    """The job as it is called: models stored first, then loaded; ranks, whether names are known, and the order."""
    path = scratch_path(spark, "models")
    for name, model in trained.items():
        models.save_model(model, f"{path}/{name}")
    stored = {name: models.load_model(f"{path}/{name}") for name in trained}
    top = toplist_job({"tracks_num": 50, "date": TOPLIST_DAY, **arguments}, fv.feature_table(spark, d), v.tracks(spark, d), stored, v.ANCHOR_L)
    before = F.lag(PREDICTION).over(W.orderBy("rank"))  # 50 rows
    return top.select("rank", F.col("name").isNotNull().alias("known"), F.coalesce(before >= F.col(PREDICTION), F.lit(True)).alias("in_order"))


@check("toplist_model", LISTED)
def toplist_model(spark, d):
    request = toplist_request({"tracks_num": 50, "date": TOPLIST_DAY, "model_type": "basic"}, v.ANCHOR_L)
    top = toplist(
        fv.feature_table(spark, d), v.tracks(spark, d), request["week"], request["tracks_num"], fitted_linear(spark, d)
    )
    before = F.lag(PREDICTION).over(W.orderBy("rank"))
    return top.select("rank", F.col("name").isNotNull().alias("known"), F.coalesce(before >= F.col(PREDICTION), F.lit(True)).alias("in_order"))


@check("toplist_job_basic", LISTED)
def toplist_job_basic(spark, d):
    return listed(spark, d, {"model_type": "basic"}, {"basic": fitted_linear(spark, d)})


@check("toplist_job_advanced", LISTED)
def toplist_job_advanced(spark, d):
    """The default model."""
    return listed(spark, d, {}, {"advanced": models.train_gbt(split(spark, d, "train"))})


@check("popular_tracks_report", f"""{ALL_SCORED},
    real_top AS (SELECT CAST(row_number() OVER (ORDER BY play_count DESC, track_id) AS BIGINT) AS rank, track_id AS real_track_id,
        play_count AS real_value FROM scored WHERE week = 44 QUALIFY rank <= 20),
    predicted AS (SELECT CAST(row_number() OVER (ORDER BY predicted_play_count DESC, track_id) AS BIGINT) AS rank,
        track_id AS predicted_track_id, predicted_play_count AS predicted_value FROM scored WHERE week = 44 QUALIFY rank <= 20)
    SELECT r.rank, real_track_id, real_value, predicted_track_id, predicted_value FROM real_top r JOIN predicted p ON r.rank = p.rank""")
def popular_tracks_report_(spark, d):
    return popular_tracks_report(persistence(fv.feature_table(spark, d)), 44, LABEL, PREDICTION)


LISTEN_TRAIN = f"""{fv.LISTEN_L}, train AS MATERIALIZED (SELECT listenability, {', '.join(f'coalesce({c}, 0) AS {c}' for c in LAGS)}
    FROM listening WHERE active AND week > 4 AND week <= 42)"""


def listenability_lags(spark, d) -> DataFrame:
    return fv.panel_l(spark, d).fillna(0, [*LAGS, "listenability"]).select("track_id", "week", "active", "listenability", *LAGS)


def fit_listenability(rows: DataFrame):
    return models.train_ols(rows.filter("active AND week > 4 AND week <= 42"), LAGS, "listenability")


@check("ols_listenability", f"{LISTEN_TRAIN} {normal_sql('train', 'listenability', LAGS)}")
def ols_listenability(spark, d):
    rows = listenability_lags(spark, d)
    train = rows.filter("active AND week > 4 AND week <= 42")
    return normal(models.score_batch(fit_listenability(rows), train), "listenability", LAGS)


@check("ols_listenability_report", f"""{fv.LISTEN_L}, late AS (SELECT track_id, coalesce(listenability, 0) AS listenability FROM listening WHERE week = 44)
    SELECT CAST(row_number() OVER (ORDER BY listenability DESC, track_id) AS BIGINT) AS rank, track_id AS real_track_id,
        {q6('listenability')} AS real_value FROM late QUALIFY rank <= 20""")
def ols_listenability_report(spark, d):
    """Weeks after 42 scored, the best 20 of week 44, real and predicted; SQL knows the real ones."""
    rows = listenability_lags(spark, d)
    scored = models.score_batch(fit_listenability(rows), rows.filter("week > 42"))
    report = popular_tracks_report(scored, 44, "listenability", PREDICTION)
    return report.where("predicted_track_id IS NOT NULL AND predicted_value IS NOT NULL").select("rank", "real_track_id", r6("real_value").alias("real_value"))


def line(part: str, item, n) -> str:
    return f"SELECT '{part}' AS part, CAST({item} AS VARCHAR) AS item, CAST({n} AS BIGINT) AS n"


def info_lines(part: str, table: str, columns: list[str]) -> list[str]:
    return [line(part, f"'{c}'", f"count(*) - count(\"{c}\")") + f" FROM {table}" for c in columns]


QUALITY = v.with_views("sessions_e", "tracks", "artists", "users") + " UNION ALL ".join([
    *info_lines("sessions_info", "sessions_e", ["event_id", "timestamp", "user_id", "track_id", "event_type"]),
    *info_lines("tracks_info", "tracks", ["track_id", "name", "id_artist", *TRACK_ATTRIBUTES]),
    *info_lines("artists_info", "artists", ["id", "genre"]),
    *info_lines("users_info", "users", ["user_id", "favourite_genres"]),
    line("sessions_missing_track", "event_type", "count(*) - count(track_id)") + " FROM sessions_e GROUP BY event_type",
    line("sessions_event_types", "event_type", "count(*)") + " FROM sessions_e GROUP BY event_type",
    line("sessions_per_week", "week", "count(*)") + " FROM sessions_e GROUP BY week",
    line("sessions_time_span", "'n_weeks'", "max(week) - min(week) + 1") + " FROM sessions_e",
    line("sessions_distinct", "'track_id'", "count(DISTINCT track_id)") + " FROM sessions_e",
    line("sessions_distinct", "'user_id'", "count(DISTINCT user_id)") + " FROM sessions_e",
    line("tracks_silent", "'n'", "count(*)") + " FROM tracks WHERE track_id NOT IN (SELECT track_id FROM sessions_e WHERE track_id IS NOT NULL)",
    line("artists_duplicate_ids", "id", "count(*)") + " FROM artists GROUP BY id HAVING count(*) > 1",
    line("artists_distinct", "'id_artist'", "count(DISTINCT id_artist)") + " FROM tracks",
    line("artists_without_tracks", "id", "count(*)") + " FROM artists WHERE id NOT IN (SELECT id_artist FROM tracks) GROUP BY id",
    line("users_genres", "genre", "count(*)") + " FROM (SELECT unnest(favourite_genres) AS genre FROM users) GROUP BY genre",
])


#: Parts of the report that are not a name and a count.
QUALITY_PARTS = {
    "sessions_time_span": f"""{v.with_views("sessions_e")} SELECT min("timestamp") AS first, max("timestamp") AS last,
        max(week) - min(week) + 1 AS n_weeks FROM sessions_e""",
    "sessions_unknown_tracks": f"""{v.with_views("sessions_e", "tracks")} SELECT track_id, CAST(count(*) AS BIGINT) AS n FROM sessions_e
        WHERE track_id IS NOT NULL AND track_id NOT IN (SELECT track_id FROM tracks) GROUP BY track_id""",
    "tracks_duplicate_ids": f"""{v.with_views("tracks")} SELECT track_id, CAST(count(*) AS BIGINT) AS n FROM tracks
        GROUP BY track_id HAVING count(*) > 1""",
    "tracks_histogram": f"{v.with_views('tracks')}, {histogram_sql('tracks', [c for c in TRACK_ATTRIBUTES if c != 'release_date'], 50)}",
    "sessions_info": v.with_views("sessions_e") + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, CAST(count(*) AS BIGINT) AS n_rows, CAST(count("{c}") AS BIGINT) AS n_non_null,
        CAST(count(*) - count("{c}") AS BIGINT) AS n_null FROM sessions_e"""
        for c, t in {"event_id": "bigint", "timestamp": "timestamp_ntz", "user_id": "bigint", "track_id": "bigint", "event_type": "string"}.items()),
}


def quality_part(name: str):
    def query(spark, d):
        part = quality_report(
            v.sessions_e(spark, d), v.tracks(spark, d), v.artists(spark, d), v.users(spark, d), v.ANCHOR_E)[name]
        return part.withColumn("bin_start", r6("bin_start")) if "bin_start" in part.columns else part
    return query


for _name, _sql in QUALITY_PARTS.items():
    check(f"quality_{_name}", _sql)(quality_part(_name))


@check("quality_report", QUALITY)
def quality_report_(spark, d):
    parts = quality_report(
        v.sessions_e(spark, d), v.tracks(spark, d), v.artists(spark, d), v.users(spark, d), v.ANCHOR_E
    )
    silent = parts["artists_without_tracks"].groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    lines = {
        **{f"{t}_info": (parts[f"{t}_info"], "column", "n_null") for t in ("sessions", "tracks", "artists", "users")},
        "sessions_missing_track": (parts["sessions_missing_track"], "event_type", "n_missing"),
        "sessions_event_types": (parts["sessions_event_types"], "event_type", "n"),
        "sessions_per_week": (parts["sessions_per_week"], "week", "n"),
        "artists_duplicate_ids": (parts["artists_duplicate_ids"], "id", "n"),
        "artists_without_tracks": (silent, "id", "n"),
        "users_genres": (parts["users_genres"], "favourite_genres", "n"),
    }
    for name, column in [
        ("sessions_time_span", "n_weeks"), ("sessions_distinct", "track_id"), ("sessions_distinct", "user_id"),
        ("tracks_silent", "n"), ("artists_distinct", "id_artist"),
    ]:
        item = parts[name].select(F.lit(column).alias("item"), F.col(column).alias("n"))
        lines[f"{name}.{column}"] = (item, "item", "n")
    report = None
    for name, (df, item, n) in lines.items():
        rows = df.select(
            F.lit(name.split(".")[0]).alias("part"), F.col(item).cast("string").alias("item"), F.col(n).cast("bigint").alias("n")
        )
        report = rows if report is None else report.unionByName(rows)
    return report


FILLED = ["listenability", "lag_1", "lag_2", "lag_3", *TRACK_ATTRIBUTES]
PARTS = ["week", "play_count", "like_count", "playtime_ratio", *FILLED]


def variant(name: str, source: str, columns: list[str]) -> str:
    return f"SELECT * FROM ({corr_sql(source, columns, constants=f'{chr(39)}{name}{chr(39)} AS variant, ')})"


CORRELATIONS = f"""{fv.LISTEN_L},
    filled AS (SELECT track_id, active, CAST(week AS DOUBLE) AS week,
        {', '.join(f'CAST(coalesce({c}, 0) AS DOUBLE) AS {c}' for c in FILLED)} FROM listening),
    warm AS (SELECT * FROM filled WHERE week > 4), active AS (SELECT * FROM filled WHERE active),
    active_warm AS (SELECT * FROM filled WHERE active AND week > 4),
    totals AS (SELECT track_id, active, sum(listenability) AS listenability,
        {', '.join(f'arg_min({c}, week) AS {c}' for c in TRACK_ATTRIBUTES)} FROM filled GROUP BY track_id, active),
    totals_active AS (SELECT * FROM totals WHERE active),
    parts AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in PARTS)} FROM listening)
    """ + " UNION ALL ".join([
    variant("all", "filled", FILLED), variant("warm", "warm", FILLED), variant("active", "active", FILLED),
    variant("active_warm", "active_warm", FILLED), variant("totals", "totals", ["listenability", *TRACK_ATTRIBUTES]),
    variant("totals_active", "totals_active", ["listenability", *TRACK_ATTRIBUTES]),
    variant("with_week", "filled", ["week", *FILLED]), variant("with_parts", "parts", PARTS),
])


@check("correlation_report", CORRELATIONS)
def correlation_report_(spark, d):
    return correlation_report(fv.cells_l(spark, d)).withColumn("r", r6("r"))


@check("correlation_thresholds", f"""WITH report AS ({CORRELATIONS}) SELECT variant, attr_a, r FROM report
    WHERE attr_b = 'listenability' AND abs(r) > 0.05""")
def correlation_thresholds(spark, d):
    """For every variant what goes with listenability by more than five hundredths."""
    report = correlation_report(fv.cells_l(spark, d))
    strong = report.filter((F.col("attr_b") == "listenability") & (F.abs("r") > 0.05))
    return strong.select("variant", "attr_a", r6("r").alias("r"))


HEARD = f"{fv.LISTEN_L}, active AS (SELECT * FROM listening WHERE active)"
SUMS = f"""{HEARD}, sums AS (SELECT track_id, sum(coalesce(listenability, 0)) AS listenability FROM listening GROUP BY track_id),
    active_sums AS (SELECT * FROM sums WHERE track_id IN (SELECT track_id FROM active))"""


def binned(rows: DataFrame) -> DataFrame:
    return histogram(rows, ["listenability"], 1000).withColumn("bin_start", r6("bin_start"))


@check("histogram_listenability_active", f"{HEARD}, {histogram_sql('active', ['listenability'], 1000)}")
def histogram_listenability_active(spark, d):
    return binned(fv.panel_l(spark, d).filter("active"))


@check("histogram_listenability_totals", f"{SUMS}, {histogram_sql('sums', ['listenability'], 1000)}")
def histogram_listenability_totals(spark, d):
    return binned(listenability_totals(fill_zero(fv.panel_l(spark, d)), []))


@check("histogram_listenability_totals_active", f"{SUMS}, {histogram_sql('active_sums', ['listenability'], 1000)}")
def histogram_listenability_totals_active(spark, d):
    return binned(listenability_totals(fill_zero(fv.panel_l(spark, d)), []).filter("active"))
