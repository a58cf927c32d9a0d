"""Series: cleaning, imputation, windows and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as T
from ..operators import matrix as X
from ..operators import models as MO
from . import views as V
from .registry import query


def known(spark, d):
    return V.series(spark, d).filter("speed is not null")


@query("drop_weekends", "SELECT segment, ts, cnt FROM series WHERE isodow(ts) < 6", "series")
def drop_weekends(spark, d):
    return X.drop_weekends(V.series(spark, d)).select("segment", "ts", "cnt")


@query(
    "drop_erroneous_days",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(cnt) AS total, count(DISTINCT ts) AS slots FROM series GROUP BY 1),
      m AS (SELECT quantile_cont(total, 0.5) AS med FROM d), k AS (SELECT slots FROM d GROUP BY 1 ORDER BY count(*) DESC, slots LIMIT 1)
      SELECT segment, ts, cnt FROM series WHERE CAST(ts AS DATE) IN (SELECT day FROM d, m, k WHERE total > 0.75 * med AND d.slots = k.slots)""",
    "series",
)
def drop_erroneous_days(spark, d):
    return X.drop_erroneous_days(V.series(spark, d)).select("segment", "ts", "cnt")


@query("valid_threshold", "SELECT segment, count(speed) AS known FROM series GROUP BY 1 HAVING count(speed) >= floor(0.8 * (SELECT count(DISTINCT ts) FROM series))", "series")
def valid_threshold(spark, d):
    return X.valid_segments(V.series(spark, d))


BAND_SQL = """SELECT road, 100.0 * (30 - n) / 30 AS missing, CASE WHEN 100.0 * (30 - n) / 30 < 20 THEN '0-20' WHEN 100.0 * (30 - n) / 30 < 22 THEN '20-22' ELSE '22-25' END AS band
  FROM (SELECT id AS road, count(DISTINCT CAST(ts AS DATE)) AS n FROM gps GROUP BY 1) WHERE 100.0 * (30 - n) / 30 < 25"""


@query("missing_bands", BAND_SQL, "gps", "missing")
def missing_bands(spark, d):
    """Cars as rows, days as slots: the grid of the month."""
    from ..operators.reshape import densify

    g = V.gps(spark, d).groupBy(F.col("id").alias("segment"), F.window("ts", "1440 minutes")["start"].alias("ts")).agg(F.avg("speed").alias("speed"))
    return X.missing_bands(densify(g, "segment", 1440, ts="ts")).select(F.col("segment").alias("road"), "missing", "band")


@query("missing_by_slot", "SELECT ts, avg(CASE WHEN speed IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM dense GROUP BY 1", "dense", "share")
def missing_by_slot(spark, d):
    return X.missing_by_slot(V.dense(spark, d))


@query("missing_by_segment", "SELECT segment, count(*) FILTER (speed IS NULL) AS missing FROM dense GROUP BY 1", "dense")
def missing_by_segment(spark, d):
    return X.missing_by_segment(V.dense(spark, d))


@query("merged_speed", "SELECT grp, ts, sum(speed * cnt) / sum(cnt) AS speed, CAST(sum(cnt) AS BIGINT) AS cnt FROM series s JOIN segmap m ON m.segment = s.segment GROUP BY 1, 2", ("series", "segmap"), "speed")
def merged_speed(spark, d):
    return X.merged_speed(V.series(spark, d), V.segment_map(spark, d))


@query("merge_group_na", "SELECT grp, avg(na) AS mean_na, min(na) AS min_na, count(*) AS members FROM (SELECT segment, avg(CASE WHEN speed IS NULL THEN 1.0 ELSE 0.0 END) AS na FROM dense GROUP BY 1) n JOIN segmap m ON m.segment = n.segment GROUP BY 1", ("dense", "segmap"), ("mean_na", "min_na"))
def merge_group_na(spark, d):
    return X.merge_group_na(V.dense(spark, d), V.segment_map(spark, d))


@query("impute_tod_mean", "SELECT segment, ts, coalesce(speed, avg(speed) OVER (PARTITION BY segment, extract(hour FROM ts))) AS speed FROM dense", "dense", "speed")
def impute_tod_mean(spark, d):
    return X.impute_by_clock(V.dense(spark, d)).select("segment", "ts", "speed")


@query("train_split", "SELECT segment, ts, train FROM marked", "marked")
def train_split(spark, d):
    return X.train_split(known(spark, d)).select("segment", "ts", "train")


@query("center_by_tod", "SELECT segment, ts, train, m AS mean, speed - m AS centred FROM (SELECT *, avg(speed) FILTER (train) OVER (PARTITION BY segment, tod) AS m FROM marked)", "marked", ("mean", "centred"))
def center_by_tod(spark, d):
    return X.centre_by_clock(known(spark, d)).select("segment", "ts", "train", "mean", "centred")


DAY = "PARTITION BY segment, CAST(ts AS DATE) ORDER BY ts"


@query("lag_features", f"SELECT segment, ts, lag(speed, 2) OVER w AS x_1, lag(speed, 1) OVER w AS x_2, speed AS y FROM known WINDOW w AS ({DAY}) QUALIFY row_number() OVER w > 2", "known", ("x_1", "x_2", "y"))
def lag_features(spark, d):
    return X.lag_features(known(spark, d), 2)


@query("network_samples", f"SELECT segment, ts, lag(speed, 2) OVER w + lag(speed, 1) OVER w AS x, speed AS y FROM known WINDOW w AS ({DAY}) QUALIFY row_number() OVER w > 2", "known", ("x", "y"))
def network_samples(spark, d):
    return MO.samples_for_networks(known(spark, d), 2).withColumn("x", F.get("x", F.lit(0)) + F.get("x", F.lit(1)))


@query("differenced_error", f"SELECT model, segment, ts, e - lag(e) OVER w AS diff FROM (SELECT *, y - pred AS e FROM fc WHERE model = 'clock') WINDOW w AS ({DAY}) QUALIFY row_number() OVER w > 1", "fc", "diff")
def differenced_error(spark, d):
    e = V.forecasts(spark, d).filter("model = 'clock'").withColumn("e", F.col("y") - F.col("pred"))
    return X.differenced(e, "e").select("model", "segment", "ts", "diff")


@query("scale_log", f"SELECT segment, ts, ln(1 + speed) - lag(ln(1 + speed)) OVER w AS scaled FROM known WINDOW w AS ({DAY}) QUALIFY row_number() OVER w > 1", "known", "scaled")
def scale_log(spark, d):
    return X.scale_log(known(spark, d)).select("segment", "ts", "scaled")


@query("diff_target", f"SELECT segment, ts, lag(speed, 1) OVER w AS last, speed - lag(speed, 1) OVER w AS y FROM known WINDOW w AS ({DAY}) QUALIFY row_number() OVER w > 2", "known", ("last", "y"))
def diff_target(spark, d):
    return MO.differentiate_target(X.lag_features(known(spark, d), 2), 2).select("segment", "ts", "last", "y")


@query("minmax_global", "SELECT segment, ts, (speed - lo) / (hi - lo) AS scaled FROM marked, (SELECT min(speed) AS lo, max(speed) AS hi FROM marked WHERE train)", "marked", "scaled")
def minmax_global(spark, d):
    return X.minmax_global(known(spark, d)).select("segment", "ts", "scaled")


@query("minmax_segment", "SELECT segment, ts, (speed - lo) / (hi - lo) AS scaled FROM (SELECT *, min(speed) FILTER (train) OVER (PARTITION BY segment) AS lo, max(speed) FILTER (train) OVER (PARTITION BY segment) AS hi FROM marked)", "marked", "scaled")
def minmax_segment(spark, d):
    return X.minmax_segment(known(spark, d)).select("segment", "ts", "scaled")


@query("scale_max", "SELECT segment, ts, speed / 130.0 AS scaled FROM known", "known", "scaled")
def scale_max(spark, d):
    return known(spark, d).select("segment", "ts", X.scale_max(F.col("speed")).alias("scaled"))


@query("regime_split", "SELECT segment, ts, CAST(slot AS INTEGER) AS slot, side FROM (SELECT segment, ts, row_number() OVER (PARTITION BY segment, CAST(ts AS DATE) ORDER BY ts) - 1 AS slot FROM known) s JOIN (VALUES ('left'), ('right')) v(side) ON (side = 'left' AND slot <= 8) OR (side = 'right' AND slot >= 8)", "known")
def regime_split(spark, d):
    return X.regime_split(known(spark, d), 8).select("segment", "ts", "slot", "side")


@query("sliding_slots", 'SELECT segment, ts, CAST(w AS INTEGER) AS "window" FROM (SELECT segment, ts, unnest(generate_series(greatest(extract(hour FROM ts) - 1, 0), least(extract(hour FROM ts), 22))) AS w FROM known)', "known")
def sliding_slots(spark, d):
    return X.sliding_slots(known(spark, d), 2, 60).select("segment", "ts", "window")


@query(
    "smooth",
    """WITH s AS (SELECT segment, ts, speed, row_number() OVER (PARTITION BY segment ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY segment) AS n FROM known),
      k AS (SELECT o, exp(-0.5 * o * o) / sum(exp(-0.5 * o * o)) OVER () AS w FROM (SELECT unnest(generate_series(-4, 4)) AS o)),
      j AS (SELECT s.segment, s.ts, k.w, CASE WHEN s.i + o < 0 THEN -(s.i + o) - 1 WHEN s.i + o >= s.n THEN 2 * s.n - 1 - (s.i + o) ELSE s.i + o END AS i FROM s CROSS JOIN k)
      SELECT j.segment, j.ts, sum(j.w * s.speed) AS speed FROM j JOIN s ON s.segment = j.segment AND s.i = j.i GROUP BY 1, 2""",
    "known",
    "speed",
)
def smooth(spark, d):
    return X.smooth(known(spark, d), 1.0)


@query(
    "gap_rows",
    """WITH w AS (SELECT segment, ts, speed FROM known WHERE isodow(ts) < 6), d AS (SELECT DISTINCT segment, CAST(ts AS DATE) AS day FROM w), n AS (SELECT *, lead(day) OVER (PARTITION BY segment ORDER BY day) AS nx FROM d)
      SELECT segment, ts, speed FROM w UNION ALL SELECT segment, CAST(day + 1 AS TIMESTAMP), NULL FROM n WHERE nx - day > 1""",
    "known",
    "speed",
)
def gap_rows(spark, d):
    return X.gap_rows(X.drop_weekends(known(spark, d)))


@query("ranked_counts", "SELECT segment, max(cnt) AS top FROM series GROUP BY 1", "series")
def ranked_counts(spark, d):
    return X.ranked_counts(V.series(spark, d))


@query(
    "cumulative_segments_over_10",
    "SELECT slots, segments, CAST(sum(segments) OVER (ORDER BY slots DESC) AS BIGINT) AS at_least FROM (SELECT slots, count(*) AS segments FROM (SELECT id, count(*) FILTER (n > 3) AS slots FROM (SELECT id, CAST(ts AS DATE) AS day, count(*) AS n FROM gps GROUP BY 1, 2) GROUP BY 1) GROUP BY 1)",
    "gps",
)
def cumulative_segments(spark, d):
    per = V.gps(spark, d).groupBy(F.col("id").alias("segment"), T.day(F.col("ts")).alias("ts")).agg(F.count(F.lit(1)).alias("cnt"))
    return X.cumulative_above(per, 3)


@query("segment_corr", "SELECT x.segment AS a, y.segment AS b, corr(x.speed, y.speed) AS corr FROM series x JOIN series y ON x.ts = y.ts AND x.segment <= y.segment GROUP BY 1, 2", "series", "corr")
def segment_corr(spark, d):
    return X.correlations(V.series(spark, d))


@query(
    "autocorr",
    """WITH x AS (SELECT ts, avg(speed) AS x, row_number() OVER (ORDER BY ts) AS i FROM known GROUP BY 1), s AS (SELECT avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM x)
      SELECT b.i - a.i AS lag, sum((a.x - m) * (b.x - m)) / (max(n) * max(v)) AS r FROM x a JOIN x b ON b.i BETWEEN a.i AND a.i + 24, s GROUP BY 1""",
    "known",
    "r",
)
def autocorr(spark, d):
    return X.autocorrelation(known(spark, d), 24).select(F.col("lag").cast("long"), "r")


@query("segment_spread", "SELECT segment, stddev_samp(speed) AS std FROM marked WHERE train GROUP BY 1", "marked", "std")
def segment_spread(spark, d):
    return X.spread_by_segment(known(spark, d))


# --- forecasts --------------------------------------------------------------


@query("baseline_last", f"SELECT segment, ts, y, pred FROM (SELECT segment, ts, speed AS y, lag(speed) OVER ({DAY}) AS pred FROM known) WHERE pred IS NOT NULL", "known", ("y", "pred"))
def baseline_last(spark, d):
    return MO.last_value(known(spark, d))


@query("baseline_historic", "SELECT segment, ts, y, pred FROM fc WHERE model = 'historic'", "fc", ("y", "pred"))
def baseline_historic(spark, d):
    return MO.historic_mean(known(spark, d))


@query("baseline_tod", "SELECT segment, ts, y, pred FROM fc WHERE model = 'clock'", "fc", ("y", "pred"))
def baseline_tod(spark, d):
    return MO.clock_mean(known(spark, d)).filter("pred is not null")


@query("ar1", "SELECT segment, regr_intercept(y, x) AS c0, regr_slope(y, x) AS c1 FROM (SELECT segment, coalesce(speed, 0) AS y, lag(coalesce(speed, 0)) OVER (PARTITION BY segment ORDER BY ts) AS x FROM dense) WHERE x IS NOT NULL GROUP BY 1", "dense", ("c0", "c1"))
def ar1(spark, d):
    return MO.ar1(V.dense(spark, d))


@query("ar_5")
def ar_5(spark, d):
    """Least squares of order 5 in NumPy; tested against normal equations."""
    c = MO.ar(V.dense(spark, d), 5)
    return MO.ar_predict(V.dense(spark, d), c, 5).select("segment", "ts", "y", F.round("pred", 6).alias("pred"))


def samples(spark, d):
    return MO.next_slot_samples(X.impute_by_clock(V.dense(spark, d)).select("segment", "ts", "speed"))


def _flat(m):
    return m.select("segment", F.posexplode("coef").alias("k", "w"), "intercept", "mse").withColumns({c: F.round(c, 6) for c in ("w", "intercept", "mse")})


@query("ols_all_segments")
def ols_all_segments(spark, d):
    return _flat(MO.fit_per_segment(samples(spark, d)))


@query("lasso_all_segments")
def lasso_all_segments(spark, d):
    return _flat(MO.fit_per_segment(samples(spark, d), alpha=5.0))


@query("lasso_cv")
def lasso_cv(spark, d):
    return MO.fit_per_segment(samples(spark, d), n_alphas=20).select("segment", F.round("alpha", 6).alias("alpha"), F.round("mse", 6).alias("mse"))


@query("lasso_by_slice")
def lasso_by_slice(spark, d):
    return MO.fit_per_slice(samples(spark, d), 5.0, 6).select("slice", "segment", F.round("mse", 6).alias("mse"))


@query("regime_search")
def regime_search(spark, d):
    """Losses and chosen penalties of both sides of every cut of the day's 23 steps; tested against a plain loop."""
    s = X.impute_by_clock(V.dense(spark, d)).select("segment", "ts", "speed")
    losses = MO.regime_losses(MO.next_slot_samples(MO.centre_by_clock(s)), list(range(1, 23)))
    return MO.best_regime(losses, 23).withColumns({c: F.round(c, 6) for c in ("left_loss", "right_loss", "left_alpha", "right_alpha", "loss")})


@query(
    "regime_weighted_loss",
    "SELECT t, avg((t * l + (24 - t) * r) / 24.0) AS loss FROM (SELECT extract(hour FROM ts) AS t, segment, avg(speed) AS l, max(speed) AS r FROM known GROUP BY 1, 2) GROUP BY 1",
    "known",
    "loss",
)
def regime_weighted_loss(spark, d):
    loss = known(spark, d).groupBy(F.hour("ts").cast("long").alias("t"), "segment").agg(F.avg("speed").alias("left_loss"), F.max("speed").alias("right_loss"))
    return MO.weighted_regime_loss(loss, 24)


@query("empirical_risk")
def empirical_risk(spark, d):
    s = X.impute_by_clock(V.dense(spark, d)).select("segment", "ts", "speed")
    return MO.empirical_risk(s, MO.fit_per_segment(samples(spark, d))).withColumn("risk", F.round("risk", 6))


def weights(spark, d):
    return V.table(spark, d, "embeddings").select(F.col("vec_id").alias("segment"), F.transform("embedding", lambda x: F.when(F.abs(x) < 0.1, 0.0).otherwise(x.cast("double"))).alias("coef"))


@query(
    "coef_activity",
    """SELECT feature, total, nonzero, coalesce(total / nullif(nonzero, 0), 0) AS mean FROM (SELECT CAST(i - 1 AS INTEGER) AS feature, sum(abs(w)) AS total, count(*) FILTER (w <> 0) AS nonzero FROM
      (SELECT generate_subscripts(embedding, 1) AS i, unnest(list_transform(embedding, lambda x: CASE WHEN abs(x) < CAST(0.1 AS FLOAT) THEN CAST(0 AS DOUBLE) ELSE CAST(x AS DOUBLE) END)) AS w FROM embeddings) GROUP BY 1)""",
    rounded=("total", "mean"),
)
def coef_activity(spark, d):
    return MO.coef_activity(weights(spark, d))


LR = "SELECT CAST(embedding[1] AS DOUBLE) AS l, CAST(embedding[2] AS DOUBLE) AS r FROM embeddings"


def lr(spark, d):
    e = V.table(spark, d, "embeddings")
    return e.select(F.get("embedding", F.lit(0)).cast("double").alias("l"), F.get("embedding", F.lit(1)).cast("double").alias("r"))


@query("support_overlap", f'SELECT count(*) FILTER (l > 0) AS "left", count(*) FILTER (r > 0) AS "right", count(*) FILTER (l > 0 OR r > 0) AS "any", count(*) FILTER (l > 0 AND r > 0) AS "both" FROM ({LR})')
def support_overlap(spark, d):
    return MO.support_overlap(lr(spark, d))


@query(
    "support_nmi",
    f"""WITH c AS (SELECT l > 0 AS a, r > 0 AS b, count(*) AS n FROM ({LR}) GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c)
      SELECT 2 * sum(n / t * ln(n * t / (na * nb))) / (-sum(n / t * ln(na / t)) - sum(n / t * ln(nb / t))) AS nmi FROM w""",
    rounded="nmi",
)
def support_nmi(spark, d):
    return MO.mutual_information(lr(spark, d))


@query("param_grid", "SELECT a.l1, b.lag FROM (VALUES (0.1), (1.0), (10.0)) a(l1) CROSS JOIN (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))) b(lag)", rounded="l1")
def param_grid(spark, d):
    return MO.param_grid(spark, {"l1": [0.1, 1.0, 10.0], "lag": [1, 2]})


@query("dickey_fuller")
def dickey_fuller(spark, d):
    return MO.dickey_fuller(V.dense(spark, d)).withColumn("stat", F.round("stat", 6))


@query("segment_kmeans")
def segment_kmeans(spark, d):
    """k-means of users by described speeds, labels in order of mean speed."""
    from ..operators.points import describe_by

    f = describe_by(V.gps(spark, d), "id", "speed").fillna(0.0)
    return MO.segment_clusters(f, ["mean", "std", "q25", "q50", "q75", "max"], "mean").select("id", "cluster")


@query("home_classifier")
def home_classifier(spark, d):
    """Random forest on location statistics: is a cluster the car's home?  Two-fold: each half of the cars is predicted by the other."""
    from ..operators import trips as TR

    g = V.gps(spark, d)
    stats = TR.location_stats(g, "kind").fillna(0.0)
    home = TR.home_cluster(g, "kind").select("id", F.col("home").alias("kind"), F.lit(1.0).alias("label"))
    data = stats.join(home, ["id", "kind"], "left").fillna(0.0, ["label"]).withColumn("fold", F.xxhash64("id") > 0)
    cols = ["n", "hour_mean", "hour_std", "speed_mean", "loc_std"]
    one, two = data.filter("fold"), data.filter("not fold")
    pred = MO.home_classifier(one, two, cols)[1].union(MO.home_classifier(two, one, cols)[1])
    return MO.confusion(pred)


@query(
    "cohen_kappa",
    """WITH c AS (SELECT CAST(label % 3 AS BIGINT) AS label, CAST(vec_id % 3 AS BIGINT) AS pred, count(*) AS n FROM embeddings GROUP BY 1, 2), r AS (SELECT label, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT pred, sum(n) AS c FROM c GROUP BY 1),
      t AS (SELECT sum(n) AS t, sum(n) FILTER (label = pred) AS d FROM c), e AS (SELECT sum(r * c) AS rc FROM r JOIN k ON r.label = k.pred)
      SELECT (d / t - rc / (t * t)) / (1 - rc / (t * t)) AS kappa FROM t, e""",
    rounded="kappa",
)
def cohen_kappa(spark, d):
    p = V.table(spark, d, "embeddings").select((F.col("label") % 3).alias("label"), (F.col("vec_id") % 3).alias("pred"))
    return MO.cohen_kappa(MO.confusion(p))


METRICS = """count(*) AS n, avg(pow(y - pred, 2)) AS mse, avg(abs(y - pred)) AS mae, avg(least(abs(y - pred), 15.0)) AS mae_capped, avg(pow(least(abs(y - pred), 15.0), 2)) AS mse_capped,
  avg(abs(greatest(y, 15.0) - greatest(pred, 15.0)) / greatest(y, 15.0)) AS mape, avg(2 * abs(pred - y) / greatest(abs(y) + abs(pred) + 0.1, 0.6)) AS smape, sqrt(avg(pow(y - pred, 2))) AS rmse, 1 - avg(pow(y - pred, 2)) / nullif(var_pop(y), 0) AS r2"""
M_COLS = ("mse", "mae", "mae_capped", "mse_capped", "mape", "smape", "rmse", "r2")


@query("comparison_table", f"SELECT model, {METRICS} FROM fc GROUP BY 1", "fc", M_COLS)
def comparison_table(spark, d):
    return MO.metrics(V.forecasts(spark, d), "model")


@query("metrics_by_segment", f"SELECT model, segment, {METRICS} FROM fc GROUP BY 1, 2", "fc", M_COLS)
def metrics_by_segment(spark, d):
    return MO.metrics(V.forecasts(spark, d), "model", "segment")


@query("error_by_tod", "SELECT model, CAST(t AS INTEGER) AS tod, avg(e) AS mae FROM (SELECT model, segment, extract(hour FROM ts) * 3600 AS t, avg(abs(y - pred)) AS e FROM fc GROUP BY 1, 2, 3) GROUP BY 1, 2", "fc", "mae")
def error_by_tod(spark, d):
    return MO.error_by_clock(V.forecasts(spark, d))


@query("error_by_date", "SELECT model, CAST(ts AS DATE) AS day, avg(abs(y - pred)) AS mae FROM fc GROUP BY 1, 2", "fc", "mae", dates="day")
def error_by_date(spark, d):
    return MO.error_by_date(V.forecasts(spark, d))


@query(
    "error_by_segment_std",
    """WITH s AS (SELECT segment, stddev_samp(speed) AS std FROM marked WHERE train GROUP BY 1), e AS (SELECT model, segment, avg(abs(y - pred)) AS mae FROM fc GROUP BY 1, 2)
      SELECT e.segment, e.model, e.mae, s.std, CAST(row_number() OVER (PARTITION BY model ORDER BY std, e.segment) AS INTEGER) AS rank FROM e JOIN s ON s.segment = e.segment""",
    ("fc", "marked"),
    ("mae", "std"),
)
def error_by_segment_std(spark, d):
    return MO.error_by_segment(V.forecasts(spark, d), X.spread_by_segment(known(spark, d)))


@query("error_by_tag", "SELECT grp AS tag, avg(abs(y - pred)) AS mae, count(*) AS n FROM fc JOIN segmap m ON m.segment = fc.segment GROUP BY 1", ("fc", "segmap"), "mae")
def error_by_tag(spark, d):
    return MO.error_by_tag(V.forecasts(spark, d), V.segment_map(spark, d).withColumnRenamed("grp", "tag"))


@query("error_hist_5", "SELECT b AS bin, n, coalesce(sum(n) OVER (ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS share_above FROM (SELECT floor(abs(y - pred) / 5) * 5 AS b, count(*) AS n FROM fc GROUP BY 1)", "fc", ("bin", "share_above"))
def error_hist_5(spark, d):
    return MO.error_histogram(V.forecasts(spark, d))


@query("discrete_speed_error", "SELECT round_even(y, 0) AS speed, avg(round_even(abs(y - pred), 0)) AS error, count(*) AS n FROM fc GROUP BY 1", "fc", ("speed", "error"))
def discrete_speed_error(spark, d):
    return MO.discrete_speed_error(V.forecasts(spark, d))


@query("avg_error_by_slot", "SELECT model, CAST(extract(hour FROM ts) * 3600 AS INTEGER) AS tod, avg(y) AS y, avg(pred) AS pred FROM fc GROUP BY 1, 2", "fc", ("y", "pred"))
def avg_error_by_slot(spark, d):
    return MO.average_by_slot(V.forecasts(spark, d))


@query("joint_hist", "SELECT CAST(trunc(y) AS INTEGER) AS y_bin, CAST(trunc(pred) AS INTEGER) AS pred_bin, count(*) AS n FROM fc GROUP BY 1, 2", "fc")
def joint_hist(spark, d):
    return MO.joint_histogram(V.forecasts(spark, d))


@query(
    "joint_hist_40",
    """WITH e AS (SELECT min(y) AS y0, max(y) AS y1, min(pred) AS p0, max(pred) AS p1 FROM fc)
      SELECT CAST(least(floor((y - y0) / (y1 - y0) * 40), 39) AS BIGINT) AS y_bin, CAST(least(floor((pred - p0) / (p1 - p0) * 40), 39) AS BIGINT) AS pred_bin, count(*) AS n FROM fc, e GROUP BY 1, 2""",
    "fc",
)
def joint_hist_40(spark, d):
    return MO.joint_histogram_40(V.forecasts(spark, d)).select(F.col("y_bin").cast("long"), F.col("pred_bin").cast("long"), "n")


@query(
    "sorted_error_100",
    """WITH r AS (SELECT model, abs(y - pred) AS e, row_number() OVER (PARTITION BY model ORDER BY abs(y - pred)) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM fc)
      SELECT model, CASE WHEN i < (n % 100) * (n // 100 + 1) THEN i // (n // 100 + 1) ELSE n % 100 + (i - (n % 100) * (n // 100 + 1)) // (n // 100) END AS part, avg(e) AS mean_error FROM r GROUP BY 1, 2""",
    "fc",
    "mean_error",
)
def sorted_error_100(spark, d):
    return MO.sorted_errors(V.forecasts(spark, d))


@query("error_cdf", "SELECT model, segment, ts, abs(y - pred) AS e, cume_dist() OVER (PARTITION BY model ORDER BY abs(y - pred)) AS p FROM fc", "fc", ("e", "p"))
def error_cdf(spark, d):
    return MO.error_cdf(V.forecasts(spark, d))


@query(
    "error_cdf_legacy",
    "SELECT model, segment, ts, e, k * (k + 1) / (n * (n - 1)) AS p FROM (SELECT *, abs(y - pred) AS e, row_number() OVER (PARTITION BY model ORDER BY abs(y - pred), segment, ts) - 1 AS k, count(*) OVER (PARTITION BY model) AS n FROM fc)",
    "fc",
    ("e", "p"),
)
def error_cdf_legacy(spark, d):
    return MO.error_cdf(V.forecasts(spark, d), legacy=True)


@query("smape", "SELECT model, avg(2 * abs(pred - y) / greatest(abs(y) + abs(pred) + 0.1, 0.6)) AS smape FROM fc GROUP BY 1", "fc", "smape")
def smape(spark, d):
    return MO.metrics(V.forecasts(spark, d), "model").select("model", "smape")


@query("rmse", "SELECT model, sqrt(avg(pow(y - pred, 2))) AS rmse FROM fc GROUP BY 1", "fc", "rmse")
def rmse(spark, d):
    return MO.metrics(V.forecasts(spark, d), "model").select("model", "rmse")


@query("r2", "SELECT segment, 1 - avg(pow(y - pred, 2)) / nullif(var_pop(y), 0) AS r2 FROM fc GROUP BY 1", "fc", "r2")
def r2(spark, d):
    return MO.metrics(V.forecasts(spark, d), "segment").select("segment", "r2")


@query("concat_preds", "SELECT model, segment, ts, y, pred FROM fc", "fc", ("y", "pred"))
def concat_preds(spark, d):
    return V.forecasts(spark, d)
