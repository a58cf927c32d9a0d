"""Baselines, linear models, clustering and comparison of forecasts.

Fits that Spark has no operator for run per group in NumPy under
``applyInPandas``; each group is one segment (or car), bounded by its own
history.  Forecasts are long: (model, segment, ts, y, pred).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import time as T
from ..functions.traffic import clip, smape_terms
from .matrix import by_day, lag_features, tod, train_split


# --- baselines -----------------------------------------------------------


def last_value(long: DataFrame) -> DataFrame:
    return long.select("segment", "ts", F.col("speed").alias("y"), F.lag("speed").over(by_day()).alias("pred")).filter("pred is not null")


def historic_mean(long: DataFrame, share: float = 0.7) -> DataFrame:
    """The segment's mean over training days, for the other days."""
    m = train_split(long, share)
    w = Window.partitionBy("segment")
    out = m.withColumn("pred", F.avg(F.when(F.col("train"), F.col("speed"))).over(w))
    return out.filter(~F.col("train")).select("segment", "ts", F.col("speed").alias("y"), "pred")


def clock_mean(long: DataFrame, share: float = 0.7) -> DataFrame:
    """The segment's mean at the time of day over training days, for the other days."""
    m = train_split(long, share).withColumn("tod", tod())
    w = Window.partitionBy("segment", "tod")
    out = m.withColumn("pred", F.avg(F.when(F.col("train"), F.col("speed"))).over(w))
    return out.filter(~F.col("train")).select("segment", "ts", F.col("speed").alias("y"), "pred")


# --- linear models -------------------------------------------------------


def ar1(dense: DataFrame) -> DataFrame:
    """(segment, c0, c1): first-order autoregression in closed form; missing speeds count as 0."""
    w = Window.partitionBy("segment").orderBy("ts")
    x = dense.withColumn("y", F.coalesce("speed", F.lit(0.0))).withColumn("x", F.lag("y").over(w)).filter("x is not null")
    return x.groupBy("segment").agg(F.regr_intercept("y", "x").alias("c0"), F.regr_slope("y", "x").alias("c1"))


def ar(dense: DataFrame, order: int) -> DataFrame:
    """(segment, coef): constant and ``order`` lag coefficients by least squares; missing speeds count as 0."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ts")["speed"].fillna(0.0).to_numpy()
        if len(x) <= order:
            return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "coef": [[float("nan")] * (order + 1)]})
        a = np.column_stack([np.ones(len(x) - order), *(x[order - k : len(x) - k] for k in range(1, order + 1))])
        return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "coef": [np.linalg.lstsq(a, x[order:], rcond=None)[0].tolist()]})

    kind = dict(dense.dtypes)["segment"]
    return dense.select("segment", "ts", "speed").groupBy("segment").applyInPandas(fit, f"segment {kind}, coef array<double>")


def ar_predict(dense: DataFrame, coefs: DataFrame, order: int) -> DataFrame:
    w = Window.partitionBy("segment").orderBy("ts")
    y = dense.withColumn("y", F.coalesce("speed", F.lit(0.0)))
    lags = F.array(F.lit(1.0), *[F.lag("y", k).over(w) for k in range(1, order + 1)])
    x = y.withColumn("x", lags).filter(F.get("x", F.lit(order)).isNotNull()).join(coefs, "segment")
    dot = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return x.select("segment", "ts", "y", dot.alias("pred"))


def slot_rows(long: DataFrame) -> DataFrame:
    """(ts, day, x): speeds of all segments at a slot as one vector, in order of segment; slots with a missing speed are left out.

    The vector's length is the number of segments of a study area.
    """
    n = long.select("segment").distinct().agg(F.count(F.lit(1)))
    v = long.filter("speed is not null").groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("segment", "speed"))).alias("s"))
    return v.filter(F.size("s") == n.scalar()).select("ts", T.day(F.col("ts")).alias("day"), F.col("s.segment").alias("segments"), F.col("s.speed").alias("x"))


def next_slot_samples(long: DataFrame) -> DataFrame:
    """(ts, segments, x, y): all segments' speeds at a slot and at the next of the same day."""
    w = Window.partitionBy("day").orderBy("ts")
    return slot_rows(long).withColumn("y", F.lead("x").over(w)).filter("y is not null")


def lasso_path(x: np.ndarray, y: np.ndarray, alpha: float, rounds: int = 2000, tol: float = 1e-8) -> np.ndarray:
    """Coordinate descent for 1/(2n) |y - Xw|^2 + alpha |w|_1 on centred data."""
    return descend(x.T @ x / len(y), x.T @ y / len(y), alpha, np.zeros(x.shape[1]), rounds, tol)


def descend(gram: np.ndarray, xy: np.ndarray, alpha: float, w: np.ndarray, rounds: int = 2000, tol: float = 1e-8) -> np.ndarray:
    """``lasso_path`` on products of the data, from the weights ``w`` on."""
    w = w.copy()
    for _ in range(rounds):
        largest = 0.0
        for j in range(len(w)):
            if gram[j, j] == 0:
                continue
            r = xy[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - alpha, 0.0) / gram[j, j]
            largest, w[j] = max(largest, abs(new - w[j])), new
        if largest < tol:
            break
    return w


def fit_linear(x: np.ndarray, y: np.ndarray, alpha: float = 0.0) -> tuple[float, np.ndarray]:
    """Intercept and weights: least squares for alpha 0, else lasso."""
    mx, my = x.mean(axis=0), y.mean()
    if alpha:
        w = lasso_path(x - mx, y - my, alpha)
    else:
        w = np.linalg.lstsq(x - mx, y - my, rcond=None)[0]
    return float(my - mx @ w), w


def lasso_cv(x: np.ndarray, y: np.ndarray, alphas: np.ndarray, folds: int = 5) -> tuple[float, float]:
    """(best alpha, its mean squared error) over contiguous folds."""
    parts = np.array_split(np.arange(len(y)), folds)
    best = (float("inf"), 0.0)
    for a in alphas:
        errors = []
        for part in parts:
            if not len(part) or len(part) == len(y):
                continue
            rest = np.setdiff1d(np.arange(len(y)), part)
            c, w = fit_linear(x[rest], y[rest], a)
            errors.append(((y[part] - c - x[part] @ w) ** 2).mean())
        if errors:
            best = min(best, (float(np.mean(errors)), float(a)))
    return best[1], best[0]


def alpha_path(x: np.ndarray, y: np.ndarray, n: int = 20, eps: float = 1e-4) -> np.ndarray:
    """``n`` penalties in equal steps of their logarithm, from the least that leaves no weight down to its ``eps``-th part."""
    top = max(float(np.abs(x.T @ y).max()) / len(y), np.finfo(float).resolution)
    return np.logspace(np.log10(top), np.log10(top * eps), n)


def lasso_cv_path(x: np.ndarray, y: np.ndarray, n_alphas: int = 20, eps: float = 1e-4, folds: int = 5) -> tuple[float, float]:
    """(best alpha of the path, its mean squared error) over contiguous folds, without intercept; ties go to the largest alpha."""
    alphas = alpha_path(x, y, n_alphas, eps)
    errors = np.zeros((folds, n_alphas))
    for k, part in enumerate(np.array_split(np.arange(len(y)), folds)):
        rest = np.setdiff1d(np.arange(len(y)), part)
        gram, xy, w = x[rest].T @ x[rest] / len(rest), x[rest].T @ y[rest] / len(rest), np.zeros(x.shape[1])
        for i, a in enumerate(alphas):
            w = descend(gram, xy, a, w)
            errors[k, i] = ((y[part] - x[part] @ w) ** 2).mean()
    best = int(errors.mean(axis=0).argmin())
    return float(alphas[best]), float(errors.mean(axis=0)[best])


def log_alphas(low: float, high: float, n: int) -> list[float]:
    return np.logspace(np.log10(low), np.log10(high), n).tolist()


TARGETS = 8


def _by_targets(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, chunk, ts, x, ys, names): the design matrix once for every ``TARGETS`` target segments, not once for each."""
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.size("y") / TARGETS).cast("int") - 1)))
    part = lambda c: F.slice(c, F.col("chunk") * TARGETS + 1, F.lit(TARGETS))
    return rows.select(*keys, "chunk", "ts", "x", part("y").alias("ys"), part("segments").alias("names"))


def _kind_of_segment(samples: DataFrame) -> str:
    return dict(samples.dtypes)["segments"].removeprefix("array<").removesuffix(">")


def fit_per_segment(samples: DataFrame, alpha: float = 0.0, alphas: list[float] | None = None, n_alphas: int = 0) -> DataFrame:
    """(segment, alpha, intercept, coef, mse): one model per target segment on all segments' present speeds.

    ``samples``: (ts, segments, x, y) as from ``next_slot_samples``.  A task gets
    the design matrix with the y of some targets; ``alphas`` searches by
    cross-validation, ``n_alphas`` over the target's own path.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        x, ys, out = np.stack(pdf["x"].to_numpy()), np.stack(pdf["ys"].to_numpy()), []
        for name, y in zip(pdf["names"].iloc[0], ys.T):
            path = alpha_path(x - x.mean(axis=0), y - y.mean(), n_alphas) if n_alphas else alphas
            a = lasso_cv(x, y, np.array(path))[0] if path is not None and len(path) else alpha
            c, w = fit_linear(x, y, a)
            out.append((name, float(a), c, w.tolist(), float(((y - c - x @ w) ** 2).mean())))
        return pd.DataFrame(out, columns=["segment", "alpha", "intercept", "coef", "mse"])

    return _by_targets(samples).groupBy("chunk").applyInPandas(fit, f"segment {_kind_of_segment(samples)}, alpha double, intercept double, coef array<double>, mse double")


def fit_per_slice(samples: DataFrame, alpha: float, hours: int = 1) -> DataFrame:
    """As ``fit_per_segment``, one model per (slice of the day, segment)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        x, ys, out = np.stack(pdf["x"].to_numpy()), np.stack(pdf["ys"].to_numpy()), []
        for name, y in zip(pdf["names"].iloc[0], ys.T):
            c, w = fit_linear(x, y, alpha)
            out.append((pdf["slice"].iloc[0], name, c, w.tolist(), float(((y - c - x @ w) ** 2).mean())))
        return pd.DataFrame(out, columns=["slice", "segment", "intercept", "coef", "mse"])

    rows = _by_targets(samples.withColumn("slice", F.floor(F.hour("ts") / hours).cast("int")), "slice")
    return rows.groupBy("slice", "chunk").applyInPandas(fit, f"slice int, segment {_kind_of_segment(samples)}, intercept double, coef array<double>, mse double")


def regime_losses(samples: DataFrame, cuts: list[int], alpha: float | None = None, folds: int = 5, n_alphas: int = 20, eps: float = 1e-4) -> DataFrame:
    """(t, segment, left_loss, right_loss, left_alpha, right_alpha): cross-validated errors of one lasso before and one behind each cut of the day.

    Without ``alpha`` each side selects its own from ``lasso_cv_path``, has no intercept
    (``samples`` are centred, see ``centre_by_clock``) and slot t is on the right only;
    with a fixed ``alpha`` there is an intercept and slot t is on both sides.
    """
    slot = F.dense_rank().over(Window.partitionBy(T.day(F.col("ts"))).orderBy("ts")) - 1
    rows = _by_targets(samples.withColumn("slot", slot).withColumn("t", F.explode(F.array(*[F.lit(c) for c in cuts]))), "t", "slot")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        t, names = int(pdf["t"].iloc[0]), pdf["names"].iloc[0]
        found: list[list[tuple[float, float]]] = [[] for _ in names]
        for side in (pdf[pdf["slot"] < t if alpha is None else pdf["slot"] <= t], pdf[pdf["slot"] >= t]):
            if len(side) < folds:
                for f in found:
                    f.append((float("nan"), float("nan")))
                continue
            x, ys = np.stack(side["x"].to_numpy()), np.stack(side["ys"].to_numpy())
            for f, y in zip(found, ys.T):
                f.append(lasso_cv_path(x, y, n_alphas, eps, folds) if alpha is None else lasso_cv(x, y, np.array([alpha]), folds))
        out = [(t, name, left, right, a, b) for name, ((a, left), (b, right)) in zip(names, found)]
        return pd.DataFrame(out, columns=["t", "segment", "left_loss", "right_loss", "left_alpha", "right_alpha"])

    return rows.groupBy("t", "chunk").applyInPandas(fit, f"t int, segment {_kind_of_segment(samples)}, left_loss double, right_loss double, left_alpha double, right_alpha double")


def centre_by_clock(long: DataFrame) -> DataFrame:
    """Speeds less the segment's mean at the time of day."""
    w = Window.partitionBy("segment", tod())
    return long.withColumn("speed", F.col("speed") - F.avg("speed").over(w))


def best_regime(losses: DataFrame, slots: int) -> DataFrame:
    """``losses`` with the weighted loss of their cut and whether it is the least of all cuts; ties go to the earliest."""
    rows = F.collect_list(F.struct(*losses.columns)).alias("rows")
    cuts = losses.groupBy("t").agg(F.avg(_weighted(slots)).alias("loss"), rows)
    first = F.first("t").over(Window.orderBy("loss", "t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # a row for each cut of the day
    return cuts.withColumn("best", F.col("t") == first).select(F.inline("rows"), "loss", "best")


def weighted_regime_loss(losses: DataFrame, slots: int) -> DataFrame:
    """(t, loss): both sides weighted by their share of the day's ``slots``, averaged over segments."""
    return losses.groupBy("t").agg(F.avg(_weighted(slots)).alias("loss"))


def _weighted(slots: int) -> Column:
    return (F.col("t") * F.col("left_loss") + (slots - F.col("t")) * F.col("right_loss")) / F.lit(float(slots))


def empirical_risk(long: DataFrame, models: DataFrame) -> DataFrame:
    """(risk): mean squared error over all samples and segments of models (segment, intercept, coef)."""
    rows = next_slot_samples(long).select("ts", "x", F.posexplode("y").alias("k", "target"), "segments")
    rows = rows.select(F.get("segments", F.col("k")).alias("segment"), "x", "target").join(models, "segment")
    dot = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.agg(F.avg(F.pow(F.col("target") - F.col("intercept") - dot, 2)).alias("risk"))


def coef_activity(models: DataFrame) -> DataFrame:
    """(feature, total, nonzero, mean): sum and number of the non-zero weights of each input over all models."""
    rows = models.select("segment", F.posexplode("coef").alias("feature", "w"))
    return rows.groupBy("feature").agg(F.sum(F.abs("w")).alias("total"), F.count_if(F.col("w") != 0).alias("nonzero")).withColumn("mean", F.coalesce(F.try_divide("total", "nonzero"), F.lit(0.0)))


def support_overlap(weights: DataFrame) -> DataFrame:
    """(left, right, any, both) counts of positive weights; ``weights`` has columns l and r."""
    a, b = F.coalesce(F.col("l") > 0, F.lit(False)), F.coalesce(F.col("r") > 0, F.lit(False))
    return weights.agg(F.count_if(a).alias("left"), F.count_if(b).alias("right"), F.count_if(a | b).alias("any"), F.count_if(a & b).alias("both"))


def mutual_information(weights: DataFrame) -> DataFrame:
    """(nmi): normalised mutual information (arithmetic mean) of two supports."""
    counts = weights.groupBy((F.col("l") > 0).alias("a"), (F.col("r") > 0).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    c = counts.withColumn("na", w("a")).withColumn("nb", w("b")).withColumn("t", w(F.lit(0)))
    mi = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb"))))
    ha = -F.sum(F.col("n") / F.col("t") * F.log(F.col("na") / F.col("t")))
    hb = -F.sum(F.col("n") / F.col("t") * F.log(F.col("nb") / F.col("t")))
    return c.agg(mi.alias("mi"), ha.alias("ha"), hb.alias("hb")).select(F.coalesce(F.try_divide(2 * F.col("mi"), F.col("ha") + F.col("hb")), F.lit(1.0)).alias("nmi"))


def param_grid(spark, grid: dict[str, list]) -> DataFrame:
    """All combinations of the parameter values, one row each."""
    import itertools

    return spark.createDataFrame(list(itertools.product(*grid.values())), list(grid))


# --- Dickey-Fuller -------------------------------------------------------


def dickey_fuller(dense: DataFrame, lags: int = 1) -> DataFrame:
    """(segment, stat, stationary_5): augmented Dickey-Fuller t-statistic with a constant, against the 5 % critical value by sample size."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ts")["speed"].dropna().to_numpy()
        d = np.diff(x)
        stat, n = float("nan"), len(d) - lags
        if n > lags + 3:
            a = np.column_stack([np.ones(n), x[lags:-1], *(d[lags - k : len(d) - k] for k in range(1, lags + 1))])
            w, *_ = np.linalg.lstsq(a, d[lags:], rcond=None)
            r = d[lags:] - a @ w
            cov = np.linalg.pinv(a.T @ a) * (r @ r) / (n - a.shape[1])
            stat = float(w[1] / np.sqrt(cov[1, 1])) if cov[1, 1] > 0 else float("nan")
        # response surface of the 5 % critical value with a constant (fixed values)
        critical = -2.86154 - 2.8903 / max(n, 1) - 4.234 / max(n, 1) ** 2 - 40.04 / max(n, 1) ** 3
        return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "stat": [stat], "stationary_5": [bool(stat < critical)]})

    kind = dict(dense.dtypes)["segment"]
    return dense.select("segment", "ts", "speed").groupBy("segment").applyInPandas(fit, f"segment {kind}, stat double, stationary_5 boolean")


# --- clustering ----------------------------------------------------------


def dbscan(distance: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Labels from a distance matrix; see ``dbscan_by_rows``."""
    return dbscan_by_rows(len(distance), lambda i: distance[i], eps, min_samples)


def dbscan_by_rows(n: int, row: Callable[[int], np.ndarray], eps: float, min_samples: int) -> np.ndarray:
    """Clusters by smallest core point, noise -1; a point counts among its own neighbours.

    ``row(i)`` are the distances of point i to all; they are worked out when a
    point is met and not kept, so memory grows with the points, not their square.
    """
    labels, cluster = np.full(n, -1), 0
    seen = np.zeros(n, bool)  # points whose neighbours are known to be too few, or that lead their cluster on
    for i in range(n):
        if labels[i] != -1 or seen[i]:
            continue
        near = np.flatnonzero(row(i) <= eps)
        seen[i] = True
        if len(near) < min_samples:
            continue
        fresh = near[labels[near] == -1]
        labels[fresh] = cluster
        front = [p for p in fresh.tolist() if p != i and not seen[p]]
        while front:
            p = front.pop()
            near = np.flatnonzero(row(p) <= eps)
            seen[p] = True
            if len(near) >= min_samples:
                fresh = near[labels[near] == -1]
                labels[fresh] = cluster
                front += [q for q in fresh.tolist() if not seen[q]]
        cluster += 1
    return labels


def _distances_of(lon: np.ndarray, lat: np.ndarray) -> Callable[[int], np.ndarray]:
    def row(i: int) -> np.ndarray:
        d = np.nan_to_num(geo.vincenty_arrays(np.full(len(lon), lon[i]), np.full(len(lat), lat[i]), lon, lat), nan=20_000.0)
        d[i] = 0.0
        return d

    return row


def regions_of_interest(places: DataFrame, eps_km: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(id, pid, cluster, clusters): DBSCAN of each car's places by ellipsoidal distance; ``clusters`` counts labels, noise included."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        labels = dbscan_by_rows(len(pdf), _distances_of(pdf["lon"].to_numpy(), pdf["lat"].to_numpy()), eps_km, min_samples)
        return pd.DataFrame({"id": pdf["id"], "pid": pdf["pid"], "cluster": labels, "clusters": len(set(labels))})

    return places.select("id", "pid", "lon", "lat").groupBy("id").applyInPandas(fit, "id long, pid long, cluster long, clusters long")


def all_regions(trips: DataFrame, both: bool = False, **options) -> dict[str, DataFrame]:
    """Regions of trip begins and ends, or of their concatenation."""
    side = lambda s, k: trips.select("id", (F.col("trip_id") * 2 + k).alias("pid"), F.col(f"{s}.lon").alias("lon"), F.col(f"{s}.lat").alias("lat"))
    b, e = side("begin", 0), side("end", 1)
    if both:
        return {"both": regions_of_interest(b.union(e), **options)}
    return {"begin": regions_of_interest(b, **options), "end": regions_of_interest(e, **options)}


def recurrent_trips(trips: DataFrame, eps_km: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(id, trip_id, cluster): DBSCAN of each car's trips by the larger of the distances of begins and ends."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trip_id")
        one, two = _distances_of(pdf["lon1"].to_numpy(), pdf["lat1"].to_numpy()), _distances_of(pdf["lon2"].to_numpy(), pdf["lat2"].to_numpy())
        labels = dbscan_by_rows(len(pdf), lambda i: np.maximum(one(i), two(i)), eps_km, min_samples)
        return pd.DataFrame({"id": pdf["id"], "trip_id": pdf["trip_id"], "cluster": labels})

    rows = trips.select("id", "trip_id", F.col("begin.lon").alias("lon1"), F.col("begin.lat").alias("lat1"), F.col("end.lon").alias("lon2"), F.col("end.lat").alias("lat2"))
    return rows.groupBy("id").applyInPandas(fit, "id long, trip_id long, cluster long")


def kmeans_1d(x: np.ndarray, centres: np.ndarray, rounds: int = 100, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm on a line from given centres: (labels, centres); ``weight`` says how often each value occurs."""
    weight = np.ones(len(x)) if weight is None else weight
    c = centres.astype(float).copy()
    labels = np.zeros(len(x), int)
    for _ in range(rounds):
        labels = np.abs(x[:, None] - c[None, :]).argmin(axis=1)
        new = np.array([np.average(x[labels == k], weights=weight[labels == k]) if (labels == k).any() else c[k] for k in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return labels, c


def heading_clusters(points: DataFrame, apart: float = 100.0) -> DataFrame:
    """(road, centres): two centres of a road's headings, one if they are closer than ``apart`` degrees.

    Works on the different headings of a road and how often each occurs, summed on the map side.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("heading")
        x, n = pdf["heading"].to_numpy(float), pdf["n"].to_numpy(float)
        _, c = kmeans_1d(x, np.array([x.min(), x.max()]), weight=n)
        c = np.sort(c) if abs(c[1] - c[0]) >= apart else np.array([np.average(x, weights=n)])
        return pd.DataFrame({"road": [pdf["road"].iloc[0]], "centres": [c.tolist()]})

    counts = points.filter("road is not null and heading is not null").groupBy("road", "heading").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("road").applyInPandas(fit, "road long, centres array<double>")


def time_clusters(points: DataFrame, centres: tuple[float, ...] = (1, 6, 12, 18, 23)) -> DataFrame:
    """(id, pid, cluster): each car's hours around fixed first centres, which also count as data."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([pdf["h"].to_numpy(float), np.array(centres, float)])
        labels, _ = kmeans_1d(x, np.array(centres, float))
        return pd.DataFrame({"id": pdf["id"], "pid": pdf["pid"], "cluster": labels[: len(pdf)]})

    return points.select("id", "pid", T.fractional_hour(F.col("ts")).alias("h")).groupBy("id").applyInPandas(fit, "id long, pid long, cluster long")


def segment_clusters(features: DataFrame, columns: list[str], order_by: str, k: int = 3, seed: int = 1) -> DataFrame:
    """Adds ``cluster``: k-means on min-max-scaled columns, labels in order of the clusters' means of ``order_by``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import MinMaxScaler, VectorAssembler

    steps = [VectorAssembler(inputCols=columns, outputCol="__v"), MinMaxScaler(inputCol="__v", outputCol="__s"), KMeans(k=k, seed=seed, featuresCol="__s", predictionCol="__c")]
    out = Pipeline(stages=steps).fit(features).transform(features)
    means = out.groupBy("__c").agg(F.avg(order_by).alias("__m"))
    ranks = means.select("__c", (F.row_number().over(Window.orderBy("__m")) - 1).alias("cluster"))
    return out.join(ranks, "__c").select(*features.columns, "cluster")


def home_classifier(train: DataFrame, test: DataFrame, columns: list[str], label: str = "label", trees: int = 50, boosted: bool = False):
    """(model, predictions): random forest with weights that balance the classes, or gradient-boosted trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    by = train.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    weighted = train.join(by, label).withColumn("__w", 1.0 / F.col("__n"))
    kind = GBTClassifier if boosted else RandomForestClassifier
    more = {"maxIter": trees} if boosted else {"numTrees": trees}
    fitted = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="__f"), kind(featuresCol="__f", labelCol=label, weightCol="__w", seed=1, **more)]).fit(weighted)
    return fitted, fitted.transform(test).select(*test.columns, F.col("prediction").alias("pred"))


def confusion(predictions: DataFrame, label: str = "label") -> DataFrame:
    return predictions.groupBy(F.col(label).cast("long").alias("label"), F.col("pred").cast("long").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(matrix: DataFrame) -> DataFrame:
    """(kappa) from (label, pred, n)."""
    rows = matrix.groupBy("label").agg(F.sum("n").alias("r"))
    cols = matrix.groupBy("pred").agg(F.sum("n").alias("c"))
    chance = rows.join(cols, rows.label == cols.pred).agg(F.sum(F.col("r") * F.col("c")).alias("rc"))
    t = matrix.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("d"))
    po, pe = F.col("d") / F.col("t"), F.coalesce(F.col("rc"), F.lit(0)) / (F.col("t") * F.col("t"))
    return t.withColumn("rc", chance.scalar()).select(F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(1.0)).alias("kappa"))


# --- comparison ----------------------------------------------------------


def metrics(preds: DataFrame, *keys: str, cap: float = 15.0) -> DataFrame:
    """mse, mae, rmse, their capped forms, mape (both sides at least ``cap``), smape and r2 by the keys."""
    e = F.col("y") - F.col("pred")
    a = F.abs(e)
    low = lambda c: F.greatest(c, F.lit(cap))
    out = preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(a).alias("mae"), F.avg(clip(a, high=cap)).alias("mae_capped"),
        F.avg(F.pow(clip(a, high=cap), 2)).alias("mse_capped"), F.avg(F.abs(low(F.col("y")) - low(F.col("pred"))) / low(F.col("y"))).alias("mape"),
        F.avg(smape_terms(F.col("y"), F.col("pred"))).alias("smape"), F.var_pop("y").alias("v"),
    )
    return out.withColumn("rmse", F.sqrt("mse")).withColumn("r2", F.lit(1.0) - F.try_divide("mse", "v")).drop("v")


def error_by_clock(preds: DataFrame) -> DataFrame:
    """(model, tod, mae): mean over days per segment, then over segments."""
    inner = preds.groupBy("model", "segment", tod().alias("tod")).agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("e"))
    return inner.groupBy("model", "tod").agg(F.avg("e").alias("mae"))


def error_by_date(preds: DataFrame) -> DataFrame:
    return preds.groupBy("model", T.day(F.col("ts")).alias("day")).agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"))


def error_by_segment(preds: DataFrame, spread: DataFrame) -> DataFrame:
    """Errors of segments in order of their spread; ``spread`` (segment, std)."""
    e = preds.groupBy("model", "segment").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae")).join(spread, "segment")
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy("std", "segment")))


def error_by_tag(preds: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, mae, n) by the road class of the segment; ``tags`` (segment, tag)."""
    return preds.join(tags, "segment").groupBy("tag").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"), F.count(F.lit(1)).alias("n"))


def error_histogram(preds: DataFrame, width: float = 5.0) -> DataFrame:
    """(bin, n, share_above): errors in bins of ``width`` and the share of errors in higher bins."""
    h = preds.groupBy((F.floor(F.abs(F.col("y") - F.col("pred")) / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return h.withColumn("share_above", above / F.sum("n").over(Window.partitionBy(F.lit(0))))


def discrete_speed_error(preds: DataFrame) -> DataFrame:
    """(speed, error): mean of rounded absolute errors by rounded true speed (half to even)."""
    return preds.groupBy(F.bround("y").alias("speed")).agg(F.avg(F.bround(F.abs(F.col("y") - F.col("pred")))).alias("error"), F.count(F.lit(1)).alias("n"))


def average_by_slot(preds: DataFrame) -> DataFrame:
    """(model, tod, y, pred): average prediction and truth by time of day."""
    return preds.groupBy("model", tod().alias("tod")).agg(F.avg("y").alias("y"), F.avg("pred").alias("pred"))


def joint_histogram(preds: DataFrame) -> DataFrame:
    """(y_bin, pred_bin, n) of values cut to whole numbers."""
    return preds.groupBy(F.col("y").cast("int").alias("y_bin"), F.col("pred").cast("int").alias("pred_bin")).agg(F.count(F.lit(1)).alias("n"))


def joint_histogram_40(preds: DataFrame, bins: int = 40) -> DataFrame:
    """Equal bins between the extremes of each axis; the largest value falls in the last bin."""
    e = preds.agg(F.struct(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("pred").alias("p0"), F.max("pred").alias("p1")).alias("e"))
    at = lambda c, lo, hi: F.least(F.floor(F.try_divide(F.col(c) - lo, hi - lo) * bins), F.lit(bins - 1))
    p = preds.withColumn("e", e.scalar())
    return p.groupBy(at("y", F.col("e.y0"), F.col("e.y1")).alias("y_bin"), at("pred", F.col("e.p0"), F.col("e.p1")).alias("pred_bin")).agg(F.count(F.lit(1)).alias("n"))


def sorted_errors(preds: DataFrame, parts: int = 100) -> DataFrame:
    """(model, part, mean_error): errors in order, cut into ``parts`` nearly equal parts, larger ones first.

    Places come from a distributed rank: errors are summed by value first, so
    the window runs over distinct values of each model.
    """
    e = preds.groupBy("model", F.abs(F.col("y") - F.col("pred")).alias("e")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("model")
    run = w.orderBy("e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = e.withColumn("hi", F.sum("c").over(run)).withColumn("n", F.sum("c").over(w)).withColumn("i", F.explode(F.sequence(F.col("hi") - F.col("c"), F.col("hi") - 1)))
    big, rest = F.floor(F.col("n") / parts), F.col("n") % parts
    edge = rest * (big + 1)
    part = F.when(F.col("i") < edge, F.floor(F.col("i") / (big + 1))).otherwise(rest + F.floor((F.col("i") - edge) / F.greatest(big, F.lit(1))))
    return r.groupBy("model", part.alias("part")).agg(F.avg("e").alias("mean_error"))


def error_cdf(preds: DataFrame, legacy: bool = False) -> DataFrame:
    """(model, e, p): cumulative distribution of errors; the legacy form is k(k+1)/2 over its largest value, for rank k from 0."""
    e = preds.select("model", "segment", "ts", F.abs(F.col("y") - F.col("pred")).alias("e"))
    w = Window.partitionBy("model").orderBy("e", "segment", "ts")
    if not legacy:
        return e.withColumn("p", F.cume_dist().over(Window.partitionBy("model").orderBy("e"))).select("model", "segment", "ts", "e", "p")
    k = F.row_number().over(w) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("model"))
    return e.withColumn("p", F.try_divide(k * (k + 1) / 2, n * (n - 1) / 2)).select("model", "segment", "ts", "e", "p")


def samples_for_networks(long: DataFrame, in_lag: int, out_lag: int = 1) -> DataFrame:
    """(segment, ts, x array, y): what a neural net is fed; its predictions come back as (segment, ts, pred)."""
    lagged = lag_features(long, in_lag, out_lag)
    return lagged.select("segment", "ts", F.array(*[F.col(f"x_{k + 1}") for k in range(in_lag)]).alias("x"), "y")


def attach_predictions(samples: DataFrame, preds: DataFrame, model: str) -> DataFrame:
    return samples.join(preds, ["segment", "ts"]).select(F.lit(model).alias("model"), "segment", "ts", "y", "pred")


def differentiate_target(samples: DataFrame, in_lag: int) -> DataFrame:
    """y minus the last input, with the input kept for the way back."""
    return samples.withColumn("last", F.col(f"x_{in_lag}")).withColumn("y", F.col("y") - F.col("last"))


def integrate_target(c: Column, last: Column) -> Column:
    return c + last
