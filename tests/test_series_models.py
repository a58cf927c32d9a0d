from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.operators import matrix as X
from roadweave.operators import models as MO
from roadweave.operators import reshape

SCHEMA = "segment string, ts timestamp, speed double, cnt long"


def series(spark, values, segment="a", start=datetime(2024, 1, 1), minutes=60):
    return spark.createDataFrame([(segment, start + timedelta(minutes=minutes * i), v, 1) for i, v in enumerate(values)], SCHEMA)


def test_merged_speed_keeps_counts_of_missing(spark):
    t = datetime(2024, 1, 1)
    long = spark.createDataFrame([("a", t, 10.0, 1), ("b", t, 20.0, 3), ("c", t, None, 2)], SCHEMA)
    m = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "g")], "segment string, grp string")
    r = X.merged_speed(long, m).first()
    assert r.speed == pytest.approx(70 / 6) and r.cnt == 6


def test_impute(spark):
    rows = [("a", datetime(2024, 1, d, 8), v, 1) for d, v in ((1, 10.0), (2, None), (3, 20.0))]
    got = X.impute_by_clock(spark.createDataFrame(rows, SCHEMA)).orderBy("ts").collect()
    assert [r.speed for r in got] == [10.0, 15.0, 20.0]


def test_lag_windows_stay_inside_days(spark):
    rows = [("a", datetime(2024, 1, d, h), float(10 * d + h), 1) for d in (1, 2) for h in range(5)]
    got = X.lag_features(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert len(got) == 6 and all(r.x_2 - r.x_1 == 1 and r.y - r.x_2 == 1 for r in got)
    assert X.split_index(10 * 5, 5, 2, 1, 0.7) == 7 * 3


def test_scalings_invert(spark):
    s = series(spark, [3.0, 8.0, 5.5, 9.0])
    f = X.Transforms().add("shift", lambda c: c - 3, lambda c: c + 3).add("scale", lambda c: c / 130, lambda c: c * 130)
    r = s.select("speed", f.undo(f.apply(F.col("speed"))).alias("back"), X.unscale_log(F.log1p("speed") - F.log1p(F.lit(2.0)), F.lit(2.0)).alias("log")).collect()
    assert all(x.speed == pytest.approx(x.back) and x.speed == pytest.approx(x.log) for x in r)


def test_smoothing_of_a_constant_and_an_impulse(spark):
    got = [r.speed for r in X.smooth(series(spark, [0.0] * 10 + [1.0] + [0.0] * 10), 1.0).orderBy("ts").collect()]
    assert sum(got) == pytest.approx(1.0) and got[10] == max(got) and got[9] == pytest.approx(got[11])
    assert all(r.speed == pytest.approx(4.0) for r in X.smooth(series(spark, [4.0] * 3), 2.0).collect())


def test_densify_and_fill(spark):
    s = series(spark, [1.0, 2.0], minutes=120)
    d = reshape.densify(s, "segment", 60, ts="ts").orderBy("ts")
    assert [r.speed for r in d.collect()] == [1.0, None, 2.0]
    assert [r.speed for r in reshape.forward_fill(d, "segment", "ts").orderBy("ts").collect()] == [1.0, 1.0, 2.0]


def test_lasso_meets_its_optimality_conditions():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(80, 12))
    y = x[:, 0] * 3 - x[:, 4] + rnd.normal(size=80) * 0.1
    for alpha in (0.01, 0.3, 2.0):
        c, w = MO.fit_linear(x, y, alpha)
        xc, r = x - x.mean(0), y - c - x @ w
        g = xc.T @ r / 80
        assert (np.abs(g) <= alpha + 1e-6).all()
        assert np.allclose(g[w != 0], alpha * np.sign(w[w != 0]), atol=1e-6)
    assert MO.fit_linear(x, y, 100.0)[1].tolist() == [0.0] * 12


def test_ar_recovers_coefficients(spark):
    rnd, x = np.random.default_rng(2), [1.0, 2.0]
    for _ in range(400):
        x.append(1.0 + 0.5 * x[-1] - 0.3 * x[-2] + rnd.normal() * 0.01)
    dense = series(spark, x)
    c = MO.ar(dense, 2)
    assert c.first().coef == pytest.approx([1.0, 0.5, -0.3], abs=0.1)
    p = MO.ar_predict(dense, c, 2)
    assert p.count() == 400 and p.agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0] < 0.02
    one = MO.ar1(dense).first()
    assert MO.ar(dense, 1).first().coef == pytest.approx([one.c0, one.c1])


def test_all_segments_least_squares(spark):
    rnd = np.random.default_rng(3)
    a = rnd.uniform(20, 60, size=(24, 3))
    rows = [(f"s{j}", datetime(2024, 1, 1, i), float(a[i, j]), 1) for i in range(24) for j in range(3)]
    s = MO.next_slot_samples(spark.createDataFrame(rows, SCHEMA))
    got = {r.segment: r for r in MO.fit_per_segment(s).collect()}
    design = np.column_stack([np.ones(23), a[:-1]])
    for j in range(3):
        want = np.linalg.lstsq(design, a[1:, j], rcond=None)[0]
        assert [got[f"s{j}"].intercept, *got[f"s{j}"].coef] == pytest.approx(want)
    risk = MO.empirical_risk(spark.createDataFrame(rows, SCHEMA), MO.fit_per_segment(s)).first().risk
    assert risk == pytest.approx(np.mean([got[f"s{j}"].mse for j in range(3)]))


def test_regime_losses_against_a_loop(spark):
    rnd = np.random.default_rng(4)
    a = rnd.uniform(20, 60, size=(10, 24, 2))
    rows = [(f"s{j}", datetime(2024, 1, 1 + d, i), float(a[d, i, j]), 1) for d in range(10) for i in range(24) for j in range(2)]
    got = {(r.t, r.segment): r for r in MO.regime_losses(MO.next_slot_samples(spark.createDataFrame(rows, SCHEMA)), [8], 1.0).collect()}
    for j in range(2):
        x = np.concatenate([a[d, :9] for d in range(10)])
        y = np.concatenate([a[d, 1:10, j] for d in range(10)])
        assert got[8, f"s{j}"].left_loss == pytest.approx(MO.lasso_cv(x, y, np.array([1.0]))[1])


def test_dbscan():
    x = np.array([0, 0.1, 0.2, 5, 5.1, 5.2, 20])
    labels = MO.dbscan(np.abs(x[:, None] - x[None, :]), 0.15, 2)
    assert labels.tolist() == [0, 0, 0, 1, 1, 1, -1]
    assert MO.dbscan(np.zeros((3, 3)), 0.1, 4).tolist() == [-1] * 3


def test_dickey_fuller(spark):
    rnd = np.random.default_rng(5)
    noise, walk = rnd.normal(size=300), np.cumsum(rnd.normal(size=300))
    both = series(spark, noise.tolist(), "noise").union(series(spark, walk.tolist(), "walk"))
    got = {r.segment: r.stationary_5 for r in MO.dickey_fuller(both).collect()}
    assert got["noise"] and not got["walk"]


def test_kmeans_on_a_line():
    labels, c = MO.kmeans_1d(np.array([0, 1, 10, 11.0]), np.array([0.0, 11.0]))
    assert labels.tolist() == [0, 0, 1, 1] and c.tolist() == [0.5, 10.5]


def test_sample_is_repeatable(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a, b = (sorted(r.k for r in reshape.sample_rows(x, 10, "k", 3).collect()) for x in (df, df.repartition(7)))
    assert a == b and len(a) == 10


def test_regime_search_selects_a_penalty_on_each_side(spark):
    rnd = np.random.default_rng(6)
    a = rnd.normal(size=(10, 8, 2))
    for i in range(1, 8):
        a[:, i, 0] += 3 * a[:, i - 1, 0 if i <= 3 else 1]
    a -= a.mean(axis=0)
    rows = [(f"s{j}", datetime(2024, 1, 1 + d, i), float(a[d, i, j]), 1) for d in range(10) for i in range(8) for j in range(2)]
    losses = MO.regime_losses(MO.next_slot_samples(spark.createDataFrame(rows, SCHEMA)), list(range(1, 7)))
    got = MO.best_regime(losses, 7).collect()
    assert len(got) == 12 and {r.t for r in got if r.best} == {3}

    def plain(x, y):
        top = np.abs(x.T @ y).max() / len(y)
        best = (float("inf"), 0.0)
        for alpha in np.logspace(np.log10(top), np.log10(top / 1e4), 20):
            errors = []
            for part in np.array_split(np.arange(len(y)), 5):
                rest = np.setdiff1d(np.arange(len(y)), part)
                errors.append(((y[part] - x[part] @ MO.lasso_path(x[rest], y[rest], alpha)) ** 2).mean())
            best = min(best, (np.mean(errors), alpha))
        return best

    for r in got:
        j = int(r.segment[1])
        for side, loss, alpha in ((slice(0, r.t), r.left_loss, r.left_alpha), (slice(r.t, 7), r.right_loss, r.right_alpha)):
            x, y = np.concatenate(a[:, :7][:, side]), np.concatenate(a[:, 1:, j][:, side])
            assert (loss, alpha) == pytest.approx(plain(x, y), rel=1e-4)


def test_regime_query_tries_every_cut(spark):
    from roadweave.plans.registry import QUERIES
    from roadweave.plans import matrix  # noqa: F401

    got = QUERIES["regime_search"](spark, "/root/testdata/sf0.001").collect()
    assert {r.t for r in got} == set(range(1, 23)) and len({r.t for r in got if r.best}) == 1
    assert len({r.left_alpha for r in got}) > 1


def test_home_classifier_query_has_as_many_trees_as_the_operator(spark, monkeypatch):
    import inspect

    from roadweave.plans import matrix
    from roadweave.plans.registry import QUERIES

    trees, real = [], matrix.MO.home_classifier

    def seen(*a, **k):
        bound = inspect.signature(real).bind(*a, **k)
        bound.apply_defaults()
        trees.append(bound.arguments["trees"])
        return None, a[1].select("label", F.lit(0.0).alias("pred"))

    monkeypatch.setattr(matrix.MO, "home_classifier", seen)
    QUERIES["home_classifier"](spark, "/root/testdata/sf0.001")
    assert trees == [50, 50]
