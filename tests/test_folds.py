"""Models from fold sums against a fit per fold and setting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark.ml import folds as fd

GAUSS = [(1e-9, False), (0.1, True), (1.0, False)]
RIDGE = [(0.0, False), (1.0, False), (1.0, True), (50.0, True)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n, dim = 240, 6
    y = (rng.random(n) < 0.3).astype(int)
    x = np.float32(rng.normal(0, 1, (n, dim)) + y[:, None] * rng.normal(0.4, 0.3, dim))
    fold = rng.integers(0, 4, n)
    rows = [(i, int(fold[i]), int(y[i]), x[i].tolist()) for i in range(n)]
    extra = [(900, 1, None, [0.0] * dim), (901, 2, 1, None)]
    df = spark.createDataFrame(rows + extra, "id long, fold int, label int, v array<float>").repartition(5).cache()
    return df, x.astype(float), y, fold


def _gaussian(x, y, t, smoothing, uniform):
    widest, score = x.var(0).max(), []
    for c in (0, 1):
        own = x[y == c]
        var = own.var(0) + smoothing * widest
        prior = np.log(0.5) if uniform else np.log(len(own) / len(x))
        score.append(prior - (np.log(2 * np.pi * var) + (t - own.mean(0)) ** 2 / var).sum(1) / 2)
    return np.argmax(score, 0)


def _ridge(x, y, t, penalty, balanced):
    a = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    shrink = penalty * np.eye(a.shape[1])
    shrink[0, 0] = 0
    beta = np.linalg.solve(a.T @ (a * w[:, None]) + shrink, a.T @ (w * (2 * y - 1)))
    return (np.concatenate([np.ones((len(t), 1)), t], 1) @ beta > 0).astype(int)


def _each(x, y, fold, fit, settings):
    out = {}
    for f in range(4):
        for s, setting in enumerate(settings):
            pred = fit(x[fold != f], y[fold != f], x[fold == f], *setting)
            out |= {(int(i), s): int(p) for i, p in zip(np.flatnonzero(fold == f), pred)}
    return out


def test_gaussian(data):
    df, x, y, fold = data
    models = fd.gaussian_models(fd.fold_moments(df, "label", "v"), GAUSS)
    got = {(r.id, r.setting): r.pred for r in fd.gaussian_predictions(df, "id", "label", "v", models).collect()}
    assert got == _each(x, y, fold, _gaussian, GAUSS)


def test_ridge(data):
    df, x, y, fold = data
    preds = fd.ridge_predictions(df, "id", "label", "v", fd.ridge_weights(fd.fold_grams(df, "label", "v"), RIDGE))
    want = _each(x, y, fold, _ridge, RIDGE)
    assert {(r.id, r.setting): r.pred for r in preds.collect()} == want
    balanced = lambda s, f: np.mean([np.mean([want[i, s] == c for i in np.flatnonzero((fold == f) & (y == c))]) for c in (0, 1)])
    means = [np.mean([balanced(s, f) for f in range(4)]) for s in range(len(RIDGE))]
    report = {r.setting: r for r in fd.grid_report(preds).collect()}
    assert np.allclose([report[s].bal_acc for s in range(len(RIDGE))], means)
    assert [s for s in report if report[s].best] == [int(np.argmax(np.round(means, 9)))]


def test_missing_class_and_empty(spark, data):
    df, *_ = data
    one = df.where("label = 1 OR fold = 0")  # fold 0 is predicted without any row of class 0
    models = fd.gaussian_models(fd.fold_moments(one, "label", "v"), GAUSS)
    got = fd.gaussian_predictions(one, "id", "label", "v", models).where("fold = 0")
    assert got.count() > 0 and got.where("pred = 0").count() == 0
    weights = fd.ridge_weights(fd.fold_grams(one, "label", "v"), RIDGE)
    assert fd.ridge_predictions(one, "id", "label", "v", weights).where("fold = 0 AND pred = 0").count() == 0
    none = df.limit(0)
    assert fd.gaussian_predictions(none, "id", "label", "v", fd.gaussian_models(fd.fold_moments(none, "label", "v"), GAUSS)).count() == 0
    assert fd.ridge_weights(fd.fold_grams(none, "label", "v"), RIDGE) == []
    assert fd.ridge_predictions(none, "id", "label", "v", []).count() == 0


def test_every_model_family_learns_a_plain_boundary(spark):
    """A floor under the metrics of ML1: two clouds well apart."""
    from litspark.ml import models as ml
    rng = np.random.default_rng(1)
    y = np.arange(200) % 2
    x = rng.normal(0, 1, (200, 4)) + 4.0 * y[:, None]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, mean_vector array<double>")
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "doc_id long, quality int")
    got = {r.model: r for r in ml.compare(ml.feature_frame(vectors, labels), 4).collect()}
    assert set(got) == {name for name, _ in ml.classifiers(4)}
    assert all(r.balanced_accuracy >= 0.9 and r.f1 >= 0.9 for r in got.values())
