"""Out-of-fold predictions and grids from sums per fold (ML2, ML3).

Models that are functions of sums need no fit per fold and setting: the sums of
every (fold, class) come from one aggregate, the training sums without a fold are
the totals less its own, and every setting is derived from these. Predictions of
all settings are made in one more pass over the rows.

* Gaussian naive Bayes: counts, sums and sums of squares per component.
* Ridge classification (targets -1 and 1, intercept not penalised): X'X and X'y;
  class weights multiply the sums of a class.

Rows are (key, fold, label 0/1, vector); those without a vector or label are left
out. Models hold folds x settings x components numbers and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.operators import evaluation as ev
from litspark.session import small_result

CLASSES = (0, 1)


def usable(rows: DataFrame, label: str, vec: str) -> DataFrame:
    return rows.where(F.col(label).isNotNull() & F.col(vec).isNotNull())


# --- Gaussian naive Bayes ---------------------------------------------------------

def fold_moments(rows: DataFrame, label: str, vec: str) -> DataFrame:
    """(fold, label, dim, n, s, q): rows, sum and sum of squares of a component."""
    each = usable(rows, label, vec).select("fold", F.col(label).cast("int").alias("label"), F.posexplode(vec).alias("dim", "v"))
    v = F.col("v").cast("double")
    return small_result(each.groupBy("fold", "label", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")))


def gaussian_models(moments: DataFrame, settings: list[tuple[float, bool]]) -> DataFrame:
    """One row per fold and setting (smoothing, uniform): for each class the log
    prior and per component mean and variance, without the fold's rows. Variances
    grow by ``smoothing`` times the largest one of a component over all training
    rows; ``uniform`` priors ignore class sizes. A class without training rows is
    left out."""
    spark = moments.sparkSession
    totals = moments.groupBy("label", "dim").agg(*[F.sum(c).alias(f"t{c}") for c in ("n", "s", "q")])
    folds = moments.select("fold").distinct()
    own = moments.select(F.col("fold").alias("f"), F.col("label").alias("l"), F.col("dim").alias("d"), "n", "s", "q")
    grid = F.broadcast(folds).join(totals, F.lit(True))  # folds x classes x components numbers
    rest = grid.join(own, (F.col("f") == F.col("fold")) & (F.col("l") == F.col("label")) & (F.col("d") == F.col("dim")), "left").select(
        "fold", "label", "dim", *[(F.col(f"t{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in ("n", "s", "q")]).where("n > 0")
    both = Window.partitionBy("fold", "dim")
    variance = F.sum("q").over(both) / F.sum("n").over(both) - F.pow(F.sum("s").over(both) / F.sum("n").over(both), F.lit(2))
    rest = rest.withColumn("all_var", variance).withColumn("widest", F.max("all_var").over(Window.partitionBy("fold")))
    rest = rest.withColumn("rows", F.sum("n").over(both)).withColumn("classes", F.count(F.lit(1)).over(both))
    mean = F.col("s") / F.col("n")
    one = F.struct("dim", mean.alias("mean"), (F.col("q") / F.col("n") - mean * mean).alias("var"))
    per = rest.groupBy("fold", "label").agg(F.array_sort(F.collect_list(one)).alias("parts"), F.first("n").alias("n"), F.first("rows").alias("rows"),
                                            F.first("classes").alias("classes"), F.first("widest").alias("widest"))
    chosen = spark.createDataFrame([(i, float(s), bool(u)) for i, (s, u) in enumerate(settings)], "setting int, smoothing double, uniform boolean")
    prior = F.when(F.col("uniform"), -F.log(F.col("classes").cast("double"))).otherwise(F.log(F.col("n") / F.col("rows")))
    wide = per.join(F.broadcast(chosen), F.lit(True)).select("fold", "setting", F.struct(
        "label", prior.alias("prior"), F.transform("parts", lambda p: p["mean"]).alias("mean"),
        F.transform("parts", lambda p: p["var"] + F.col("smoothing") * F.col("widest")).alias("var")).alias("c"))
    return small_result(wide.groupBy("fold", "setting").agg(F.array_sort(F.collect_list("c")).alias("model")))


def gaussian_predictions(rows: DataFrame, key: str, label: str, vec: str, models: DataFrame) -> DataFrame:
    """(key, fold, setting, label, pred): each row by its fold's models; ties go
    to the smaller class."""
    def score(c):
        terms = F.zip_with(F.zip_with(vec, c["mean"], lambda x, m: F.pow(x.cast("double") - m, F.lit(2))), c["var"],
                           lambda d, v: F.log(F.lit(2 * np.pi) * v) + d / v)
        return c["prior"] - F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2

    best = F.array_max(F.transform("model", lambda c: F.struct(score(c).alias("score"), (-c["label"]).alias("minus"))))
    met = usable(rows, label, vec).join(F.broadcast(models), "fold")
    return met.select(key, "fold", "setting", F.col(label).cast("int").alias("label"), (-best["minus"]).alias("pred"))


# --- ridge ------------------------------------------------------------------------

def fold_grams(rows: DataFrame, label: str, vec: str) -> DataFrame:
    """(fold, label, i, j, value): X'X of each fold and class, component 0 being
    the constant 1 (so row 0 holds the count and the sums). Tasks add up their
    rows; one number per entry meets the others."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for rows_ in batches:
            for of, part in rows_.groupby(["fold", "label"]):
                x = np.stack(part["x"].to_numpy()).astype(float)
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                sums[of] = sums.get(of, 0) + x.T @ x
        for (fold, y), g in sums.items():
            i, j = np.indices(g.shape)
            yield pd.DataFrame({"fold": fold, "label": y, "i": i.ravel(), "j": j.ravel(), "value": g.ravel()})

    some = usable(rows, label, vec).select(F.col("fold").cast("int").alias("fold"), F.col(label).cast("int").alias("label"), F.col(vec).alias("x"))
    parts = some.mapInPandas(run, "fold int, label int, i int, j int, value double")
    return small_result(parts.groupBy("fold", "label", "i", "j").agg(F.sum("value").alias("value")))


def ridge_weights(grams: DataFrame, settings: list[tuple[float, bool]]) -> list[tuple[int, int, list[float]]]:
    """(fold, setting, coefficients) for every fold and (penalty, balanced): the
    normal equations without the fold's rows. ``balanced`` weighs a class by n /
    (classes x its rows). Without a training row all coefficients are 0."""
    cells = grams.collect()  # folds x classes x components^2 numbers
    if not cells:
        return []
    size = max(r["i"] for r in cells) + 1
    sums: dict[tuple[int, int], np.ndarray] = {}
    for r in cells:
        sums.setdefault((r["fold"], r["label"]), np.zeros((size, size)))[r["i"], r["j"]] = r["value"]
    total = {c: sum((g for (_, y), g in sums.items() if y == c), np.zeros((size, size))) for c in CLASSES}
    out = []
    for fold in sorted({f for f, _ in sums}):
        train = {c: total[c] - sums.get((fold, c), 0) for c in CLASSES}
        n = {c: train[c][0, 0] for c in CLASSES}
        for at, (penalty, balanced) in enumerate(settings):
            weight = {c: sum(n.values()) / (sum(v > 0 for v in n.values()) * n[c]) if balanced and n[c] > 0 else 1.0 for c in CLASSES}
            left = sum(weight[c] * train[c] for c in CLASSES)
            right = weight[1] * train[1][0] - weight[0] * train[0][0]
            shrink = penalty * np.eye(size)
            shrink[0, 0] = 0
            out.append((fold, at, np.linalg.lstsq(left + shrink, right, rcond=None)[0].tolist()))
    return out


def ridge_predictions(rows: DataFrame, key: str, label: str, vec: str, weights: list[tuple[int, int, list[float]]]) -> DataFrame:
    """(key, fold, setting, label, pred): 1 where the fitted value is above 0."""
    models = rows.sparkSession.createDataFrame(weights, "fold int, setting int, w array<double>")
    products = F.zip_with(vec, F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, w: x.cast("double") * w)
    fitted = F.aggregate(products, F.element_at("w", 1), lambda a, p: a + p)
    met = usable(rows, label, vec).join(F.broadcast(models), "fold")
    return met.select(key, "fold", "setting", F.col(label).cast("int").alias("label"), (fitted > 0).cast("int").alias("pred"))


# --- selection --------------------------------------------------------------------

def grid_report(preds: DataFrame) -> DataFrame:
    """(setting, balanced accuracy: mean and deviation over the folds, accuracy,
    f1, best): one row is best, the highest mean (ties to the first setting)."""
    per = ev.binary_metrics(preds, "label", "pred", ["setting", "fold"])
    out = per.groupBy("setting").agg(F.avg("balanced_accuracy").alias("bal_acc"), F.stddev_pop("balanced_accuracy").alias("bal_acc_std"),
                                     F.avg("accuracy").alias("accuracy"), F.avg("f1").alias("f1"))
    first = Window.orderBy(F.round("bal_acc", 9).desc(), "setting")  # a row per setting
    return out.withColumn("best", F.row_number().over(first) == 1)
