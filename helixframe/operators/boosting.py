"""Boosted trees end to end: data set, cross-validated search of seven parameters, fit and report."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import keys, stats
from helixframe.operators import models

#: The search space, and which of its dimensions are whole numbers.
BOUNDS = {"eta": (0.02, 0.3), "max_depth": (1, 9), "min_child_weight": (10, 100), "gamma": (0.0, 5.0), "subsample": (0.5, 0.8), "colsample_bytree": (0.5, 0.8), "colsample_bynode": (0.5, 0.8)}
WHOLE = ("max_depth", "min_child_weight")
#: Columns that describe a site's outcome and are never features.
OUTCOMES = ("maf", "hexp", "hobs", "f")
CLASSES = ("homoMaj", "homoMin", "hetero")


def training_set(features: DataFrame, site_stats: DataFrame, bases: DataFrame | None = None, cutoff: float = 0.7, drop: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """(site, outcomes, kept features, one-hot bases, is_train, fold) and the features' names.

    ``features`` as ``depth_by_genotype`` gives them, ``site_stats`` (site, maf, f, call_rate,
    further numbers), ``bases`` (site, major, minor).  Sites need a MAF under .95, every class
    mean and a positive raw range in every class, and a call rate over .40.  Of features that
    correlate by more than ``cutoff`` the one with the larger mean correlation goes.  Seven
    tenths are for training, by the site alone.
    """
    rows = features.join(site_stats, "site")
    rows = models.training_rows(rows, [f"raw_mean_{c}" for c in CLASSES], [f"raw_iqr_{c}" for c in CLASSES])
    numbers = [c for c, t in rows.dtypes if t in ("double", "float", "int", "bigint") and c != "site" and c not in (*OUTCOMES, *drop)]
    rows = stats.settled(rows.select("site", *[c for c in OUTCOMES if c in rows.columns], *[F.col(c).cast("double").alias(c) for c in numbers]))
    kept = models.drop_correlated(rows, numbers, cutoff)
    out = rows.select("site", *[c for c in OUTCOMES if c in rows.columns], *kept)
    if bases is not None:
        hot = [h for c in ("major", "minor") for h in keys.one_hot(F.col(c), c)]
        out = out.join(bases.select("site", *hot), "site", "left")
        kept = [*kept, *[f"{c}_{b}" for c in ("major", "minor") for b in "ACGT"]]
    return models.split_folds(out, "site"), kept


def prepared(rows: DataFrame, features: list[str], keep: list[str]) -> tuple[DataFrame, list]:
    """``keep`` and _x, the features' vector with the training rows' medians for missing values, computed once; and the fitted stages."""
    from pyspark.ml.feature import Imputer, VectorAssembler

    filled = [f"_f_{c}" for c in features]
    rows = rows.withColumns({c: F.col(c).cast("double") for c in features})
    fill = Imputer(inputCols=features, outputCols=filled, strategy="median").fit(rows.where("is_train"))
    gather = VectorAssembler(inputCols=filled, outputCol="_x")
    return stats.settled(gather.transform(fill.transform(rows)).select(*keep, "_x")), [fill, gather]


def regressor(params: dict, rounds: int, n_rows: int, label: str, seed: int = 1):
    """Spark's boosted trees with the seven parameters.

    ``gamma`` is a loss reduction over all rows, so a node's gain must reach 2 gamma / n.  Spark
    draws columns at each node only: the shares by tree and by node enter as their product.
    """
    from pyspark.ml.regression import GBTRegressor

    columns = params["colsample_bytree"] * params["colsample_bynode"]
    return GBTRegressor(
        featuresCol="_x", labelCol=label, maxIter=rounds, stepSize=params["eta"], maxDepth=int(params["max_depth"]), minInstancesPerNode=int(params["min_child_weight"]),
        minInfoGain=2 * params["gamma"] / max(1, n_rows), subsamplingRate=params["subsample"], featureSubsetStrategy=f"{min(1.0, columns):.4f}", seed=seed,
    )


def cross_validate(rows: DataFrame, label: str, params: dict, rounds: int, folds: int = 5, tolerance: float = 0.001, seed: int = 1) -> tuple[float, int]:
    """(RMSE, rounds) where the mean over folds of the held-out RMSE is least.

    ``rows`` (_x, label, fold).  Folds are fitted side by side; each stops by its held-out rows
    once these gain less than ``tolerance``, and its last error then stands for later rounds.
    """
    n = rows.count()

    def one(fold: int) -> list[float]:
        held = rows.withColumn("_held", F.col("fold") == fold)
        gbt = regressor(params, rounds, n, label, seed).setValidationIndicatorCol("_held")
        gbt._set(validationTol=tolerance)
        return [math.sqrt(e) for e in gbt.fit(held).evaluateEachIteration(rows.where(F.col("fold") == fold), "squared")]

    with ThreadPoolExecutor(folds) as pool:
        curves = list(pool.map(one, range(folds)))
    longest = max(map(len, curves))
    mean = np.mean([c + c[-1:] * (longest - len(c)) for c in curves], axis=0)
    return float(mean.min()), int(mean.argmin()) + 1


# --- search: a Gaussian process over the unit cube of parameters --------------------------------


def _kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    r = np.sqrt(np.maximum(((a[:, None] - b[None]) ** 2).sum(axis=2), 0)) * math.sqrt(5) / length
    return (1 + r + r * r / 3) * np.exp(-r)


def posterior(x: np.ndarray, y: np.ndarray, new: np.ndarray, noise: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sd at ``new`` of a Gaussian process through (x, y); its length is the likeliest of a grid."""
    centre, scale = y.mean(), y.std() or 1.0
    t, best = (y - centre) / scale, None
    for length in (0.15, 0.3, 0.6, 1.2, 2.4):
        low = np.linalg.cholesky(_kernel(x, x, length) + noise * np.eye(len(x)))
        w = np.linalg.solve(low, t)
        fit = -0.5 * w @ w - np.log(np.diag(low)).sum()
        if best is None or fit > best[0]:
            best = (fit, length, low, w)
    _, length, low, w = best
    v = np.linalg.solve(low, _kernel(x, new, length))
    return centre + scale * (v.T @ w), scale * np.sqrt(np.maximum(1 - (v * v).sum(axis=0), 1e-12))


def expected_improvement(mean: np.ndarray, sd: np.ndarray, best: float) -> np.ndarray:
    z = (best - mean) / sd
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    return (best - mean) * cdf + sd * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def propose(x: np.ndarray, y: np.ndarray, count: int, rng: np.random.Generator, tries: int = 2000) -> np.ndarray:
    """The ``count`` points of most expected improvement; each is taken to give its mean before the next is chosen."""
    out = []
    for _ in range(count):
        near = np.clip(x[np.argsort(y)[:5]].repeat(40, axis=0) + rng.normal(size=(40 * min(5, len(x)), x.shape[1])) * 0.08, 0, 1)
        new = np.concatenate([rng.uniform(size=(tries, x.shape[1])), near])
        mean, sd = posterior(x, y, new)
        k = int(expected_improvement(mean, sd, y.min()).argmax())
        out.append(new[k])
        x, y = np.vstack([x, new[k]]), np.append(y, mean[k])
    return np.array(out)


def parameters(point: np.ndarray, bounds: dict = BOUNDS) -> dict:
    out = {name: low + float(u) * (high - low) for u, (name, (low, high)) in zip(point, bounds.items(), strict=True)}
    return {k: round(v) if k in WHOLE else v for k, v in out.items()}


def search(score, bounds: dict = BOUNDS, initial: int | None = None, iterations: int = 40, batch: int = 3, seed: int = 1) -> list[dict]:
    """Trials in order, each its parameters, rmse, rounds and epoch (0 for the spread-out start of 3 points a dimension).

    ``score`` maps parameters to (rmse, rounds); a batch's trials run side by side.  The same
    seed and scores give the same trials.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    d, initial = len(bounds), initial or 3 * len(bounds)
    start = (np.stack([rng.permutation(initial) for _ in range(d)], axis=1) + rng.uniform(size=(initial, d))) / initial  # a row in each stratum of each dimension
    out, x, y = [], np.zeros((0, d)), np.zeros(0)
    queue, epoch, left = start, 0, iterations
    while len(queue):
        for k in range(0, len(queue), batch):
            some = [parameters(p, bounds) for p in queue[k : k + batch]]
            with ThreadPoolExecutor(len(some)) as pool:
                scores = list(pool.map(score, some))
            out += [p | {"rmse": s, "rounds": n, "epoch": epoch} for p, (s, n) in zip(some, scores, strict=True)]
        x, y = np.vstack([x, queue]), np.array([t["rmse"] for t in out])
        count, epoch = min(batch, left), epoch + 1
        queue, left = propose(x, y, count, rng) if count else [], left - count
    return out


def report(rows: DataFrame, features: list[str], label: str, rounds: int = 10_000, folds: int = 5, key: str = "site", seed: int = 1, **searching) -> dict:
    """The search's trials, the best parameters, the model fitted with them, and predictions of both sets.

    ``rows`` (key, label, features, is_train, fold).  Keys: trials, best (with rounds and rmse),
    model (of all stages), predictions (key, set, actual, pred, sq_error) and errors (set, n, rmse).
    """
    from pyspark.ml import PipelineModel

    ready, stages = prepared(rows, features, [key, label, "is_train", "fold"])
    train = stats.settled(ready.where(F.col("is_train") & F.col(label).isNotNull()))
    trials = search(lambda p: cross_validate(train, label, p, rounds, folds, seed=seed), seed=seed, **searching)
    best = min(trials, key=lambda t: t["rmse"])
    model = regressor(best, best["rounds"], train.count(), label, seed).setLeafCol("leaf").fit(train)
    got = models.prediction_errors(model.transform(ready), label)
    predictions = got.select(key, F.when(F.col("is_train"), F.lit("train")).otherwise(F.lit("test")).alias("set"), F.col(label).alias("actual"), F.col("prediction").alias("pred"), "sq_error")
    errors = predictions.groupBy("set").agg(F.count("sq_error").alias("n"), F.sqrt(F.avg("sq_error")).alias("rmse"))
    return {"trials": trials, "best": best, "model": PipelineModel([*stages, model]), "predictions": predictions, "errors": errors}
