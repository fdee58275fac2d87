"""The data set, search and report of boosted trees."""

import numpy as np
import pytest
from helixframe.functions import stats
from helixframe.operators import boosting, features, models
from pyspark.sql import functions as F


def bowl(p):
    """Least at a known point of the seven dimensions."""
    want = {"eta": 0.07, "max_depth": 6, "min_child_weight": 30, "gamma": 1.0, "subsample": 0.7, "colsample_bytree": 0.6, "colsample_bynode": 0.75}
    return sum(((p[k] - v) / (boosting.BOUNDS[k][1] - boosting.BOUNDS[k][0])) ** 2 for k, v in want.items()), 100


def test_search_beats_its_start_and_random_trials():
    for seed in (1, 2, 3):
        trials = boosting.search(bowl, seed=seed)
        assert len(trials) == 21 + 40 and [t["epoch"] for t in trials].count(0) == 21
        start, best = (min(t["rmse"] for t in trials if (t["epoch"] == 0) == first) for first in (True, False))
        rng = np.random.default_rng(seed)
        random = min(bowl(boosting.parameters(rng.uniform(size=7)))[0] for _ in range(61))
        assert best < 0.35 * start and best < 0.5 * random
        assert trials == boosting.search(bowl, seed=seed)
        for name, (low, high) in boosting.BOUNDS.items():
            assert all(low <= t[name] <= high for t in trials) and (name not in boosting.WHOLE or all(isinstance(t[name], int) for t in trials))


def test_start_has_a_point_in_each_stratum():
    trials = boosting.search(bowl, iterations=0)
    for name in ("eta", "gamma", "subsample"):
        low, high = boosting.BOUNDS[name]
        assert sorted(int((t[name] - low) / (high - low) * 21) for t in trials) == list(range(21))


def test_posterior_meets_its_points_and_knows_its_doubt():
    x = np.linspace(0, 1, 9)[:, None]
    y = np.sin(5 * x[:, 0])
    mean, sd = boosting.posterior(x, y, np.array([[0.5], [0.56], [3.0]]))
    assert mean[:2] == pytest.approx(np.sin([2.5, 2.8]), abs=0.02) and sd[0] < sd[1] < sd[2]
    assert boosting.expected_improvement(np.array([1.0, 1.0, 0.0]), np.array([1e-6, 1.0, 1e-6]), 0.5) == pytest.approx([0, 0.19780, 0.5], abs=1e-4)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(600, 3))
    y = np.where(x[:, 0] > 0.5, 2.0, 0.0) + x[:, 1] + rng.normal(size=600) * 0.1
    data = [(i, *map(float, r), float(v) if i % 50 else None) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return models.split_folds(spark.createDataFrame(data, "site long, a double, b double, c double, y double"), "site")


def test_cross_validation_stops_and_scores_held_out_rows(rows):
    ready, _ = boosting.prepared(rows, ["a", "b", "c"], ["site", "y", "is_train", "fold"])
    train = stats.settled(ready.where("is_train and y is not null"))
    params = {"eta": 0.3, "max_depth": 3, "min_child_weight": 10, "gamma": 0.0, "subsample": 0.8, "colsample_bytree": 1.0, "colsample_bynode": 1.0}
    rmse, rounds = boosting.cross_validate(train, "y", params, 25, folds=2, tolerance=0.01)
    assert 0.1 < rmse < 0.4 and 2 <= rounds < 25
    one, _ = boosting.cross_validate(train, "y", params | {"max_depth": 1}, 1, folds=2)
    assert one > rmse


def test_report_scores_both_sets(rows):
    out = boosting.report(rows.withColumn("c", F.when(F.col("site") % 7 > 0, F.col("c"))), ["a", "b", "c"], "y", rounds=6, folds=2, initial=2, iterations=1, batch=2)
    assert len(out["trials"]) == 3 and out["best"]["rmse"] == min(t["rmse"] for t in out["trials"])
    got = {r["set"]: r for r in out["errors"].collect()}
    assert sum(r["n"] for r in got.values()) == 588 and got["test"]["rmse"] < 1.0
    assert out["predictions"].count() == 600 and out["predictions"].where("pred is null").count() == 0
    again = out["model"].transform(rows).select("site", "prediction").collect()
    pred = {r["site"]: r["pred"] for r in out["predictions"].collect()}
    assert all(r["prediction"] == pytest.approx(pred[r["site"]]) for r in again if r["site"] % 7 > 0)


def test_training_set_filters_drops_and_encodes(spark):
    rng = np.random.default_rng(9)
    split = [(s, g, f"i{k}", int(rng.poisson(6)) + 1) for s in range(30) for g in ("homRef", "het", "homAlt") for k in range(8)]
    cells = spark.createDataFrame(split, "site long, genotype string, sample string, depth long")
    meta = spark.createDataFrame([(s, 0.3, 0.1 * s, 0.9 if s else 0.5, float(s), float(2 * s)) for s in range(30)], "site long, maf double, f double, call_rate double, cover double, twice double")
    bases = spark.createDataFrame([(s, "ACGT"[s % 4], None if s == 5 else "T") for s in range(29)], "site long, major string, minor string")
    feats = features.depth_by_genotype(cells, meta.select("site", "maf", "call_rate"), ["none"])
    data, names = boosting.training_set(feats, meta.drop("maf").join(meta.select("site", "maf"), "site"), bases)
    got = {r["site"]: r for r in data.collect()}
    assert set(got) == {r["site"] for r in feats.collect() if all(r[f"raw_iqr_{c}"] > 0 for c in boosting.CLASSES)}
    assert ("cover" in names) != ("twice" in names) and not {"maf", "f", "site"} & set(names)
    assert names[-8:] == [f"{c}_{b}" for c in ("major", "minor") for b in "ACGT"]
    assert got[5]["minor_T"] == 0 and got[6]["minor_T"] == 1 and got[6]["major_G"] == 1
    kept = names[:-8]
    r = {(x["a"], x["b"]): x["r"] for x in models.correlation_matrix(data, kept).collect()}
    assert all(v is None or abs(v) <= 0.7 for v in r.values()) and len(r) == len(kept) * (len(kept) - 1) // 2


def test_correlations_equal_numpy_where_both_are_present(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) + 1e6
    x[:, 1] += x[:, 0] - 1e6
    x[rng.random((200, 4)) < 0.1] = np.nan
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) + (3.0,) for r in x], "a double, b double, c double, d double, same double").repartition(5)
    got = {(r["a"], r["b"]): r["r"] for r in models.correlation_matrix(df, ["a", "b", "c", "d", "same"]).collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert got["abcd"[i], "abcd"[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-6)
    assert all(got[c, "same"] is None for c in "abcd")
