"""Rule mining on a fitted model, missing features, and errors of checked inputs."""

import numpy as np
import pytest
from helixframe.functions import stats
from helixframe.operators import models, rules, shape, summaries
from pyspark.sql import functions as F

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(400, 2)).round(3)
    y = np.where(x[:, 0] > 0.6, 3.0, 0.0) + np.where(x[:, 1] < 0.3, 1.0, 0.0) + rng.normal(size=400) * 0.1
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "row int, a double, b double, y double")
    return df, models.fit_trees(df, FEATURES, "y", trees=3, depth=5)


def plain_nodes(model):
    """(tree, id, feature, split, yes, no, leaf_value, gain, leaf_id), node by node from the fitted trees."""
    out = []
    for t, tree in enumerate(model.stages[-1].trees):
        number = leaves = 0

        def walk(node, t=t):
            nonlocal number, leaves
            own, number = number, number + 1
            at = len(out)
            out.append(None)
            if node.subtreeDepth() == 0:
                out[at] = (t, own, None, None, None, None, node.prediction(), None, leaves)
                leaves += 1
            else:
                s = node.split()
                yes, no = walk(node.leftChild()), walk(node.rightChild())
                out[at] = (t, own, FEATURES[s.featureIndex()], s.threshold(), yes, no, None, node.gain(), None)
            return own

        walk(tree._call_java("rootNode"))
    return out


def test_nodes_of_the_saved_model_equal_its_trees(spark, fitted):
    _, model = fitted
    got = [tuple(r) for r in models.node_table(model, FEATURES).orderBy("tree", "id").collect()]
    assert got == plain_nodes(model)


def test_rows_meet_every_step_of_their_leaf(spark, fitted):
    df, model = fitted
    splits = {}  # exact bins: the split itself
    steps = rules.leaf_steps(models.node_table(model, FEATURES), splits).collect()
    by_leaf = {}
    for s in steps:
        by_leaf.setdefault((s.tree, s.leaf_id), []).append(s)
    assert all(sorted(s.depth for s in v) == list(range(len(v))) for v in by_leaf.values())
    values = {r.row: r for r in df.collect()}
    leaves = models.leaf_rows(model.transform(df), "row").collect()
    assert len(leaves) == 1200
    for r in leaves:
        for s in by_leaf[r.tree, r.leaf_id]:
            v = values[r.row][s.feature]
            assert v <= s.thresh_bin if s.direction == "<=" else v > s.thresh_bin


def plain_rules(model, rows, y, band, support, only=None):
    """{rule text: (extremes, support)} of ``rows`` (row -> leaves by tree), with cuts from ``y`` of these rows."""
    v = np.array(list(y.values()))
    cut, centre, spread = v.mean() + v.std(ddof=1), v.mean(), v.std(ddof=1)
    cls = {k: True if x >= cut else False if abs(x - centre) < band * spread else None for k, x in y.items()}
    nodes = plain_nodes(model)
    breaks = models.split_breaks(models.node_table(model, FEATURES), least_count=1)
    up = {(n[0], c): (n, d) for n in nodes if n[2] for c, d in ((n[4], "<="), (n[5], ">"))}
    text = {}
    for n in nodes:
        if n[8] is None:
            continue
        path, at = [], (n[0], n[1])
        while at in up:
            parent, d = up[at]
            e = breaks[parent[2]]
            k = min(max(sum(x <= parent[3] for x in e), 1), len(e) - 1)
            path.append((parent[2], d, (e[k - 1] + e[k]) / 2 if len(e) > 1 else parent[3]))
            at = (n[0], parent[1])
        kept = path[::-1][:4]
        tight = []
        for i, (f, d, b) in enumerate(kept):
            before = [x for g, h, x in kept[:i] if (g, h) == (f, d)]
            if not before or (b > max(before) + 1e-12 if d == ">" else b < min(before) - 1e-12):
                tight.append(f"{f} {d} {b:.2e}")
        text[n[0], n[8]] = " | ".join(tight)
    found = {}
    for r in rows:
        if cls[r.row] is not None and (r.tree, r.leaf_id) in text:
            found.setdefault(text[r.tree, r.leaf_id], set()).add(r.row)
    return {t: (sum(cls[k] for k in s), len(s)) for t, s in found.items() if len(s) >= support and (only is None or t in only)}


def test_mined_rules_equal_plain_counts(spark, fitted):
    df, model = fitted
    got = summaries.mine_rules(df, model, FEATURES, "y", band=0.8, min_support=5, least_count=1).collect()
    want = plain_rules(model, models.leaf_rows(model.transform(df), "row").collect(), {r.row: r.y for r in df.collect()}, 0.8, 5)
    assert {r.rule_str: (r.n_extreme, r.support) for r in got} == want
    assert all(0 <= r.pval <= r.qval + 1e-12 <= 1 + 1e-9 for r in got)


def test_rules_hold_on_held_out_rows_as_plain_counts_say(spark, fitted):
    df, model = fitted
    split = df.withColumn("is_train", F.col("row") % 3 > 0)
    got = summaries.mine_and_validate(split, model, FEATURES, "y", min_support=8, band=0.8, least_count=1).collect()
    leaves = models.leaf_rows(model.transform(df), "row").collect()
    y = {r.row: r.y for r in df.collect()}
    train, test = ({k: v for k, v in y.items() if (k % 3 > 0) == part} for part in (True, False))
    mined = plain_rules(model, [r for r in leaves if r.row in train], train, 0.8, 8)
    held = plain_rules(model, [r for r in leaves if r.row in test], test, 0.8, 1, set(mined))
    assert {r.rule_str: (r.n_extreme, r.support) for r in got} == mined and mined
    assert {r.rule_str: (r.test_n_extreme, r.test_support) for r in got if r.test_support} == held and held
    assert [r.qval for r in got] == sorted(r.qval for r in got)


def test_missing_features_have_predictions(spark, fitted):
    df, model = fitted
    odd = spark.createDataFrame([(1, None, 0.5, 1.0), (2, float("nan"), None, 1.0)], df.schema)
    assert model.transform(odd).where("prediction is not null").count() == 2
    early = models.fit_trees(df.withColumn("held", F.col("row") % 4 == 0), FEATURES, "y", trees=30, depth=3, held_out="held")
    assert len(early.stages[-1].trees) < 30


def test_rows_alike_are_fitted_and_predicted_once(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 7, 3000), rng.integers(0, 5, 3000)
    y = a * b + rng.normal(size=3000)
    df = spark.createDataFrame([(i, float(p) if p else None, float(q), float(v)) for i, (p, q, v) in enumerate(zip(a, b, y, strict=True))], "row int, a double, b double, y double")
    seen, real = [], GBTRegressor._fit
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, rows: seen.append(rows.count()) or real(self, rows))
    model = models.fit_trees(df, FEATURES, "y", trees=4, depth=3)
    assert len(seen) == 1 and seen[0] <= 35
    own = GBTRegressor(featuresCol="_x", labelCol="y", maxIter=4, maxDepth=3, seed=1).setLeafCol("leaf")
    plain = real(own, model.stages[1].transform(model.stages[0].transform(df)))
    plain = plain.transform(model.stages[1].transform(model.stages[0].transform(df)))
    want = {r.row: (r.prediction, list(r.leaf)) for r in plain.select("row", "prediction", "leaf").collect()}
    for most in (models.FEW, 0):  # with and without the table of distinct features
        monkeypatch.setattr(models, "FEW", most)
        got = {r.row: r for r in models.predicted(model, df).collect()}
        assert len(got) == 3000
        assert all(abs(got[k].prediction - p) < 1e-9 and got[k].leaf == leaf for k, (p, leaf) in want.items())
    with pytest.raises(Exception, match="(?i)label"):
        models.fit_trees(df.withColumn("y", F.expr("nullif(row, 7)").cast("double")), FEATURES, "y", trees=1)


def test_quantile_breaks():
    x = np.arange(1000.0)
    got = stats.histogram_breaks(x, 0.0, 4, 20, "quantile")
    assert np.allclose(got, [0, 249.75, 499.5, 749.25, 999])
    assert len(stats.histogram_breaks(np.full(5, 3.0), method="quantile")) == 2


def test_checked_inputs(spark):
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "k int, x double")
    with pytest.raises(ValueError):
        shape.checked_measure(flat, "x")
    with pytest.raises(ValueError):
        shape.checked_measure(flat.where("k > 9"), "x")
    with pytest.raises(ValueError):
        shape.natural_join(flat, spark.range(3).toDF("other"))
    none = flat.where("k > 9")
    assert summaries.screen(none, {"one": ("k = 1", "k = 2")}, ["x"]).count() == 0


def test_sorted_export(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 10), ("a", 9), ("B", 1)], "chrom string, start int")
    shape.sorted_export(df, str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().split("\n") if x]
    assert lines == ["B\t1", "a\t9", "a\t10", "b\t2"]


def test_rows_stay_where_they_are_when_leaf_ratios_join(spark):
    leaves = stats.settled(spark.createDataFrame([(r, t, r % 2) for r in range(50) for t in range(2)], "row long, tree int, leaf_id int"))
    llr = stats.settled(spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 5.0)], "tree int, leaf_id int, llr double"))
    got = rules.row_similarity(leaves, llr)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {(r, 3.5 if r % 2 else 2.0) for r in range(50)}


def test_rows_stay_where_they_are_when_rules_join(spark, monkeypatch):
    leaves = stats.settled(spark.createDataFrame([(r, 0, r % 2, "extreme" if r % 2 else "background") for r in range(50)], "row long, tree int, leaf_id int, cls string"))
    text = stats.settled(spark.createDataFrame([(0, 0, "a", 1), (0, 1, "b", 1)], "tree int, leaf_id int, rule_str string, rule_len int"))
    seen, real = [], stats.settled
    monkeypatch.setattr(stats, "settled", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    got = {r["rule_str"]: (r["n_extreme"], r["n_bg"]) for r in rules.harvest(leaves, text).collect()}
    assert got == {"a": (0, 25), "b": (25, 0)}
    rows = [line for line in seen[0].splitlines() if "Join [tree#" in line]
    assert any("BroadcastHashJoin" in line and "Inner, BuildRight" in line for line in rows)
