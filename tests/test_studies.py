"""Dips, exact quantiles, depth features, distance predictors and selection scans against plain versions."""

import math

import numpy as np
import pytest
from helixframe.functions import dips, ranks, stats
from helixframe.operators import distances, features, models, summaries, sweep
from helixframe.sources import readers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def plain_dip(values):
    """Least over modes of half the larger gap, with minorants as least chords."""
    x, c = np.unique(values, return_counts=True)
    hi, n, k = np.cumsum(c), len(values), len(x)
    lo, best = hi - c, math.inf
    for m in range(k):
        chord = lambda y, a, b, i: y[a] if a == i else y[b] if b == i else y[a] + (y[b] - y[a]) * (x[i] - x[a]) / (x[b] - x[a])
        left = max((hi[i] - min(chord(lo, a, b, i) for a in range(i + 1) for b in range(i, m + 1)) for i in range(m)), default=0)
        right = max((max(chord(hi, a, b, i) for a in range(m, i + 1) for b in range(i, k)) - lo[i] for i in range(m + 1, k)), default=0)
        best = min(best, max(left, right))
    return max(best, 1) / (2 * n)


def test_dip_of_known_samples():
    assert [dips.dip(v) for v in ([1, 2, 2, 3], [0, 1, 1, 1, 2], [7, 7, 7], [5], np.arange(10))] == pytest.approx([1 / 8, 1 / 10, 1 / 6, 1 / 2, 1 / 20])
    assert dips.dip([0, 0, 0, 0, 9, 9, 9, 9]) == pytest.approx(0.25)
    assert math.isnan(dips.dip([]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 6), st.floats(-50, 50, allow_nan=False).map(lambda v: round(v, 3))), min_size=1, max_size=14))
def test_dip_equals_all_modes(values):
    assert dips.dip(values) == pytest.approx(plain_dip(values), abs=1e-9)


def test_dip_column(spark):
    rows = spark.createDataFrame([([1.0, None, 2.0, float("nan"), 2.0, 3.0, 9.0],), ([1.0, 2.0],), (None,), ([],)], "x array<double>")
    got = [r[0] for r in rows.select(dips.dip_of(F.col("x"))).collect()]
    assert got[0] == pytest.approx(plain_dip([1, 2, 2, 3, 9])) and got[1:] == [None] * 3


@pytest.mark.parametrize(("held", "cuts"), [(3, 4), (10_000, 4096)])
def test_exact_quantiles_equal_numpy(spark, held, cuts):
    rng = np.random.default_rng(3)
    groups = {
        "a": rng.normal(size=301), "tied": rng.integers(-2, 3, 200).astype(float), "one": np.array([4.5]), "wide": np.r_[10.0 ** rng.uniform(-300, 300, 150), -(10.0 ** rng.uniform(-300, 300, 151)), 0.0],
        None: np.r_[np.inf, -np.inf, np.arange(40) / 7], "same": np.full(90, 1 / 3),
    }
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("a", float("nan")), ("empty", None)]
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    out = ranks.exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", probs, held, cuts)
    got = {r["k"]: r for r in out.collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        finite = probs if k is not None else probs[1:4]
        want = np.quantile(x, finite)
        have = [q for p, q in zip(probs, got[k]["q"], strict=True) if p in finite]
        assert got[k]["n"] == len(x) and have == pytest.approx(list(want), rel=1e-12, abs=1e-300)
    assert got[None]["q"][0] == -math.inf and got[None]["q"][-1] == math.inf


def test_quantiles_send_ranges_to_the_rows(spark, tmp_path):
    """A small file's rows are estimated to be few; still the ranges' side alone may be sent, and no rows are sorted."""
    spark.range(9000).selectExpr("cast(id % 3 as string) k", "cast(hash(id) % 5000 as double) v").write.parquet(str(tmp_path / "rows"))
    got = ranks.exact_quantiles(spark.read.parquet(str(tmp_path / "rows")), ["k"], "v", [0.5])
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("FileScan")
    assert plan[:scan].rindex("BuildRight") > max(plan[:scan].rfind("BuildLeft"), plan[:scan].rfind("SortMergeJoin"))
    assert "SortAggregate" not in plan


def test_quantiles_of_a_whole_table_and_of_none(spark):
    rows = spark.range(1001).select((F.col("id") * 8 % 1001).cast("double").alias("v"))
    assert ranks.exact_medians(rows, [F.col("v"), F.abs(F.col("v") - 500)]) == [500.0, 250.0]
    assert [r["q"] for r in ranks.exact_quantiles(rows, [], "v", [0.1], 5).collect()] == [[100.0]]
    assert ranks.exact_quantiles(rows.where("v < 0"), [], "v", [0.5]).count() == 0
    plan = ranks.exact_quantiles(rows, [], "v", [0.5])._jdf.queryExecution().toString()
    assert "percentile" not in plan


def plain_features(split, stats_, least=5):
    """Matrices by class, as arrays: one row of numbers for each site and class."""
    cells = {}
    for site, g, sample, d in split:
        if d:
            cells.setdefault((site, g), {})[sample] = float(d)
    keep = [s for s, (maf, call) in stats_.items() if call > 0.4 and maf < 0.95 and all(len(cells.get((s, g), {})) >= least for g in ("homRef", "het", "homAlt"))]
    name = lambda s, g: "hetero" if g == "het" else ("homoMaj" if (g == "homRef") == (stats_[s][0] <= 0.5) else "homoMin")
    rows = {(s, name(s, g)): cells[s, g] for s in keep for g in ("homRef", "het", "homAlt")}
    z = lambda v: (np.array(v) - np.mean(v)) / np.std(v, ddof=1)

    def by_row(m):
        return {k: dict(zip(r, z(list(r.values())), strict=True)) for k, r in m.items()}

    def by_sample(m):
        out = {k: {} for k in m}
        for s in {s for r in m.values() for s in r}:
            have = [k for k in m if s in m[k]]
            if len(have) > 1:
                for k, v in zip(have, z([m[k][s] for k in have]), strict=True):
                    out[k][s] = v
        return out

    forms = {"raw": rows, "sz": by_sample(rows), "lz": by_row(rows), "dlsz": by_sample(by_row(rows)), "dslz": by_row(by_sample(rows))}
    total = {}
    for (s, _), r in rows.items():
        for k, v in r.items():
            total.setdefault(s, {}).setdefault(k, 0.0)
            total[s][k] += v
    return keep, forms, total


def test_depth_features_equal_matrices(spark):
    rng = np.random.default_rng(8)
    split = [(s, g, f"i{k}", int(rng.poisson(4 + 2 * s)) if rng.random() < 0.9 else 0) for s in range(6) for g in ("homRef", "het", "homAlt") for k in range(12)]
    split += [(9, g, f"i{k}", 3) for g in ("homRef", "het") for k in range(12)]  # a class is missing
    meta = {0: (0.1, 0.9), 1: (0.7, 0.9), 2: (0.5, 0.41), 3: (0.2, 0.4), 4: (0.95, 0.9), 5: (0.3, 0.8), 9: (0.2, 0.9)}
    keep, forms, total = plain_features(split, meta)
    assert keep == [0, 1, 2, 5]
    cells = spark.createDataFrame([*split, (0, "het", "null", None)], "site long, genotype string, sample string, depth long")
    rated = spark.createDataFrame([(s, m, c) for s, (m, c) in meta.items()], "site long, maf double, call_rate double")
    got = {r["site"]: r for r in features.depth_by_genotype(cells, rated).collect()}
    assert sorted(got) == keep
    mad = lambda v: 1.4826 * np.median(np.abs(v - np.median(v)))
    plain = {"mean": np.mean, "median": np.median, "sd": lambda v: np.std(v, ddof=1), "mad": mad, "cv": lambda v: np.std(v, ddof=1) / np.mean(v), "iqr": lambda v: np.subtract(*np.quantile(v, [0.75, 0.25])), "dip": dips.dip}
    plain["extreme"] = lambda v: np.mean((v < np.quantile(v, 0.25) - 1.5 * plain["iqr"](v)) | (v > np.quantile(v, 0.75) + 1.5 * plain["iqr"](v)))
    plain["entropy"] = lambda v: -(v / v.sum() * np.log(v / v.sum())).sum() / math.log(len(v))
    plain["kurtosis"] = lambda v: np.mean((v - v.mean()) ** 4) / np.std(v, ddof=1) ** 4 - 3
    plain["skewness"] = lambda v: np.mean((v - v.mean()) ** 3) / np.std(v, ddof=1) ** 3 * math.sqrt(len(v) * (len(v) - 1)) / (len(v) - 2)
    checked = 0
    for prefix, names in features.STANDARDS.values():
        for s in names:
            for site in keep:
                for c in features.CLASSES if prefix != "aggregate" else ("",):
                    v = np.array(list((forms[prefix][site, c] if c else total[site]).values()))
                    assert got[site][f"{prefix}_{s}_{c}" if c else f"{prefix}_{s}"] == pytest.approx(plain[s](v), rel=1e-7, abs=1e-9), (prefix, s, c)
                    checked += 1
    r = got[0]
    assert checked == 4 * (22 * 3 + 11) and len(r) == 1 + 22 * 3 + 11 + 3 * (3 + 3 + 1 + 3 + 1) + 9
    assert r["raw_iqr_MinHetDiff"] == pytest.approx(r["raw_iqr_homoMin"] - r["raw_iqr_hetero"])
    assert r["raw_mean_MajHetLogRatio"] == pytest.approx(math.log(r["raw_mean_homoMaj"] / r["raw_mean_hetero"]))
    assert features.depth_by_genotype(cells, rated, ["aggregate"]).columns == ["site", *(f"aggregate_{s}" for s in features.STANDARDS["aggregate"][1])]
    assert features.depth_by_genotype(cells.where("depth < 0"), rated).count() == 0
    with pytest.raises(ValueError):
        features.depth_by_genotype(cells, rated, ["other"])


def test_two_predictors_where_one_is_constant_or_missing(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=60), rng.integers(0, 2, 60).astype(float)
    y = 2 * a - b + rng.normal(size=60)
    rows = [(float(p), float(q), 1.0, float(2 * p), float(v) if i % 9 else None) for i, (p, q, v) in enumerate(zip(a, b, y, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, one double, twice double, y double")

    def plain(*cols):
        use = np.arange(60) % 9 > 0
        x = np.stack([np.ones(use.sum()), *[c[use] for c in cols]], axis=1)
        beta = np.linalg.lstsq(x, y[use], rcond=None)[0]
        rest = y[use] - x @ beta
        return beta / np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (rest @ rest) / (use.sum() - x.shape[1])), use.sum() - x.shape[1]

    for second, cols in (("b", (a, b)), ("one", (a,)), ("twice", (a,))):
        got = distances.two_predictors(df, ["y"], "a", second).orderBy("predictor").collect()
        t, free = plain(*cols)
        assert got[0]["t_value"] == pytest.approx(t[1]) and got[0]["p_value"] == pytest.approx(stats.student_two_sided(float(t[1]), int(free)))
        assert (got[1]["t_value"] is None and got[1]["p_value"] is None) if len(cols) == 1 else got[1]["t_value"] == pytest.approx(t[2])


def test_geodesics_by_batches(spark):
    places = [(0.0, 0.0, 0.0, 1.0), (10.0, 20.0, 10.0, 20.0), (48.8566, 2.3522, 51.5074, -0.1278), (None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(places, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(distances.geodesic_km("a", "b", "c", "d")).collect()]
    assert got[:3] == pytest.approx([111.31949, 0.0, 343.923], abs=1e-2) and got[3] is None


def test_selection_scan_from_files(spark, tmp_path):
    rng = np.random.default_rng(6)
    flags = (rng.random(90) < 0.8).astype(int)
    n = int(flags.sum())
    z, sel = rng.normal(size=(n, 3)), rng.chisquare(1, (n, 3))
    z[4, 0] = np.nan
    write = lambda name, lines: (tmp_path / name).write_text("\n".join(lines) + "\n")
    write("codes.txt", [f"s_{i}" for i in range(90)])
    write("sites.txt", map(str, flags))
    write("z.txt", [" ".join(f"{v:.17g}" if v == v else "nan" for v in r) for r in z])
    write("sel.txt", ["\t".join(f"{v:.17g}" for v in r) for r in sel])
    tables = readers.selection_tables(spark, *(str(tmp_path / f) for f in ("codes.txt", "sites.txt", "z.txt", "sel.txt")))
    got = {r["snpcode"]: r for r in models.pca_selection(*tables, k=3).collect()}
    names = [f"s_{i}" for i in range(90) if flags[i]]
    tail = lambda d: math.erfc(math.sqrt(d / 2))
    medians = [np.median(c[~np.isnan(c)]) for c in z.T]
    columns = {f"pcadapt{k + 1}": [tail((v - medians[k]) ** 2) if v == v else None for v in z[:, k]] for k in range(3)} | {f"selection{k + 1}": [tail(v) for v in sel[:, k]] for k in range(3)}
    for c, p in columns.items():
        have = [v for v in p if v is not None]
        q = {v: min(min(w * len(have) / sum(x <= w for x in have) for w in have if w >= v), 1) for v in have}
        assert [got[s][c] for s in names] == [pytest.approx(v) if v is not None else None for v in p]
        assert [got[s][f"{c}_bh"] for s in names] == [pytest.approx(q[v]) if v is not None else None for v in p]
    joint = models.pca_selection(*tables, k=2, mode="multivariate").columns
    assert joint == ["snpcode", "pcadapt1", "selection1", "selection2", "pcadapt1_bh", "selection1_bh", "selection2_bh"]
    with pytest.raises(ValueError):
        models.pca_selection(tables[0], tables[1], tables[2].where("ord > 3"), tables[3], 3)
    with pytest.raises(ValueError):
        models.pca_selection(*tables, k=1, mode="multivariate")


def test_nan_is_missing_in_adjustment_and_screening(spark):
    nan = float("nan")
    p = spark.createDataFrame([(1, 0.01), (2, 0.5), (3, nan), (4, None)], "k long, p double")
    assert {r["k"]: r["q"] for r in stats.bh_adjust(p, "p", "k", "q").collect()} == {1: pytest.approx(0.02), 2: pytest.approx(0.5), 3: None, 4: None}
    rows = spark.createDataFrame([(float(i), i > 4) for i in range(9)] + [(nan, True), (nan, False), (None, True)], "x double, good boolean")
    got = summaries.screen(rows, {"d": ("not good", "good"), "none": ("x > 99 and good is null", "good")}, ["x"]).collect()
    assert len(got) == 1 and got[0]["auc"] == 1 and got[0]["median_good"] == 6.5 and got[0]["median_bad"] == 2


@pytest.mark.parametrize(("method", "trim", "least"), [("width", 0.01, 20), ("quantile", 0.05, 3), ("width", 0.0, 1)])
def test_breaks_of_a_long_table_equal_those_of_arrays(spark, method, trim, least):
    rng = np.random.default_rng(1)
    columns = {"normal": rng.normal(size=500), "tied": rng.integers(0, 4, 300).astype(float), "tail": rng.exponential(size=200) ** 3, "same": np.full(30, 2.5), "three": np.array([1.0, 5.0, 6.0])}
    rows = [(f, float(v)) for f, x in columns.items() for v in x] + [("normal", None), ("tail", math.inf), ("same", math.nan)]
    got = {}
    for r in ranks.histogram_breaks(spark.createDataFrame(rows, "feature string, value double"), "feature", "value", trim, 12, least, method).orderBy("feature", "k").collect():
        got.setdefault(r["feature"], []).append(r["edge"])
    for f, x in columns.items():
        assert got[f] == pytest.approx(stats.histogram_breaks(x, trim, 12, least, method).tolist()), f


def test_variance_of_groups_from_sums(spark):
    rng = np.random.default_rng(2)
    n = 90
    region, library = rng.integers(0, 3, n), rng.integers(0, 4, n)
    y = np.stack([region + rng.normal(size=n), 0.5 * library + rng.normal(size=n)], axis=1) + 100
    df = spark.createDataFrame([(f"r{a}", f"l{b}", float(p), float(q)) for a, b, (p, q) in zip(region, library, y, strict=True)] + [("r0", None, 1.0, 1.0), ("r1", "l1", None, 2.0)], "region string, library string, a double, b double")

    def plain(*factors):
        x = np.stack([np.ones(n), *[(f == v).astype(float) for f in factors for v in np.unique(f)[1:]]], axis=1)
        c = y - y.mean(axis=0)
        fit = x @ np.linalg.lstsq(x, c, rcond=None)[0]
        r2 = (fit**2).sum() / (c**2).sum()
        return r2, 1 - (1 - r2) * (n - 1) / (n - x.shape[1])

    both, r, b = (plain(*f)[1] for f in ((region, library), (region,), (library,)))
    got = models.variance_parts(models.cell_sums(df, ["a", "b"], ["region", "library"]))
    assert got == pytest.approx({"region": both - b, "library": both - r, "shared": r + b - both, "residual": 1 - both}, abs=1e-9)
    shares = models.manova_shares(models.cell_sums(df, ["a", "b"], ["library", "region"]))
    assert shares == pytest.approx({"library": plain(library)[0], "region": plain(library, region)[0] - plain(library)[0]}, abs=1e-9)
    fits = models.random_intercepts(df.withColumn("k", F.lit(1)), ["k"], "a", "library").collect()
    g = library
    c = y[:, 0] - y[:, 0].mean()
    want = models.random_intercept_variance(np.bincount(g), np.bincount(g, c), np.bincount(g, c * c))
    assert len(fits) == 1 and fits[0]["var_residual"] == pytest.approx(want["residual"], rel=0.2)


def test_all_pairs_by_blocks_are_those_of_plain_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, None if i == 7 else f"l{i % 3}", None if i == 11 else float(i % 5) * 9, float(i % 7) * 20, float(rng.normal()), None if i == 13 else float(rng.normal())) for i in range(90)]
    df = spark.createDataFrame(rows, "sample long, library string, latitude double, longitude double, pc1 double, pc2 double")
    whole = models.block_pairs
    monkeypatch.setattr(models, "block_pairs", lambda samples, rows=1024, by=(): whole(samples, 20, by))
    blocks = models.block_pairs(df.select("sample", "latitude", "longitude"), by=("latitude", "longitude"))
    assert blocks.count() == 5 * 6 // 2  # not one for each order of two blocks
    plain = distances.pc_distances(df, ["pc1", "pc2"])
    assert plain.count() == 90 * 89 // 2
    want = {tuple(r[:2]): r[2] for r in plain.select("sample_1", "sample_2", F.round("geo_km", 3)).collect()}
    got = {tuple(r[:2]): r[2] for r in distances.geodesic_pairs(df, 3).collect()}
    assert got == want and got[7, 11] is None
    want = distances.two_predictors(plain, ["pc1_dist", "pc2_dist"], "geo_km", "diff_library").orderBy("response", "predictor").collect()
    got = distances.pc_distance_predictors(df, ["pc1", "pc2"]).orderBy("pc", "predictor").collect()
    assert [(r["response"][:3], r["predictor"], r["n"]) for r in want] == [tuple(r[:3]) for r in got]
    np.testing.assert_allclose([r[3:] for r in got], [r[3:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("held", [40, 1 << 18])
def test_geodesic_pairs_are_made_outside_of_python(spark, monkeypatch, held):
    """Of equal, different and missing places, in pieces too."""
    monkeypatch.setattr(distances, "HELD", held)
    whole = models.block_pairs
    monkeypatch.setattr(models, "block_pairs", lambda samples, rows=1024, by=(): whole(samples, 25, by))
    rng = np.random.default_rng(5)
    place = [(1.0, 2.0)] * 40 + [(float(a), float(b)) for a, b in rng.uniform(-60, 60, (50, 2))] + [(None, 3.0)] * 3
    df = spark.createDataFrame([(f"s{i:02d}", *p) for i, p in enumerate(place)], "sample string, latitude double, longitude double")
    rows = distances.geodesic_pairs(df, 2)
    assert "Generate inline" in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r["sample_1"], r["sample_2"]): r["km"] for r in rows.collect()}
    i, j = np.triu_indices(len(place), 1)
    at = np.array([[np.nan if c is None else c for c in p] for p in place])
    km = stats.half_up(stats.vincenty(at[i, 0], at[i, 1], at[j, 0], at[j, 1]) / 1000, 2)
    want = {(f"s{a:02d}", f"s{b:02d}"): None if d != d else d for a, b, d in zip(i, j, km.tolist(), strict=True)}
    assert rows.count() == len(want) and got == want


def test_depth_features_read_their_lines_once(spark, tmp_path, monkeypatch):
    rows = [(s, g, i, float(i + s)) for s in range(4) for g in ("homRef", "het", "homAlt") for i in range(1, 8)]
    spark.createDataFrame(rows, "site long, genotype string, sample long, depth double").write.parquet(str(tmp_path / "split"))
    rated = spark.createDataFrame([(s, 0.2, 0.9) for s in range(4)], "site long, maf double, call_rate double")
    plans, real = [], stats.settled

    def settled(df):
        out = real(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(stats, "settled", settled)
    dealt = spark.read.parquet(str(tmp_path / "split")).repartition(3, "site")
    got = features.depth_by_genotype(dealt.groupBy("site", "genotype", "sample").agg(F.sum("depth").alias("depth")), rated)
    assert got.count() == 4
    assert len(plans) == 1 and "ReusedExchange" in plans[0] and "FileScan" not in got._jdf.queryExecution().executedPlan().toString()


def test_quantiles_join_rows_by_their_keys(spark, tmp_path, monkeypatch):
    rows = [(k, n, float(i % 50)) for k in ("a", None) for n in (1.5, float("nan"), None) for i in range(200)]
    spark.createDataFrame(rows, "k string, n double, v double").write.parquet(str(tmp_path / "rows"))
    plans, real = [], ranks.settled

    def settled(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    monkeypatch.setattr(ranks, "settled", settled)
    got = ranks.exact_quantiles(spark.read.parquet(str(tmp_path / "rows")), ["k", "n"], "v", [0.5], 10, 8).collect()
    assert len(got) == 6 and all(r["q"] == [24.5] for r in got)
    below = plans[0].split("Aggregate")[1:]  # the text of the keys is made of counted groups, not of rows
    assert "Relation" in below[-1] and "to_json" not in below[-1].split("Project", 1)[-1]
    assert all("to_json" not in p for p in plans[1:])


@pytest.mark.parametrize("held, cuts", [(10_000, 4096), (3, 4)])
def test_weighted_quantiles_equal_those_of_repeated_values(spark, held, cuts):
    values = [(k, v, n) for k in ("a", "b") for v, n in ((-3.5, 2), (0.0, 7), (0.1, 1), (0.11, 5), (2.0, 3), (1e6, 1))]
    rows = spark.createDataFrame(values, "k string, v double, n long").where("k = 'a' or v > 0").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r["k"]: (r["n"], r["q"]) for r in ranks.exact_quantiles(rows, ["k"], "v", probs, held, cuts, weight="n").collect()}
    for k in ("a", "b"):
        plain = [v for g, v, n in values for _ in range(n) if g == k and (k == "a" or v > 0)]
        assert got[k][0] == len(plain) and np.allclose(got[k][1], np.quantile(plain, probs))


def test_cube_ranks_distinct_values(spark, monkeypatch):
    seen, plain = [], ranks.exact_quantiles
    monkeypatch.setattr(ranks, "exact_quantiles", lambda df, *a, **k: seen.append(df.count()) or plain(df, *a, **k))
    rows = spark.range(900).selectExpr("id % 2 k", "id site", "if(id % 9 = 8, null, id % 3 / 10.0D) v")
    out = {r["k"]: r for r in sweep.stat_cube(rows, ["k"], ["v"]).collect()}
    assert seen == [6]  # all 900 rows before
    for k in (0, 1):
        own = [i % 3 / 10 for i in range(900) if i % 2 == k and i % 9 != 8]
        assert np.allclose([out[k]["q25"], out[k]["median"], out[k]["q75"]], np.quantile(own, [0.25, 0.5, 0.75])) and out[k]["n_sites"] == len(own)
