"""Intervals by ranges and hierarchical bins, reference building, and close pairs, against plain loops."""

import numpy as np
import pytest
from helixframe.functions import stats
from helixframe.operators import intervals, populations
from pyspark.sql import functions as F


def plain_merge(rows, pad=0):
    out = []
    for c, a, b in sorted((c, a - pad, b + pad) for c, a, b in rows):
        if out and out[-1][0] == c and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([c, a, b])
    return sorted(map(tuple, out))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [("long", int(a), int(a + n)) for a, n in zip(rng.integers(0, 60_000, 900), rng.integers(1, 60, 900), strict=True)]
    out += [("long", 10, 30_000), ("long", 50_000, 50_001), ("b", 5, 6), ("b", 6, 9), ("b", 11, 12), ("c", 0, 10**9)]
    return list(dict.fromkeys(out))


def test_one_long_chromosome_is_cut_into_ranges(spark, rows):
    df = spark.createDataFrame(rows, "chrom string, start long, end long")
    parts = intervals.by_ranges(df, "chrom", "start", "end")
    assert parts.where("chrom = 'long'").select("_part").distinct().count() > 2
    for pad in (0, 7):
        assert sorted(map(tuple, intervals.merge(df, pad).collect())) == plain_merge(rows, pad)
    lengths = spark.createDataFrame([("long", 61_000), ("b", 20), ("none", 50), ("c", 5)], "chrom string, length long")
    got = sorted(map(tuple, intervals.subtract(lengths, df, 2, 3).select("chrom", "start", "end").collect()))
    want = []
    for c, n in (("long", 61_000), ("b", 20), ("none", 50), ("c", 5)):
        at = 0
        for _, a, b in [m for m in plain_merge(rows, 2) if m[0] == c] + [(c, n, n)]:
            if min(a, n) - at >= 3:
                want.append((c, at, min(a, n)))
            at = max(at, b)
    assert got == sorted(want)


def test_equal_intervals_in_any_order_are_one_island(spark):
    rows = [(c, 100 * k, 100 * k + 50) for c in range(40) for k in range(200) for _ in range(8)]
    df = spark.createDataFrame(rows, "chrom long, start long, end long").repartition(16, F.rand(1))
    got = sorted(map(tuple, intervals.merge(df).select("chrom", "start", "end").collect()))
    assert got == sorted(set(rows))


def test_references_given_twice_count_once_in_subtraction(spark):
    df = spark.createDataFrame([("a", 10, 20), ("a", 40, 50), ("a", 40, 50), ("b", 0, 5)], "chrom string, start long, end long")
    lengths = spark.createDataFrame([("a", 90), ("a", 90), ("a", 80), ("b", 30), ("b", 30), ("none", 7), ("none", 7), (None, 8), (None, 8)], "chrom string, length long")
    got = [tuple(r) for r in intervals.subtract(lengths, df, 1, 3).select("chrom", "start", "end").collect()]
    assert sorted(got, key=str) == sorted([("a", 0, 9), ("a", 21, 39), ("a", 51, 90), ("b", 6, 30), ("none", 0, 7), (None, 0, 8)], key=str)


def test_islands_across_ranges(spark):
    rng = np.random.default_rng(4)
    pos = sorted({int(p) for p in rng.integers(1, 4000, 3000)})
    df = spark.createDataFrame([("a", p) for p in pos + pos[:50]] + [("b", 7)], "scaffold string, pos long")
    got = sorted((r["scaffold"], r["start"], r["end"]) for r in intervals.islands(df).collect())
    want, begin = [], pos[0]
    for p, q in zip(pos, [*pos[1:], 10**9], strict=True):
        if q != p + 1:
            want.append(("a", begin - 1, p))
            begin = q
    assert got == [*want, ("b", 6, 7)]
    beds, scaffolds = intervals.experiment_reference(df)
    assert beds.where("first_site = start + 1").count() == len(got) and {r[0] for r in scaffolds.collect()} == {"a", "b"}


def test_overlap_of_any_lengths(spark):
    rng = np.random.default_rng(5)
    make = lambda n, k: [("x", int(a), int(a + size)) for a, size in zip(rng.integers(0, 10**7, n), 10 ** rng.uniform(0, k, n), strict=True)]
    a, b = make(300, 6.5), make(200, 4) + [("x", 5 * 10**6, 5 * 10**6 + 2), ("y", 0, 9), ("x", 7, 7)]
    left, right = (spark.createDataFrame(r, "chrom string, start long, end long") for r in ([*a, a[0], ("x", 3, 3)], b))
    got = sorted(map(tuple, intervals.overlap(left, right).collect()))
    assert got == sorted(r for r in [*a, a[0]] if r[2] > r[1] and any(r[0] == s[0] and r[1] < s[2] and r[2] > s[1] and s[2] > s[1] for s in b))
    huge = spark.createDataFrame([("x", 0, 10**9)], "chrom string, start long, end long")
    assert intervals.overlap(huge, right).count() == 1


def test_reference_targets(spark):
    bed = [("s1", 0, 50), ("s1", 60, 90), ("s2", 0, 70), ("bad", 0, 900), ("my_chloroplast", 0, 800), ("s3", 5, 65), ("s4", 0, 10), ("s5", 0, 9)]
    df = spark.createDataFrame(bed, "chrom string, start long, end long")
    scaffolds, pieces = intervals.reference_targets(df, spark.createDataFrame([("bad",), ("bad",)], "chrom string"), 205, 3)
    assert sorted((r["chunk"], r["scaffold"], r["length"]) for r in scaffolds.collect()) == [(1, "s1", 80), (2, "s2", 70), (3, "s3", 60)]
    assert sorted((r["chunk"], r["scaffold"], r["start"], r["end"], r["first_site"]) for r in pieces.collect()) == [(1, "s1", 0, 50, 1), (1, "s1", 60, 90, 61), (2, "s2", 0, 70, 1), (3, "s3", 5, 65, 6)]


@pytest.mark.parametrize("km", [5.0, 250.0, 4000.0])
def test_grid_join_finds_all_pairs_within(spark, km):
    rng = np.random.default_rng(int(km))
    n = 160
    near = rng.uniform(-1, 1, (n, 2)) * (0.1 if km < 10 else 5)
    place = np.c_[np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)]
    place[:60] = near[:60] + [89.0, 0]  # at a pole
    place[60:120] = near[60:120] + [10.0, 180.0]  # across the date line
    place[:, 0] = np.clip(place[:, 0], -90, 90)
    place[:, 1] = (place[:, 1] + 180) % 360 - 180
    df = spark.createDataFrame([(f"p{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(place)] + [("null", None, 1.0)], "pop_code string, latitude double, longitude double")
    got = {(r["pop1"], r["pop2"]): r["distance_km"] for r in populations.pairs_within(df, km).collect()}
    i, j = np.triu_indices(n, 1)
    d = stats.vincenty(place[i, 0], place[i, 1], place[j, 0], place[j, 1]) / 1000
    want = {(f"p{a:03d}", f"p{b:03d}"): v for a, b, v in zip(i, j, d, strict=True) if v <= km}
    assert set(got) == set(want) and len(want) > 10 and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_population_steps(spark):
    depths = spark.createDataFrame([(i, 100 * (i + 1), 10 * (i + 1)) for i in range(24)] + [(99, None, 5)], "sample long, n_reads long, n_scaffolds long")
    pops = ["A"] * 8 + ["B"] * 8 + ["C"] * 8
    libs = ["l1", "l2"] * 4 + ["l2"] * 8 + ["l1"] * 7 + ["l2"]
    spots = {"A": (0.0, 0.0, "x"), "B": (0.0, 0.5, "x"), "C": (0.0, 2.5, "siberia")}
    meta = spark.createDataFrame([(i, p, spots[p][2], l, spots[p][0], spots[p][1]) for i, (p, l) in enumerate(zip(pops, libs, strict=True))], "sample long, pop_code string, domain string, library string, latitude double, longitude double")
    kept = populations.enough_reads(depths, meta, 0.1, 0.1)
    logs = np.log(100 * (np.arange(24) + 1))
    assert kept.count() == int((logs > np.quantile(logs, 0.1)).sum()) and kept.where("sample = 99").count() == 0
    assert populations.enough_reads(depths.limit(0), meta).count() == 0
    out = populations.select_populations(depths, meta, read_quantile=0.0, scaffold_quantile=0.0)
    got = {(r["pop_code"], r["paired_pop"]): r for r in out.collect()}
    # A is mixed (l2 has 4 of 7 left), B and C have one main library; B to C is 223 km and one side is Siberian
    assert set(got) == {("A", None), ("B", "C"), ("C", "B")}
    assert got["A", None]["is_mixed"] and not got["A", None]["is_paired"] and got["A", None]["domain"] == "x" and got["A", None]["total_samples"] == 7
    assert got["B", "C"]["is_paired"] and got["B", "C"]["domain"] is None and got["B", "C"]["distance_km"] == pytest.approx(222.64, abs=0.1)
    far = spark.createDataFrame([("A", "B", 300.0), ("B", "A", 90.0), ("A", "C", 251.0), ("A", "A", 0.0), ("B", "C", None)], "pop1 string, pop2 string, distance_km double")
    lookup = populations.library_makeup(meta.withColumn("library", F.col("pop_code")), mixed_only=False)
    assert [tuple(r) for r in populations.cross_library_pairs(far, lookup).collect()] == [("A", "B", 90.0)]
