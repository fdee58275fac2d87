import gzip
import math
import os

import numpy as np
import pytest
from helixframe.functions import dips, keys, stats
from helixframe.operators import intervals, models, reads, rules, site
from helixframe.sources import readers
from pyspark.sql import functions as F


def test_code_round_trip(spark):
    df = spark.createDataFrame([("sc_1_x", 5), ("a", 7)], "s string, p int").withColumn("c", keys.site_code("s", "p"))
    a, b = keys.split_code(F.col("c"))
    assert {(r.a, r.b) for r in df.select(a.alias("a"), b.alias("b")).collect()} == {("sc_1_x", "5"), ("a", "7")}


def test_known_values():
    assert stats.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.vincenty(0, 0, 0, 1) == pytest.approx(111319.49, abs=0.1)
    assert dips.dip(np.arange(10.0)) == pytest.approx(0.05)
    assert dips.dip(np.r_[np.zeros(50) + np.arange(50) / 1e3, 9 + np.arange(50) / 1e3]) > 0.2
    assert stats.pretty(0, 97, 5).tolist() == [0, 20, 40, 60, 80, 100]


def test_scan_tail(spark):
    rows = spark.createDataFrame([(3.841,), (5.991,), (7.815,)], "x double")
    got = rows.select(*[stats.chi2_upper(k)("x").alias(f"p{k}") for k in (1, 2, 3)]).collect()
    assert [got[i][i] for i in range(3)] == pytest.approx([0.05] * 3, abs=1e-4)


def test_random_intercept():
    rng = np.random.default_rng(0)
    g = np.repeat(np.arange(40), 10)
    y = rng.normal(size=40)[g] * 2 + rng.normal(size=400)
    v = models.random_intercept_variance(np.bincount(g), np.bincount(g, y), np.bincount(g, y * y))
    assert 2 < v["group"] < 7 and 0.8 < v["residual"] < 1.2
    assert math.isnan(models.random_intercept_variance([1], [1.0], [1.0])["group"])


def test_alignment_walk():
    got = reads.walk_batch([b"ACGTN"], [np.array([40, 12, 30, 13, 40])], [np.array([4, 0, 5])], [np.array([1, 4, 2])], [b"CTAA"])
    assert got.tolist() == [[2, 2, 30 + 13, 40 + 26]]


def test_islands_cover_exactly(spark):
    pos = spark.createDataFrame([("a", p) for p in (1, 2, 3, 7, 9, 10)], "scaffold string, pos long")
    isl = intervals.islands(pos)
    assert sorted((r.start, r.end) for r in isl.collect()) == [(0, 3), (6, 7), (8, 10)]
    assert intervals.island_sites(isl).exceptAll(pos).count() == 0


def test_reheader_checks_names(spark):
    cells = spark.createDataFrame([(1, 0, 5), (1, 1, 6)], "site long, ord long, depth long")
    names = spark.createDataFrame([(0, "x")], "ord long, name string")
    with pytest.raises(ValueError):
        site.reheader(cells, names)
    assert site.reheader(cells, names, permissive=True).count() == 1


def test_depth_matrix_and_names(spark, tmp_path):
    with gzip.open(tmp_path / "c.tsv.gz", "wt") as f:
        f.write("ind0\tind1\t\n0\t4\t\n3\t0\t\n")
    rows = {(r.ord, r.sample, r.depth) for r in readers.depth_matrix(spark, str(tmp_path / "c.tsv.gz")).collect()}
    assert rows == {(0, "ind0", 0.0), (0, "ind1", 4.0), (1, "ind0", 3.0), (1, "ind1", 0.0)}
    (tmp_path / "n.txt").write_text("a \n\n b\n")
    assert [(r.ord, r.name) for r in readers.names(spark, str(tmp_path / "n.txt")).orderBy("ord").collect()] == [(0, "a"), (1, "b")]


def test_diagnostics_reject_short_lines(spark, tmp_path):
    good = "c\t1\tn\t1:2:3\t4:5\t6:7\t8:9\t10:11\n"
    (tmp_path / "d.tsv").write_text(good)
    row = readers.diagnostics(spark, str(tmp_path / "d.tsv")).first()
    assert row[0] == "c_1" and list(row)[1:] == [float(i) for i in range(1, 12)]
    (tmp_path / "e.tsv").write_text("c\t1\tn\t1:2:3\n")
    with pytest.raises(Exception, match="eight"):
        readers.diagnostics(spark, str(tmp_path / "e.tsv")).collect()


def test_bh_is_monotone_and_capped(spark):
    p = [0.01, 0.04, 0.04, 0.9, None]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    q = {r.i: r.qval for r in stats.bh_adjust(df, "p", "i").collect()}
    assert q[4] is None and q[0] == pytest.approx(0.04) and q[1] == q[2] == pytest.approx(0.04 * 4 / 3) and q[3] == pytest.approx(0.9)


def test_harvest_counts_leaves_of_deep_paths(spark):
    first = [(k, f"f{k}", ">=", k + 0.5) for k in range(4)]
    deep = [(4, "f4", "<", 1.0), (5, "f5", ">=", 2.0)]
    other = [(4, "f4", ">=", 1.0)]
    path = {0: first + deep, 1: first + other, 2: [(0, "f0", "<", 0.5)]}
    steps = spark.createDataFrame([(0, leaf, *x) for leaf, p in path.items() for x in p], "tree int, leaf_id int, depth int, feature string, direction string, thresh_bin double")
    text = rules.path_rules(steps)
    assert {r.leaf_id: r.rule_len for r in text.collect()} == {0: 4, 1: 4, 2: 1}
    leaves = spark.createDataFrame([(r, 0, r % 3, "extreme" if r % 3 < 2 else "background") for r in range(90)], "row int, tree int, leaf_id int, cls string")
    got = {r.rule_len: (r.n_extreme, r.n_bg) for r in rules.harvest(leaves, text).collect()}
    assert got == {4: (60, 0), 1: (0, 30)}
    whole = rules.rule_strings(rules.tighten(steps))
    assert sorted((r.rule_len, r.support) for r in rules.harvest(leaves, whole, pooled=False).collect()) == [(1, 30), (5, 30), (6, 30)]


def test_sample_pairs_over_many_blocks(spark):
    few = spark.createDataFrame([*((i, f"p{i % 3}") for i in range(50)), (None, "p0")], "sample long, pop string")
    for rows in (7, 50, 1024):
        got = models.sample_pairs(few, rows)
        assert got.columns == ["sample_1", "pop_1", "sample_2", "pop_2"]
        found = sorted(tuple(r) for r in got.collect())
        assert found == [(i, f"p{i % 3}", j, f"p{j % 3}") for i in range(50) for j in range(i + 1, 50)]
    many = models.sample_pairs(spark.range(5000).toDF("sample"))
    assert tuple(many.agg(F.count("*"), F.countDistinct("sample_1"), F.sum(F.col("sample_2") - F.col("sample_1"))).first()) == (5000 * 4999 // 2, 4999, 5000 * (5000**2 - 1) // 6)


def test_repeats_of_paired_samples_grow_with_their_number(spark):
    """At most 32 blocks, so what is shuffled doesn't grow with the square; ranges and repeated keys as well."""
    assert [models.block_rows(n) for n in (10, 36_000, 360_000, 10**8)] == [1024, 1125, 11_250, 1 << 16]
    files = lambda: {f: os.path.getsize(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle" in f and os.path.exists(f)}
    before = files()
    got = models.sample_pairs(spark.range(6000).selectExpr("id * 7919 % 6007 AS sample", "concat('p', id) AS name"), 40)
    assert got.count() == 6000 * 5999 // 2
    assert sum(n for f, n in files().items() if f not in before) < 2.5e6
    twice = spark.createDataFrame([(i // 2, i) for i in range(60)], "sample long, nth int")
    found = sorted((r["nth_1"], r["nth_2"]) for r in models.sample_pairs(twice, 4).collect())
    assert found == [(i, j) for i in range(60) for j in range(60) if i // 2 < j // 2]


def test_ordinals_follow_paths_and_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"a{i}\n" for i in range(3)))
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(200)))
    (tmp_path / "c.txt").write_text("c0\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # b.txt is read in several parts
    try:
        rows = readers.with_ordinal(spark.read.text(str(tmp_path))).collect()
        flagged = readers.with_ordinal(readers.with_ordinal(spark.read.text(str(tmp_path))).where("value like '%0'").withColumnRenamed("ord", "all")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    want = [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(200)] + ["c0"]
    assert [r.value for r in sorted(rows, key=lambda r: r.ord)] == want and sorted(r.ord for r in rows) == list(range(204))
    assert [(r.value, r["all"]) for r in sorted(flagged, key=lambda r: r.ord)] == [(v, i) for i, v in enumerate(want) if v.endswith("0")]


def test_hypergeometric_tails_equal_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(300):
        m, n = (int(x) for x in rng.integers(0, 40, 2))
        size = int(rng.integers(0, m + n + 1))
        k = int(rng.integers(0, 42))
        want = sum(math.comb(m, x) * math.comb(n, size - x) for x in range(max(k, 1), min(m, size) + 1) if size - x <= n) / math.comb(m + n, size)
        assert stats.hypergeom_tail(k, m, n, size) == pytest.approx(want, rel=1e-9, abs=1e-300)
    # mean 49,950, deviation 218: the normal tail beyond 0.227 deviations is 0.410
    assert stats.hypergeom_tail(50_000, 10**6, 10**9, 5 * 10**7) == pytest.approx(0.410, abs=0.003)
    assert stats.hypergeom_tail(1000, 10**5, 10**5, 2000) == pytest.approx(0.5, abs=0.02)


def test_tasks_that_gather_cells_grow_with_the_lines(spark, monkeypatch):
    from helixframe.operators import genotype
    from helixframe.plans import tables as T

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(T, "MOST_LINES", 500)
    lines = T.read(spark, folder, "lineitem").count()
    assert T.by_cell(spark, folder).rdd.getNumPartitions() >= lines // 500 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = genotype.split_cells(T.cells(spark, folder))
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    joined = genotype.split_by_genotype(T.counts(spark, folder), T.gl(spark, folder))
    assert split.exceptAll(joined).count() == 0 and split.count() == joined.count()


def test_a_reads_cost_is_computed_once_for_all_caps(spark, monkeypatch):
    walk, cost, asked = ("sub_q", "mismatches", "matched", "clip_q"), reads.alignment_cost, []
    df = spark.createDataFrame([(1, 60, 30.0, 2, 100, 8.0), (2, 60, 0.0, None, 100, 0.0)], "name long, orig_mq int, sub_q double, mismatches int, matched int, clip_q double")
    plain = {c: df.select("name", reads.mapq_cap(*map(F.col, walk), c).alias("m")).collect() for c in (50, 75)}
    monkeypatch.setattr(reads, "alignment_cost", lambda *a: asked.append(a) or cost(*a))
    got = {(r["name"], r["c"]): r["new_mq"] for r in reads.recap(df, (0, 50, 75)).collect()}
    assert len(asked) == 1
    assert got == {(r["name"], c): r["m"] for c, some in plain.items() for r in some} | {(1, 0): 60, (2, 0): 60}
