"""Text matrices through the command line, the other readers and sinks, and the stream."""

import gzip
import os

import pytest
from helixframe import cli
from helixframe.sources import matrices, readers, sinks
from helixframe.streaming import depth
from pyspark.sql import functions as F

N = 700


def put(path, text):
    with (gzip.open if str(path).endswith(".gz") else open)(path, "wt") as f:
        f.write(text)
    return str(path)


def got(folder):
    """The parts of a written folder, put together in order of name."""
    out = ""
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            with gzip.open(os.path.join(folder, name), "rt") as f:
                out += f.read()
    return [x.split("\t") for x in out.split("\n")[:-1]]


def parts(folder):
    return sum(x.startswith("part-") for x in os.listdir(folder))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("text")
    names = ["b 1", "a", "c"]
    depth_rows = [[str((i * 7 + k) % 5) for k in range(3)] for i in range(N)]
    gl_rows = [[f"s_{i}", "0", "1", *[f"{v:.3f}" for k in range(3) for v in ((0.1, 0.2, 0.7), (0.8, 0.1, 0.1), (0.4, 0.4, 0.2), (0.1, 0.7, 0.2))[(i + k) % 4]]] for i in range(N)]
    put(d / "names.txt", " b 1\n\na \nc\n")
    put(d / "counts.gz", "ind0\tind1\tind2\t\n" + "".join("\t".join(r) + "\t\n" for r in depth_rows))
    put(d / "pos.gz", "chr\tpos\ttotDepth\n" + "".join(f"s\t{i}\t9\n" for i in range(N)))
    put(d / "gl.gz", "marker\tallele1\tallele2\t" + "\t".join(f"Ind{k}" for k in range(3) for _ in range(3)) + "\n" + "".join("\t".join(r) + "\n" for r in gl_rows))
    return d, names, depth_rows, gl_rows


def test_command_line_round_trip(spark, files):
    d, names, depth_rows, gl_rows = files
    cli.main(["reheader", str(d / "counts.gz"), str(d / "names.txt"), str(d / "named"), "--pos", str(d / "pos.gz")], spark)
    cli.main(["reheader", str(d / "gl.gz"), str(d / "names.txt"), str(d / "gl_named")], spark)
    counts = [["snpcode", *names], *[[f"s_{i}", *r] for i, r in enumerate(depth_rows)]]
    assert got(d / "named") == counts and parts(d / "named") > 1
    assert got(d / "gl_named") == [["marker", "allele1", "allele2", *[n for n in names for _ in range(3)]], *gl_rows]

    put(d / "sites.txt", "".join(f"s_{i}\n" for i in range(0, N, 3)) + "s_0\nnowhere\n")
    put(d / "few.txt", "c\nb 1\nnobody\n")
    cli.main(["subset", str(d / "named"), str(d / "cut"), "--snps", str(d / "sites.txt"), "--samples", str(d / "few.txt")], spark)
    assert got(d / "cut") == [[r[0], r[1], r[3]] for r in [counts[0], *counts[1::3]]]
    cli.main(["subset", str(d / "gl_named"), str(d / "gl_cut"), "--samples", str(d / "few.txt")], spark)
    assert got(d / "gl_cut")[5] == gl_rows[4][:6] + gl_rows[4][9:] and got(d / "gl_cut")[0][3:] == ["b 1"] * 3 + ["c"] * 3
    cli.main(["subset", str(d / "named"), str(d / "same")], spark)
    assert got(d / "same") == counts

    put(d / "stats.tsv", "snpcode\tMAF\n" + "".join(f"s_{i}\t{'NA' if i == 4 else 0.05 if i % 2 else 0.06}\n" for i in range(N)))
    cli.main(["split-genotype", str(d / "gl_named"), str(d / "named"), str(d / "out"), "--site-stats", str(d / "stats.tsv")], spark)
    call = lambda i, k: ("homAlt", "homRef", None, "het")[(i + k) % 4]
    for name in matrices.CLASSES:
        want = [["snpcode", "genotype", *names], *[[f"s_{i}", name, *[v if call(i, k) == name else "0" for k, v in enumerate(r)]] for i, r in enumerate(depth_rows)]]
        assert got(d / f"out.{name}.tsv.gz") == want
        assert got(d / f"out.{name}.maf05.tsv.gz") == [r for i, r in enumerate(want) if not i or (i - 1) % 2 == 0 and i - 1 != 4]


def test_command_line_refuses_what_does_not_fit(spark, files):
    d, names, depth_rows, _ = files
    put(d / "two.txt", "x\ny\n")
    with pytest.raises(ValueError, match="columns"):
        cli.main(["reheader", str(d / "gl.gz"), str(d / "two.txt"), str(d / "no1")], spark)
    with pytest.raises(ValueError, match="snpcode"):
        cli.main(["subset", str(d / "counts.gz"), str(d / "no2")], spark)
    short = put(d / "short.tsv", "snpcode\tb 1\ta\tc\ns_0\t1\t2\t3\ns_9\t1\t2\t3\n")
    wrong = put(d / "wrong.tsv", "snpcode\ta\tb 1\tc\ns_0\t1\t2\t3\n")
    gl = put(d / "gl2.tsv", "marker\tallele1\tallele2\t" + "\t".join(n for n in names for _ in range(3)) + "\n" + "".join(f"s_{i}\t0\t1" + "\t0.2\t0.5\t0.3" * 3 + "\n" for i in range(2)))
    with pytest.raises(ValueError, match="names"):
        cli.main(["split-genotype", gl, wrong, str(d / "no3")], spark)
    with pytest.raises(Exception, match="sites differ"):
        cli.main(["split-genotype", gl, short, str(d / "no4")], spark)
    # rows are filled and cut to the names
    odd = put(d / "odd.tsv", "i0\ti1\n1\t\t2\n5\n6\t7\t8\n")
    pos = put(d / "odd.pos", "chr\tpos\nz\t1\nz\t2\nz\t3\nz\t4\n")
    cli.main(["reheader", odd, str(d / "two.txt"), str(d / "filled"), "--pos", pos], spark)
    assert got(d / "filled") == [["snpcode", "x", "y"], ["z_1", "1", "2"], ["z_2", "5", ""], ["z_3", "6", "7"]]


def test_site_readers(spark, tmp_path):
    pos = put(tmp_path / "p.tsv", "Chromosome\tposition\ttotDepth\nsc_1\t5\t9\nsc_1\t7\tNA\n")
    assert [tuple(r) for r in readers.positions(spark, pos).select("ord", "snpcode", "pos", "tot_depth").orderBy("ord").collect()] == [(0, "sc_1_5", 5, 9.0), (1, "sc_1_7", 7, None)]
    with pytest.raises(ValueError):
        readers.positions(spark, put(tmp_path / "bad.tsv", "x\ty\n1\t2\n"))
    h = readers.hwe(spark, put(tmp_path / "h.tsv", "Chromo\tPosition\thweFreq\tF\nc\t1\t0.25\t0.5\nc\t2\tNA\t0\n")).orderBy("snpcode").collect()
    assert tuple(h[0]) == ("c_1", 0.25, 0.5, 0.375, 0.1875) and h[1]["hexp"] is None
    m = readers.mafs(spark, put(tmp_path / "m.gz", "chromo\tposition\tmajor\tminor\tknownEM\tnInd\nc\t1\tA\tT\t0.2\t33\n")).first()
    assert tuple(m) == ("c_1", "A", "T", 0.2, 33)
    gl = readers.likelihoods(spark, put(tmp_path / "g.txt", "marker allele1 allele2 a a a b b b\nc_1 0 1 .1 .2 .7 1 0 0\n"), sep=" ").orderBy("ord").collect()
    assert [(r["site"], r["ord"], list(r["gl"])) for r in gl] == [("c_1", 0, [0.1, 0.2, 0.7]), ("c_1", 1, [1.0, 0.0, 0.0])]
    with pytest.raises(ValueError):
        readers.likelihoods(spark, put(tmp_path / "g2.txt", "m\ta\tb\tx\n1\t2\t3\t4\n"))


def test_sample_and_matrix_readers(spark, tmp_path):
    cols = "bam_code,pop_code,library,domain,region,latitude,longitude"
    r = readers.metadata(spark, put(tmp_path / "meta.csv", f"{cols},more\nb1,p,l,d,r,60.5,NA,z\n")).first()
    assert r["bam_code"] == "b1" and r["latitude"] == 60.5 and r["longitude"] is None
    os.mkdir(tmp_path / "depth")
    put(tmp_path / "depth" / "sampleA.depth.gz", "sc\t1\t4\nsc\t2\t0\n")
    d = readers.per_sample_depth(spark, str(tmp_path / "depth" / "sampleA.depth.gz")).orderBy("pos").collect()
    assert [(r["scaffold"], r["pos"], r["depth"]) for r in d] == [("sc", 1, 4), ("sc", 2, 0)] and d[0]["sample"].startswith("sampleA")
    c = readers.square_matrix(spark, put(tmp_path / "c.cov", "1.5 2\n2 4e-1\n")).orderBy("i", "j").collect()
    assert [tuple(r) for r in c] == [(0, 0, 1.5), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 0.4)]
    s = readers.selection_outputs(spark, put(tmp_path / "sites", "1\n0\n1\n"), put(tmp_path / "scores", "0.5 1\n2 3\n")).orderBy("site").collect()
    assert [(r["site"], list(r["scores"])) for r in s] == [(0, [0.5, 1.0]), (2, [2.0, 3.0])]
    with pytest.raises(ValueError):
        readers.selection_outputs(spark, str(tmp_path / "sites"), put(tmp_path / "scores1", "0.5 1\n"))
    e = readers.marginal_means(spark, put(tmp_path / "e.csv", "statistic,parameter,emmean,SE\npi,baq,0.5,0.1\nf,C,NA,1\n")).collect()
    assert [tuple(r) for r in e] == [("pi", "baq", 0.5, 0.1)]
    assert tuple(readers.bed(spark, put(tmp_path / "a.bed", "c\t0\t5\n")).first()) == ("c", 0, 5)
    both = readers.concat(spark, [put(tmp_path / "k1.tsv", "a\tb\n1\t2\n"), put(tmp_path / "k2.tsv", "a\tb\n3\t4\n")])
    assert sorted(tuple(r) for r in both.collect()) == [("1", "2"), ("3", "4")]
    assert readers.unique_file(spark, str(tmp_path / "*.bed")).endswith("a.bed")
    for pattern in ("k?.tsv", "none*"):
        with pytest.raises(FileNotFoundError):
            readers.unique_file(spark, str(tmp_path / pattern))


def test_spectra_take_parameters_from_paths(spark, tmp_path):
    folder = tmp_path / "north_baq1_C50_q20_mq30" / "popA" / "north_baq1_C50_q20_mq30_ct4"
    os.makedirs(folder)
    put(folder / "bam7.est.ml", "90.5 9.5\n")
    r = readers.spectra(spark, str(tmp_path)).first()
    assert (r["baq"], r["C"], r["q"], r["mq"], r["pop_code"]) == (1, 50, 20, 30, "popA") and (r["ref_sites"], r["alt_sites"]) == (90.5, 9.5)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.4, 0.5), ("b", 1.0, 0.02), ("c", 0.35, None)], "site string, threshold double, maf double")
    sinks.tsv_gz(df.coalesce(1), str(tmp_path / "t"))
    assert got(tmp_path / "t") == [["site", "threshold", "maf"], ["a", "0.4", "0.5"], ["b", "1.0", "0.02"], ["c", "0.35", "NA"]]
    sinks.plain(df.select("site").coalesce(1), str(tmp_path / "p"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "p")).collect()) == ["a", "b", "c"]
    sinks.append_csv(df.limit(1), str(tmp_path / "csv"))
    sinks.append_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4
    sinks.by_threshold(df.select("site", "threshold"), str(tmp_path / "ct"))
    assert sorted(x for x in os.listdir(tmp_path / "ct") if x.startswith("ct=")) == ["ct=10", "ct=3.5", "ct=4"]
    sinks.with_common(df, str(tmp_path / "both"))
    assert spark.read.parquet(str(tmp_path / "both/all")).count() == 3 and [r["site"] for r in spark.read.parquet(str(tmp_path / "both/common")).collect()] == ["a"]
    cells = spark.createDataFrame([("x", "s2", 3), ("x", "s1", 1), ("y", "s2", 4)], "site string, sample string, depth long")
    sinks.wide(cells, ["s2", "s1"], str(tmp_path / "wide"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "wide"), sep="\t", header=True).collect())) == [("x", "3", "1"), ("y", "4", "0")]


def test_model_results_appear_together(spark, tmp_path):
    schema = "statistic string, formula string, var_components array<struct<grp: string, vcov: double>>, marginal_means array<struct<baq: int, emmean: double>>"
    rows = spark.createDataFrame([("pi", "y ~ baq", [("pop", 0.5), ("Residual", 1.0)], [(0, 2.0)]), ("f", "y ~ 1", None, [])], schema)
    written = sinks.model_results(rows, str(tmp_path / "m"), "run")
    assert [os.path.basename(p) for p in written] == ["run_all_formulas.csv", "run_var_components.csv", "run_marginal_means.csv"]
    read = lambda n: sorted(map(tuple, spark.read.csv(str(tmp_path / f"m/run_{n}.csv"), header=True).collect()))
    assert read("all_formulas") == [("f", "y ~ 1"), ("pi", "y ~ baq")]
    assert read("var_components") == [("Residual", "1.0", "pi", "y ~ baq"), ("pop", "0.5", "pi", "y ~ baq")]
    assert read("marginal_means") == [("0", "2.0", "pi", "y ~ baq")]
    with pytest.raises(FileExistsError):
        sinks.model_results(rows, str(tmp_path / "m"), "run")
    bad = rows.withColumn("marginal_means", F.array(F.struct(F.array(F.lit(1)).alias("no_text"))))
    with pytest.raises(Exception, match="array|ARRAY"):
        sinks.model_results(bad, str(tmp_path / "m"), "other")
    assert not [x for x in os.listdir(tmp_path / "m") if "other" in x]


def test_depth_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "a", 4), ("2024-01-01 02:00:00", "a", 0), ("2024-01-01 03:00:00", "b", 2), ("2024-01-02 03:00:00", "a", 6)], "ts string, sample string, depth int")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, sample string, depth int").parquet(str(tmp_path / "in"))
    q = depth.windowed_depth(stream).writeStream.outputMode("complete").format("memory").queryName("depths").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["day"], r["sample"]): (r["n"], r["call_rate"], r["mean_depth"]) for r in spark.sql("select day(window.start) as day, * from depths").collect()}
    assert got == {(1, "a"): (2, 0.5, 4.0), (1, "b"): (1, 1.0, 2.0), (2, "a"): (1, 1.0, 6.0)}
