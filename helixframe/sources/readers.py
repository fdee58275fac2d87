"""Text sources as keyed, long tables.  Compression follows the file's suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import keys


def _tsv(spark: SparkSession, path, header: bool = True, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=header, nullValue="NA")


def with_ordinal(df: DataFrame) -> DataFrame:
    """Adds ord, the line's number from 0: dense over files in path order, without one big window.

    ``df`` is a scan, perhaps filtered or projected, so both of its evaluations agree.  Spark deals
    out parts of files by size, and several to a task; within a part, ids follow the lines.  Parts
    are put in order of path and offset, and their sizes (one row each) give their bases.
    """
    part = {"_file": F.input_file_name(), "_at": F.input_file_block_start(), "_id": F.monotonically_increasing_id()}
    df = df.withColumns(part).withColumn("_p", F.shiftright("_id", 33))
    sizes = df.groupBy("_file", "_at", "_p").agg(F.min("_id").alias("low"), F.count("*").alias("n")).collect()
    base, rows = 0, []
    for r in sorted(sizes):
        rows.append((r["_file"], r["_at"], r["_p"], base - r["low"]))
        base += r["n"]
    bases = df.sparkSession.createDataFrame(rows, "_file string, _at long, _p long, _base long")
    return df.join(F.broadcast(bases), ["_file", "_at", "_p"]).withColumn("ord", F.col("_base") + F.col("_id")).drop("_file", "_at", "_p", "_id", "_base")  # a row for each part


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def same_length(*tables: DataFrame) -> None:
    """Positional sources must have as many rows."""
    sizes = [t.count() for t in tables]
    if len(set(sizes)) > 1:
        raise ValueError(f"row counts differ: {sizes}")


def depth_matrix(spark: SparkSession, path) -> DataFrame:
    """(ord, sample, depth) of a headed matrix with one column for each sample; blank trailing columns go."""
    m = with_ordinal(_tsv(spark, path))
    cols = [c for c in m.columns if c != "ord" and not c.startswith("_c")]
    m = m.select("ord", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in cols])
    return m.unpivot("ord", cols, "sample", "depth").where("depth is not null")


def positions(spark: SparkSession, path) -> DataFrame:
    """(ord, scaffold, pos, tot_depth, snpcode), whatever the headers' aliases."""
    p = keys.rename_site_columns(_tsv(spark, path))
    require(p, ["scaffold", "pos"], "position table")
    tot = F.col("totDepth").try_cast("double") if "totDepth" in p.columns else F.lit(None).cast("double")
    out = p.select("scaffold", F.col("pos").try_cast("long").alias("pos"), tot.alias("tot_depth"))
    return with_ordinal(out).withColumn("snpcode", keys.site_code("scaffold", "pos"))


def hwe(spark: SparkSession, path) -> DataFrame:
    """(snpcode, maf, f, hexp, hobs); the frequency and F columns are required."""
    h = require(_tsv(spark, path), ["Chromo", "Position", "hweFreq", "F"], "HWE table")
    maf, f = F.col("hweFreq").try_cast("double"), F.col("F").try_cast("double")
    e = 2 * maf * (1 - maf)
    return h.select(keys.site_code(F.col("Chromo"), F.col("Position")).alias("snpcode"), maf.alias("maf"), f.alias("f"), e.alias("hexp"), (e - f * e).alias("hobs"))


DIAGNOSTICS = ("sb1", "sb2", "sb3", "hwe_lrt", "hwe_pval", "base_q_z", "base_q_pval", "map_q_z", "map_q_pval", "edge_z", "edge_pval")


def diagnostics(spark: SparkSession, path) -> DataFrame:
    """(snpcode, eleven numbers) of packed columns; a line with under eight fields is an error."""
    parts = F.split("value", "\t")
    ok = F.when(F.size(parts) >= 8, parts).otherwise(F.raise_error(F.lit("diagnostics line has under eight fields")).cast("array<string>"))
    t = spark.read.text(path).where("not value rlike '^(#|Chromo\\\\t)'").select(ok.alias("p"))
    numbers = keys.packed_numbers(F.col("p")[3], 3)
    for i in range(4, 8):
        numbers += keys.packed_numbers(F.col("p")[i], 2)
    return t.select(F.concat_ws("_", F.col("p")[0], F.col("p")[1]).alias("snpcode"), *[n.alias(c) for n, c in zip(numbers, DIAGNOSTICS, strict=True)])


def mafs(spark: SparkSession, path) -> DataFrame:
    m = require(_tsv(spark, path), ["chromo", "position", "knownEM", "nInd"], "MAF table")
    return m.select(keys.site_code(F.col("chromo"), F.col("position")).alias("snpcode"), "major", "minor", F.col("knownEM").try_cast("double").alias("maf"), F.col("nInd").try_cast("int").alias("n_ind"))


def likelihoods(spark: SparkSession, path, sep: str = "\t") -> DataFrame:
    """(site, allele1, allele2, sample ordinal, gl) of a matrix with three meta and three columns a sample."""
    m = _tsv(spark, path, sep=sep)
    n, extra = divmod(len(m.columns) - 3, 3)
    if n < 1 or extra:
        raise ValueError("a likelihood matrix has three meta columns and three for each sample")
    m = m.toDF("site", "allele1", "allele2", *[f"g{i}" for i in range(3 * n)])
    gl = F.array(*[F.array(*[F.col(f"g{3 * i + k}").try_cast("double") for k in range(3)]) for i in range(n)])
    return m.select("site", "allele1", "allele2", F.posexplode(gl).alias("ord", "gl"))


def names(spark: SparkSession, path, as_set: bool = False) -> DataFrame:
    """(ord, name), stripped, without blank lines; or the distinct names."""
    n = spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")
    return n.distinct() if as_set else with_ordinal(n)


def metadata(spark: SparkSession, path) -> DataFrame:
    cols = ["bam_code", "pop_code", "library", "domain", "region", "latitude", "longitude"]
    return require(spark.read.csv(path, header=True, nullValue="NA"), cols, "metadata").select(*cols[:5], *[F.col(c).try_cast("double").alias(c) for c in cols[5:]])


def per_sample_depth(spark: SparkSession, path) -> DataFrame:
    """(sample, scaffold, pos, depth) of headerless files named by sample."""
    d = spark.read.csv(path, sep="\t", schema="scaffold string, pos long, depth long")
    return d.select(keys.base_name(F.input_file_name()).alias("sample"), "*")


def spectra(spark: SparkSession, path) -> DataFrame:
    """Two-field spectra whose parameters, population and sample are in the path."""
    p = F.input_file_name()
    t = spark.read.option("recursiveFileLookup", "true").text(path).select(p.alias("path"), F.split(F.trim("value"), r"\s+").alias("v"))
    folder = F.element_at(F.split("path", "/"), -4)
    k = keys.parse_param(folder)
    return t.select(*[k[c].alias(c) for c in ("domain", "baq", "C", "q", "mq")], F.element_at(F.split("path", "/"), -3).alias("pop_code"), keys.parse_param(F.element_at(F.split("path", "/"), -2))["ct"].alias("ct"), keys.base_name(F.col("path")).alias("bam_code"), F.col("v")[0].try_cast("double").alias("ref_sites"), F.col("v")[1].try_cast("double").alias("alt_sites"))


def square_matrix(spark: SparkSession, path, sep: str = " ") -> DataFrame:
    """(i, j, v) of a headerless matrix."""
    m = with_ordinal(spark.read.text(path)).select("ord", F.posexplode(F.split(F.trim("value"), sep)).alias("j", "v"))
    return m.select(F.col("ord").cast("int").alias("i"), "j", F.col("v").try_cast("double").alias("v"))


def selection_outputs(spark: SparkSession, sites, scores) -> DataFrame:
    """Scores aligned by order with the sites whose flag is 1; differing lengths are an error."""
    flags = with_ordinal(spark.read.text(sites)).where("trim(value) = '1'").select(F.col("ord").alias("site"))
    kept = with_ordinal(flags).select("site", "ord")  # still in the files' order
    rows = with_ordinal(spark.read.text(scores)).select("ord", F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double")).alias("scores"))
    same_length(kept, rows)
    return kept.join(rows, "ord").drop("ord")


def selection_tables(spark: SparkSession, codes, sites, scores, selection) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(ord, snpcode), (ord, kept), (ord, values) and (ord, values): what ``pca_selection`` takes, by line."""
    line = lambda path: with_ordinal(spark.read.text(path))
    numbers = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double"))
    names, flags = line(codes).select("ord", F.trim("value").alias("snpcode")), line(sites).select("ord", F.trim("value").try_cast("int").alias("kept"))
    same_length(names, flags)
    return names, flags, *(line(p).select("ord", numbers.alias("values")) for p in (scores, selection))


def marginal_means(spark: SparkSession, path, text: tuple[str, ...] = ("statistic", "parameter")) -> DataFrame:
    m = require(spark.read.csv(path, header=True, nullValue="NA"), ["emmean"], "marginal means")
    return m.select(*[F.col(c) if c in text else F.col(c).try_cast("double").alias(c) for c in m.columns]).where("emmean is not null")


def bed(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, start long, end long")


def concat(spark: SparkSession, paths: list[str], sep: str = "\t") -> DataFrame:
    """Files with one header each, as one table by position; headers that differ are an error."""
    return spark.read.csv(paths, sep=sep, header=True, enforceSchema=False, nullValue="NA")


def unique_file(spark: SparkSession, pattern: str) -> str:
    """The one path that matches; none or several are an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = [str(s.getPath()) for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []]
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} files match {pattern}")
    return found[0]
