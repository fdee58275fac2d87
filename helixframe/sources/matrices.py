"""Text matrices as whole lines: named, cut down and split by genotype, in order and under one header.

Counts have a first column and one for each sample; likelihoods have three meta columns and
three for each sample.  Values pass through as they are written.  A result is a folder of
compressed parts in the rows' order, of which the first begins with the header; it reads back
as one matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.operators import genotype
from helixframe.sources import readers

META = ("marker", "allele1", "allele2")
#: Classes by the place of their likelihood, as the outputs name them.
CLASSES = ("homRef", "het", "homAlt")


def lines(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Header fields, and (ord, fields) of the other lines, from 0."""
    every = readers.with_ordinal(spark.read.text(path))
    first = every.where("ord = 0").select("value").first()
    if first is None:
        raise ValueError(f"{path} is empty")
    return first["value"].split("\t"), every.where("ord > 0").select((F.col("ord") - 1).alias("ord"), F.split("value", "\t").alias("fields"))


def write(rows: DataFrame, header: list[str], path: str, mode: str = "errorifexists") -> None:
    """``rows`` (ord, fields) as compressed text in the order of ord: ranges of rows side by side, one header before all."""
    spark = rows.sparkSession
    top = spark.createDataFrame([(-1, "\t".join(header))], "ord long, value string")
    text = rows.select(F.col("ord").cast("long").alias("ord"), F.array_join("fields", "\t").alias("value")).union(top)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text.repartitionByRange(n, "ord").sortWithinPartitions("ord").select("value").write.mode(mode).text(path, compression="gzip")


def padded(fields: Column, n: int) -> Column:
    """The first ``n`` fields, with empty ones for those that lack."""
    kept = F.slice(fields, 1, n)
    return F.concat(kept, F.array_repeat(F.lit(""), F.lit(n) - F.size(kept)))


def picked(fields: Column, places: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, places)), lambda i: F.get(fields, i)) if places else F.array().cast("array<string>")


def sample_names(spark: SparkSession, path: str) -> list[str]:
    return [r["name"] for r in readers.names(spark, path).orderBy("ord").collect()]  # samples


def reheader_counts(spark: SparkSession, counts: str, positions: str, names: str, out: str) -> None:
    """Counts with a snpcode column from the positions' lines and the samples' names.

    Blank fields go; rows are cut or filled to the number of names; rows end with the shorter file.
    """
    samples = sample_names(spark, names)
    _, rows = lines(spark, counts)
    _, pos = lines(spark, positions)
    code = F.concat_ws("_", F.get("fields", F.lit(0)), F.get("fields", F.lit(1)))
    named = rows.select("ord", padded(F.filter("fields", lambda x: F.trim(x) != ""), len(samples)).alias("_v")).join(pos.select("ord", code.alias("_c")), "ord")
    write(named.select("ord", F.concat(F.array("_c"), "_v").alias("fields")), ["snpcode", *samples], out)


def reheader_likelihoods(spark: SparkSession, likelihoods: str, names: str, out: str) -> None:
    """Likelihoods with each sample's name over its three columns; another number of columns is an error."""
    samples = sample_names(spark, names)
    header, rows = lines(spark, likelihoods)
    n = 3 + 3 * len(samples)
    if len(header) != n:
        raise ValueError(f"{len(header)} columns, not {n} (3 and 3 for each of {len(samples)} samples)")
    write(rows.select("ord", padded(F.col("fields"), n).alias("fields")), [*header[:3], *[s for s in samples for _ in range(3)]], out)


def subset(spark: SparkSession, path: str, out: str, sites: str | None = None, samples: str | None = None) -> None:
    """Listed sites and samples of a named matrix of either kind, in its own order; no list keeps all."""
    header, rows = lines(spark, path)
    if header[0] not in ("snpcode", "marker"):
        raise ValueError("the first column is neither snpcode nor marker")
    meta, each = (3, 3) if len(header) > 3 and tuple(header[1:3]) == META[1:] else (1, 1)
    keep = list(range(len(header)))
    if samples is not None:
        wanted = set(sample_names(spark, samples))
        keep = keep[:meta] + [i + k for i in range(meta, len(header) - each + 1, each) if header[i] in wanted for k in range(each)]
    rows = rows.select("ord", padded(F.col("fields"), len(header)).alias("fields"))
    if sites is not None:
        listed = readers.names(spark, sites, as_set=True).withColumnRenamed("name", "_site")
        rows = rows.withColumn("_site", F.get("fields", F.lit(0))).join(listed, "_site", "left_semi").drop("_site")
    write(rows.select("ord", picked(F.col("fields"), keep).alias("fields")), [header[i] for i in keep], out)


def split_genotype(spark: SparkSession, likelihoods: str, counts: str, prefix: str, site_stats: str | None = None, least: float = 0.05) -> list[str]:
    """Counts by called class, one matrix each, 0 where a sample's call is another or tied; the paths written.

    Lines of both files belong together by order: other sample names or another site on a line
    are errors.  With ``site_stats`` (columns snpcode and MAF), also those with a MAF over ``least``.
    """
    gl_header, gl = lines(spark, likelihoods)
    header, rows = lines(spark, counts)
    samples = header[1:]
    if samples != gl_header[3::3]:
        raise ValueError("sample names or their order differ between likelihoods and counts")
    value = lambda i, k: F.get("_g", 3 + 3 * i + k).cast("double")
    at = F.sequence(F.lit(0), F.lit(len(samples) - 1)) if samples else F.array().cast("array<int>")
    calls = F.transform(at, lambda i: genotype.call(F.array(*[value(i, k) for k in range(3)])))
    j = gl.select("ord", F.col("fields").alias("_g")).join(rows, "ord")
    site = F.when(F.get("_g", F.lit(0)) == F.get("fields", F.lit(0)), F.get("_g", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("sites differ: "), F.get("_g", F.lit(0)), F.lit(" and "), F.get("fields", F.lit(0)))).cast("string"))
    done = stats.settled(j.select("ord", site.alias("site"), calls.alias("calls"), F.slice("fields", 2, max(1, len(samples))).alias("counts")))
    common = None
    if site_stats is not None:
        s = readers.require(spark.read.csv(site_stats, sep="\t", header=True), ["snpcode", "MAF"], "site table")
        common = done.join(s.where(F.col("MAF").try_cast("double") > least).select(F.col("snpcode").alias("site")).distinct(), "site", "left_semi")
    paths = []
    for k, name in enumerate(CLASSES):
        own = F.zip_with("calls", "counts", lambda c, v: F.when(c == k, v).otherwise(F.lit("0")))  # noqa: B023
        for table, end in ((done, ""), (common, ".maf05")):
            if table is not None:
                paths.append(f"{prefix}.{name}{end}.tsv.gz")
                write(table.select("ord", F.concat(F.array("site", F.lit(name)), own).alias("fields")), ["snpcode", "genotype", *samples], paths[-1])
    return paths
