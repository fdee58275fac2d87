"""Sites and samples: depth summaries, call rates, callable sites, joins and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import stats


def site_depth_summary(counts: DataFrame, n_samples: DataFrame | int) -> DataFrame:
    """Per site, over non-zero cells: mean, median, call rate, population cv, relative IQR.

    The call rate's denominator is the number of samples, not of present cells.
    """
    x = F.when(F.col("depth") != 0, F.col("depth").cast("double"))
    g = counts.groupBy("site").agg(F.avg(x).alias("m"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.stddev_pop(x).alias("s"), F.count(x).alias("nz"))
    n = F.lit(n_samples) if isinstance(n_samples, int) else F.col("_n")
    g = g if isinstance(n_samples, int) else g.join(F.broadcast(n_samples.agg(F.count("*").alias("_n"))))  # one row
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    return g.select(
        "site", zero(F.col("m")).alias("mean_depth"), zero(F.col("q")[1]).alias("median_depth"), zero(F.try_divide("nz", n)).alias("call_rate"),
        F.when(F.col("nz") > 1, zero(F.try_divide("s", "m"))).otherwise(0.0).alias("cv_depth"), zero(F.try_divide(F.col("q")[2] - F.col("q")[0], F.col("q")[1])).alias("rel_iqr_depth"),
    )


def heterozygosity(maf: Column, f: Column) -> tuple[Column, Column]:
    """(expected, observed)."""
    e = 2 * maf * (1 - maf)
    return e, e - f * e


def clamped_call_rate(n_ind: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(F.least(F.greatest(n_ind, F.lit(0)), n), F.nullif(n, F.lit(0))), F.lit(0.0))


def site_summary(depth: DataFrame, freq: DataFrame) -> DataFrame:
    """Depth summary joined by key to allele frequencies, with both heterozygosities."""
    e, o = heterozygosity(F.col("maf"), F.col("f"))
    return depth.join(freq, "site").withColumns({"hexp": e, "hobs": o})


def common_sites(df: DataFrame, least: float = 0.05, maf: str = "maf") -> DataFrame:
    """least < MAF < 1 - least; NaN and null fail."""
    m = F.col(maf)
    return df.where((m > least) & (m < 1 - least) & ~F.isnan(m))


def sample_call_rate(counts: DataFrame, samples: DataFrame, n_sites: DataFrame, threshold: float = 0) -> DataFrame:
    """Share of all sites with depth over ``threshold``, and mean depth of those cells, for every sample."""
    ok = F.when(F.col("depth") > threshold, F.col("depth"))
    g = counts.groupBy("sample").agg(F.count(ok).alias("n"), F.avg(ok).alias("mean_depth"))
    n = F.broadcast(n_sites.agg(F.count("*").alias("_n")))  # one row
    j = samples.select("sample").join(g, "sample", "left").join(n)
    return j.select("sample", F.coalesce(F.try_divide("n", "_n"), F.lit(0.0)).alias("call_rate"), "mean_depth")


def sample_depth_breadth(bases: DataFrame, least: int = 5) -> DataFrame:
    """Scaffolds with a base of at least ``least`` reads, and total depth, of each sample."""
    s = F.when(F.col("depth") >= least, F.col("scaffold"))
    return bases.groupBy("sample").agg(F.count_distinct(s).alias("n_scaffolds"), F.sum("depth").alias("total_depth"))


def mapping_summary(reads: DataFrame) -> DataFrame:
    return reads.groupBy("sample").agg(F.count_if(F.col("n") > 0).alias("n_scaffolds"), F.sum("n").alias("n_reads"))


def callable_sites(counts: DataFrame, meta: DataFrame, thresholds: list[float], library_share: float = 0.1) -> DataFrame:
    """(threshold, site) where the site is present in at least the threshold of every library kept.

    Libraries with a tenth of all samples count.  Presence is counted once for all thresholds;
    each threshold must be over 0, so a site that a library lacks can't pass.
    """
    if min(thresholds) <= 0:
        raise ValueError("thresholds must be over 0")
    total = F.broadcast(meta.agg(F.count("*").alias("_all")))  # one row
    libs = meta.groupBy("library").agg(F.count("*").alias("_k")).join(total).where(F.col("_k") >= library_share * F.col("_all"))
    n_libs = F.broadcast(libs.agg(F.count("*").alias("_libs")))  # one row
    present = counts.where("depth > 0").join(meta.select("sample", "library"), "sample").groupBy("site", "library").agg(F.count("*").alias("_p"))
    ratio = present.join(libs.select("library", "_k"), "library").groupBy("site").agg(F.min(F.col("_p") / F.col("_k")).alias("_r"), F.count("*").alias("_l"))
    t = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    full = ratio.join(n_libs).where(F.col("_l") == F.col("_libs"))
    return full.select("site", "_r", t).where(F.col("_r") >= F.col("threshold")).select("threshold", "site")


def quantile_filter(df: DataFrame, metrics: list[str], q: float = 0.1, keep: bool = True, log: bool = True) -> DataFrame:
    """Rows above the quantile in all metrics, or (``keep`` False) rows below it in any."""
    f = F.ln if log else (lambda c: c)
    cut = df.agg(*[stats.quantile(f(F.col(m).cast("double")), q).alias(f"_{m}") for m in metrics])
    j = df.join(F.broadcast(cut))  # one row
    test = None
    for m in metrics:
        x = f(F.col(m).cast("double"))
        t = x > F.col(f"_{m}") if keep else x < F.col(f"_{m}")
        test = t if test is None else (test & t if keep else test | t)
    return j.where(test).select(*df.columns)


def subset(df: DataFrame, sites: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """Rows of the given sites and samples; lists may repeat entries."""
    for keys, name in ((sites, "site"), (samples, "sample")):
        df = df if keys is None else df.join(keys, name, "left_semi")
    return df


def reheader(df: DataFrame, names: DataFrame, permissive: bool = False) -> DataFrame:
    """Replace positional sample numbers (``ord``) by names; a count mismatch is an error unless permissive.

    Permissive: positions without a name are dropped, names without a position unused.
    """
    if not permissive:
        bad = df.select("ord").distinct().join(names.select("ord").distinct().withColumn("_named", F.lit(1)), "ord", "full").where("_named is null or ord is null")
        if bad.limit(1).count():
            raise ValueError("more samples than names")
    return df.join(names.select("ord", "name"), "ord").drop("ord")


def checked_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails if either side has a key the other lacks."""
    for x, y in ((a, b), (b, a)):
        if x.select(*keys).join(y.select(*keys), keys, "left_anti").limit(1).count():
            raise ValueError(f"keys {keys} differ between the two sides")
    return a.join(b, keys)


def null_out(df: DataFrame, cols: list[str], maf: str, least: float) -> DataFrame:
    """Blank ``cols`` where MAF is under ``least``; rows stay, and a null MAF blanks nothing."""
    return df.withColumns({c: F.when(F.col(maf) < least, None).otherwise(F.col(c)) for c in cols})
