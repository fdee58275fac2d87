"""Parameter sweeps: grids, summary cubes, variation among groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import ranks, stats


def grid(spark: SparkSession, **levels: list) -> DataFrame:
    """All combinations of the levels, from one row (its size is that of the lists)."""
    df = spark.range(1).drop("id")
    return reduce(lambda d, kv: d.withColumn(kv[0], F.explode(F.array(*map(F.lit, kv[1])))), levels.items(), df)


def stat_cube(df: DataFrame, keys: list[str], values: list[str], site: str = "site") -> DataFrame:
    """For each statistic and key: mean, median, sd, var, iqr, cv, q25, q75, rel_iqr and distinct sites with a value.

    Quartiles are exact and by counts of value ranges: there are few groups, each of which may be large.
    Equal values are counted once, so the passes over ranges read distinct values.
    """
    df = stats.stored(df.select(*keys, site, *values))
    long = df.select(*keys, *values).unpivot(keys, values, "statistic", "value")
    v = F.col("value")
    g = long.groupBy("statistic", *keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.var_samp(v).alias("var"))
    # one row for each group and site is shuffled, with a flag for each statistic
    sites = df.where(F.col(site).isNotNull()).groupBy(*keys, site).agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in values])
    sites = sites.groupBy(*keys).agg(*[F.count_if(c).alias(c) for c in values]).unpivot(keys, values, "statistic", "n_sites")
    by = ["statistic", *keys]
    counted = stats.stored(long.where(v.isNotNull()).groupBy(*by, "value").agg(F.count("*").alias("_count")))
    q = ranks.exact_quantiles(counted, by, "value", [0.25, 0.5, 0.75], weight="_count")
    for name, part in (("q", q.select(*by, F.col("q").alias("_q"))), ("n", sites)):
        part = part.withColumnsRenamed({c: f"_{name}_{c}" for c in by})
        g = g.join(part, [F.col(c).eqNullSafe(F.col(f"_{name}_{c}")) for c in by], "left")
    q1, q2, q3 = (F.get("_q", F.lit(i)) for i in range(3))
    return g.select("statistic", *keys, "mean", q2.alias("median"), "sd", "var", (q3 - q1).alias("iqr"), F.try_divide("sd", F.abs("mean")).alias("cv"), q1.alias("q25"), q3.alias("q75"), F.try_divide(q3 - q1, q2).alias("rel_iqr"), F.coalesce("n_sites", F.lit(0)).alias("n_sites"))


def het_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Individual heterozygosity alt / (alt + ref) by group."""
    x = df.withColumn("_h", F.try_divide("alt", F.col("alt") + F.col("ref")))
    return x.groupBy(*keys).agg(F.avg("_h").alias("mean"), F.stddev_samp("_h").alias("sd"), stats.cv("_h").alias("cv"), stats.iqr("_h").alias("iqr"), stats.rel_iqr("_h").alias("rel_iqr"), F.count("_h").alias("n"))


def region_variation(per_pop: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Variation among populations of their means and medians; groups of ``least`` populations or more."""
    g = per_pop.groupBy(*keys).agg(stats.cv("mean").alias("cv_means"), stats.iqr("median").alias("iqr_medians"), stats.rel_iqr("median").alias("rel_iqr_medians"), F.avg("iqr").alias("mean_within_iqr"), F.count_distinct("pop_code").alias("n_pops"))
    return g.where(F.col("n_pops") >= least)


def rmse(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sqrt(F.avg(F.col(value) ** 2)).alias("rmse"))


def fill(df: DataFrame, keys: list[str], value: str, fn=F.avg) -> DataFrame:
    """Heat-map cells: any aggregate of a column."""
    return df.groupBy(*keys).agg(fn(value).alias("fill"))


def core_slice(df: DataFrame) -> DataFrame:
    return df.where((F.col("mq") != 50) & F.col("C").isin(0, 50))


def extended_slice(df: DataFrame, caps: tuple[int, ...] | None = (0, 60, 75, 100)) -> DataFrame:
    kept = df.where(F.col("baq") == 0)
    return kept if caps is None else kept.where(F.col("C").isin(*caps))


def model_slice(df: DataFrame, ct: float = 0.6, value: str = "f") -> DataFrame:
    return df.where((F.col("baq") == 0) & (F.col("C") != 50) & (F.col("ct") == ct) & F.col(value).isNotNull())


def unlog(df: DataFrame) -> DataFrame:
    """pi and theta from logs, absolute F, and D = pi - theta of the un-logged values."""
    return df.withColumns({"pi": F.exp("log_pi"), "theta": F.exp("log_theta"), "abs_f": F.abs("f")}).withColumn("d", F.col("pi") - F.col("theta"))


def library_majority(meta: DataFrame) -> DataFrame:
    """(pop_code, total, library, n, share) of each population's largest library; ties to the first name."""
    n = meta.groupBy("pop_code", "library").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("library", "n"), F.struct(F.negative("n").alias("o"), "library"))
    g = n.groupBy("pop_code").agg(F.sum("n").alias("total"), best.alias("_b"))
    return g.select("pop_code", "total", "_b.library", "_b.n", F.try_divide("_b.n", "total").alias("share"))


def mixed_populations(meta: DataFrame, least: int = 5, most_share: float = 0.8) -> DataFrame:
    return library_majority(meta).where((F.col("total") >= least) & (F.col("share") < most_share))


def close_pairs(dist: DataFrame, groups: DataFrame, limits: dict[str, float], default: float) -> DataFrame:
    """Unordered population pairs of one domain and different libraries within the domain's distance."""
    a = groups.select(F.col("pop_code").alias("pop1"), F.col("domain").alias("dom1"), F.col("library").alias("lib1"))
    b = groups.select(F.col("pop_code").alias("pop2"), F.col("domain").alias("dom2"), F.col("library").alias("lib2"))
    j = dist.join(a, "pop1", "left").join(b, "pop2", "left")
    limit = F.coalesce(*[F.when(F.col("dom1") == k, F.lit(float(v))) for k, v in limits.items()], F.lit(float(default)))
    ok = j.where((F.col("pop1") != F.col("pop2")) & (F.col("dom1") == F.col("dom2")) & (F.col("lib1") != F.col("lib2")) & (F.col("km") <= limit))
    key = F.concat_ws("_", F.least("pop1", "pop2"), F.greatest("pop1", "pop2"))
    return ok.groupBy(key.alias("pair")).agg(F.min("km").alias("km"), F.first("dom1").alias("domain"))


def population_status(pops: DataFrame, mixed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether each population is mixed, or in a close pair (either side)."""
    sides = pairs.select(F.col("pop1").alias("pop_code")).union(pairs.select("pop2")).distinct().withColumn("in_pair", F.lit(True))
    j = pops.join(mixed.select("pop_code").withColumn("mixed", F.lit(True)), "pop_code", "left").join(sides, "pop_code", "left")
    return j.select("pop_code", F.coalesce("mixed", F.lit(False)).alias("mixed"), F.coalesce("in_pair", F.lit(False)).alias("in_pair"))


def first_row(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in an explicit order (partial aggregation, no window)."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def top_within(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """First ``k`` rows of each key; Spark limits each task's rows before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
