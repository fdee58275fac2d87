"""Depth features of genotype classes: every standardisation, statistic, class and difference of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.functions.dips import dip_of
from helixframe.operators import genotype

#: Standardisations, their prefixes and the statistics of each, as the output names them.
STANDARDS = {
    "none": ("raw", ("mean", "median", "sd", "mad", "cv", "iqr", "extreme")),
    "sample_z": ("sz", ("mean", "median", "sd", "mad", "cv", "iqr")),
    "loci_z": ("lz", ("median", "mad")),
    "double_loci_sample": ("dlsz", ("mean", "median", "sd", "mad", "iqr")),
    "double_sample_loci": ("dslz", ("median", "mad")),
    "aggregate": ("aggregate", ("mean", "median", "sd", "mad", "cv", "iqr", "kurtosis", "skewness", "entropy", "extreme", "dip")),
}
CLASSES = ("homoMaj", "homoMin", "hetero")
#: Names of differences and log ratios, with the classes they compare.
PAIRS = (("homoDiff", "MajMinLogRatio", "homoMaj", "homoMin"), ("MajHetDiff", "MajHetLogRatio", "homoMaj", "hetero"), ("MinHetDiff", "MinHetLogRatio", "homoMin", "hetero"))
COMPARED = ("mean", "median", "iqr")


def sorted_quantile(values: Column, p: float) -> Column:
    """Quantile of a sorted array, linear between neighbours; null for an empty one."""
    h = (F.size(values) - 1) * F.lit(p)
    at = F.floor(h).cast("int")
    a, b = F.get(values, at), F.get(values, F.least(at + 1, F.size(values) - 1))
    return a + (h - at) * (b - a)


def measured(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Adds quartiles and MAD of each sorted array ``_a_<name>``: columns of their own, so that no lambda works them out for every value."""
    a = lambda c: F.col(f"_a_{c}")
    rows = rows.withColumns({f"_q{i}_{c}": sorted_quantile(a(c), i / 4) for c in names for i in (1, 2, 3)})
    away = lambda c: F.transform(a(c), lambda v: F.abs(v - F.col(f"_q2_{c}")))
    rows = rows.withColumns({f"_w_{c}": F.sort_array(away(c)) for c in names})
    return rows.withColumns({f"_d_{c}": 1.4826 * sorted_quantile(F.col(f"_w_{c}"), 0.5) for c in names})


def row_panel(name: str) -> dict[str, Column]:
    """Statistics of the sorted array ``_a_<name>``, whose mean ``_m_``, sample sd ``_s_``, quartiles and MAD are columns beside it."""
    x, mean, sd, q1, median, q3, mad = (F.col(f"{p}_{name}") for p in ("_a", "_m", "_s", "_q1", "_q2", "_q3", "_d"))
    n = F.size(x)
    total = lambda f: F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v))
    out = lambda v: (v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))
    share = lambda v: v / (mean * n)
    entropy = total(lambda v: F.when(share(v) > 0, -share(v) * F.ln(share(v))).otherwise(0.0))
    shape = lambda k: F.when(n >= 5, F.try_divide(total(lambda v: F.pow(v - mean, F.lit(k))) / n, F.pow(sd, F.lit(k))))
    return {
        "mean": mean, "median": median, "sd": sd, "cv": F.try_divide(sd, mean), "iqr": q3 - q1,
        "mad": mad,
        "extreme": F.when(n >= 5, F.size(F.filter(x, out)) / n),
        "kurtosis": shape(4.0) - 3, "skewness": shape(3.0) * F.sqrt(n * (n - 1)) / (n - 2),
        "entropy": F.when((n > 1) & (mean > 0), entropy / F.ln(n)), "dip": dip_of(x),
    }


def class_names(genotype_: Column, maf: Column) -> Column:
    """Homozygotes as the major's or the minor's by whether the alternative is the rarer allele."""
    ref, alt = F.lit(CLASSES[0]), F.lit(CLASSES[1])
    homo = F.when((genotype_ == "homRef") == (maf <= 0.5), ref).otherwise(alt)
    return F.when(genotype_.isin("homRef", "homAlt"), homo).otherwise(F.lit(CLASSES[2]))


def depth_by_genotype(split: DataFrame, site_stats: DataFrame, standards: list[str] = tuple(STANDARDS), least: int = 5) -> DataFrame:
    """One row a site: statistics of its depths by genotype class under each standardisation, their differences, and those over all classes.

    ``split`` (site, genotype, sample, depth) has a row for each cell of the class matrices,
    ``site_stats`` (site, maf, call_rate).  Sites need ``least`` non-zero cells in each class, a
    call rate over 0.4 and a MAF under 0.95; zero, null and NaN depths are missing.  Columns are
    ``<prefix>_<statistic>_<class>``; only ``aggregate`` gives that panel alone.

    A row of a class is z-scored in itself, so its own statistics give those of both scores by
    row; the scores by sample need one aggregation over all cells, of raw and of row-scored
    values together.  What is gathered into one row is a site's samples.  A ``split`` that is
    dealt to tasks by site stays there until its sites are chosen.
    """
    unknown = set(standards) - set(STANDARDS)
    if unknown:
        raise ValueError(f"unknown standardisations: {sorted(unknown)}")
    depth = F.col("depth").cast("double")
    seen = split.where(depth.isNotNull() & ~F.isnan(depth) & (depth != 0)).select("site", "genotype", "sample", depth.alias("x"))
    full = genotype.observed_rows(seen.withColumnRenamed("x", "depth"), least).groupBy("site").agg(F.count("*").alias("_c")).where(F.col("_c") == len(genotype.CLASSES)).select("site")
    sites = full.join(site_stats.where("call_rate > 0.4 and maf < 0.95").select("site", "maf"), "site")
    cells = seen.join(sites.hint("shuffle_hash"), "site").select("site", class_names(F.col("genotype"), F.col("maf")).alias("class"), "sample", "x")
    cells = stats.settled(cells)  # read several times below; often few of ``split``

    out = None
    if set(standards) != {"aggregate"}:
        panel = class_panels(cells, standards)
        out = panel.groupBy("site").agg(*[F.max(F.when(F.col("class") == c, F.col(s))).alias(f"{s}_{c}") for s in panel.columns[2:] for c in CLASSES])
        out = out.withColumns(differences(standards))
    if "aggregate" in standards:
        every = aggregate_panel(cells)
        out = every if out is None else out.join(every, "site", "left")
    return out


def class_panels(cells: DataFrame, standards) -> DataFrame:
    """(site, class, <prefix>_<statistic>...) of cells (site, class, sample, x)."""
    rows = cells.groupBy("site", "class").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.collect_list(F.struct("sample", "x")).alias("cells"))
    z = lambda v, m, s: F.try_divide(v - m, F.nullif(s, F.lit(0.0)))
    flat = rows.select("site", "class", "m", "s", F.explode("cells").alias("c")).select("site", "class", F.col("c.sample").alias("sample"), F.col("c.x").alias("x"), z(F.col("c.x"), F.col("m"), F.col("s")).alias("lz"))
    by_sample = flat.groupBy("sample").agg(F.avg("x").alias("_mx"), F.stddev_samp("x").alias("_sx"), F.avg("lz").alias("_ml"), F.stddev_samp("lz").alias("_sl"))
    scored = flat.join(by_sample, "sample").withColumns({"sz": z(F.col("x"), F.col("_mx"), F.col("_sx")), "dlsz": z(F.col("lz"), F.col("_ml"), F.col("_sl"))})
    of = lambda c: (F.sort_array(F.collect_list(c)).alias(f"_a_{c}"), F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))
    rows = measured(scored.groupBy("site", "class").agg(*of("x"), *of("sz"), *of("dlsz")), ("x", "sz", "dlsz"))
    panels = {p: row_panel(c) for p, c in (("raw", "x"), ("sz", "sz"), ("dlsz", "dlsz"))}
    for own, base, c in (("lz", "raw", "x"), ("dslz", "sz", "sz")):  # scores of a row in itself: shifted and scaled
        s = F.nullif(F.col(f"_s_{c}"), F.lit(0.0))
        panels[own] = {"median": F.try_divide(panels[base]["median"] - F.col(f"_m_{c}"), s), "mad": F.try_divide(panels[base]["mad"], s)}
    wanted = [(p, s) for name in standards if name != "aggregate" for p, names in [STANDARDS[name]] for s in names]
    return rows.select("site", "class", *[panels[p][s].alias(f"{p}_{s}") for p, s in wanted])


def aggregate_panel(cells: DataFrame) -> DataFrame:
    """(site, aggregate_<statistic>...) of each sample's depth over all classes; sums of 0 are missing."""
    total = cells.groupBy("site", "sample").agg(F.sum("x").alias("x")).where("x <> 0")
    rows = measured(total.groupBy("site").agg(F.sort_array(F.collect_list("x")).alias("_a_x"), F.avg("x").alias("_m_x"), F.stddev_samp("x").alias("_s_x")), ("x",))
    panel = row_panel("x")
    prefix, names = STANDARDS["aggregate"]
    return rows.select("site", *[panel[s].alias(f"{prefix}_{s}") for s in names])


def differences(standards) -> dict[str, Column]:
    """Differences of the classes' means, medians and ranges, and for raw depths their log ratios."""
    out = {}
    for name in standards:
        prefix, names = STANDARDS[name]
        for s in COMPARED if name != "aggregate" else ():
            for diff, ratio, a, b in PAIRS if s in names else ():
                x, y = F.col(f"{prefix}_{s}_{a}"), F.col(f"{prefix}_{s}_{b}")
                out[f"{prefix}_{s}_{diff}"] = x - y
                if name == "none":
                    out[f"{prefix}_{s}_{ratio}"] = genotype.log_ratio(x, y)
    return out
