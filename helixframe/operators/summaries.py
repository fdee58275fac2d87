"""Whole reports: site summaries, sweep collation, ROC screening, rule mining on a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import keys, stats
from helixframe.operators import models, rules, site

#: Packed columns of a site's tests and the names of their fields.
TESTS = {"sb": ("sb1", "sb2", "sb3"), "hwe": ("hwe_lrt", "hwe_pval"), "base_q": ("base_q_z", "base_q_pval"), "map_q": ("map_q_z", "map_q_pval"), "edge": ("edge_z", "edge_pval")}


def unpack_tests(tests: DataFrame) -> DataFrame:
    """(site, 11 numbers) from the packed columns of ``TESTS``; too few fields are an error."""
    got = [x.alias(n) for c, names in TESTS.items() for x, n in zip(keys.packed_numbers(F.col(c), len(names)), names, strict=True)]
    return tests.select("site", *got)


def depth_report(counts: DataFrame, n_samples: DataFrame | int, freq: DataFrame, tests: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """22 columns a site: depth statistics, allele frequency, heterozygosities, and tests (null without them).

    Sites are those with frequencies.  With ``least``, only common alleles.
    """
    total = counts.groupBy("site").agg(F.sum("depth").alias("total_depth"))
    rows = site.site_summary(site.site_depth_summary(counts, n_samples), freq).join(total, "site")
    names = [n for group in TESTS.values() for n in group]
    rows = rows.withColumns({n: F.lit(None).cast("double") for n in names}) if tests is None else rows.join(unpack_tests(tests), "site", "left")
    rows = rows if least is None else site.common_sites(rows, least)
    first = ["site", "total_depth", "mean_depth", "median_depth", "call_rate", "cv_depth", "rel_iqr_depth", "maf", "hexp", "hobs", "f"]
    return rows.select(*first, *names)


def frequency_report(freq: DataFrame, n_samples: int, tests: DataFrame, least: float | None = None) -> DataFrame:
    """17 columns a site: call rate (n_ind over the samples, clamped), frequency, heterozygosities, tests.

    The first six numbers have six decimals, and ``least`` is tested on those; a site that one
    side lacks is an error.
    """
    r6 = lambda c: F.round(c, 6)
    e = 2 * F.col("maf") * (1 - F.col("maf"))
    call = site.clamped_call_rate(F.col("n_ind").cast("double"), F.lit(n_samples))
    rows = freq.select("site", r6(call).alias("call_rate"), r6("maf").alias("maf"), r6(e).alias("hexp"), r6(e * (1 - F.col("f"))).alias("hobs"), r6("f").alias("f"))
    rows = site.checked_join(rows, unpack_tests(tests), ["site"])
    return rows if least is None else site.common_sites(rows, least)


def callable_variants(counts: DataFrame, meta: DataFrame, freq: DataFrame, thresholds: list[float], least: float = 0.05) -> DataFrame:
    """(which, threshold, site): all callable sites, and those whose MAF is at least ``least``."""
    every = site.callable_sites(counts, meta, thresholds)
    passed = every.join(freq.where(F.col("maf") >= least).select("site"), "site", "left_semi").select(*every.columns)
    return every.select(F.lit("all").alias("which"), "*").union(passed.select(F.lit("maf_filtered").alias("which"), "*"))


def collate_sweep(thetas: DataFrame, freq: DataFrame, callable_: DataFrame, keys_: list[str]) -> DataFrame:
    """Population statistics (``keys_`` and site) with frequencies, at every threshold and variant that has the site.

    Statistics without a frequency stay with nulls; ``callable_`` may hold some of ``keys_`` too.
    """
    e, o = site.heterozygosity(F.col("maf"), F.col("f"))
    own = [c for c in [*keys_, "site"] if c in freq.columns]
    rows = thetas.join(freq, own, "left").withColumns({"hexp": e, "hobs": o})
    on = [c for c in [*keys_, "site"] if c in callable_.columns]
    return rows.join(callable_.withColumnRenamed("threshold", "call_thresh"), on)


def screen(df: DataFrame, groups: dict[str, tuple[str, str]], columns: list[str], ranges: int = 64) -> DataFrame:
    """A row for each class definition and statistic: AUC, best threshold, its rates, medians of both classes.

    ``groups``: name -> (predicate of the bad class, predicate of the good class), as SQL text;
    a row in both counts in both.  Where the good class has the lower median, calls are values
    at or below a threshold.  The best threshold has the largest Youden index; ties go to the
    highest.  NaN values are missing; a statistic without values in either class gives no row.

    Rows are dealt to their definitions and statistics once, counted by distinct value, and
    ranked by ranges of values within each pair of definition and statistic.
    """
    by = ["definition", "stat"]
    member = [F.when(F.expr(p), F.struct(F.lit(n).alias("definition"), F.lit(good).alias("good"))) for n, pair in groups.items() for p, good in zip(pair, (False, True), strict=True)]
    numbers = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("x")) for c in columns])
    rows = df.select(F.explode(F.array_compact(F.array(*member))).alias("m"), numbers.alias("v"))
    rows = rows.select("m.definition", "m.good", F.explode("v").alias("v")).select("definition", "good", "v.stat", "v.x").where("x is not null and not isnan(x)")
    per = rows.groupBy(*by, "x").agg(F.count_if("good").alias("p"), F.count_if(~F.col("good")).alias("q"))
    per = stats.settled(per)
    total = per.groupBy(*by).agg(F.sum("p").alias("np"), F.sum("q").alias("nq")).where("np > 0 and nq > 0")
    up = stats.running_total(stats.running_total(per, ["x"], "p", "tp", ranges, True, by), ["x"], "q", "fp", ranges, True, by)
    c = up.join(total, by)  # tp, fp: calls at or above x
    low_t, low_f = (F.col("np") - F.col("tp") + F.col("p")) / F.col("np"), (F.col("nq") - F.col("fp") + F.col("q")) / F.col("nq")
    best = lambda t, f: F.max(F.struct(F.round(t - f, 9).alias("j"), F.col("x").alias("threshold"), t.alias("t"), f.alias("f")))
    # values at the middle ranks, counted from the largest
    at = lambda have, n, f: F.max(F.when(F.col(have) >= f((F.col(n) + 1) / 2), F.col("x")))
    row = c.groupBy(*by).agg(
        (F.sum(F.col("p") * (F.col("nq") - F.col("fp") + F.col("q") / 2.0)) / F.first("np") / F.first("nq")).alias("a"),
        best(F.col("tp") / F.col("np"), F.col("fp") / F.col("nq")).alias("hi"), best(low_t, low_f).alias("lo"),
        ((at("tp", "np", F.ceil) + at("tp", "np", F.floor)) / 2).alias("median_good"), ((at("fp", "nq", F.ceil) + at("fp", "nq", F.floor)) / 2).alias("median_bad"),
    )
    rising = F.col("median_good") >= F.col("median_bad")
    b = F.when(rising, F.col("hi")).otherwise(F.col("lo"))
    return row.select(
        *by, F.when(rising, F.col("a")).otherwise(1 - F.col("a")).alias("auc"), b["threshold"].alias("threshold"),
        b["t"].alias("sensitivity"), (1 - b["f"]).alias("specificity"), "median_good", "median_bad",
    )


def classified_leaves(rows: DataFrame, model, y: str, row: str, k: float, band: float) -> DataFrame:
    """(row, tree, leaf_id, cls) of the rows that are extreme or background by their own ``y``, computed once; an error where either set is empty."""
    cls = stats.settled(rules.classify(rows, y, rules.thresholds(rows, y, k), band).select(F.col(row).alias("row"), "cls"))
    found = {r["cls"] for r in cls.select("cls").distinct().collect()} - {None}
    if len(found) < 2:
        raise ValueError(f"{y} has no {' and no '.join(sorted({'extreme', 'background'} - found))} rows")
    return stats.settled(models.leaf_rows(models.predicted(model, rows), row).join(cls.where("cls is not null"), "row"))


def rule_texts(model, features: list[str], max_depth: int = 4, **binning) -> DataFrame:
    """(tree, leaf_id, rule_str, rule_len) of a fitted model's leaves, from its saved nodes."""
    nodes = stats.settled(models.node_table(model, features))
    return stats.settled(rules.path_rules(rules.leaf_steps(nodes, models.split_breaks(nodes, **binning)), max_depth))


def mine_rules(rows: DataFrame, model, features: list[str], y: str, row: str = "row", k: float = 1.0, band: float = 1.0, max_depth: int = 4, min_support: int = 20, **binning) -> DataFrame:
    """Rules of a fitted model: its leaves over ``rows``, their paths as texts, and the harvest over extremes of ``y``."""
    leaves = classified_leaves(rows, model, y, row, k, band)
    return rules.harvest(leaves, rule_texts(model, features, max_depth, **binning), min_support=min_support)


def validate_rules(rows: DataFrame, model, features: list[str], y: str, candidates: DataFrame, row: str = "row", k: float = 1.0, band: float = 1.0, max_depth: int = 4, min_support: int = 1, **binning) -> DataFrame:
    """The candidates' statistics on other ``rows``, whose extremes and background come from their own ``y``.

    ``candidates`` (rule_str) as ``mine_rules`` gives them; a rule without enough rows here has no row.
    """
    leaves = classified_leaves(rows, model, y, row, k, band)
    return rules.validate(leaves, rule_texts(model, features, max_depth, **binning), candidates.select("rule_str").distinct(), min_support=min_support)


def mine_and_validate(rows: DataFrame, model, features: list[str], y: str, train: str = "is_train", row: str = "row", min_support: int = 20, **options) -> DataFrame:
    """Rules mined on the training rows beside their statistics on the others (``test_...``, null where a rule has no row), best first."""
    found = stats.settled(mine_rules(rows.where(train), model, features, y, row, min_support=min_support, **options))
    test = validate_rules(rows.where(f"not {train}"), model, features, y, found, row, **options)
    test = test.select("rule_str", *[F.col(c).alias(f"test_{c}") for c in test.columns if c not in ("rule_str", "rule_len")])
    return rules.rule_order(found.join(test, "rule_str", "left"))
