"""Named queries over the logical tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import keys, ranks, stats
from helixframe.operators import genotype, gram, intervals, models, reads, rules, shape, site, summaries, sweep

from . import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = T.SQL + sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that results compare whatever the order of addition; no negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0 AS {n.split('.')[-1]}" for n in names)


# --- sites ----------------------------------------------------------------------------------


@query("""SELECT site, round(avg(d), 6) AS mean_depth, round(median(d), 6) AS median_depth, round(count(d) / (SELECT count(*) FROM meta), 6) AS call_rate,
 round(CASE WHEN count(d) > 1 THEN stddev_pop(d) / avg(d) ELSE 0 END, 6) AS cv_depth,
 round((quantile_cont(d, 0.75) - quantile_cont(d, 0.25)) / median(d), 6) AS rel_iqr_depth FROM (SELECT site, CAST(depth AS DOUBLE) AS d FROM counts WHERE depth <> 0) GROUP BY 1""")
def site_depth_summary(spark, d):
    return rounded(site.site_depth_summary(T.counts(spark, d), T.meta(spark, d)))


@query("""SELECT c.site, round(avg(CAST(depth AS DOUBLE)), 6) AS mean_depth, round(any_value(maf), 6) AS maf, round(any_value(2 * maf * (1 - maf)), 6) AS hexp,
 round(any_value(2 * maf * (1 - maf) - f * 2 * maf * (1 - maf)), 6) + 0 AS hobs, round(count(*) / (SELECT count(*) FROM meta), 6) AS call_rate
 FROM counts c JOIN site_stats s ON c.site = s.site WHERE maf > 0.05::DOUBLE AND maf < 0.95::DOUBLE GROUP BY 1""")
def site_summary_join(spark, d):
    depth = site.site_depth_summary(T.counts(spark, d), T.meta(spark, d))
    rows = site.common_sites(site.site_summary(depth, T.site_stats(spark, d)))
    return rounded(rows.select("site", "mean_depth", "maf", "hexp", "hobs", "call_rate"))


@query("""SELECT m.sample, round(coalesce(count(depth) FILTER (depth > 20) / (SELECT count(*) FROM site_stats), 0), 6) AS call_rate,
 round(avg(CAST(depth AS DOUBLE)) FILTER (depth > 20), 6) AS mean_depth FROM meta m LEFT JOIN counts c ON m.sample = c.sample GROUP BY 1""")
def sample_call_rate(spark, d):
    return rounded(site.sample_call_rate(T.counts(spark, d), T.meta(spark, d), T.site_stats(spark, d), 20))


@query("SELECT l_suppkey AS sample, count(DISTINCT CASE WHEN l_quantity >= 5 THEN l_partkey END) AS n_scaffolds, CAST(sum(l_quantity) AS BIGINT) AS total_depth FROM lineitem GROUP BY 1")
def sample_depth_breadth(spark, d):
    b = T.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("scaffold"), F.col("l_quantity").cast("long").alias("depth"))
    return site.sample_depth_breadth(b)


@query("SELECT sample, count(*) FILTER (n > 0) AS n_scaffolds, CAST(sum(n) AS BIGINT) AS n_reads FROM (SELECT sample, CAST(depth - 30 AS BIGINT) AS n FROM counts) GROUP BY 1")
def mapping_summary(spark, d):
    return site.mapping_summary(T.counts(spark, d).select("sample", (F.col("depth") - 30).alias("n")))


@query("SELECT DISTINCT site AS scaffold FROM counts WHERE depth >= 60")
def covered_scaffolds(spark, d):
    return T.counts(spark, d).where("depth >= 60").select(F.col("site").alias("scaffold")).distinct()


_METRICS = "m AS (SELECT sample, count(*) AS n_scaffolds, CAST(sum(depth) AS BIGINT) AS n_reads FROM counts GROUP BY 1)"


def _metrics(spark, d):
    return T.counts(spark, d).groupBy("sample").agg(F.count("*").alias("n_scaffolds"), F.sum("depth").alias("n_reads"))


@query(f""", {_METRICS} SELECT m.*, true AS fail, 'low_coverage' AS reason FROM m WHERE n_scaffolds < (SELECT quantile_cont(CAST(n_scaffolds AS DOUBLE), 0.1) FROM m) OR n_reads < (SELECT quantile_cont(CAST(n_reads AS DOUBLE), 0.1) FROM m)""")
def qc_fail_list(spark, d):
    bad = site.quantile_filter(_metrics(spark, d), ["n_scaffolds", "n_reads"], 0.1, keep=False, log=False)
    return bad.withColumns({"fail": F.lit(True), "reason": F.lit("low_coverage")})


@query(f""", {_METRICS} SELECT * FROM m WHERE ln(n_scaffolds) > (SELECT quantile_cont(ln(CAST(n_scaffolds AS DOUBLE)), 0.25) FROM m) AND ln(n_reads) > (SELECT quantile_cont(ln(CAST(n_reads AS DOUBLE)), 0.25) FROM m)""")
def qc_keep_quantile(spark, d):
    return site.quantile_filter(_metrics(spark, d), ["n_scaffolds", "n_reads"], 0.25)


@query("SELECT threshold, site FROM (SELECT site, min(p / k) AS r, count(*) AS l FROM (SELECT site, library, count(*) AS p FROM counts JOIN meta USING (sample) WHERE depth > 0 GROUP BY 1, 2) JOIN (SELECT library, count(*) AS k FROM meta GROUP BY 1 HAVING count(*) >= 0.1 * (SELECT count(*) FROM meta)) USING (library) GROUP BY 1), (SELECT unnest([0.2, 0.1]::DOUBLE[]) AS threshold) WHERE r >= threshold AND l = (SELECT count(*) FROM (SELECT library FROM meta GROUP BY 1 HAVING count(*) >= 0.1 * (SELECT count(*) FROM meta)))")
def callable_sites_multi(spark, d):
    return site.callable_sites(T.counts(spark, d), T.meta(spark, d), [0.2, 0.1])


@query(SQL["callable_sites_multi"].removeprefix(T.SQL).replace("SELECT threshold, site", "SELECT site").replace("[0.2, 0.1]", "[0.2]"))
def callable_sites(spark, d):
    return site.callable_sites(T.counts(spark, d), T.meta(spark, d), [0.2]).select("site")


@query("SELECT * FROM counts WHERE site IN (SELECT site FROM site_stats WHERE maf >= 0.2::DOUBLE)")
def subset_sites(spark, d):
    return site.subset(T.counts(spark, d), sites=T.site_stats(spark, d).where("maf >= 0.2D").select("site"))


@query("SELECT * FROM counts WHERE sample IN (SELECT sample FROM meta WHERE library = 'ASIA')")
def subset_samples(spark, d):
    return site.subset(T.counts(spark, d), samples=T.meta(spark, d).where("library = 'ASIA'").select("sample"))


@query("SELECT * FROM counts WHERE sample IN (SELECT sample FROM meta WHERE library = 'ASIA') AND site IN (SELECT site FROM site_stats WHERE maf >= 0.2::DOUBLE)")
def subset_both(spark, d):
    return site.subset(T.counts(spark, d), T.site_stats(spark, d).where("maf >= 0.2D").select("site"), T.meta(spark, d).where("library = 'ASIA'").select("sample"))


@query("SELECT site, depth, s_name AS name FROM counts JOIN supplier ON sample = s_suppkey")
def reheader_ordinal(spark, d):
    names = T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"))
    return site.reheader(T.counts(spark, d).withColumnRenamed("sample", "ord"), names)


@query("SELECT site, sample, depth, gl[1] AS g0 FROM counts JOIN gl USING (site, sample)")
def checked_zip(spark, d):
    j = site.checked_join(T.counts(spark, d), T.gl(spark, d), ["site", "sample"])
    return j.select("site", "sample", "depth", F.col("gl")[0].alias("g0"))


@query("SELECT c.*, pop_code, library FROM counts c LEFT JOIN meta m ON c.sample = m.sample AND library <> 'ASIA'")
def metadata_join(spark, d):
    return T.counts(spark, d).join(T.meta(spark, d).where("library <> 'ASIA'"), "sample", "left").select("site", "sample", "depth", "pop_code", "library")


@query("SELECT site, maf, f FROM site_stats WHERE site NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_contaminants(spark, d):
    bad = T.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("site"))
    return shape.anti_join(T.site_stats(spark, d), bad, "site")


# --- keys and scalars -------------------------------------------------------------------------


@query("SELECT p_name AS scaffold, p_partkey AS pos, p_name || '_' || p_partkey AS snpcode FROM part")
def code_build(spark, d):
    p = T.read(spark, d, "part").select(F.col("p_name").alias("scaffold"), F.col("p_partkey").alias("pos"))
    return p.withColumn("snpcode", keys.site_code("scaffold", "pos"))


@query("SELECT p_partkey AS k, CASE WHEN c LIKE '%\\_%' ESCAPE '\\' THEN regexp_extract(c, '^(.*)_([^_]*)$', 1) ELSE c END AS scaffold, CASE WHEN c LIKE '%\\_%' ESCAPE '\\' THEN regexp_extract(c, '^(.*)_([^_]*)$', 2) ELSE '' END AS pos FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE 'sc_' || p_type || '_' || p_size END AS c FROM part)")
def code_split(spark, d):
    p = T.read(spark, d, "part")
    c = F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).otherwise(F.concat_ws("_", F.lit("sc"), "p_type", F.col("p_size").cast("string")))
    a, b = keys.split_code(c)
    return p.select(F.col("p_partkey").alias("k"), a.alias("scaffold"), b.alias("pos"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_brand || chr(9) || p_type || chr(9) || p_size ELSE p_brand || '_' || p_size END AS code FROM part")
def code_merge(spark, d):
    p = T.read(spark, d, "part")
    size = F.col("p_size").cast("string")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("\t", "p_brand", "p_type", size)).otherwise(F.concat_ws("\t", "p_brand", size))
    return p.select(F.col("p_partkey").alias("k"), keys.merge_code(line).alias("code"))


@query("SELECT DISTINCT param_id, regexp_extract(param_id, '^[^_]+') AS domain, CAST(regexp_extract(param_id, '_baq([0-9]+)', 1) AS INT) AS baq, CAST(regexp_extract(param_id, '_C([0-9]+)', 1) AS INT) AS C, CAST(regexp_extract(param_id, '_q([0-9]+)', 1) AS INT) AS q, CAST(regexp_extract(param_id, '_mq([0-9]+)', 1) AS INT) AS mq, CAST(regexp_extract(param_id, '_ct([0-9.]+)', 1) AS DOUBLE) AS ct FROM params")
def param_parse(spark, d):
    return T.params(spark, d).select("param_id").distinct().withColumns(keys.parse_param(F.col("param_id")))


@query("SELECT s_suppkey AS sample, CAST(s_name AS VARCHAR) AS name FROM supplier")
def basename_strip(spark, d):
    s = T.read(spark, d, "supplier")
    path = F.concat(F.lit("/data/run.1/"), F.col("s_name"), F.lit(".sorted.realigned.bam"))
    return s.select(F.col("s_suppkey").alias("sample"), keys.base_name(path).alias("name"))


@query("SELECT l_orderkey AS k, l_linenumber AS i, round(l_quantity, 6) AS sb1, round(l_discount, 6) AS sb2, round(l_tax, 6) AS sb3 FROM lineitem")
def packed_parse(spark, d):
    li = T.read(spark, d, "lineitem")
    packed = F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_quantity", "l_discount", "l_tax")])
    parts = keys.packed_numbers(packed, 3)
    return rounded(li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), *[p.alias(f"sb{i + 1}") for i, p in enumerate(parts)]))


@query("SELECT site, maf, round(2 * maf * (1 - maf), 6) AS hexp, round(2 * maf * (1 - maf) * (1 - f), 6) + 0 AS hobs FROM site_stats")
def heterozygosity(spark, d):
    e, o = site.heterozygosity(F.col("maf"), F.col("f"))
    return rounded(T.site_stats(spark, d).select("site", "maf", e.alias("hexp"), o.alias("hobs")))


@query("SELECT p_partkey AS site, round(least(greatest(p_size - 5, 0), 40) / 40, 6) AS call_rate FROM part")
def clamped_call_rate(spark, d):
    return rounded(T.read(spark, d, "part").select(F.col("p_partkey").alias("site"), site.clamped_call_rate(F.col("p_size") - 5, F.lit(40)).alias("call_rate")))


@query("SELECT site, maf, f FROM site_stats WHERE maf > 0.05::DOUBLE AND maf < 0.95::DOUBLE")
def maf_strict(spark, d):
    return site.common_sites(T.site_stats(spark, d))


@query("SELECT site, maf > 0.05::DOUBLE AS over, maf >= 0.05::DOUBLE AS from_on FROM site_stats")
def maf_onesided(spark, d):
    return T.site_stats(spark, d).select("site", (F.col("maf") > 0.05).alias("over"), (F.col("maf") >= 0.05).alias("from_on"))


@query("SELECT site, maf, CASE WHEN maf < 0.05::DOUBLE THEN NULL ELSE f END AS f FROM site_stats")
def maf_nullout(spark, d):
    return site.null_out(T.site_stats(spark, d), ["f"], "maf", 0.05)


@query("SELECT site, maf FROM site_stats WHERE round(maf / 3, 6) > 0.05::DOUBLE")
def maf_rounded(spark, d):
    return T.site_stats(spark, d).where(F.round(F.col("maf") / 3, 6) > 0.05).select("site", "maf")


@query("SELECT l_orderkey AS k, l_linenumber AS i, round(exp(-l_discount * 10), 6) AS pi, round(exp(-l_tax * 10), 6) AS theta, round(abs(l_discount - l_tax), 6) AS abs_f, round(exp(-l_discount * 10) - exp(-l_tax * 10), 6) + 0 AS d FROM lineitem")
def log_unlog_stats(spark, d):
    li = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (-F.col("l_discount") * 10).alias("log_pi"), (-F.col("l_tax") * 10).alias("log_theta"), (F.col("l_discount") - F.col("l_tax")).alias("f"))
    return rounded(sweep.unlog(li).select("k", "i", "pi", "theta", "abs_f", "d"))


@query("SELECT p_partkey AS site, CAST(p_size % 4 = 0 AS INT) AS base_A, CAST(p_size % 4 = 1 AS INT) AS base_C, CAST(p_size % 4 = 2 AS INT) AS base_G, 0 AS base_T FROM part")
def one_hot(spark, d):
    p = T.read(spark, d, "part")
    base = F.when(F.col("p_size") % 4 == 0, "A").when(F.col("p_size") % 4 == 1, "C").when(F.col("p_size") % 4 == 2, "G")
    return p.select(F.col("p_partkey").alias("site"), *keys.one_hot(base, "base"))


@query("SELECT sample, pop_code, 'baq: ' || (sample % 3) AS baq_label, CAST(floor(0.4::DOUBLE * sample + 0.5::DOUBLE) AS BIGINT) AS min_ind FROM meta")
def factor_relabel(spark, d):
    return T.meta(spark, d).select("sample", "pop_code", F.concat(F.lit("baq: "), (F.col("sample") % 3).cast("string")).alias("baq_label"), F.floor(F.col("sample") * 0.4 + 0.5).alias("min_ind"))


# --- sweep ------------------------------------------------------------------------------------

_PARSED = """p AS (SELECT site, sample, CAST(regexp_extract(param_id, '_baq([0-9]+)', 1) AS INT) AS baq, CAST(regexp_extract(param_id, '_C([0-9]+)', 1) AS INT) AS C, CAST(regexp_extract(param_id, '_mq([0-9]+)', 1) AS INT) AS mq, CAST(regexp_extract(param_id, '_ct([0-9.]+)', 1) AS DOUBLE) AS ct, l_discount AS pi, l_tax AS theta, l_extendedprice AS price FROM params)"""


def _parsed(spark, d):
    p = T.params(spark, d)
    k = keys.parse_param(F.col("param_id"))
    return p.select("site", "sample", *[k[c].alias(c) for c in ("baq", "C", "mq", "ct")], F.col("l_discount").alias("pi"), F.col("l_tax").alias("theta"), F.col("l_extendedprice").alias("price"))


def _cube_sql(keys_: str) -> str:
    one = lambda s: f"SELECT '{s}' AS statistic, {keys_}, {s} AS v, site FROM j"
    return f""", {_PARSED}, j AS (SELECT * FROM p JOIN meta USING (sample)), u AS ({one('pi')} UNION ALL {one('theta')})
 SELECT statistic, {keys_}, round(avg(v), 9) AS mean, round(median(v), 9) AS median, round(stddev_samp(v), 9) AS sd, round(var_samp(v), 9) AS var, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 9) AS iqr,
 round(stddev_samp(v) / nullif(abs(avg(v)), 0), 9) AS cv, round(quantile_cont(v, 0.25), 9) AS q25, round(quantile_cont(v, 0.75), 9) AS q75, round((quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / nullif(median(v), 0), 9) AS rel_iqr, count(DISTINCT site) AS n_sites FROM u GROUP BY statistic, {keys_}"""


def _cube(rows, by):
    """Variances of round numbers may end in a 5 at the tenth place: what is beyond the fourteenth is the order of addition."""
    return rounded(rounded(sweep.stat_cube(rows, by, ["pi", "theta"]), 14), 9)


@query(_cube_sql("baq, C, mq, ct"))
def stat_cube(spark, d):
    return _cube(_parsed(spark, d), ["baq", "C", "mq", "ct"])


@query(_cube_sql("baq, C, pop_code"))
def stat_cube_pop(spark, d):
    rows = _parsed(spark, d).join(T.meta(spark, d), "sample")
    return _cube(rows, ["baq", "C", "pop_code"])


@query(f", {_PARSED} SELECT 'core' AS slice, count(*) AS n FROM p WHERE mq <> 50 AND C IN (0, 50) UNION ALL SELECT 'extended', count(*) FROM p WHERE baq = 0 AND C IN (0, 60, 75, 100) UNION ALL SELECT 'model', count(*) FROM p WHERE baq = 0 AND C <> 50 AND ct = 0.4::DOUBLE AND pi IS NOT NULL")
def sweep_slice(spark, d):
    p = _parsed(spark, d)
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("slice"), "n")
    return n(sweep.core_slice(p), "core").union(n(sweep.extended_slice(p), "extended")).union(n(sweep.model_slice(p, 0.4, "pi"), "model"))


@query("SELECT pop_code, round(avg(h), 6) AS mean, round(stddev_samp(h), 6) AS sd, round(stddev_samp(h) / abs(avg(h)), 6) AS cv, round(quantile_cont(h, 0.75) - quantile_cont(h, 0.25), 6) AS iqr, round((quantile_cont(h, 0.75) - quantile_cont(h, 0.25)) / median(h), 6) AS rel_iqr, count(h) AS n FROM (SELECT pop_code, l_quantity / (l_quantity + l_linenumber) AS h FROM lineitem JOIN meta ON l_suppkey = sample) GROUP BY 1")
def het_summary(spark, d):
    li = T.read(spark, d, "lineitem").join(T.meta(spark, d), F.col("l_suppkey") == F.col("sample"))
    return rounded(sweep.het_summary(li.select("pop_code", F.col("l_quantity").alias("alt"), F.col("l_linenumber").alias("ref")), ["pop_code"]))


@query(f""", {_PARSED}, g AS (SELECT library, pop_code, avg(price) AS mean, median(price) AS med, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS iqr FROM p JOIN meta USING (sample) GROUP BY 1, 2)
 SELECT library, round(stddev_samp(mean) / abs(avg(mean)), 6) AS cv_means, round(quantile_cont(med, 0.75) - quantile_cont(med, 0.25), 4) AS iqr_medians, round((quantile_cont(med, 0.75) - quantile_cont(med, 0.25)) / median(med), 6) AS rel_iqr_medians, round(avg(iqr), 4) AS mean_within_iqr, count(DISTINCT pop_code) AS n_pops FROM g GROUP BY 1 HAVING count(DISTINCT pop_code) >= 3""")
def region_variation(spark, d):
    rows = _parsed(spark, d).join(T.meta(spark, d), "sample").groupBy("library", "pop_code")
    per = rows.agg(F.avg("price").alias("mean"), F.median("price").alias("median"), stats.iqr("price").alias("iqr"))
    out = sweep.region_variation(per, ["library"])
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("iqr_medians", "mean_within_iqr")}))


@query(f", {_PARSED} SELECT baq, C, round(sqrt(avg((pi - theta) * (pi - theta))), 6) AS rmse FROM p GROUP BY 1, 2")
def rmse_by_param(spark, d):
    return rounded(sweep.rmse(_parsed(spark, d).withColumn("f", F.col("pi") - F.col("theta")), ["baq", "C"], "f"))


@query(f", {_PARSED} SELECT baq, mq, round(max(pi), 6) AS fill FROM p GROUP BY 1, 2")
def heat_fill(spark, d):
    return rounded(sweep.fill(_parsed(spark, d), ["baq", "mq"], "pi", F.max))


@query("SELECT * FROM (SELECT unnest([0, 1, 2]) AS baq), (SELECT unnest([0, 50]) AS C), (SELECT unnest([20, 30]) AS q), (SELECT unnest([20, 30, 50]) AS mq), (SELECT unnest([0.4, 0.5, 0.6]::DOUBLE[]) AS ct)")
def param_grid(spark, d):
    return sweep.grid(spark, baq=[0, 1, 2], C=[0, 50], q=[20, 30], mq=[20, 30, 50], ct=[0.4, 0.5, 0.6])


@query("SELECT site, sample, statistic, round(value, 6) AS value FROM (SELECT site, sample, unnest(['l_quantity', 'l_discount', 'l_tax']) AS statistic, unnest([l_quantity, l_discount, l_tax]) AS value FROM params)")
def unpivot_long(spark, d):
    return rounded(T.params(spark, d).unpivot(["site", "sample"], ["l_quantity", "l_discount", "l_tax"], "statistic", "value"))


# --- samples ----------------------------------------------------------------------------------

_CUSTOMERS = "m AS (SELECT c_mktsegment AS pop_code, r_name AS library FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _customers(spark, d):
    c, n, r = (T.read(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("c_mktsegment").alias("pop_code"), F.col("r_name").alias("library"))


@query(f", {_CUSTOMERS}, g AS (SELECT pop_code, library, count(*) AS n FROM m GROUP BY 1, 2), w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY pop_code) AS BIGINT) AS total, row_number() OVER (PARTITION BY pop_code ORDER BY n DESC, library) AS k FROM g) SELECT pop_code, total, library, n, round(n / total, 6) AS share FROM w WHERE k = 1 AND total >= 5 AND n / total < 0.8::DOUBLE")
def library_majority(spark, d):
    return rounded(sweep.mixed_populations(_customers(spark, d)))


_DIST = """dist AS (SELECT a.n_name AS pop1, b.n_name AS pop2, CAST(abs(a.n_nationkey - b.n_nationkey) * 40 AS DOUBLE) AS km FROM nation a, nation b),
grp AS (SELECT n_name AS pop_code, r_name AS domain, 'lib' || (n_nationkey % 3) AS library FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _dist(spark, d):
    n = T.read(spark, d, "nation").select("n_name", "n_nationkey")
    wide = n.toDF("pop1", "k1").join(n.toDF("pop2", "k2"), F.col("k1") > -1)
    km = (F.abs(F.col("k1") - F.col("k2")) * 40).cast("double")
    g = T.read(spark, d, "nation").join(T.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    groups = g.select(F.col("n_name").alias("pop_code"), F.col("r_name").alias("domain"), F.concat(F.lit("lib"), (F.col("n_nationkey") % 3).cast("string")).alias("library"))
    return wide.select("pop1", "pop2", km.alias("km")), groups


@query(f", {_DIST} SELECT least(pop1, pop2) || '_' || greatest(pop1, pop2) AS pair, min(km) AS km, any_value(a.domain) AS domain FROM dist JOIN grp a ON pop1 = a.pop_code JOIN grp b ON pop2 = b.pop_code WHERE pop1 <> pop2 AND a.domain = b.domain AND a.library <> b.library AND km <= CASE a.domain WHEN 'ASIA' THEN 100 ELSE 250 END GROUP BY 1")
def pop_pairs(spark, d):
    dist, groups = _dist(spark, d)
    return sweep.close_pairs(dist, groups, {"ASIA": 100}, 250)


@query(f", {_DIST}, pr AS (SELECT pop1, pop2 FROM dist WHERE km = 40 AND pop1 LIKE 'A%') SELECT pop_code, library = 'lib0' AS mixed, pop_code IN (SELECT pop1 FROM pr UNION SELECT pop2 FROM pr) AS in_pair FROM grp")
def pop_status(spark, d):
    dist, groups = _dist(spark, d)
    return sweep.population_status(groups, groups.where("library = 'lib0'"), dist.where("km = 40 and pop1 like 'A%'"))


@query("SELECT c.site, arg_min(sample, (-depth, sample)) AS sample, max(depth) AS depth FROM counts c GROUP BY 1")
def first_row(spark, d):
    return sweep.first_row(T.counts(spark, d), ["site"], [F.negative("depth"), F.col("sample")])


@query("SELECT site, sample, depth FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth DESC, sample) AS k FROM counts) WHERE k <= 3")
def head_k(spark, d):
    return sweep.top_within(T.counts(spark, d), ["site"], [F.desc("depth"), "sample"], 3)


@query("SELECT a.sample AS sample_1, b.sample AS sample_2, a.pop_code = b.pop_code AS same_pop FROM meta a JOIN meta b ON a.sample < b.sample")
def pairs_self_theta(spark, d):
    return models.sample_pairs(T.meta(spark, d).select("sample", "pop_code")).select("sample_1", "sample_2", (F.col("pop_code_1") == F.col("pop_code_2")).alias("same_pop"))


# --- genotypes --------------------------------------------------------------------------------

_CALLS = "k AS (SELECT site, sample, CASE WHEN len(list_filter(gl, lambda x: x = list_max(gl))) = 1 THEN list_position(gl, list_max(gl)) - 1 ELSE -1 END AS c FROM gl), cls AS (SELECT unnest([0, 1, 2]) AS c, unnest(['homRef', 'het', 'homAlt']) AS genotype), sp AS (SELECT site, cls.genotype, sample, CASE WHEN k.c = cls.c THEN depth ELSE 0 END AS depth FROM counts JOIN k USING (site, sample), cls)"


def _split(spark, d):
    return genotype.split_cells(T.cells(spark, d))


@query(f", {_CALLS} SELECT site, sample, CAST(c AS INT) AS call FROM k")
def genotype_argmax(spark, d):
    return T.gl(spark, d).select("site", "sample", genotype.call(F.col("gl")).alias("call"))


@query(f", {_CALLS} SELECT site, genotype, sample, depth FROM sp")
def split_genotype(spark, d):
    return _split(spark, d)


@query(f", {_CALLS} SELECT site, genotype, sample, depth FROM sp WHERE site IN (SELECT site FROM site_stats WHERE maf > 0.05::DOUBLE)")
def split_genotype_maf(spark, d):
    return site.subset(_split(spark, d), sites=T.site_stats(spark, d).where("maf > 0.05D").select("site"))


@query(f", {_CALLS} SELECT site, genotype, count(*) AS n FROM sp WHERE depth <> 0 GROUP BY 1, 2 HAVING count(*) >= 5")
def observed_rows(spark, d):
    return genotype.observed_rows(_split(spark, d))


@query(f", {_CALLS} SELECT site, sample, nullif(CAST(sum(depth) AS BIGINT), 0) AS depth FROM sp GROUP BY 1, 2")
def aggregate_depth(spark, d):
    return genotype.aggregate_depth(_split(spark, d))


_PANEL = """b AS (SELECT *, avg(x) OVER w AS m, stddev_samp(x) OVER w AS s, sum(x) OVER w AS t, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY site)),
q AS (SELECT site, quantile_cont(x, 0.25) AS q1, median(x) AS q2, quantile_cont(x, 0.75) AS q3 FROM x GROUP BY 1),
panel AS (SELECT site, any_value(n) AS n, round(any_value(m), 6) AS mean, round(any_value(q2), 6) AS median, round(any_value(s), 6) AS sd, round(1.4826::DOUBLE * median(abs(x - q2)), 6) AS mad, round(any_value(s / m), 6) AS cv, round(any_value(q3 - q1), 6) AS iqr,
 round(CASE WHEN any_value(n) >= 5 THEN avg(pow(x - m, 4)) / nullif(pow(any_value(s), 4), 0) - 3 END, 6) + 0 AS kurtosis,
 round(CASE WHEN any_value(n) >= 5 THEN avg(pow(x - m, 3)) / nullif(pow(any_value(s), 3), 0) * sqrt(any_value(n) * (any_value(n) - 1)) / (any_value(n) - 2) END, 6) + 0 AS skewness,
 round(CASE WHEN any_value(n) > 1 THEN sum(-x / t * ln(x / t)) / ln(any_value(n)) END, 6) AS entropy,
 round(CASE WHEN any_value(n) >= 5 THEN avg(CAST(x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) AS DOUBLE)) END, 6) AS extreme_share FROM b JOIN q USING (site) GROUP BY 1)"""


def _panel(spark, d):
    return rounded(stats.summary_panel(T.counts(spark, d).select("site", F.col("depth").cast("double").alias("x")), ["site"], "x"))


_X = "x AS (SELECT site, CAST(depth AS DOUBLE) AS x FROM counts)"


@query(f", {_X}, {_PANEL} SELECT * FROM panel")
def row_panel(spark, d):
    return _panel(spark, d)


@query(f", {_X}, {_PANEL} SELECT site, mad FROM panel")
def mad(spark, d):
    return _panel(spark, d).select("site", "mad")


@query(f", {_X}, {_PANEL} SELECT site, skewness, kurtosis FROM panel")
def skew_kurt(spark, d):
    return _panel(spark, d).select("site", "skewness", "kurtosis")


@query(f", {_X}, {_PANEL} SELECT site, entropy FROM panel")
def entropy(spark, d):
    return _panel(spark, d).select("site", "entropy")


@query(f", {_X}, {_PANEL} SELECT site, extreme_share FROM panel")
def tukey_extreme(spark, d):
    return _panel(spark, d).select("site", "extreme_share")


def _z(by: str, col: str, src: str, out: str) -> str:
    return f"SELECT *, ({col} - avg({col}) OVER (PARTITION BY {by})) / nullif(stddev_samp({col}) OVER (PARTITION BY {by}), 0) AS {out} FROM {src}"


_Z = f"v AS (SELECT site, sample, CAST(depth AS DOUBLE) AS v FROM counts), z1 AS ({_z('sample', 'v', 'v', 'zs')}), z2 AS ({_z('site', 'v', 'z1', 'zr')}), z3 AS ({_z('site', 'zs', 'z2', 'zsl')}), z4 AS ({_z('sample', 'zr', 'z3', 'zls')})"


def _standard(spark, d):
    return genotype.standardise(T.counts(spark, d))


@query(f", {_Z} SELECT site, sample, round(zs, 6) + 0 AS z FROM z4")
def z_sample(spark, d):
    return rounded(_standard(spark, d).select("site", "sample", F.col("z_sample").alias("z")))


@query(f", {_Z} SELECT site, sample, round(zr, 6) + 0 AS z FROM z4")
def z_site(spark, d):
    return rounded(_standard(spark, d).select("site", "sample", F.col("z_site").alias("z")))


@query(f", {_Z} SELECT site, sample, round(zsl, 5) + 0 AS z FROM z4")
def z_double_sl(spark, d):
    return rounded(_standard(spark, d).select("site", "sample", F.col("z_double_sl").alias("z")), 5)


@query(f", {_Z} SELECT site, sample, round(zls, 5) + 0 AS z FROM z4")
def z_double_ls(spark, d):
    return rounded(_standard(spark, d).select("site", "sample", F.col("z_double_ls").alias("z")), 5)


_DIFF = "".join(f", round({a}_m - {b}_m, 6) + 0 AS mean_{a}_minus_{b}, round(CASE WHEN {a}_m > 0 AND {b}_m > 0 THEN ln({a}_m / {b}_m) END, 6) + 0 AS mean_{a}_over_{b}" for a, b in (("Maj", "Min"), ("Maj", "Het"), ("Min", "Het")))


@query(f""", {_CALLS}, g AS (SELECT site, CASE WHEN genotype = 'het' THEN 'Het' WHEN (genotype = 'homRef') = (maf <= 0.5::DOUBLE) THEN 'Maj' ELSE 'Min' END AS g, CAST(depth AS DOUBLE) AS v FROM sp JOIN site_stats USING (site) WHERE depth <> 0),
 a AS (SELECT site, avg(v) FILTER (g = 'Maj') AS Maj_m, avg(v) FILTER (g = 'Het') AS Het_m, avg(v) FILTER (g = 'Min') AS Min_m FROM g GROUP BY 1)
 SELECT site, round(Maj_m, 6) AS mean_Maj, round(Het_m, 6) AS mean_Het, round(Min_m, 6) AS mean_Min{_DIFF} FROM a""")
def class_diff_pivot(spark, d):
    s = _split(spark, d).join(T.site_stats(spark, d), "site").where("depth <> 0")
    s = s.withColumn("genotype", genotype.major_minor(F.col("genotype"), F.col("maf")))
    return rounded(genotype.class_differences(s.groupBy("site", "genotype").agg(F.avg("depth").alias("mean")), ["mean"]))


# --- intervals --------------------------------------------------------------------------------

_ISLANDS = "isl AS (SELECT scaffold, min(pos) - 1 AS s, max(pos) AS e FROM (SELECT scaffold, pos, pos - row_number() OVER (PARTITION BY scaffold ORDER BY pos) AS g FROM positions) GROUP BY scaffold, g)"


@query(f', {_ISLANDS} SELECT scaffold, s AS start, e AS "end" FROM isl')
def islands(spark, d):
    return intervals.islands(T.positions(spark, d))


@query("SELECT scaffold, pos FROM positions")
def island_sites_1based(spark, d):
    return intervals.island_sites(intervals.islands(T.positions(spark, d)))


@query("""SELECT o_custkey AS name, CAST(n AS BIGINT) AS length FROM (SELECT o_custkey, n, sum(n) OVER (ORDER BY n DESC, o_custkey ROWS UNBOUNDED PRECEDING) - n AS before FROM (SELECT o_custkey, count(*) * 10 + o_custkey % 7 AS n FROM orders GROUP BY 1)) WHERE before <= 20000""")
def length_cutoff(spark, d):
    n = T.read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return intervals.length_cutoff(n.select(F.col("o_custkey").alias("name"), (F.col("n") * 10 + F.col("o_custkey") % 7).alias("length")), 20000)


@query("""SELECT o_orderpriority AS chrom, CAST(sum(o_custkey) AS BIGINT) AS length FROM orders GROUP BY 1""")
def scaffold_lengths(spark, d):
    return T.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("chrom")).agg(F.sum("o_custkey").alias("length"))


@query(""", pad AS (SELECT chrom, s - 30 AS s, e + 30 AS e FROM intervals), r AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM pad),
 k AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM r), mg AS (SELECT chrom, min(s) AS s, max(e) AS e FROM k GROUP BY chrom, k.k),
 ref AS (SELECT c_custkey AS chrom, 4000 AS length FROM customer),
 gaps AS (SELECT chrom, 0 AS s, least(coalesce(min(mg.s), max(length)), max(length)) AS e FROM ref LEFT JOIN mg USING (chrom) GROUP BY 1
  UNION ALL SELECT chrom, greatest(mg.e, 0), least(coalesce(lead(mg.s) OVER (PARTITION BY chrom ORDER BY mg.s), length), length) FROM mg JOIN ref USING (chrom))
 SELECT chrom, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM gaps WHERE e - s >= 100""")
def interval_subtract(spark, d):
    return intervals.subtract(T.references(spark, d), T.intervals(spark, d), 30, 100)


@query("""SELECT DISTINCT a.chrom, a.s AS start, a.e AS "end" FROM (SELECT chrom, s, s + 20 AS e FROM intervals WHERE s % 2 = 0) a JOIN (SELECT chrom, s, s + 20 AS e FROM intervals WHERE s % 2 = 1) b ON a.chrom = b.chrom AND a.s < b.e AND a.e > b.s""")
def interval_overlap(spark, d):
    iv = T.intervals(spark, d).withColumn("end", F.col("start") + 20)
    return intervals.overlap(iv.where("start % 2 = 0").distinct(), iv.where("start % 2 = 1"))


@query("SELECT p_partkey AS site, CAST(ntile(20) OVER (ORDER BY p_partkey) AS INT) AS chunk FROM part")
def nway_split(spark, d):
    return intervals.split_evenly(T.read(spark, d, "part").select(F.col("p_partkey").alias("site")), 20, "site")


@query("SELECT p_partkey AS site, (p_partkey * 7919 + 13) % 10 < 7 AS is_train, CAST(p_partkey // 10 % 5 AS INT) AS fold FROM part")
def hash_split_folds(spark, d):
    return models.split_folds(T.read(spark, d, "part").select(F.col("p_partkey").alias("site")), "site")


# --- statistics -------------------------------------------------------------------------------


@query(""", p AS (SELECT p_partkey AS site, CASE WHEN p_size > 1 THEN CAST(p_partkey * 7 % 1000 + 1 AS DOUBLE) / 1001 END AS p FROM part),
 r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS n FROM p WHERE p IS NOT NULL)
 SELECT p.site, round(p.p, 6) AS p, round(CASE WHEN p.p IS NOT NULL THEN least(q, 1) END, 6) AS qval FROM p LEFT JOIN (SELECT site, min(p * n / k) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM r) USING (site)""")
def bh_adjust(spark, d):
    x = T.read(spark, d, "part").select(F.col("p_partkey").alias("site"), F.when(F.col("p_size") > 1, (F.col("p_partkey") * 7 % 1000 + 1).cast("double") / 1001).alias("p"))
    return rounded(stats.bh_adjust(x, "p", "site").select("site", "p", "qval"))


_LABEL = "x AS (SELECT p_retailprice AS s, p_size > 25 AS y FROM part)"


def _labelled(spark, d):
    return T.read(spark, d, "part").select(F.col("p_retailprice").alias("s"), (F.col("p_size") > 25).alias("y"))


@query(f""", {_LABEL}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM x)
 SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc FROM r""")
def roc_auc(spark, d):
    return rounded(stats.auc(stats.roc(_labelled(spark, d), "s", "y")).select("auc"))


@query(f""", {_LABEL}, t AS (SELECT s, sum(CAST(y AS INT)) AS p, sum(CAST(NOT y AS INT)) AS q FROM x GROUP BY 1),
 c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) / sum(p) OVER () AS tpr, sum(q) OVER (ORDER BY s DESC) / sum(q) OVER () AS fpr FROM t)
 SELECT round(s, 6) AS threshold, round(tpr, 6) AS sensitivity, round(1 - fpr, 6) AS specificity FROM c ORDER BY round(tpr - fpr, 9) DESC, s DESC LIMIT 1""")
def youden_best(spark, d):
    return rounded(stats.auc(stats.roc(_labelled(spark, d), "s", "y")).select("threshold", "sensitivity", "specificity"))


@query("""SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem""")
def corr_matrix(spark, d):
    return rounded(models.correlation_matrix(T.read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query(""", m AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) * count(*) AS aa, covar_pop(b, b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS bm, covar_pop(y, y) * count(*) AS yy FROM (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem)),
 c AS (SELECT *, (ay * bb - bm * ab) / (aa * bb - ab * ab) AS b1, (bm * aa - ay * ab) / (aa * bb - ab * ab) AS b2, aa * bb - ab * ab AS det FROM m), s AS (SELECT *, (yy - b1 * ay - b2 * bm) / (n - 3) AS s2 FROM c)
 SELECT n, round(my - b1 * ma - b2 * mb, 3) AS b0, round(b1, 3) AS b1, round(b2, 3) AS b2, round(b1 / sqrt(s2 * bb / det), 3) AS t1, round(b2 / sqrt(s2 * aa / det), 3) AS t2 FROM s""")
def ols_t(spark, d):
    return rounded(models.ols_two(T.read(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_discount"), 3)


@query("""SELECT l_orderkey AS k, l_linenumber AS i, CASE WHEN t > 50 THEN 0 ELSE CAST(floor(50 * sqrt((50 - greatest(t, 0)) / 50) + 0.499::DOUBLE) AS INT) END AS cap FROM (SELECT l_orderkey, l_linenumber, l_quantity - 4.343::DOUBLE * (l_linenumber * ln(100) - ln(factorial(l_linenumber)::DOUBLE)) + l_tax * 100 / 5 AS t FROM lineitem)""")
def mq_cap(spark, d):
    li = T.read(spark, d, "lineitem")
    cap = reads.mapq_cap(F.col("l_quantity"), F.col("l_linenumber"), F.lit(100), F.col("l_tax") * 100, 50)
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), cap.alias("cap"))


_CUTS = "cut AS (SELECT avg(y) AS c, stddev_samp(y) AS s FROM (SELECT DISTINCT row, y FROM leaves)), cl AS (SELECT l.row, tree, leaf_id, y, CASE WHEN y >= c + s THEN 'extreme' WHEN abs(y - c) < 0.5 * s THEN 'background' END AS cls FROM leaves l, cut)"


def _classified(spark, d):
    x = T.leaves(spark, d)
    return rules.classify(x, "y", rules.thresholds(x.where("tree = 0").select("row", "y").distinct(), "y"), 0.5)


@query(f", {_CUTS} SELECT row, cls FROM cl WHERE tree = 0")
def extreme_bg(spark, d):
    return _classified(spark, d).where("tree = 0").select("row", "cls")


@query("""SELECT row, CASE WHEN y >= c + 1.5 * s THEN 'extreme' WHEN abs(y - c) < s THEN 'background' END AS cls FROM (SELECT DISTINCT row, y FROM leaves), (SELECT med AS c, 1.4826::DOUBLE * median(abs(y - med)) AS s FROM (SELECT DISTINCT row, y FROM leaves WHERE row % 2 = 0), (SELECT median(y) AS med FROM (SELECT DISTINCT row, y FROM leaves WHERE row % 2 = 0)) GROUP BY med) WHERE row % 2 = 1""")
def sigma_rule_apply(spark, d):
    x = T.leaves(spark, d).where("tree = 0").select("row", "y").distinct()
    cuts = rules.thresholds(x.where("row % 2 = 0"), "y", 1.5, "median", "mad")
    return rules.classify(x.where("row % 2 = 1"), "y", cuts).select("row", "cls")


_LLR = "lc AS (SELECT tree, leaf_id, count(*) FILTER (cls = 'extreme') AS n_extreme, count(*) FILTER (cls = 'background') AS n_bg FROM cl GROUP BY 1, 2), ll AS (SELECT *, ln((n_extreme / nullif(sum(n_extreme) OVER w, 0) + 1e-12) / (n_bg / nullif(sum(n_bg) OVER w, 0) + 1e-12)) AS llr FROM lc WINDOW w AS (PARTITION BY tree))"


@query(f", {_CUTS}, {_LLR} SELECT tree, leaf_id, n_extreme, n_bg FROM lc")
def leaf_counts(spark, d):
    return rules.leaf_counts(_classified(spark, d))


@query(f", {_CUTS}, {_LLR} SELECT tree, leaf_id, n_extreme, n_bg, round(llr, 5) AS llr FROM ll")
def leaf_llr(spark, d):
    return rounded(rules.leaf_llr(rules.leaf_counts(_classified(spark, d))), 5)


@query(f", {_CUTS}, {_LLR} SELECT row, round(avg(llr), 5) AS mean_llr FROM cl JOIN ll USING (tree, leaf_id) GROUP BY 1")
def row_similarity(spark, d):
    c = _classified(spark, d)
    return rounded(rules.row_similarity(c, rules.leaf_llr(rules.leaf_counts(c))), 5)


_STEPS = "st AS (SELECT p_size % 3 AS tree, p_partkey % 50 AS leaf_id, row_number() OVER (PARTITION BY p_size % 3, p_partkey % 50 ORDER BY p_partkey) AS depth, 'f' || (p_partkey % 4) AS feature, CASE WHEN p_partkey % 7 < 4 THEN '>=' ELSE '<' END AS direction, CAST(p_size AS DOUBLE) AS thresh_bin FROM part)"


def _steps(spark, d):
    p, k = T.read(spark, d, "part"), F.col("p_partkey")
    depth = F.row_number().over(Window.partitionBy(F.col("p_size") % 3, k % 50).orderBy(k))
    return p.select((F.col("p_size") % 3).alias("tree"), (k % 50).alias("leaf_id"), depth.alias("depth"), F.concat(F.lit("f"), (k % 4).cast("string")).alias("feature"), F.when(k % 7 < 4, ">=").otherwise("<").alias("direction"), F.col("p_size").cast("double").alias("thresh_bin"))


@query(f", {_STEPS} SELECT tree, leaf_id, round(sum(CASE WHEN k <= 2 THEN n ELSE 0 END) / sum(n), 6) AS topk_share FROM (SELECT *, row_number() OVER (PARTITION BY tree, leaf_id ORDER BY n DESC, feature) AS k FROM (SELECT tree, leaf_id, feature, count(*) AS n FROM st GROUP BY 1, 2, 3)) GROUP BY 1, 2")
def topk_share(spark, d):
    return rounded(rules.topk_share(_steps(spark, d)))


_RULES = """tg AS (SELECT *, max(thresh_bin) OVER w AS up, min(thresh_bin) OVER w AS dn FROM st WINDOW w AS (PARTITION BY tree, leaf_id, feature, direction ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 rs AS (SELECT tree, leaf_id, string_agg(feature || ' ' || direction || ' ' || printf('%.2e', thresh_bin), ' | ' ORDER BY depth) AS rule_str, CAST(count(*) AS INT) AS rule_len FROM tg WHERE CASE WHEN direction = '>=' THEN up IS NULL OR thresh_bin > up + 1e-12 ELSE dn IS NULL OR thresh_bin < dn - 1e-12 END GROUP BY 1, 2)"""


@query(f", {_STEPS}, {_RULES} SELECT * FROM rs")
def rule_strings(spark, d):
    return rules.rule_strings(rules.tighten(_steps(spark, d)))


_PARTS = """nf AS (SELECT row, avg(s) AS mean_topk FROM cl JOIN (SELECT unnest([0, 1, 2]) AS tree, unnest([0.5, 0.25, 0.75]::DOUBLE[]) AS s) USING (tree) GROUP BY 1)"""


@query(f", {_CUTS}, {_PARTS} SELECT row, round(mean_topk, 6) AS mean_topk FROM nf")
def feature_conc(spark, d):
    share = spark.createDataFrame([(t, i, s) for t, s in enumerate((0.5, 0.25, 0.75)) for i in range(3)], "tree int, leaf_id int, topk double").withColumn("llr", F.lit(0.0))
    return rounded(rules.row_similarity(_classified(spark, d), share, ["topk"]).select("row", "mean_topk"))


#: Leaves 0 of trees 0 and 1 share a rule, so that pooling matters.
_TEXT = [(t, i, f"rule{0 if i == 0 and t < 2 else 3 * t + i}", 1 + i) for t in range(3) for i in range(3)]
_TEXT_SQL = "rt AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, {i}, '{s}', {n})" for t, i, s, n in _TEXT) + ") v(tree, leaf_id, rule_str, rule_len))"


def _rule_text(spark):
    return spark.createDataFrame(_TEXT, "tree int, leaf_id int, rule_str string, rule_len int")


def _harvest_sql(key: str, where: str = "true", more: str = "") -> str:
    return f""", {_CUTS}, {_TEXT_SQL}, kn AS (SELECT * FROM cl WHERE cls IS NOT NULL AND {where}), tt AS (SELECT count(*) FILTER (cls = 'extreme') AS N, count(*) FILTER (cls = 'background') AS B FROM (SELECT DISTINCT row, cls FROM kn)),
 rw AS (SELECT DISTINCT {key}, rule_len, row, cls FROM kn JOIN rt USING (tree, leaf_id) {more}), g AS (SELECT {key}, max(rule_len) AS rule_len, count(DISTINCT row) FILTER (cls = 'extreme') AS n_extreme, count(DISTINCT row) FILTER (cls = 'background') AS n_bg FROM rw GROUP BY {key}),
 h AS (SELECT *, n_extreme + n_bg AS support FROM g, tt WHERE n_extreme + n_bg >= 1), hx AS (SELECT *, unnest(range(greatest(n_extreme, 1, support - B), least(N, support) + 1)) AS x FROM h),
 pv AS (SELECT {key}, least(1, sum(exp(lgamma(N + 1) - lgamma(x + 1) - lgamma(N - x + 1) + lgamma(B + 1) - lgamma(support - x + 1) - lgamma(B - support + x + 1) - lgamma(N + B + 1) + lgamma(support + 1) + lgamma(N + B - support + 1)))) AS pval FROM hx GROUP BY {key}),
 qv AS (SELECT *, least(1, min(pval * tests / ranked) OVER (ORDER BY pval DESC)) AS qval FROM (SELECT *, count(*) OVER () AS tests, count(*) OVER (ORDER BY pval) AS ranked FROM pv))
 SELECT {key}, rule_len, n_extreme, n_bg, support, round(n_extreme / support, 6) AS precision, round(n_extreme / N, 6) AS recall, round((n_extreme + 0.5) * (B - n_bg + 0.5) / ((n_bg + 0.5) * (N - n_extreme + 0.5)), 6) AS odds_ratio, round(n_extreme / support / (N / (N + B)), 6) AS lift, round(pval, 6) AS pval, round(qval, 6) AS qval FROM h JOIN qv USING ({key})"""


_SHOWN = ["rule_len", "n_extreme", "n_bg", "support", "precision", "recall", "odds_ratio", "lift", "pval", "qval"]


@query(_harvest_sql("rule_str"))
def rule_pool(spark, d):
    return rounded(rules.harvest(_classified(spark, d), _rule_text(spark), min_support=1).select("rule_str", *_SHOWN))


@query(_harvest_sql("rule_str, tree, leaf_id"))
def rule_unpooled(spark, d):
    return rounded(rules.harvest(_classified(spark, d), _rule_text(spark), pooled=False, min_support=1).select("rule_str", "tree", "leaf_id", *_SHOWN))


@query(_harvest_sql("rule_str", "row % 2 = 1", "WHERE rule_str IN ('rule0', 'rule2', 'rule8')"))
def rule_validate(spark, d):
    text = _rule_text(spark)
    got = rules.validate(_classified(spark, d).where("row % 2 = 1"), text, text.where("rule_str in ('rule0', 'rule2', 'rule8')"))
    return rounded(got.select("rule_str", *_SHOWN))


@query(""", t AS (SELECT DISTINCT p_size % 10 AS k, 12 AS m, 30 AS n, 10 + p_size % 5 AS s FROM part),
 lf AS (SELECT i, sum(ln(greatest(i, 1))) OVER (ORDER BY i) AS f FROM range(0, 43) r(i)), x AS (SELECT t.*, unnest(range(greatest(k, 1), least(m, s) + 1)) AS x FROM t)
 SELECT k, m, n, s, round(sum(exp(a.f - b.f - c.f + e.f - g.f - h.f - o.f + p.f + q.f)), 6) AS pval FROM x JOIN lf a ON a.i = m JOIN lf b ON b.i = x JOIN lf c ON c.i = m - x JOIN lf e ON e.i = n JOIN lf g ON g.i = s - x JOIN lf h ON h.i = n - s + x JOIN lf o ON o.i = m + n JOIN lf p ON p.i = s JOIN lf q ON q.i = m + n - s GROUP BY 1, 2, 3, 4""")
def hypergeom(spark, d):
    x = T.read(spark, d, "part").select((F.col("p_size") % 10).alias("k"), F.lit(12).alias("m"), F.lit(30).alias("n"), (10 + F.col("p_size") % 5).alias("s")).distinct()
    return rounded(stats.hypergeom_upper(x, "k", "m", "n", "s"))


@query(""", nd AS (SELECT k % 3 AS tree, k // 3 AS id FROM range(0, 93) r(k)), pt AS (SELECT tree, id, 0 AS depth, CAST(id AS VARCHAR) AS path FROM nd WHERE id = 0 UNION ALL SELECT nd.tree, nd.id, depth + 1, path || '>' || nd.id FROM pt JOIN nd ON nd.tree = pt.tree AND nd.id IN (2 * pt.id + 1, 2 * pt.id + 2))
 SELECT tree, id, depth, path FROM pt""")
def tree_paths(spark, d):
    k = spark.range(93).select((F.col("id") % 3).alias("tree"), F.floor(F.col("id") / 3).alias("id"))
    child = lambda i: F.when(2 * F.col("id") + i < 31, 2 * F.col("id") + i)
    return rules.tree_paths(k.withColumns({"yes": child(1), "no": child(2)}))


@query("SELECT mask, count(*) AS n FROM (SELECT site, sum(DISTINCT CASE library WHEN 'AFRICA' THEN 1 WHEN 'AMERICA' THEN 2 WHEN 'ASIA' THEN 4 WHEN 'EUROPE' THEN 8 ELSE 16 END)::BIGINT AS mask FROM counts JOIN meta USING (sample) WHERE depth > 60 GROUP BY 1) GROUP BY 1 ORDER BY n DESC, mask LIMIT 15")
def upset_counts(spark, d):
    deep = T.counts(spark, d).where("depth > 60").join(T.meta(spark, d), "sample")
    return shape.membership_counts(deep, "site", "library", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])


@query("""SELECT 'intersect' AS op, site FROM (SELECT site FROM counts WHERE depth > 100 INTERSECT SELECT site FROM site_stats WHERE maf > 0.5::DOUBLE) UNION ALL SELECT 'union', site FROM (SELECT site FROM counts WHERE depth > 100 UNION SELECT site FROM site_stats WHERE maf > 0.5::DOUBLE) UNION ALL SELECT 'minus', site FROM (SELECT site FROM site_stats WHERE maf > 0.5::DOUBLE EXCEPT SELECT site FROM counts WHERE depth > 100)""")
def set_ops(spark, d):
    a, b = T.counts(spark, d).where("depth > 100").select("site"), T.site_stats(spark, d).where("maf > 0.5D").select("site")
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "site")
    return shape.stack([tag(shape.common_keys([a, b], "site"), "intersect"), tag(shape.union_keys([a, b], "site"), "union"), tag(shape.minus_keys(b, a, "site"), "minus")])


@query("SELECT DISTINCT least(a.library, b.library) || '_' || greatest(a.library, b.library) AS pair FROM meta a, meta b WHERE a.library <> b.library")
def symmetric_pairs(spark, d):
    libs = T.meta(spark, d).select("library").distinct()
    j = models.sample_pairs(libs)
    both = j.select(F.col("library_1").alias("a"), F.col("library_2").alias("b")).union(j.select("library_2", "library_1"))
    return both.select(F.concat_ws("_", F.least("a", "b"), F.greatest("a", "b")).alias("pair")).distinct()


@query("SELECT library, CAST(count(*) AS BIGINT) AS n, list_sort(list(sample)) AS samples FROM meta GROUP BY 1")
def collect_ids(spark, d):
    return T.meta(spark, d).groupBy("library").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("sample")).alias("samples"))


@query("SELECT p_partkey AS site, CAST(greatest(1, least(4, len(list_filter([0, 10, 20, 30, 40], lambda b: b <= p_size)))) AS INT) AS bin FROM part")
def bin_lookup(spark, d):
    breaks = F.array(*[F.lit(b) for b in (0, 10, 20, 30, 40)])
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("site"), rules.find_bin(F.col("p_size"), breaks).alias("bin"))


# --- whole tables by name, and reports ------------------------------------------------------------


@query("SELECT site, sample, depth, gl[1] AS g0 FROM counts NATURAL JOIN gl")
def natural_join(spark, d):
    return shape.natural_join(T.counts(spark, d), T.gl(spark, d)).select("site", "sample", "depth", F.col("gl")[0].alias("g0"))


@query("SELECT p_partkey AS site, p_size, l_linenumber FROM part LEFT JOIN (SELECT l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') ON p_partkey = l_partkey")
def left_many(spark, d):
    li = T.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("site"), "l_linenumber")
    return shape.left_many(T.read(spark, d, "part").select(F.col("p_partkey").alias("site"), "p_size"), li)


@query("SELECT s_suppkey AS sample, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, n_name) AS label FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def filled_join(spark, d):
    a = T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("label"))
    return shape.filled_join(a, T.meta(spark, d).select("sample", F.col("pop_code").alias("label")), ["sample"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name NOT LIKE '%AN%'")
def without_pattern(spark, d):
    return shape.without_pattern(T.read(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", "AN")


@query("SELECT s_suppkey AS sample, round(CAST(s_suppkey % 5 AS DOUBLE) / nullif(s_suppkey % 5 + s_suppkey % 3, 0), 6) AS region_prop FROM supplier")
def region_share(spark, d):
    k = F.col("s_suppkey")
    return rounded(T.read(spark, d, "supplier").select(k.alias("sample"), shape.share(k % 5, k % 3).cast("double").alias("region_prop")))


@query("SELECT s_suppkey AS k, s_name AS name, NULL AS size FROM supplier UNION ALL SELECT p_partkey, NULL, p_size FROM part UNION ALL SELECT n_nationkey, n_name, NULL FROM nation")
def stack_fill(spark, d):
    r = lambda t: T.read(spark, d, t)
    return shape.stack([r("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), r("part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size")), r("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))])


@query("""SELECT chrom, s AS start, e AS "end" FROM intervals UNION ALL SELECT c_custkey, 0, 4000 FROM customer""")
def concat_beds(spark, d):
    whole = T.references(spark, d).select(F.col("chrom").alias("c"), F.lit(0).cast("long").alias("s"), "length")
    return shape.concat_beds([T.intervals(spark, d), whole])


@query("SELECT site FROM counts WHERE depth > 60 INTERSECT SELECT site FROM site_stats WHERE maf > 0.2::DOUBLE INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def common_sites_of_three(spark, d):
    r = T.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("site"))
    return shape.common_keys([T.counts(spark, d).where("depth > 60"), T.site_stats(spark, d).where("maf > 0.2D"), r], "site")


@query("SELECT 'x' || o_custkey AS chrom, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS start, o_orderkey AS k FROM orders ORDER BY 1, 2, 3")
def genome_sort(spark, d):
    day = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("long")
    o = T.read(spark, d, "orders").select(F.concat(F.lit("x"), F.col("o_custkey").cast("string")).alias("chrom"), day.alias("start"), F.col("o_orderkey").alias("k"))
    return shape.arrange(o, "chrom", "start", "k")


@query("SELECT library, pop_code, sample FROM meta ORDER BY library, pop_code DESC, sample")
def arrange_keys(spark, d):
    return shape.arrange(T.meta(spark, d).select("library", "pop_code", "sample"), "library", "-pop_code", "sample")


@query("SELECT site, s AS stat, round(v, 6) + 0 AS value FROM (SELECT p_partkey AS site, unnest(['size', 'price']) AS s, unnest([p_size::DOUBLE, p_retailprice::DOUBLE]) AS v FROM part)")
def longer_by_suffix(spark, d):
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("site"), F.col("p_size").alias("size_x"), F.col("p_retailprice").alias("price_x"), "p_name")
    return rounded(shape.longer_by_suffix(p, ["site"], "_x"))


@query("SELECT l_orderkey AS k, l_linenumber AS i, unnest(['flag', 'status']) AS parameter, unnest([l_returnflag, l_linestatus]) AS level FROM lineitem")
def parameter_levels(spark, d):
    li = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return shape.levels(li, ["k", "i"], ["flag", "status"])


@query("SELECT library, sample FROM meta")
def unlist(spark, d):
    per = T.meta(spark, d).groupBy("library").agg(F.collect_list("sample").alias("sample"))
    return shape.unlist(per, "sample")


@query("SELECT site, depth FROM counts")
def checked_measure(spark, d):
    return shape.checked_measure(T.counts(spark, d).select("site", "depth"), "depth")


def _tests(spark, d):
    n = lambda i: ((F.col("p_partkey") * i) % 97).cast("string")
    pack = lambda *i: F.concat_ws(":", *map(n, i))
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("site"), pack(1, 2, 3).alias("sb"), pack(4, 5).alias("hwe"), pack(6, 7).alias("base_q"), pack(8, 9).alias("map_q"), pack(10, 11).alias("edge"))


_FIELDS = ", ".join(f"CAST(p_partkey * {i} % 97 AS DOUBLE) AS {n}" for i, n in enumerate([x for g in summaries.TESTS.values() for x in g], 1))


@query(f"""SELECT c.site, sum(depth)::BIGINT AS total_depth, round(avg(CAST(depth AS DOUBLE)), 6) AS mean_depth, round(median(depth::DOUBLE), 6) AS median_depth, round(count(*) / (SELECT count(*) FROM meta), 6) AS call_rate,
 round(CASE WHEN count(*) > 1 THEN stddev_pop(depth::DOUBLE) / avg(depth::DOUBLE) ELSE 0 END, 6) AS cv_depth, round((quantile_cont(depth::DOUBLE, 0.75) - quantile_cont(depth::DOUBLE, 0.25)) / median(depth::DOUBLE), 6) AS rel_iqr_depth,
 any_value(maf) AS maf, round(any_value(2 * maf * (1 - maf)), 6) AS hexp, round(any_value(2 * maf * (1 - maf) * (1 - f)), 6) + 0 AS hobs, any_value(f) AS f, any_value(COLUMNS(t.* EXCLUDE (p_partkey))) FROM counts c JOIN site_stats s ON c.site = s.site
 JOIN (SELECT p_partkey, {_FIELDS} FROM part) t ON t.p_partkey = c.site WHERE maf > 0.05::DOUBLE AND maf < 0.95::DOUBLE GROUP BY 1""")
def depth_report(spark, d):
    return rounded(summaries.depth_report(T.counts(spark, d), T.meta(spark, d), T.site_stats(spark, d), _tests(spark, d), 0.05))


@query(f"""SELECT * FROM (SELECT s.site, round(least(greatest(CAST(s.site % 140 - 10 AS DOUBLE), 0), 100) / 100, 6) AS call_rate, round(maf, 6) AS maf, round(2 * maf * (1 - maf), 6) AS hexp, round(2 * maf * (1 - maf) * (1 - f), 6) + 0 AS hobs, round(f, 6) + 0 AS f
 FROM site_stats s) JOIN (SELECT p_partkey AS site, {_FIELDS} FROM part) USING (site) WHERE maf > 0.05::DOUBLE AND maf < 0.95::DOUBLE""")
def frequency_report(spark, d):
    freq = T.site_stats(spark, d).withColumn("n_ind", F.col("site") % 140 - 10)
    return rounded(summaries.frequency_report(freq, 100, _tests(spark, d), 0.05))


_CALLABLE = SQL["callable_sites_multi"].removeprefix(T.SQL)
_VARIANTS = f"ca AS ({_CALLABLE}), cv AS (SELECT 'all' AS which, * FROM ca UNION ALL SELECT 'maf_filtered', ca.* FROM ca JOIN site_stats USING (site) WHERE maf >= 0.05::DOUBLE)"


@query(f", {_VARIANTS} SELECT * FROM cv")
def callable_variants(spark, d):
    return summaries.callable_variants(T.counts(spark, d), T.meta(spark, d), T.site_stats(spark, d), [0.2, 0.1])


@query(f""", {_VARIANTS} SELECT pop_code, t.site, pi, maf, f, round(2 * maf * (1 - maf), 6) AS hexp, round(2 * maf * (1 - maf) * (1 - f), 6) + 0 AS hobs, which, threshold AS call_thresh
 FROM (SELECT pop_code, site, round(avg(depth::DOUBLE), 6) AS pi FROM counts JOIN meta USING (sample) GROUP BY 1, 2) t LEFT JOIN (SELECT * FROM site_stats WHERE site % 5 > 0) s ON s.site = t.site JOIN cv ON cv.site = t.site""")
def sweep_collation(spark, d):
    pi = T.counts(spark, d).join(T.meta(spark, d), "sample").groupBy("pop_code", "site").agg(F.avg("depth").alias("pi"))
    sites = summaries.callable_variants(T.counts(spark, d), T.meta(spark, d), T.site_stats(spark, d), [0.2, 0.1])
    return rounded(summaries.collate_sweep(pi, T.site_stats(spark, d).where("site % 5 > 0"), sites, ["pop_code"]))


_CLASSES = {"flag": ("l_returnflag = 'R'", "l_returnflag = 'A'"), "price": ("l_extendedprice < 20000", "l_extendedprice >= 30000 and l_linenumber > 1")}
_CLASS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS definition, {g} AS good, * FROM lineitem WHERE {w}" for n, pair in _CLASSES.items() for g, w in zip(("false", "true"), pair, strict=True))
_SCREENED = ["l_quantity", "l_discount", "neg"]


@query(f""", b AS (SELECT definition, good, unnest(['l_quantity', 'l_discount', 'neg']) AS stat, unnest([l_quantity::DOUBLE, l_discount::DOUBLE, -l_extendedprice::DOUBLE]) AS x FROM ({_CLASS_SQL})),
 v AS (SELECT definition, stat, x, count(*) FILTER (good) AS p, count(*) FILTER (NOT good) AS q FROM b GROUP BY 1, 2, 3),
 m AS (SELECT definition, stat, median(x) FILTER (good) AS median_good, median(x) FILTER (NOT good) AS median_bad, count(*) FILTER (good) AS np, count(*) FILTER (NOT good) AS nq FROM b GROUP BY 1, 2),
 c AS (SELECT v.*, m.* EXCLUDE (definition, stat), sum(p) OVER up AS tp, sum(q) OVER up AS fp, sum(p) OVER dn AS lp, sum(q) OVER dn AS lq, median_good >= median_bad AS rising FROM v JOIN m USING (definition, stat)
  WINDOW up AS (PARTITION BY definition, stat ORDER BY x DESC), dn AS (PARTITION BY definition, stat ORDER BY x)),
 y AS (SELECT *, CASE WHEN rising THEN tp / np ELSE lp / np END AS t, CASE WHEN rising THEN fp / nq ELSE lq / nq END AS g FROM c),
 z AS (SELECT *, row_number() OVER (PARTITION BY definition, stat ORDER BY round(t - g, 9) DESC, x DESC) AS k, sum(p * (nq - fp + q / 2)) OVER (PARTITION BY definition, stat) / np / nq AS a FROM y)
 SELECT definition, stat, round(CASE WHEN rising THEN a ELSE 1 - a END, 6) AS auc, round(x, 6) AS threshold, round(t, 6) AS sensitivity, round(1 - g, 6) AS specificity, round(median_good, 6) AS median_good, round(median_bad, 6) AS median_bad FROM z WHERE k = 1""")
def roc_screen(spark, d):
    li = T.read(spark, d, "lineitem").withColumn("neg", -F.col("l_extendedprice"))
    return rounded(summaries.screen(li, _CLASSES, _SCREENED))


@query("""SELECT l_orderkey * 10 + l_linenumber AS name, 60 AS orig_mq, CASE WHEN c = 0 THEN 60 WHEN t > c THEN 0 ELSE CAST(floor(c * sqrt((c - greatest(t, 0)) / c) + 0.499::DOUBLE) AS INT) END AS new_mq, round(l_quantity::DOUBLE, 6) AS sub_q, round(l_tax * 100::DOUBLE, 6) AS clip_q, c, round(t, 6) + 0 AS t
 FROM (SELECT *, l_quantity - 4.343::DOUBLE * (l_linenumber * ln(100) - ln(factorial(l_linenumber)::DOUBLE)) + l_tax * 100 / 5 AS t FROM lineitem), (SELECT unnest([0, 50, 60, 75, 100]) AS c)""")
def mq_recap(spark, d):
    li = T.read(spark, d, "lineitem")
    x = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("name"), F.lit(60).alias("orig_mq"), F.col("l_quantity").cast("double").alias("sub_q"), F.col("l_linenumber").alias("mismatches"), F.lit(100).alias("matched"), (F.col("l_tax") * 100).cast("double").alias("clip_q"))
    return reads.recap(x, digits=6)


@query(""", nd AS (SELECT k % 3 AS tree, k // 3 AS id FROM range(0, 93) r(k)), pt AS (SELECT tree, id, id AS leaf, 0 AS up FROM nd WHERE id >= 15 UNION ALL SELECT tree, (id - 1) // 2, leaf, up + 1 FROM pt WHERE id > 0)
 SELECT tree::INT AS tree, (c.leaf - 15)::INT AS leaf_id, (3 - c.up)::INT AS depth, 'f' || ((c.id - 1) // 2 % 3) AS feature, CASE WHEN c.id % 2 = 1 THEN '<=' ELSE '>' END AS direction, CASE (c.id - 1) // 2 % 3 WHEN 0 THEN 2.0 + 4 * least((c.id - 1) // 2 // 4, 1) WHEN 1 THEN 7.0 ELSE (c.id - 1) // 2 END::DOUBLE AS thresh_bin FROM pt c WHERE c.id > 0""")
def leaf_steps(spark, d):
    """Complete trees of 15 splits and 16 leaves; the split of node i is i."""
    k = spark.range(93).select((F.col("id") % 3).cast("int").alias("tree"), F.floor(F.col("id") / 3).cast("int").alias("id"))
    inner, i = F.col("id") < 15, F.col("id")
    nodes = k.select("tree", "id", F.when(inner, F.concat(F.lit("f"), (i % 3).cast("string"))).alias("feature"), F.when(inner, i.cast("double")).alias("split"), F.when(inner, 2 * i + 1).alias("yes"), F.when(inner, 2 * i + 2).alias("no"), F.when(~inner, i - 15).alias("leaf_id"))
    return rules.leaf_steps(nodes, {"f0": [0.0, 4.0, 8.0], "f1": [0.0, 14.0], "f2": [3.0]})


# --- beyond SQL: rows only ----------------------------------------------------------------------


@query()
def chi2_scan(spark, d):
    z = T.read(spark, d, "part").select(F.col("p_partkey").alias("site"), (F.col("p_size") / 10.0).alias("z1"), (F.col("p_retailprice") / 500).alias("z2"), (F.pmod(F.col("p_partkey") * 31, F.lit(17)) / 5.0).alias("z3"))
    return rounded(models.selection_scan(z, ["z1", "z2", "z3"]).select("site", "d2", "p", "q"))


@query()
def pca_pcs(spark, d):
    z = genotype.standardised_in_sites(T.counts(spark, d, "site"))
    sites = gram.gathered(z)
    order = gram.numbered(sites.select(F.explode("i").alias("sample")))
    return gram.principal_components(gram.moments_for(sites, order), order).select("sample", "pc1", "pc2")


@query()
def varpart(spark, d):
    """From sums over combinations of library and a made-up region; the tests compare with whole matrices."""
    rows = pca_pcs(spark, d).join(T.meta(spark, d), "sample").withColumn("quarter", (F.col("sample") % 4).cast("string"))
    parts = models.variance_parts(models.cell_sums(rows, ["pc1", "pc2"], ["library", "quarter"]))
    shares = models.manova_shares(models.cell_sums(rows, ["pc1", "pc2"], ["quarter", "library"]))
    return spark.createDataFrame([(k, float(v)) for k, v in [*parts.items(), *((f"manova_{k}", v) for k, v in shares.items())]], "part string, fraction double")


@query()
def mixed_model_variance(spark, d):
    rows = _parsed(spark, d).join(T.meta(spark, d), "sample").groupBy("baq", "sample", "library").agg(F.avg("price").alias("y"))
    return models.random_intercepts(rows, ["baq"], "y", "library").withColumnsRenamed({"var_group": "var_library"})


_FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query()
def gbt_fit_predict(spark, d):
    li = T.read(spark, d, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    s = models.split_folds(li, "row")
    model = models.fit_trees(s.where("is_train"), _FEATURES, "l_extendedprice")
    return models.prediction_errors(models.predicted(model, s.where("not is_train")), "l_extendedprice").select("row", "prediction", "error", "sq_error")


@query()
def gbt_leaves(spark, d):
    li = T.read(spark, d, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    model = models.fit_trees(li, _FEATURES, "l_extendedprice")
    return models.leaf_rows(models.predicted(model, li), "row")


@query()
def histogram_breaks(spark, d):
    """Equal to numpy's on whole columns in the tests."""
    long = T.read(spark, d, "lineitem").unpivot(["l_orderkey"], _FEATURES, "feature", "value")
    return ranks.histogram_breaks(long, "feature", "value")


@query()
def rule_mining(spark, d):
    """A fitted model's leaves, paths and rules; see the tests for a check against plain Python."""
    li = T.read(spark, d, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    model = models.fit_trees(li, _FEATURES, "l_extendedprice", trees=5, depth=3)
    return rounded(summaries.mine_rules(li, model, _FEATURES, "l_extendedprice", band=0.5, least_count=2))


from . import studies  # noqa: E402, F401  registers its queries
