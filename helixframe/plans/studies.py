"""Queries of whole studies: depth features, dips, distance predictors, selection scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import dips, stats
from helixframe.operators import boosting, distances, features, genotype, gram, intervals, models, populations, site, summaries

from . import tables as T
from .catalog import query, rounded

# --- depth features of genotype classes ---------------------------------------------------------

_SPLIT = """sp AS (SELECT l_partkey AS site, CASE l_linenumber % 3 WHEN 0 THEN 'homRef' WHEN 1 THEN 'het' ELSE 'homAlt' END AS genotype, l_suppkey AS sample, CAST(sum(l_quantity) AS DOUBLE) AS x FROM lineitem GROUP BY 1, 2, 3),
fl AS (SELECT site FROM (SELECT site, genotype FROM sp WHERE x <> 0 GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1 HAVING count(*) = 3),
cells AS (SELECT site, CASE WHEN genotype = 'het' THEN 'hetero' WHEN (genotype = 'homRef') = (maf <= 0.5::DOUBLE) THEN 'homoMaj' ELSE 'homoMin' END AS class, sample, x
 FROM sp JOIN site_stats USING (site) WHERE CAST(site * 13 % 100 AS DOUBLE) / 100 > 0.4::DOUBLE AND maf < 0.95::DOUBLE AND x <> 0 AND site IN (SELECT site FROM fl)),
z1 AS (SELECT *, (x - avg(x) OVER r) / nullif(stddev_samp(x) OVER r, 0) AS lz, (x - avg(x) OVER s) / nullif(stddev_samp(x) OVER s, 0) AS sz FROM cells WINDOW r AS (PARTITION BY site, class), s AS (PARTITION BY sample)),
z2 AS (SELECT *, (lz - avg(lz) OVER s) / nullif(stddev_samp(lz) OVER s, 0) AS dlsz, (sz - avg(sz) OVER r) / nullif(stddev_samp(sz) OVER r, 0) AS dslz FROM z1 WINDOW r AS (PARTITION BY site, class), s AS (PARTITION BY sample)),
lg AS (SELECT site, class, unnest(['raw', 'sz', 'lz', 'dlsz', 'dslz']) AS std, unnest([x, sz, lz, dlsz, dslz]) AS v FROM z2 UNION ALL SELECT site, '' AS class, 'aggregate' AS std, sum(x) AS v FROM cells GROUP BY site, sample),
p0 AS (SELECT site, class, std, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS sd, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(v) AS n, sum(v) AS t FROM lg GROUP BY 1, 2, 3),
p1 AS (SELECT site, class, std, any_value(mean) AS mean, any_value(median) AS median, any_value(sd) AS sd, any_value(sd / nullif(mean, 0)) AS cv, any_value(q3 - q1) AS iqr, 1.4826::DOUBLE * median(abs(v - median)) AS mad,
 CASE WHEN any_value(n) >= 5 THEN avg(CAST(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) AS DOUBLE)) END AS extreme,
 CASE WHEN any_value(n) >= 5 THEN avg(pow(v - mean, 4)) / nullif(pow(any_value(sd), 4), 0) - 3 END AS kurtosis,
 CASE WHEN any_value(n) >= 5 THEN avg(pow(v - mean, 3)) / nullif(pow(any_value(sd), 3), 0) * sqrt(any_value(n) * (any_value(n) - 1)) / (any_value(n) - 2) END AS skewness,
 CASE WHEN any_value(n) > 1 AND any_value(std) = 'aggregate' THEN sum(CASE WHEN v > 0 AND t > 0 THEN -v / t * ln(v / t) END) / ln(any_value(n)) END AS entropy FROM lg JOIN p0 USING (site, class, std) WHERE v IS NOT NULL GROUP BY 1, 2, 3)"""


def _feature_sql() -> str:
    pick, wide, diffs = [], [], []
    for name, (prefix, names) in features.STANDARDS.items():
        for s in names:
            if s == "dip":
                continue  # SQL for it is beside the query dip
            for c in features.CLASSES if name != "aggregate" else ("",):
                label = f"{prefix}_{s}_{c}" if c else f"{prefix}_{s}"
                pick.append(f"max({s}) FILTER (std = '{prefix}' AND class = '{c}') AS {label}")
                wide.append(f"round({label}, 4) + 0 AS {label}")
        for s in features.COMPARED:
            for diff, ratio, a, b in features.PAIRS if s in names and name != "aggregate" else ():
                x, y = f"{prefix}_{s}_{a}", f"{prefix}_{s}_{b}"
                diffs.append(f"round({x} - {y}, 4) + 0 AS {prefix}_{s}_{diff}")
                if name == "none":
                    diffs.append(f"round(CASE WHEN {x} > 0 AND {y} > 0 THEN ln({x} / {y}) END, 4) + 0 AS {prefix}_{s}_{ratio}")
    return f", {_SPLIT}, wd AS (SELECT site, {', '.join(pick)} FROM p1 GROUP BY 1) SELECT site, {', '.join(wide + diffs)} FROM wd"


def _class_split(spark, d):
    kind = F.when(F.col("l_linenumber") % 3 == 0, genotype.CLASSES[0]).when(F.col("l_linenumber") % 3 == 1, genotype.CLASSES[1]).otherwise(genotype.CLASSES[2])
    rows = T.dealt(spark, d, "site").groupBy("site", kind.alias("genotype"), "sample")  # a site's cells meet in one task, once
    return rows.agg(F.sum("l_quantity").cast("double").alias("depth"))


def _rated(spark, d):
    return T.site_stats(spark, d).select("site", "maf", (F.pmod(F.col("site") * 13, F.lit(100)).cast("double") / 100).alias("call_rate"))


@query(_feature_sql())
def depth_by_genotype(spark, d):
    return rounded(features.depth_by_genotype(_class_split(spark, d), _rated(spark, d)).drop("aggregate_dip"), 4)


_DIP = """, x AS (SELECT site, CAST(depth AS DOUBLE) AS x, count(*) AS c FROM counts GROUP BY 1, 2),
v AS (SELECT site, x, row_number() OVER w AS i, sum(c) OVER w AS hi, sum(c) OVER w - c AS lo FROM x WINDOW w AS (PARTITION BY site ORDER BY x)),
lf AS (SELECT i.site, i.i, b.i AS m, i.hi AS step, min(CASE WHEN b.i = i.i THEN i.lo WHEN a.i = i.i THEN i.lo ELSE a.lo + (b.lo - a.lo) * (i.x - a.x) / (b.x - a.x) END) AS y FROM v i JOIN v a ON a.site = i.site AND a.i <= i.i JOIN v b ON b.site = i.site AND b.i >= i.i GROUP BY 1, 2, 3, 4),
rt AS (SELECT i.site, i.i, a.i AS m, i.lo AS step, max(CASE WHEN a.i = i.i THEN i.hi WHEN b.i = i.i THEN i.hi ELSE a.hi + (b.hi - a.hi) * (i.x - a.x) / (b.x - a.x) END) AS y FROM v i JOIN v a ON a.site = i.site AND a.i <= i.i JOIN v b ON b.site = i.site AND b.i >= i.i GROUP BY 1, 2, 3, 4),
gl2 AS (SELECT site, i, m, step - min(y) OVER (PARTITION BY site, i ORDER BY m) AS g FROM lf), gr2 AS (SELECT site, i, m, max(y) OVER (PARTITION BY site, i ORDER BY m DESC) - step AS g FROM rt),
md AS (SELECT v.site, v.i, greatest(coalesce((SELECT max(g) FROM gl2 WHERE gl2.site = v.site AND gl2.m = v.i AND gl2.i < v.i), 0), coalesce((SELECT max(g) FROM gr2 WHERE gr2.site = v.site AND gr2.m = v.i AND gr2.i > v.i), 0)) AS g FROM v)
SELECT site, round(CASE WHEN n >= 5 THEN greatest(min(g), 1) / (2 * n) END, 6) AS dip FROM md JOIN (SELECT site, sum(c) AS n FROM x GROUP BY 1) USING (site) GROUP BY site, n"""


@query(_DIP)
def dip(spark, d):
    """The SQL tries every mode and takes minorants as least chords."""
    rows = T.counts(spark, d).groupBy("site").agg(F.collect_list(F.col("depth").cast("double")).alias("x"))
    return rounded(rows.select("site", dips.dip_of(F.col("x")).alias("dip")))


# --- distances ----------------------------------------------------------------------------------

_F = "(1 / 298.257223563::DOUBLE)"
_B = f"((1 - {_F}) * 6378137.0::DOUBLE)"
_PLACES = """, pl AS (SELECT sample, library, CAST(sample % 60 AS DOUBLE) AS lat, CAST(sample * 7 % 170 AS DOUBLE) AS lon, CAST(sample * 37 % 101 AS DOUBLE) / 100 AS pc1, CAST(s_acctbal AS DOUBLE) / 10000 AS pc2 FROM meta JOIN supplier ON s_suppkey = sample)"""
_PAIRS = f""",
pr AS (SELECT a.sample AS sample_1, b.sample AS sample_2, CAST(a.library <> b.library AS INT) AS diff_library, abs(a.pc1 - b.pc1) AS y1, abs(a.pc2 - b.pc2) AS y2,
 atan((1 - {_F}) * tan(radians(a.lat))) AS u1, atan((1 - {_F}) * tan(radians(b.lat))) AS u2, radians(b.lon - a.lon) AS l FROM pl a JOIN pl b ON a.sample < b.sample),
it AS (SELECT *, l AS lam, 0 AS k FROM pr UNION ALL
 SELECT sample_1, sample_2, diff_library, y1, y2, u1, u2, l, l + (1 - c) * {_F} * sa * (sig + c * ss * (cm + c * cs * (2 * cm * cm - 1))), k + 1 FROM (SELECT *, {_F} / 16 * ca2 * (4 + {_F} * (4 - 3 * ca2)) AS c FROM
 (SELECT *, 1 - sa * sa AS ca2, CASE WHEN 1 - sa * sa > 0 THEN cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) ELSE 0 END AS cm FROM (SELECT *, atan2(ss, cs) AS sig, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa FROM
 (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM it WHERE k < 30)))) q),
g0 AS (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM it WHERE k = 30),
g1 AS (SELECT *, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa, atan2(ss, cs) AS sig FROM g0),
g2 AS (SELECT *, CASE WHEN 1 - sa * sa > 0 THEN cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) ELSE 0 END AS cm, (1 - sa * sa) * (pow(6378137.0::DOUBLE, 2) - pow({_B}, 2)) / pow({_B}, 2) AS u FROM g1),
g3 AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS ba, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS bb FROM g2),
geo AS (SELECT sample_1, sample_2, diff_library, y1, y2, {_B} * ba * (sig - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) / 1000 AS km FROM g3)"""
_GEO = _PLACES + _PAIRS


def _places(spark, d):
    s = T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), (F.col("s_acctbal").cast("double") / 10000).alias("pc2"))
    k = F.col("sample")
    return T.meta(spark, d).join(s, "sample").select("sample", "library", (k % 60).cast("double").alias("latitude"), (k * 7 % 170).cast("double").alias("longitude"), ((k * 37 % 101).cast("double") / 100).alias("pc1"), "pc2")


@query(f"{_GEO} SELECT sample_1, sample_2, round(km, 3) + 0 AS km FROM geo")
def geodesic(spark, d):
    return distances.geodesic_pairs(_places(spark, d), 3)


_T = "exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(nu * pi()) * pow(1 + pow(abs(t_value) * k / 4000, 2) / nu, -(nu + 1) / 2)"
_FIT = f"""{_GEO}, ys AS (SELECT km AS a, CAST(diff_library AS DOUBLE) AS b, unnest(['pc1', 'pc2']) AS pc, unnest([y1, y2]) AS y FROM geo),
mo AS (SELECT pc, count(*) AS n, covar_pop(a, a) * count(*) AS aa, covar_pop(b, b) * count(*) AS bb, covar_pop(y, y) * count(*) AS yy, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS yb FROM ys GROUP BY 1),
co AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS e1, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS e2, aa * bb - ab * ab AS det FROM mo),
va AS (SELECT *, (yy - e1 * ay - e2 * yb) / (n - 3) AS s2 FROM co),
tv AS (SELECT pc, 'geo_km' AS predictor, n, e1 AS estimate, e1 / sqrt(s2 * bb / det) AS t_value, CAST(n - 3 AS DOUBLE) AS nu FROM va UNION ALL SELECT pc, 'diff_library', n, e2, e2 / sqrt(s2 * aa / det), CAST(n - 3 AS DOUBLE) FROM va),
pv AS (SELECT pc, predictor, greatest(0, 1 - 2 * any_value(abs(t_value)) / 4000 / 3 * sum({_T} * CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)) AS p FROM tv, range(0, 4001) r(k) GROUP BY 1, 2)
SELECT pc, predictor, n, round(estimate, 9) + 0 AS estimate, round(t_value, 6) + 0 AS t_value, round(p, 6) + 0 AS p_value FROM tv JOIN pv USING (pc, predictor)"""


@query(_FIT)
def pc_distance_predictors(spark, d):
    """The SQL integrates the density of t for its p values."""
    fits = distances.pc_distance_predictors(_places(spark, d), ["pc1", "pc2"])
    r = lambda c, k: (F.round(c, k) + F.lit(0.0)).alias(c)
    return fits.select("pc", "predictor", "n", r("estimate", 9), r("t_value", 6), r("p_value", 6))


# --- selection scans ------------------------------------------------------------------------------

_SCAN = """, st AS (SELECT 'p_' || p_partkey AS snpcode, CAST(p_size AS DOUBLE) / 10 AS z1, CAST(p_retailprice AS DOUBLE) / 400 AS z2, CAST(p_partkey * 31 % 17 AS DOUBLE) / 3 AS s1, CAST(p_partkey * 7 % 23 AS DOUBLE) / 4 AS s2 FROM part WHERE p_size % 3 > 0)"""
_CHI1 = lambda h: f"CASE WHEN {h} > 30 THEN 0.0 WHEN {h} = 0 THEN 1.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 160), lambda k: exp(2 * k * ln(2) + (k + 0.5) * ln({h}) - lgamma(2 * k + 2) + lgamma(k + 1) - {h}))) END"


def _adjusted(names: list[str]) -> str:
    ranked = ", ".join(f"count(*) OVER (ORDER BY {n}) AS r_{n}" for n in names)
    least = ", ".join(f"least(1.0, min({n} * n / r_{n}) OVER (ORDER BY {n} DESC)) AS q_{n}" for n in names)
    out = ", ".join(f"round({n}, 6) + 0 AS {n}, round(q_{n}, 6) + 0 AS {n}_bh" for n in names)
    return f", rk AS (SELECT *, count(*) OVER () AS n, {ranked} FROM pv), bh AS (SELECT *, {least} FROM rk) SELECT snpcode, {out} FROM bh"


def _scan_tables(spark, d):
    p = T.read(spark, d, "part")
    at = stats.running_total(p.select("p_partkey", F.lit(1).alias("one")), ["p_partkey"], "one", "_n")
    p = p.join(at.select("p_partkey", (F.col("_n") - 1).alias("ord")), "p_partkey").withColumn("kept", (F.col("p_size") % 3 > 0).cast("int"))
    at = stats.running_total(p.where("kept = 1").select("ord", F.lit(1).alias("one")), ["ord"], "one", "_n").select("ord", (F.col("_n") - 1).alias("at"))
    kept, k = p.join(at, "ord"), F.col("p_partkey")
    z = kept.select(F.col("at").alias("ord"), F.array(F.col("p_size").cast("double") / 10, F.col("p_retailprice").cast("double") / 400).alias("values"))
    s = kept.select(F.col("at").alias("ord"), F.array((k * 31 % 17).cast("double") / 3, (k * 7 % 23).cast("double") / 4).alias("values"))
    return p.select("ord", F.concat(F.lit("p_"), k.cast("string")).alias("snpcode")), p.select("ord", "kept"), z, s


@query(f"{_SCAN}, md AS (SELECT median(z1) AS m1, median(z2) AS m2 FROM st), pv AS (SELECT snpcode, {_CHI1('pow(z1 - m1, 2) / 2')} AS pcadapt1, {_CHI1('pow(z2 - m2, 2) / 2')} AS pcadapt2, {_CHI1('s1 / 2')} AS selection1, {_CHI1('s2 / 2')} AS selection2 FROM st, md){_adjusted(['pcadapt1', 'pcadapt2', 'selection1', 'selection2'])}")
def pca_selection(spark, d):
    return rounded(models.pca_selection(*_scan_tables(spark, d), 2))


_MAD = lambda x: f"(SELECT 1.4826::DOUBLE * median(abs({x} - (SELECT median({x}) FROM %s))) FROM %s)"


@query(f"""{_SCAN}, sc AS (SELECT *, z1 / {_MAD("z1") % ("st", "st")} AS y1, z2 / {_MAD("z2") % ("st", "st")} AS y2 FROM st), tn AS (SELECT *, (y1 + y2) / sqrt(2) AS t1, (y1 - y2) / sqrt(2) AS t2 FROM sc),
 d2 AS (SELECT *, pow((t1 - (SELECT median(t1) FROM tn)) / {_MAD("t1") % ("tn", "tn")}, 2) + pow((t2 - (SELECT median(t2) FROM tn)) / {_MAD("t2") % ("tn", "tn")}, 2) AS d2 FROM tn),
 pv AS (SELECT snpcode, exp(-d2 / 2) AS pcadapt1, {_CHI1('s1 / 2')} AS selection1, {_CHI1('s2 / 2')} AS selection2 FROM d2){_adjusted(['pcadapt1', 'selection1', 'selection2'])}""")
def pca_selection_joint(spark, d):
    """Two components' axes are always the diagonals, so the SQL needs no eigenvectors."""
    return rounded(models.pca_selection(*_scan_tables(spark, d), 2, "multivariate"))


# --- boosted trees ----------------------------------------------------------------------------------


@query()
def gbm_report(spark, d):
    """Predictions of the model that a short search finds, from the data set of depth features; the tests check search and data set."""
    rows = features.depth_by_genotype(_class_split(spark, d), _rated(spark, d), ["none", "aggregate"])
    stats_ = _rated(spark, d).join(T.site_stats(spark, d).select("site", "f"), "site")
    data, names = boosting.training_set(rows, stats_, drop=("call_rate",))
    out = boosting.report(data, names, "f", rounds=8, folds=2, initial=3, iterations=2, batch=3)
    return rounded(out["predictions"])


@query()
def rule_validation(spark, d):
    """Rules mined on training rows beside their statistics on held-out ones; see the tests for plain counts."""
    li = T.read(spark, d, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    names = ["l_quantity", "l_discount", "l_tax"]
    split = models.split_folds(li, "row")
    model = models.fit_trees(split.where("is_train"), names, "l_extendedprice", trees=5, depth=3)
    return rounded(summaries.mine_and_validate(split, model, names, "l_extendedprice", band=0.5, least_count=2))


# --- reference building and selection of populations ---------------------------------------------

_REF = """, ln AS (SELECT chrom AS name, CAST(sum(e - s) AS BIGINT) AS length FROM intervals WHERE chrom NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0) AND CAST(chrom AS VARCHAR) NOT LIKE '%77%' GROUP BY 1),
 rk AS (SELECT *, sum(length) OVER w - length AS before, row_number() OVER w AS k FROM ln WINDOW w AS (ORDER BY length DESC, name ROWS UNBOUNDED PRECEDING)),
 kp AS (SELECT name, length, CAST(ntile(10) OVER (ORDER BY k) AS INT) AS chunk FROM rk WHERE before <= 500)
 SELECT chunk, name AS scaffold, s AS start, e AS "end", s + 1 AS first_site FROM intervals JOIN kp ON chrom = name"""


@query(_REF)
def reference_targets(spark, d):
    """The ninth of all customers are contaminants, names with 77 an organelle."""
    bad = T.references(spark, d).where("chrom % 9 = 0")
    return intervals.reference_targets(T.intervals(spark, d), bad, 500, 10, "77")[1]


@query("""SELECT scaffold, min(pos) - 1 AS start, max(pos) AS "end", min(pos) AS first_site FROM (SELECT *, pos - row_number() OVER (PARTITION BY scaffold ORDER BY pos) AS g FROM positions) GROUP BY scaffold, g""")
def experiment_reference(spark, d):
    return intervals.experiment_reference(T.positions(spark, d))[0]


_SELECT = """, dp AS (SELECT l_suppkey AS sample, CAST(sum(l_quantity) AS BIGINT) AS n_reads, count(DISTINCT l_partkey) AS n_scaffolds FROM lineitem GROUP BY 1),
 mt AS (SELECT sample, pop_code, library AS domain, 'lib' || sample % 3 AS library, CAST(length(pop_code) * 7 % 40 + ascii(pop_code) % 20 AS DOUBLE) AS latitude, CAST(ascii(substr(pop_code, 2, 1)) * 5 % 90 AS DOUBLE) AS longitude FROM meta),
 sm AS (SELECT * FROM dp LEFT JOIN mt USING (sample) WHERE ln(n_reads) > (SELECT quantile_cont(ln(n_reads), 0.1) FROM dp) AND ln(n_scaffolds) > (SELECT quantile_cont(ln(n_scaffolds), 0.1) FROM dp)),
 cn AS (SELECT domain, pop_code, library, count(*) AS n FROM sm GROUP BY 1, 2, 3), mk AS (SELECT *, sum(n) OVER (PARTITION BY domain, pop_code) AS total, row_number() OVER (PARTITION BY domain, pop_code ORDER BY n DESC, library) AS k FROM cn),
 lk AS (SELECT pop_code, domain, library AS majority_library, n / total AS max_library_prop, CAST(total AS BIGINT) AS total_samples FROM mk WHERE k = 1 AND total >= 2), mx AS (SELECT * FROM lk WHERE max_library_prop < 0.6::DOUBLE),
 pl AS (SELECT pop_code AS sample, '' AS library, avg(latitude) AS lat, avg(longitude) AS lon, 0.0 AS pc1, 0.0 AS pc2 FROM mt WHERE pop_code IN (SELECT pop_code FROM lk) GROUP BY 1)"""
_STATUS = """, cp AS (SELECT sample_1, sample_2, km FROM geo JOIN lk a ON a.pop_code = sample_1 JOIN lk b ON b.pop_code = sample_2 WHERE a.majority_library <> b.majority_library AND km <= CASE WHEN 'ASIA' IN (a.domain, b.domain) THEN 2500 ELSE 1500 END),
 bo AS (SELECT sample_1 AS pop_code, sample_2 AS paired_pop, km FROM cp UNION ALL SELECT sample_2, sample_1, km FROM cp), ev AS (SELECT pop_code FROM mx UNION SELECT pop_code FROM bo)
 SELECT ev.pop_code, mx.domain, lk.majority_library, round(mx.max_library_prop, 6) AS max_library_prop, coalesce(mx.total_samples, lk.total_samples) AS total_samples, mx.pop_code IS NOT NULL AS is_mixed, bo.pop_code IS NOT NULL AS is_paired, paired_pop, round(km, 3) AS distance_km
 FROM ev LEFT JOIN mx ON mx.pop_code = ev.pop_code LEFT JOIN lk ON lk.pop_code = ev.pop_code LEFT JOIN bo ON bo.pop_code = ev.pop_code"""


@query(_SELECT + _PAIRS + _STATUS)
def population_selection(spark, d):
    """Coordinates from the populations' names; partners come from the grid join."""
    depths = T.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(F.sum("l_quantity").cast("long").alias("n_reads"), F.count_distinct("l_partkey").alias("n_scaffolds"))
    m, name = T.meta(spark, d), F.col("pop_code")
    lat = (F.length(name) * 7 % 40 + F.ascii(name) % 20).cast("double")
    lon = (F.ascii(F.substring(name, 2, 1)) * 5 % 90).cast("double")
    meta = m.select("sample", "pop_code", F.col("library").alias("domain"), F.concat(F.lit("lib"), (F.col("sample") % 3).cast("string")).alias("library"), lat.alias("latitude"), lon.alias("longitude"))
    out = populations.select_populations(depths, meta, least=2, most_share=0.6, wide_domain="ASIA", wide_km=2500, km=1500, read_quantile=0.1, scaffold_quantile=0.1)
    return out.withColumns({"max_library_prop": F.round("max_library_prop", 6), "distance_km": F.round("distance_km", 3)})


# --- covariances of samples -------------------------------------------------------------------------

_SETS = """, pl2 AS (SELECT site, library, count(*) AS p FROM counts JOIN meta USING (sample) WHERE depth > 0 GROUP BY 1, 2), lb AS (SELECT library, count(*) AS k FROM meta GROUP BY 1 HAVING count(*) >= 0.1 * (SELECT count(*) FROM meta)),
 rt AS (SELECT site, min(p / k) AS r FROM pl2 JOIN lb USING (library) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM lb)), th AS (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE]) AS threshold)"""


@query(f"""{_SETS}, c AS (SELECT site, sample, CAST(depth AS DOUBLE) AS z FROM counts), s AS (SELECT threshold, site FROM rt, th WHERE r >= threshold)
 SELECT threshold, a.sample AS i, b.sample AS j, round(covar_samp(a.z, b.z), 5) + 0 AS v FROM s JOIN c a ON a.site = s.site JOIN c b ON b.site = s.site AND a.sample <= b.sample GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def batch_covariances(spark, d):
    """Covariances of samples over the callable sites of each threshold, all thresholds in one pass."""
    cells = T.counts(spark, d).select("site", "sample", F.col("depth").cast("double").alias("z"))
    sets = site.callable_sites(T.counts(spark, d), T.meta(spark, d), [0.1, 0.2]).select("site", F.col("threshold").cast("string").alias("kind"))
    order = gram.numbered(cells)
    v = gram.covariances(gram.sample_moments(cells, order, sets), order)
    return rounded(v.select(F.col("kind").cast("double").alias("threshold"), "i", "j", "v"), 5)


@query()
def batch_effects(spark, d):
    """Principal components of the same; the tests compare with numpy."""
    counts = stats.stored(T.counts(spark, d))
    seen = counts.where("sample is not null").withColumn("_v", F.nullif(F.col("depth").cast("double"), F.lit(0.0)))
    z = stats.z_score(seen, ["site"], "_v", "z").select("site", "sample", "z")  # z_site of ``genotype.standardise`` alone
    return rounded(gram.batch_effects(counts, z, T.meta(spark, d), [0.1, 0.2]), 4)
