"""Statistics as aggregate and scalar columns, by the definitions the analyses use."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quantile(x, p: float) -> Column:
    """Linear interpolation between order statistics."""
    return F.percentile(_c(x), F.lit(p))


def iqr(x) -> Column:
    return quantile(x, 0.75) - quantile(x, 0.25)


def rel_iqr(x) -> Column:
    return F.try_divide(iqr(x), quantile(x, 0.5))


def cv(x) -> Column:
    """Sample sd over the absolute mean; null at mean 0."""
    return F.try_divide(F.stddev_samp(_c(x)), F.abs(F.avg(_c(x))))


def summary_panel(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, median, sd, mad, cv, iqr, kurtosis, skewness, entropy, extreme_share and n for each group.

    Two aggregations on the same key.  NaN counts as missing.  Shape statistics need five
    values; entropy needs two and a positive sum.
    """
    x = F.col(value)
    df = df.withColumn(value, F.when(~F.isnan(x), x)).where(x.isNotNull())
    first = df.groupBy(*keys).agg(
        F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), F.sum(x).alias("_t"), F.count(x).alias("_n"),
        F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
    )
    j = df.join(first, keys)
    d, s, n = x - F.col("_m"), F.first("_s"), F.first("_n")
    q1, med, q3 = F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    outside = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
    p = F.try_divide(x, F.col("_t"))
    enough = lambda e: F.when(n >= 5, e)
    return j.groupBy(*keys).agg(
        n.alias("n"), F.first("_m").alias("mean"), F.first(med).alias("median"), s.alias("sd"),
        (1.4826 * F.percentile(F.abs(x - med), F.lit(0.5))).alias("mad"), F.try_divide(s, F.first("_m")).alias("cv"), F.first(q3 - q1).alias("iqr"),
        enough(F.try_divide(F.avg(d**4), s**4) - 3).alias("kurtosis"),
        enough(F.try_divide(F.avg(d**3), s**3) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when((n > 1) & (F.first("_t") > 0), F.sum(F.when(p > 0, -p * F.ln(p)).otherwise(0.0)) / F.ln(n)).alias("entropy"),
        enough(F.avg(outside.cast("double"))).alias("extreme_share"),
    )


def z_score(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """(value - mean) / sample sd within ``by``; null where sd is 0.

    A group-by and a join back, so that a large group is pre-aggregated and never one task's window.
    """
    m = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = F.try_divide(F.col(value) - F.col("_m"), F.nullif(F.col("_s"), F.lit(0.0)))
    return df.join(m, by).withColumn(out, z).drop("_m", "_s")


def bh_adjust(df: DataFrame, p: str, tiebreak: str, out: str = "qval", groups: int = 64) -> DataFrame:
    """Benjamini-Hochberg q values; null and NaN p values get null and don't count.

    Ranks come from range partitions of the distinct p values with their counts, so no window
    spans the whole table.
    """
    per = df.where(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(p).agg(F.count("*").alias("_k"))
    total = F.broadcast(per.agg(F.sum("_k").alias("_n")))  # one row
    ranked = running_total(per, [p], "_k", "_r", groups).join(total)
    ranked = ranked.withColumn("_v", F.col(p) * F.col("_n") / F.col("_r"))
    q = running_min_from_end(ranked, p, "_v", out, groups).withColumn(out, F.least(F.col(out), F.lit(1.0)))
    return df.join(q.select(p, out), p, "left")


def shared_folder(spark) -> str:
    """Folder that the driver and all executors reach: ``spark.checkpoint.dir``, or one of our own on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "helixframe-settled")
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, as Parquet in the shared folder: for many rows of few columns that are read several times."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _slices(df: DataFrame, key: str, groups: int) -> DataFrame:
    """Adds _g: the range of ``key`` (at most ``groups`` ranges, so the cuts are a bounded row)."""
    cuts = df.agg(F.percentile_approx(key, [i / groups for i in range(1, groups)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    g = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    return df.withColumn("_g", g)


def running_total(df: DataFrame, order: list[str], value: str, out: str, groups: int = 64, descending: bool = False, by: list[str] = ()) -> DataFrame:
    """Inclusive running sum over the whole table, or within each group of ``by``: by ranges of ``order[0]`` and within each."""
    s = _slices(df, order[0], groups)
    sums = s.groupBy(*by, "_g").agg(F.sum(value).alias("_s"))  # a row for each range
    up = F.col("_g").desc() if descending else F.col("_g").asc()
    before = sums.select(*by, "_g", F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy(up).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    before = before if by else F.broadcast(before)
    keys = [F.col(order[0]).desc() if descending else F.col(order[0]).asc(), *order[1:]]
    inner = F.sum(value).over(Window.partitionBy(*by, "_g").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return s.join(before, [*by, "_g"]).withColumn(out, F.col("_b") + inner).drop("_g", "_b")


def running_min_from_end(df: DataFrame, key: str, value: str, out: str, groups: int = 64, by: list[str] = ()) -> DataFrame:
    """Least value at this key or any larger one (in the group of ``by``), by ranges of the key."""
    s = _slices(df, key, groups)
    lows = s.groupBy(*by, "_g").agg(F.min(value).alias("_l"))  # a row for each range
    after = lows.select(*by, "_g", F.min("_l").over(Window.partitionBy(*by).orderBy(F.col("_g").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_b"))
    after = after if by else F.broadcast(after)
    inner = F.min(value).over(Window.partitionBy(*by, "_g").orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0))
    return s.join(after, [*by, "_g"]).withColumn(out, F.least(F.col("_b"), inner)).drop("_g", "_b")


def bh_adjust_columns(df: DataFrame, key: str, columns: list[str], suffix: str = "_bh", groups: int = 64) -> DataFrame:
    """(key, <column><suffix>...): Benjamini-Hochberg q values of several columns of p values, all in one pass.

    ``key`` names a row; null and NaN p values get null and don't count.
    """
    p = F.col("_p")
    long = df.unpivot([key], columns, "_name", "_p").where(p.isNotNull() & ~F.isnan(p))
    per = settled(long.groupBy("_name", "_p").agg(F.count("*").alias("_k")))
    total = F.broadcast(per.groupBy("_name").agg(F.sum("_k").alias("_n")))  # a row for each column
    ranked = running_total(per, ["_p"], "_k", "_r", groups, by=["_name"]).join(total, "_name")
    ranked = settled(ranked.select("_name", "_p", (p * F.col("_n") / F.col("_r")).alias("_v")))
    q = running_min_from_end(ranked, "_p", "_v", "_q", groups, by=["_name"]).select("_name", "_p", F.least("_q", F.lit(1.0)).alias("_q"))
    wide = long.join(q, ["_name", "_p"]).groupBy(key).agg(*[F.max(F.when(F.col("_name") == c, F.col("_q"))).alias(c + suffix) for c in columns])
    return df.select(key).join(wide, key, "left")


def roc(df: DataFrame, stat: str, label: str, groups: int = 64) -> DataFrame:
    """(threshold, tpr, fpr): a point for each distinct value, calls being values at or above it."""
    per = df.where(F.col(stat).isNotNull() & ~F.isnan(stat)).groupBy(stat).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.sum((~F.col(label)).cast("long")).alias("_q"))
    per = running_total(running_total(per, [stat], "_p", "_tp", groups, True), [stat], "_q", "_fp", groups, True)
    tot = F.broadcast(per.agg(F.sum("_p").alias("_tot_p"), F.sum("_q").alias("_tot_q")))  # one row
    return per.join(tot).select(F.col(stat).alias("threshold"), F.try_divide("_tp", "_tot_p").alias("tpr"), F.try_divide("_fp", "_tot_q").alias("fpr"), "_p", "_q", "_tot_p", "_tot_q")


def auc(points: DataFrame) -> DataFrame:
    """(auc, threshold, sensitivity, specificity): area, and the threshold of the largest Youden index.

    Ties of the index go to the highest threshold.
    """
    a = F.sum(F.col("_p") * (F.col("_tot_q") * (1 - F.col("fpr")) + F.col("_q") / 2.0)) / (F.first("_tot_p") * F.first("_tot_q"))
    best = F.max(F.struct(F.round(F.col("tpr") - F.col("fpr"), 9).alias("j"), "threshold", "tpr", "fpr"))
    return points.agg(a.alias("auc"), best.alias("_b")).select("auc", F.col("_b.threshold").alias("threshold"), F.col("_b.tpr").alias("sensitivity"), (1 - F.col("_b.fpr")).alias("specificity"))


def odds_ratio(a, b, c, d) -> Column:
    """Haldane-corrected odds ratio of a 2 x 2 table."""
    a, b, c, d = map(_c, (a, b, c, d))
    return (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))


def hypergeom_tail(k: int, m: int, n: int, size: int) -> float:
    """P(X >= max(k, 1)), summed from the likeliest term outwards by the terms' ratios."""
    k, low, high = max(k, 1), max(0, size - n), min(m, size)
    if k > high:
        return 0.0
    if k <= low:
        return 1.0
    start = min(high, max(k, (size + 1) * (m + 1) // (m + n + 2)))
    ln = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    total = 1.0
    for step in (1, -1):
        x, last = start, 1.0
        while last > 1e-18 * total and (x < high if step > 0 else x > k):
            at = np.arange(x, min(high, x + 4096), dtype=float) if step > 0 else np.arange(x, max(k, x - 4096), -1, dtype=float)
            if step > 0:
                terms = last * np.cumprod((m - at) * (size - at) / ((at + 1) * (n - size + at + 1)))
            else:
                terms = last * np.cumprod(at * (n - size + at) / ((m - at + 1) * (size - at + 1)))
            total += float(terms.sum())
            last, x = float(terms[-1]), x + step * len(at)
    return min(1.0, math.exp(ln(m, start) + ln(n, size - start) - ln(m + n, size) + math.log(total)))


def hypergeom_upper(df: DataFrame, k: str, m: str, n: str, size: str, out: str = "pval") -> DataFrame:
    """P(X >= k) drawing ``size`` from m marked and n others; k = 0 gives P(X > 0), as the analyses do.

    A tail takes about as many terms as the distribution is wide, in blocks of numpy; rows with
    a null have none.
    """

    def tails(k: pd.Series, m: pd.Series, n: pd.Series, size: pd.Series) -> pd.Series:
        known: dict[tuple, float | None] = {}
        for c in zip(k, m, n, size, strict=True):
            if c not in known:
                known[c] = None if any(pd.isna(x) for x in c) else hypergeom_tail(*map(int, c))
        return pd.Series([known[c] for c in zip(k, m, n, size, strict=True)], dtype=float)

    tails.__annotations__ = dict.fromkeys(("k", "m", "n", "size", "return"), pd.Series)
    return df.withColumn(out, F.pandas_udf(tails, "double")(*[F.col(c).cast("long") for c in (k, m, n, size)]))


# --- what SQL lacks: vectorised Python -----------------------------------------------------


def chi2_upper(df_: int):
    """Pandas UDF: upper tail of chi squared with ``df_`` degrees of freedom."""

    def tail(x: pd.Series) -> pd.Series:
        v = x.to_numpy(float)
        h = v / 2
        if df_ % 2 == 0:
            term = total = np.exp(-h)
            for i in range(1, df_ // 2):
                term = term * h / i
                total = total + term
            return pd.Series(total)
        total = np.array([math.erfc(math.sqrt(t)) if t >= 0 else np.nan for t in h])
        term = np.sqrt(h / math.pi) * 2 * np.exp(-h)
        for i in range(3, df_ + 1, 2):
            total = total + term
            term = term * v / i
        return pd.Series(total)

    tail.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(tail, "double")


def student_two_sided(t: float, df_: float) -> float:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta."""
    if t != t or df_ <= 0:
        return math.nan
    x = df_ / (df_ + t * t)
    a, b = df_ / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a, b, x):
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def vincenty(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Metres between places on the WGS84 ellipsoid, for arrays of degrees; NaN where a number is missing."""
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(v, float)) for v in (lat1, lon1, lat2, lon2))
    u1, u2 = (np.arctan((1 - f) * np.tan(v)) for v in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    apart = lam = lon2 - lon1
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(200):
            ss = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
            cs = s1 * s2 + c1 * c2 * np.cos(lam)
            sig = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * np.sin(lam) / ss, 0.0)
            ca2 = 1 - sa * sa
            cm = np.where(ca2 > 0, cs - 2 * s1 * s2 / ca2, 0.0)
            c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            old, lam = lam, apart + (1 - c) * f * sa * (sig + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
            if not (np.abs(lam - old) >= 1e-12).any():
                break
    u = ca2 * (a * a - b * b) / (b * b)
    big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    turn = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    return b * big * (sig - turn)


def pretty(low: float, high: float, n: int) -> np.ndarray:
    """About ``n`` equal steps of 1, 2 or 5 times a power of ten that cover the range."""
    if not high > low or n < 1:
        return np.array([low, high])
    raw = (high - low) / n
    power = 10 ** math.floor(math.log10(raw))
    unit = next((u * power for u, cut in ((1, 1.414213562), (2, 3.162277660), (5, 7.071067812)) if raw < cut * power), 10 * power)
    return np.arange(math.floor(low / unit + 1e-7), math.ceil(high / unit - 1e-7) + 1) * unit


def histogram_breaks(x: np.ndarray, trim: float = 0.01, most: int = 40, least_count: int = 20, method: str = "width") -> np.ndarray:
    """Breaks over the winsorised range by Freedman-Diaconis width, or at quantiles (``method`` "quantile").

    Sparse bins merge with the next.
    """
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if not len(x):
        return np.zeros(0)
    lo, hi = np.quantile(x, [trim, 1 - trim])
    x = np.clip(x, lo, hi)
    br = np.quantile(x, np.linspace(0, 1, max(2, most) + 1)) if method == "quantile" else even_breaks(lo, hi, *np.quantile(x, [0.25, 0.75]), len(x), most)
    br = checked_breaks(br, lo, hi)
    return dense_breaks(br, np.histogram(x, br)[0], least_count)


def even_breaks(lo: float, hi: float, q1: float, q3: float, n: int, most: int) -> np.ndarray:
    """Round breaks about as wide as the quartiles and the number of values ask for, ``most`` of them."""
    width = 2 * (q3 - q1) / n ** (1 / 3)
    return pretty(lo, hi, int(min(most, max(1, math.ceil((hi - lo) / width)))) if width > 0 else 1)


def checked_breaks(br: np.ndarray, lo: float, hi: float) -> np.ndarray:
    br = np.unique(br)
    return br if len(br) > 1 else np.array([lo, hi])


def dense_breaks(br: np.ndarray, counts: np.ndarray, least_count: int) -> np.ndarray:
    """Breaks whose bins hold ``least_count`` values, sparse ones merged with the next."""
    kept, held = [br[0]], 0
    for c, edge in zip(counts, br[1:], strict=True):
        held += c
        if held >= least_count:
            kept.append(edge)
            held = 0
    if len(kept) == 1 or held:
        kept = [*kept[: max(1, len(kept) - (held > 0 and len(kept) > 1))], br[-1]]
    return np.array(kept)


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark's ``round``: halves of the shortest decimal form go up, away from 0."""
    scale = 10.0**digits
    out = np.round(x * scale) / scale
    near = np.flatnonzero(np.abs(np.abs(x * scale - np.floor(x * scale)) - 0.5) < 1e-4)
    for k in near:
        out.flat[k] = float(Decimal(repr(float(x.flat[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out
