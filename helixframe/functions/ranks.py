"""Exact quantiles of groups of any size: ranks are found by counts of value ranges, never by a buffer of values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.functions.stats import settled

#: Ranges into which a range that holds a rank is cut.
CUTS = 4096
#: Values of one range that are put in order together.
HELD = 10_000
#: Wanted ranks up to which their ranges go to every task, so that rows stay where they are.
FEW = 20_000


def _magnitude(v: Column) -> Column:
    """A whole number that never falls as v grows: its sign and power of two."""
    power = F.floor(F.greatest(F.least(F.log2(F.abs(v)), F.lit(1100.0)), F.lit(-1090.0))) + 1100
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.when(v > 0, power).otherwise(-power))


def _ranged(counted: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """Of ``counted`` (by, b, c, lo, hi, base), for each rank (_k, r) of ``asked`` the range that holds it."""
    up = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("before", F.col("base") + F.coalesce(F.sum("c").over(up), F.lit(0)))
    holds = (F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("c"))
    return before.join(asked, "_k").where(holds).select("_k", "r", "lo", "hi", "c", "before")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], held: int = HELD, cuts: int = CUTS, weight: str | None = None) -> DataFrame:
    """(keys, n, q): q is an array, the quantiles ``probs`` of each group by linear interpolation.

    Null and NaN values don't count; null keys are a group; groups without a value give no row.
    A first aggregation counts values by sign and power of two.  Ranges that hold a wanted rank
    and more than ``held`` values are cut into ``cuts`` and counted again, then the few values
    left are put in order.  Rows are only counted, so a group may be the whole table; a group
    takes at most some thousand counters a pass.  A row stands for ``weight`` (a whole number) values.
    """
    v = F.col(value).cast("double")
    own = [f"_g{i}" for i in range(len(keys))]
    size = F.sum("w") if weight else F.count("*")
    rows = df.select(v.alias("v"), *([F.col(weight).cast("long").alias("w")] if weight else []), *[F.col(k).alias(g) for g, k in zip(own, keys, strict=True)]).where(v.isNotNull() & ~F.isnan(v))
    # text of the keys only where rows are counted: rows themselves are grouped and joined by the keys
    key = F.to_json(F.struct(*own)) if own else F.lit("")
    first = rows.groupBy(*own, _magnitude(F.col("v")).alias("b")).agg(size.alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    first = settled(first.select(key.alias("_k"), "*"))
    names = settled(first.select("_k", *own).distinct())
    groups = first.groupBy("_k", *own).agg(F.sum("c").alias("n"))
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.array(*[f(at(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]))
    asked = settled(groups.select("_k", F.explode(ranks).alias("r")))
    counted = first.select("_k", "b", "c", "lo", "hi", F.lit(0).cast("long").alias("base"))
    ends = settled(_ranged(counted, asked, ["_k"]))
    few = asked.count() <= FEW
    # the ranges' side is named, so that never the rows are sent to all, nor those of a few groups to a few tasks
    near = lambda spans: F.broadcast(spans) if few else spans.hint("merge")

    def within(spans: DataFrame) -> DataFrame:
        spans = spans.join(names, "_k").select("_k", *[F.col(g).alias(f"_s{g}") for g in own], *[c for c in spans.columns if c != "_k"])
        same = [F.col(g).eqNullSafe(F.col(f"_s{g}")) for g in own] or [F.lit(True)]
        return rows.join(near(spans), same).where("v >= lo and v <= hi")

    while True:
        wide = (F.col("lo") < F.col("hi")) & (F.col("c") > held)
        todo = ends.where(wide)
        if not todo.limit(1).count():
            break
        spans = todo.select("_k", "lo", "hi", F.col("before").alias("base")).distinct()
        inside = within(spans)
        b = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cuts), F.lit(cuts - 1))
        counted = inside.groupBy("_k", "base", b.alias("b")).agg(size.alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        ends = settled(ends.where(~wide).union(_ranged(counted, todo.select("_k", "r"), ["_k", "base"])))
    spans = ends.where("lo < hi").select("_k", "lo", "hi", "before").distinct()
    values = F.flatten(F.collect_list(F.array_repeat("v", F.col("w").cast("int")))) if weight else F.collect_list("v")
    sorted_ = within(spans).groupBy("_k", "before").agg(F.sort_array(values).alias("s"))
    found = ends.join(sorted_, ["_k", "before"], "left")
    found = found.select("_k", "r", F.coalesce(F.get("s", (F.col("r") - F.col("before")).cast("int")), F.col("lo")).alias("x"))
    found = found.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("r", "x"))).alias("m"))  # a few ranks

    def quantile(p: float) -> Column:
        a, b = (F.element_at("m", f(at(p)).cast("long")) for f in (F.floor, F.ceil))
        part = at(p) - F.floor(at(p))
        return F.when(part == 0, a).otherwise(a + part * (b - a))

    out = groups.join(found, "_k")
    return out.select(*[F.col(f"_g{i}").alias(k) for i, k in enumerate(keys)], "n", F.array(*[quantile(p) for p in probs]).alias("q"))


def exact_medians(df: DataFrame, values: list[Column]) -> list[float | None]:
    """Median of each expression over the whole table: a number each."""
    items = F.array(*[F.struct(F.lit(i).alias("i"), v.cast("double").alias("x")) for i, v in enumerate(values)])
    found = exact_quantiles(df.select(F.explode(items).alias("_")).select("_.*"), ["i"], "x", [0.5])
    known = {r["i"]: r["q"][0] for r in found.collect()}  # a row for each expression
    return [known.get(i) for i in range(len(values))]


def histogram_breaks(long: DataFrame, feature: str, value: str, trim: float = 0.01, most: int = 40, least_count: int = 20, method: str = "width") -> DataFrame:
    """(feature, k, edge): ``stats.histogram_breaks`` of each feature of a long table, by counts alone.

    Features are few; their quantiles and bins meet on the driver, the values never do.
    """
    v = F.col(value).cast("double")
    rows = long.select(F.col(feature).alias("f"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ends = exact_quantiles(rows, ["f"], "v", [trim, 1 - trim]).select("f", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
    clipped = rows.join(F.broadcast(ends), "f").select("f", F.least(F.greatest("v", "lo"), "hi").alias("v"))  # a row for each feature
    probs = np.linspace(0, 1, max(2, most) + 1).tolist() if method == "quantile" else [0.25, 0.75]
    found = {r["f"]: r for r in exact_quantiles(clipped, ["f"], "v", probs).collect()}
    breaks = {}
    for r in ends.collect():
        q = found[r["f"]]
        br = np.array(q["q"]) if method == "quantile" else stats.even_breaks(r["lo"], r["hi"], *q["q"], q["n"], most)
        breaks[r["f"]] = stats.checked_breaks(br, r["lo"], r["hi"])
    spark, kind = long.sparkSession, dict(long.dtypes)[feature]
    table = spark.createDataFrame([(f, br.astype(float).tolist()) for f, br in breaks.items()], f"f {kind}, br array<double>")
    at = F.least(F.size(F.filter("br", lambda b: b <= F.col("v"))), F.size("br") - 1)  # the last bin holds its end
    counted = clipped.join(F.broadcast(table), "f").groupBy("f", at.alias("b")).count().collect()
    out = []
    for f, br in breaks.items():
        counts = np.zeros(len(br) - 1, np.int64)
        for r in counted:
            if r["f"] == f and r["b"] >= 1:
                counts[r["b"] - 1] = r["count"]
        out += [(f, k, float(e)) for k, e in enumerate(stats.dense_breaks(br, counts, least_count))]
    return spark.createDataFrame(out, f"{feature} {kind}, k int, edge double")
