"""Models and matrices: boosted trees, correlation, regression, principal components, scans."""

from __future__ import annotations

import math
import uuid
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import ranks, stats

#: Distinct sets of features up to which their predictions go to every task.
FEW = 100_000


def split_folds(df: DataFrame, key: str, train_tenths: int = 7, folds: int = 5) -> DataFrame:
    """Adds is_train and fold, from the key alone: stable under any partitioning."""
    h = F.pmod(F.col(key) * 7919 + 13, F.lit(10))
    return df.withColumns({"is_train": h < train_tenths, "fold": F.pmod(F.floor(F.col(key) / 10), F.lit(folds)).cast("int")})


def training_rows(df: DataFrame, means: list[str], iqrs: list[str]) -> DataFrame:
    """MAF under .95, all class means present, all class IQRs over 0, call rate over .40."""
    ok = (F.col("maf") < 0.95) & (F.col("call_rate") > 0.40)
    for m in means:
        ok = ok & F.col(m).isNotNull()
    for q in iqrs:
        ok = ok & (F.col(q) > 0)
    return df.where(ok)


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, r) of all pairs in one pass; each pair over the rows that have both.

    Every task multiplies its batches' matrices, so what is shuffled is the pairs' moment sums
    of each task, features squared, whatever the rows.  Values are centred first.
    """
    centre = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features]).first()
    shift = np.array([c or 0.0 for c in centre])
    k = len(features)
    i, j = np.triu_indices(k, 1)

    def moments(batches):
        sums = np.zeros((6, k, k))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) - shift
            have = ~np.isnan(x)
            m, x = have.astype(float), np.where(have, x, 0.0)
            for n, (p, q) in enumerate(((m, m), (x, m), (m, x), (x * x, m), (m, x * x), (x, x))):
                sums[n] += p.T @ q
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), **{f"s{n}": sums[n][i, j] for n in range(6)}})

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in features]).mapInArrow(moments, "i int, j int, " + ", ".join(f"s{n} double" for n in range(6)))
    n, x, y, xx, yy, xy = (F.sum(f"s{t}") for t in range(6))
    cov = lambda p, q, pq: pq - F.try_divide(p * q, n)
    r = F.try_divide(cov(x, y, xy), F.nullif(F.sqrt(F.greatest(cov(x, x, xx), F.lit(0.0)) * F.greatest(cov(y, y, yy), F.lit(0.0))), F.lit(0.0)))
    names = F.array(*map(F.lit, features))
    return parts.groupBy("i", "j").agg(r.alias("r")).select(F.get(names, "i").alias("a"), F.get(names, "j").alias("b"), "r")


def drop_correlated(df: DataFrame, features: list[str], limit: float = 0.7) -> list[str]:
    """Features left after dropping, from the most correlated pair on, the one with the larger mean |r|."""
    r = {(x["a"], x["b"]): abs(x["r"] or 0.0) for x in correlation_matrix(df, features).collect()}  # features squared
    get = lambda a, b: r.get((a, b), r.get((b, a), 0.0))
    left = list(features)
    while len(left) > 1:
        a, b = max(combinations(left, 2), key=lambda p: get(*p))
        if get(a, b) <= limit:
            break
        mean = {c: np.mean([get(c, o) for o in left if o != c]) for c in (a, b)}
        left.remove(max((a, b), key=lambda c: mean[c]))
    return left


def ols_two(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """One row: intercept, coefficients and t values of y ~ x1 + x2, from moment sums (centred)."""
    cols = dict(y=y, a=x1, b=x2)
    use = df.select(*[F.col(c).cast("double").alias(k) for k, c in cols.items()]).dropna()
    m = use.agg(F.count("*").alias("n"), *[F.avg(k).alias(f"m{k}") for k in cols], *[F.covar_pop(p, q).alias(f"{p}{q}") for p, q in ("aa", "bb", "ab", "ay", "by", "yy")])
    c = lambda k: F.col(k) * F.col("n")
    det = c("aa") * c("bb") - c("ab") * c("ab")
    m = m.withColumn("det", det).withColumns({"b1": F.try_divide(c("ay") * c("bb") - c("by") * c("ab"), F.col("det")), "b2": F.try_divide(c("by") * c("aa") - c("ay") * c("ab"), F.col("det"))})
    m = m.withColumn("s2", F.try_divide(c("yy") - F.col("b1") * c("ay") - F.col("b2") * c("by"), F.col("n") - 3))
    t1, t2 = F.try_divide("b1", F.sqrt(F.col("s2") * F.try_divide(c("bb"), F.col("det")))), F.try_divide("b2", F.sqrt(F.col("s2") * F.try_divide(c("aa"), F.col("det"))))
    return m.select("n", (F.col("my") - F.col("b1") * F.col("ma") - F.col("b2") * F.col("mb")).alias("b0"), "b1", "b2", t1.alias("t1"), t2.alias("t2"))


def p_two_sided(t: Column, df_: Column) -> Column:
    def tail(t: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([stats.student_two_sided(a, b) for a, b in zip(t, d, strict=True)])

    tail.__annotations__ = {"t": pd.Series, "d": pd.Series, "return": pd.Series}
    return F.pandas_udf(tail, "double")(t, df_)


def fit_trees(train: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 1, held_out: str | None = None, tolerance: float = 0.01):
    """Boosted regression trees; the model gives leaf ordinals in column leaf.

    Missing and NaN features take the median of the training rows, so every row has a
    prediction.  ``held_out``: a boolean column; trees stop where those rows' error falls by
    less than ``tolerance``.

    Training rows with equal features can't be parted by any split, so each set of them enters
    as one row, its mean label weighted by its size: gains and leaf values are those of all rows.
    Held-out rows, whose own errors count, enter one by one.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    filled = [f"_f_{c}" for c in features]
    fill = Imputer(inputCols=features, outputCols=filled, strategy="median").fit(train)
    gather = VectorAssembler(inputCols=filled, outputCol="_x")
    gbt = GBTRegressor(featuresCol="_x", labelCol=label, weightCol="_n", maxIter=trees, maxDepth=depth, seed=seed)
    y = F.coalesce(F.col(label).cast("double"), F.lit(float("nan"))).alias(label)  # NaN: Spark's trees refuse a missing label
    held = F.coalesce(F.col(held_out), F.lit(False)) if held_out else F.lit(False)
    rows = fill.transform(train).select(*filled, y, held.alias("_held"))
    fit = rows.where(~F.col("_held")).groupBy(*filled).agg(F.avg(label).alias(label), F.count("*").cast("double").alias("_n"))
    if held_out:
        fit = fit.withColumn("_held", F.lit(False)).unionByName(rows.where("_held").withColumn("_n", F.lit(1.0)))
        gbt.setValidationIndicatorCol("_held")
        gbt._set(validationTol=tolerance)
    return PipelineModel([fill, gather, gbt.setLeafCol("leaf").fit(gather.transform(stats.settled(fit)))])


def predicted(model, rows: DataFrame) -> DataFrame:
    """``rows`` with prediction and leaf (an array) from ``fit_trees``; each distinct set of features is predicted once where they are few."""
    from pyspark.ml.functions import vector_to_array

    features = model.stages[0].getInputCols()
    out = (F.col("prediction"), vector_to_array("leaf").cast("array<int>").alias("leaf"))
    if rows.agg(F.approx_count_distinct(F.struct(*features))).first()[0] > FEW:
        return model.transform(rows).select(*rows.columns, *out)
    own = [f"_k_{c}" for c in features]
    once = stats.settled(model.transform(rows.select(*features).distinct()).select(*[F.col(c).alias(k) for c, k in zip(features, own, strict=True)], *out))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(features, own, strict=True)]
    return rows.join(F.broadcast(once), same).drop(*own)  # about FEW rows at most


def prediction_errors(predicted: DataFrame, label: str) -> DataFrame:
    e = F.col(label) - F.col("prediction")
    return predicted.withColumns({"error": e, "sq_error": e * e})


def leaf_rows(predicted: DataFrame, row: str) -> DataFrame:
    """(row, tree, leaf_id) from a model's leaf vector or array."""
    from pyspark.ml.functions import vector_to_array

    leaf = F.col("leaf") if dict(predicted.dtypes)["leaf"].startswith("array") else vector_to_array("leaf")
    return predicted.select(F.col(row).alias("row"), F.posexplode(leaf).alias("tree", "leaf_id")).withColumn("leaf_id", F.col("leaf_id").cast("int"))


def node_table(model, features: list[str]) -> DataFrame:
    """(tree, id, feature, split, yes, no, leaf_value, gain, leaf_id) of a fitted ensemble, read from its saved form.

    Nodes are numbered in preorder, leaves from left to right as in the model's leaf vector;
    ``yes`` is the child of rows at or under the split.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = f"{stats.shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.stages[-1].save(path)
    node = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    leaf = F.col("leftChild") < 0
    inner = lambda c: F.when(~leaf, c)
    left_to_right = Window.partitionBy("tree").orderBy("id")  # a tree's nodes
    names = F.array(*map(F.lit, features))
    return node.select(
        "tree", "id", inner(F.get(names, F.col("split.featureIndex"))).alias("feature"), inner(F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("split"),
        inner(F.col("leftChild")).alias("yes"), inner(F.col("rightChild")).alias("no"), F.when(leaf, F.col("prediction")).alias("leaf_value"), inner(F.col("gain")).alias("gain"),
        F.when(leaf, F.count_if(leaf).over(left_to_right).cast("int") - 1).alias("leaf_id"),
    )


def split_breaks(nodes: DataFrame, most: int = 10, least_count: int = 50, trim: float = 0.01, method: str = "width") -> dict[str, list[float]]:
    """Bin edges of each feature's split values, of which there are as many as the model has nodes."""
    out = {}
    values = nodes.where("feature is not null").groupBy("feature").agg(F.collect_list("split").alias("v"))
    for f, v in sorted(values.collect()):  # the model's nodes
        edges = stats.histogram_breaks(np.array(v), trim, most, least_count, method)
        out[f] = sorted({float(x) for x in edges})
    return out


# --- variance of groups, from sums; pairs of samples --------------------------------------------


def cell_sums(rows: DataFrame, responses: list[str], factors: list[str]) -> list[tuple[tuple, int, np.ndarray, float]]:
    """(levels, rows, sums of the responses, their sum of squares) of each combination of ``factors``: all that the models below need.

    What reaches the driver has a row for each combination, whatever the rows.  Rows that lack a response or a factor don't count.
    """
    use = rows.select(*[F.col(f).cast("string").alias(f) for f in factors], *[F.col(r).cast("double").alias(r) for r in responses]).dropna()
    square = sum((F.sum(F.col(r) * F.col(r)) for r in responses), F.lit(0.0))
    got = use.groupBy(*factors).agg(F.count("*").alias("_n"), square.alias("_q"), *[F.sum(r).alias(f"_s{i}") for i, r in enumerate(responses)]).collect()
    return [(tuple(r[f] for f in factors), r["_n"], np.array([r[f"_s{i}"] for i in range(len(responses))]), r["_q"]) for r in sorted(got)]


def explained(cells: list, factors: list[int]) -> tuple[float, int]:
    """Sum of squares that dummy-coded factors (by place) explain beyond the mean, and the columns' rank without it."""
    levels = [sorted({c[0][f] for c in cells}) for f in factors]
    x = np.array([[1.0, *[float(c[0][f] == v) for f, own in zip(factors, levels, strict=True) for v in own[1:]]] for c in cells])
    n, s = np.array([float(c[1]) for c in cells]), np.stack([c[2] for c in cells])
    gram, cross = x.T @ (n[:, None] * x), x.T @ s
    fit = np.linalg.lstsq(gram, cross, rcond=None)[0]
    mean = s.sum(axis=0)
    return float((fit * cross).sum() - mean @ mean / n.sum()), int(np.linalg.matrix_rank(gram)) - 1


def variance_parts(cells: list) -> dict[str, float]:
    """Fractions of variance of ``cells`` with factors (region, library): region alone, library alone, shared, residual; by adjusted R squared."""
    n, total = sum(c[1] for c in cells), _total(cells)

    def adjusted(*factors: int) -> float:
        ss, rank = explained(cells, list(factors))
        return 1 - (1 - ss / total) * (n - 1) / (n - rank - 1) if n > rank + 1 and total > 0 else math.nan

    both, r, b = adjusted(0, 1), adjusted(0), adjusted(1)
    return {"region": both - b, "library": both - r, "shared": r + b - both, "residual": 1 - both}


def _total(cells: list) -> float:
    s = np.sum([c[2] for c in cells], axis=0)
    return float(sum(c[3] for c in cells) - s @ s / sum(c[1] for c in cells))


def manova_shares(cells: list) -> dict[str, float]:
    """Trace ratios of sequential sums of squares of ``cells`` with factors (library, region): library first, then region."""
    total, first, both = _total(cells), explained(cells, [0])[0], explained(cells, [0, 1])[0]
    return {"library": first / total, "region": (both - first) / total}


def block_pairs(samples: DataFrame, rows: int = 1024, by: tuple[str, ...] = ()) -> DataFrame:
    """(_s, _t, a, b), _s <= _t: each unordered pair of blocks of about ``rows`` samples, as arrays of structs.

    Samples, named by the first column, are dealt by a hash of it, or of ``by`` so that equal
    ones come together, at most ``rows`` of them to a place of their own.
    """
    key, blocks = samples.columns[0], max(1, -(-samples.count() // rows))
    if by:
        nth = F.row_number().over(Window.partitionBy(*by).orderBy(key))
        dealt = samples.withColumn("_u", F.floor(nth / rows)).withColumn("_s", F.pmod(F.xxhash64(*by, "_u"), F.lit(blocks)))
    else:
        dealt = samples.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(blocks)))
    own = dealt.groupBy("_s").agg(F.collect_list(F.struct(*samples.columns)).alias("a"))
    pairs = blocks * (blocks + 1) // 2
    n = max(1, min(pairs, max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // 4)))
    upto = lambda x, y: F.explode(F.sequence(x, y).cast("array<bigint>"))
    a = own.select("_s", upto(F.col("_s"), F.lit(blocks - 1).cast("bigint")).alias("_t"), "a")
    b = own.select(F.col("_s").alias("_t"), upto(F.lit(0).cast("bigint"), F.col("_s")).alias("_s"), F.col("a").alias("b"))
    # a stated number, so that small inputs with large results aren't gathered into one task
    return a.repartition(n, "_s", "_t").join(b.repartition(n, "_s", "_t"), ["_s", "_t"])


def block_rows(count: int, rows: int = 1024) -> int:
    """Samples of a block where blocks are paired: at least ``rows``, and from 32 blocks on more samples rather than more blocks.

    A sample is repeated once for each block, so what is shuffled grows with the samples and not
    with their square, until blocks have 65,536 samples.
    """
    return max(rows, min(-(-count // 32), 1 << 16))


def sample_pairs(samples: DataFrame, rows: int = 1024) -> DataFrame:
    """All unordered pairs of samples, whatever their number.

    Samples are dealt to blocks (``block_rows``) by ranges of the key, so that of two blocks one
    comes first whole and a pair is tried once, except within a block.  A row meets a block as
    an array, of whose pairs with it a task holds no more than these.
    """
    key, count = samples.columns[0], samples.count()
    blocks = max(1, -(-count // block_rows(count, rows)))
    dealt = samples.where(F.col(key).isNotNull()).repartitionByRange(blocks, key).withColumn("_s", F.spark_partition_id().cast("bigint"))
    dealt = stats.stored(dealt)  # ranges are cut by drawing rows, so once
    pairs = blocks * (blocks + 1) // 2
    n = max(1, min(pairs, max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // 2)))
    upto = lambda x, y: F.explode(F.sequence(x, y).cast("array<bigint>"))
    a = dealt.select(F.struct(*samples.columns).alias("a"), "_s", upto(F.col("_s"), F.lit(blocks - 1).cast("bigint")).alias("_t"))
    own = dealt.groupBy(F.col("_s").alias("_t")).agg(F.collect_list(F.struct(*samples.columns)).alias("b"))
    b = own.select("_t", upto(F.lit(0).cast("bigint"), F.col("_t")).alias("_s"), "b")
    # a stated number, so that small inputs with large results aren't gathered into one task; merged, so that
    # each row of a is given out alone, where a hash join would hold all pairs of two blocks
    j = a.repartition(n, "_s", "_t").join(b.repartition(n, "_s", "_t").hint("merge"), ["_s", "_t"])
    each = j.select("_s", "_t", *[F.col("a")[c].alias(f"{c}_1") for c in samples.columns], F.inline("b").alias(*[f"{c}_2" for c in samples.columns]))
    return each.where((F.col("_s") < F.col("_t")) | (F.col(f"{key}_1") < F.col(f"{key}_2"))).drop("_s", "_t")


def random_intercept_variance(size: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> dict[str, float]:
    """REML variance components of y ~ 1 + (1 | group), by search over their ratio; NaN if too few.

    ``size``, ``sums`` and ``squares`` are of y in each group: the likelihood needs no more.
    """
    size, sums = np.asarray(size, float), np.asarray(sums, float)
    n, square = size.sum(), float(np.sum(squares))
    if n < 2 or len(size) < 2 or len(size) == n:
        return {"group": math.nan, "residual": math.nan}

    def parts(ratio):
        w = 1 / (1 + ratio * size)
        m = (w * sums).sum() / (w * size).sum()
        d = sums - size * m
        q = square - 2 * m * sums.sum() + n * m * m - (ratio * w * d**2).sum()
        s2 = q / (n - 1)
        return (n - 1) * math.log(max(s2, 1e-300)) + np.log(1 + ratio * size).sum() + math.log((w * size).sum()), s2

    grid = np.concatenate([[0], np.logspace(-6, 6, 121)])
    k = int(np.argmin([parts(r)[0] for r in grid]))
    lo, hi = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
    for _ in range(80):
        a, b = lo + 0.382 * (hi - lo), lo + 0.618 * (hi - lo)
        lo, hi = (lo, b) if parts(a)[0] < parts(b)[0] else (a, hi)
    r = (lo + hi) / 2
    s2 = parts(r)[1]
    return {"group": r * s2, "residual": s2}


def random_intercepts(rows: DataFrame, keys: list[str], y: str, group: str) -> DataFrame:
    """(keys, var_group, var_residual): a random-intercept model for each key, from sums of each of its groups.

    Values are centred on the table's mean first, so that squares don't swallow the variance.
    """
    centre = F.broadcast(rows.agg(F.coalesce(F.avg(y), F.lit(0.0)).alias("_c")))  # one row
    x = rows.join(centre).withColumn("_y", F.col(y) - F.col("_c")).where("_y is not null")
    sums = x.groupBy(*keys, group).agg(F.count("*").alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q"))
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = random_intercept_variance(pdf["n"].to_numpy(), pdf["s"].to_numpy(), pdf["q"].to_numpy())
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in keys}, "var_group": [v["group"]], "var_residual": [v["residual"]]})

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["var_group double", "var_residual double"])
    return sums.groupBy(*keys).applyInPandas(run, schema)


def selection_scan(z: DataFrame, cols: list[str]) -> DataFrame:
    """Adds d2 (robust squared distance), p (chi squared, one degree for each column) and q."""
    out = z.withColumn("d2", robust_distance(z, cols))
    return stats.bh_adjust(out.withColumn("p", stats.chi2_upper(len(cols))("d2")), "p", "d2", "q")


def robust_distance(z: DataFrame, cols: list[str]) -> Column:
    """Squared distance from the centre by the orthogonalised pairwise estimator, as an expression of ``cols``.

    It needs medians only: of the columns, of their pairwise sums and differences, and of the
    rotated columns, all exact and by counts of value ranges.
    """
    k = len(cols)
    scale = _mads(z, [F.col(c) for c in cols])
    y = [F.col(c) / (s[1] or 1e-12) for c, s in zip(cols, scale, strict=True)]
    pairs = list(combinations(range(k), 2))
    got = _mads(z, [e for i, j in pairs for e in (y[i] + y[j], y[i] - y[j])]) if pairs else []
    u = np.eye(k)
    for n, (i, j) in enumerate(pairs):
        u[i, j] = u[j, i] = (got[2 * n][1] ** 2 - got[2 * n + 1][1] ** 2) / 4
    e = np.linalg.eigh(u)[1]
    turned = [sum((y[i] * float(e[i, c]) for i in range(k)), F.lit(0.0)) for c in range(k)]
    centre = _mads(z, turned)
    return sum((((t - float(m)) / float(s or 1e-12)) ** 2 for t, (m, s) in zip(turned, centre, strict=True)), F.lit(0.0))


def _mads(df: DataFrame, exprs: list[Column]) -> list[tuple[float, float]]:
    """(median, scaled median absolute deviation) of each expression."""
    med = [m or 0.0 for m in ranks.exact_medians(df, exprs)]
    mad = ranks.exact_medians(df, [F.abs(e - m) for e, m in zip(exprs, med, strict=True)])
    return [(m, 1.4826 * (d or 0.0)) for m, d in zip(med, mad, strict=True)]


def pca_selection(sites: DataFrame, flags: DataFrame, scores: DataFrame, selection: DataFrame, k: int, mode: str = "univariate") -> DataFrame:
    """(snpcode, pcadapt1.., selection1.., and a _bh of each): p values of sites that may be under selection.

    ``sites`` (ord, snpcode) and ``flags`` (ord, kept) are lines of one length; ``scores`` and
    ``selection`` (ord, values: array) have a line for each kept site, in order.  ``univariate``
    scores are squared deviations from their column's median, one degree of freedom each;
    ``multivariate`` ones are one robust distance with ``k`` degrees.  Missing values have no p
    value and don't count in the adjustment.
    """
    if mode not in ("univariate", "multivariate"):
        raise ValueError("mode is univariate or multivariate")
    if mode == "multivariate" and k < 2:
        raise ValueError("a multivariate scan needs two components")
    kept = flags.where("kept = 1").withColumn("_one", F.lit(1))
    kept = stats.running_total(kept, ["ord"], "_one", "_at").select("ord", (F.col("_at") - 1).alias("_at"))
    sizes = [t.count() for t in (kept, scores, selection)]
    if len(set(sizes)) > 1:
        raise ValueError(f"kept sites, scores and selection statistics differ in number: {sizes}")
    value = lambda i: F.get("values", F.lit(i)).cast("double")
    z = scores.select(F.col("ord").alias("_at"), *[value(i).alias(f"_z{i}") for i in range(k)])
    s = selection.select(F.col("ord").alias("_at"), *[value(i).alias(f"_s{i}") for i in range(k)])
    rows = stats.settled(kept.join(sites.select("ord", "snpcode"), "ord").join(z, "_at").join(s, "_at"))
    cols = [f"_z{i}" for i in range(k)]
    if mode == "univariate":
        medians = ranks.exact_medians(rows, [F.col(c) for c in cols])
        own = {f"pcadapt{i + 1}": stats.chi2_upper(1)((F.col(c) - F.lit(m)) ** 2) for i, (c, m) in enumerate(zip(cols, medians, strict=True))}
    else:
        own = {"pcadapt1": stats.chi2_upper(k)(robust_distance(rows, cols))}
    own |= {f"selection{i + 1}": stats.chi2_upper(1)(F.col(f"_s{i}")) for i in range(k)}
    out = stats.settled(rows.select("_at", "snpcode", *[F.nanvl(p, F.lit(None).cast("double")).alias(n) for n, p in own.items()]))
    return out.join(stats.bh_adjust_columns(out, "_at", list(own)), "_at").select("snpcode", *own, *[f"{n}_bh" for n in own])
