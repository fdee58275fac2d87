"""Rule mining over tree leaves: leaf counts, likelihood ratios, rule text, pooling, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import ranks, stats

TINY = 1e-12


def thresholds(df: DataFrame, y: str, k: float = 1.0, centre: str = "mean", spread: str = "sd") -> DataFrame:
    """One row to keep and apply elsewhere: centre, spread and the extreme cut (centre + k spreads)."""
    if centre == "mean" and spread == "sd":
        g = df.agg(F.avg(y).alias("centre"), F.stddev_samp(y).alias("spread"))
    else:
        g = df.agg(F.avg(y).alias("_a"), F.stddev_samp(y).alias("_s"))
        med = ranks.exact_medians(df, [F.col(y)])[0]
        mad = ranks.exact_medians(df, [F.abs(F.col(y) - F.lit(med))])[0] if spread != "sd" else None
        g = g.select((F.col("_a") if centre == "mean" else F.lit(med)).alias("centre"), (F.col("_s") if spread == "sd" else F.lit(1.4826 * mad if mad is not None else None)).cast("double").alias("spread"))
    return g.withColumn("cut", F.col("centre") + k * F.col("spread"))


def classify(df: DataFrame, y: str, cuts: DataFrame, band: float = 1.0) -> DataFrame:
    """Adds cls: extreme (y at or over the cut), background (within ``band`` spreads of the centre), else null."""
    j = df.join(F.broadcast(cuts))  # one row
    near = F.abs(F.col(y) - F.col("centre")) < band * F.col("spread")
    cls = F.when(F.col(y) >= F.col("cut"), F.lit("extreme")).when(near, F.lit("background"))
    return j.withColumn("cls", cls).select(*df.columns, "cls")


def leaf_counts(leaves: DataFrame) -> DataFrame:
    """(tree, leaf_id, n_extreme, n_bg) of classified rows."""
    one = lambda c: F.count_if(F.col("cls") == c)
    return leaves.groupBy("tree", "leaf_id").agg(one("extreme").alias("n_extreme"), one("background").alias("n_bg"))


def leaf_llr(counts: DataFrame) -> DataFrame:
    """Adds llr = ln((share of extremes + 1e-12) / (share of background + 1e-12)), shares within each tree."""
    per = counts.groupBy("tree").agg(F.sum("n_extreme").alias("_e"), F.sum("n_bg").alias("_b"))
    p = lambda n, t: F.coalesce(F.try_divide(n, t), F.lit(0.0)) + TINY
    return counts.join(per, "tree").withColumn("llr", F.ln(p("n_extreme", "_e") / p("n_bg", "_b"))).drop("_e", "_b")


def row_similarity(leaves: DataFrame, llr: DataFrame, attributes: list[str] = ()) -> DataFrame:
    """Mean log likelihood ratio (and other leaf attributes) over the trees of each row."""
    j = leaves.join(F.broadcast(llr), ["tree", "leaf_id"], "left")  # a row for each leaf of the model
    return j.groupBy("row").agg(F.avg("llr").alias("mean_llr"), *[F.avg(a).alias(f"mean_{a}") for a in attributes])


def topk_share(steps: DataFrame, k: int = 2) -> DataFrame:
    """Share of a leaf's path steps that its ``k`` commonest features make; ties to the first names."""
    n = steps.groupBy("tree", "leaf_id", "feature").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tree", "leaf_id").orderBy(F.desc("n"), "feature")
    r = n.withColumn("_k", F.row_number().over(w))
    return r.groupBy("tree", "leaf_id").agg((F.sum(F.when(F.col("_k") <= k, F.col("n")).otherwise(0)) / F.sum("n")).alias("topk_share"))


def tighten(steps: DataFrame) -> DataFrame:
    """Keeps, along a path, a >= or > step only if its bin exceeds all before it (a < or <= step: undercuts them)."""
    w = Window.partitionBy("tree", "leaf_id", "feature", "direction").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    up, down = F.max("thresh_bin").over(w), F.min("thresh_bin").over(w)
    b = F.col("thresh_bin")
    ok = F.when(F.col("direction").isin(">=", ">"), up.isNull() | (b > up + TINY)).when(F.col("direction").isin("<", "<="), down.isNull() | (b < down - TINY)).otherwise(True)
    return steps.withColumn("_ok", ok).where("_ok").drop("_ok")


def rule_strings(steps: DataFrame) -> DataFrame:
    """(tree, leaf_id, rule_str, rule_len): conditions in path order, joined by ' | '."""
    cond = F.concat_ws(" ", "feature", "direction", F.format_string("%.2e", "thresh_bin"))
    g = steps.groupBy("tree", "leaf_id").agg(F.sort_array(F.collect_list(F.struct("depth", cond.alias("cond")))).alias("_c"))
    return g.select("tree", "leaf_id", F.array_join(F.transform("_c", lambda x: x["cond"]), " | ").alias("rule_str"), F.size("_c").alias("rule_len"))


def path_rules(steps: DataFrame, max_depth: int = 4) -> DataFrame:
    """Rule texts of all leaves, from their steps of depth (from 0) under ``max_depth``, tightened.

    Deeper leaves share the text of their first steps, so a pooled harvest counts their rows there.
    """
    return rule_strings(tighten(steps.where(F.col("depth") < max_depth)))


def leaf_steps(nodes: DataFrame, breaks: dict[str, list[float]], max_depth: int = 32) -> DataFrame:
    """(tree, leaf_id, depth, feature, direction, thresh_bin): the conditions from the root to each leaf.

    ``nodes`` as ``models.node_table`` gives them; depth counts from 0 at the root, ``<=`` leads
    to ``yes``.  thresh_bin is the midpoint of the split's bin among its feature's ``breaks``,
    or the split itself where those are fewer than two.  A tree of one leaf has no step.
    """
    spark = nodes.sparkSession
    edge = F.explode(F.array(F.struct(F.col("yes").alias("id"), F.lit("<=").alias("direction")), F.struct(F.col("no").alias("id"), F.lit(">").alias("direction"))))
    up = nodes.where("feature is not null").select("tree", F.col("id").alias("parent"), "feature", "split", edge.alias("_e")).select("tree", "parent", "feature", "split", "_e.*")
    # from the leaves upwards: a level a join
    level = nodes.where("leaf_id is not null").select("tree", "leaf_id", "id", F.lit(0).alias("_up"))
    out = None
    for _ in range(max_depth):
        step = stats.settled(level.join(up, ["tree", "id"]))  # a row for each leaf, once
        if not step.limit(1).count():
            break
        part = step.select("tree", "leaf_id", "_up", "feature", "direction", "split")
        out = part if out is None else out.union(part)
        level = step.select("tree", "leaf_id", F.col("parent").alias("id"), (F.col("_up") + 1).alias("_up"))
    if out is None:
        return spark.createDataFrame([], "tree int, leaf_id int, depth int, feature string, direction string, thresh_bin double")
    deep = out.groupBy("tree", "leaf_id").agg(F.max("_up").alias("_deep"))
    edges = spark.createDataFrame([(f, b) for f, b in breaks.items() if len(b) > 1] or [("", [0.0, 0.0])], "feature string, _breaks array<double>")  # a row for each feature
    j = out.join(deep, ["tree", "leaf_id"]).join(F.broadcast(edges), "feature", "left")
    k = find_bin(F.col("split"), F.col("_breaks"))
    middle = (F.element_at("_breaks", k) + F.element_at("_breaks", k + 1)) / 2
    return j.select("tree", "leaf_id", (F.col("_deep") - F.col("_up")).alias("depth"), "feature", "direction", F.when(F.col("_breaks").isNull(), F.col("split")).otherwise(middle).alias("thresh_bin"))


def find_bin(x: Column, breaks: Column) -> Column:
    """Interval number 1 .. n - 1, ends included."""
    return F.greatest(F.lit(1), F.least(F.size(breaks) - 1, F.size(F.filter(breaks, lambda b: b <= x))))


def harvest(leaves: DataFrame, rules: DataFrame, pooled: bool = True, min_support: int = 20) -> DataFrame:
    """Rules with support, precision, recall, lift, odds ratio, p and q values.

    ``rules`` holds every leaf's text (``path_rules``), whatever its length.  Pooled: a rule's
    rows are the distinct rows of all leaves that share its text.  A cheap
    first pass over leaf counts drops rules that can't reach the support.  Rules, a row for each
    leaf of the model, go to the rows.
    """
    key = ["rule_str"] if pooled else ["rule_str", "tree", "leaf_id"]
    known = leaves.where("cls is not null")
    tot = known.select("row", "cls").distinct().agg(F.count_if(F.col("cls") == "extreme").alias("_N"), F.count_if(F.col("cls") == "background").alias("_B"))
    ledger = leaf_counts(known).join(rules, ["tree", "leaf_id"]).groupBy(*key).agg(F.sum(F.col("n_extreme") + F.col("n_bg")).alias("_s")).where(F.col("_s") >= min_support)
    kept = rules.join(ledger.select(*key), key, "left_semi")
    rows = known.join(F.broadcast(kept), ["tree", "leaf_id"]).select(*key, "rule_len", "row", "cls").distinct()
    g = rows.groupBy(*key).agg(F.max("rule_len").alias("rule_len"), F.count_if(F.col("cls") == "extreme").alias("n_extreme"), F.count_if(F.col("cls") == "background").alias("n_bg"))
    g = g.withColumn("support", F.col("n_extreme") + F.col("n_bg")).where(F.col("support") >= min_support).join(F.broadcast(tot))  # one row
    e, s = F.col("n_extreme"), F.col("support")
    g = g.withColumns({"precision": e / F.greatest(F.lit(TINY), s), "recall": F.try_divide(e, F.col("_N")), "odds_ratio": stats.odds_ratio(e, F.col("n_bg"), F.col("_N") - e, F.col("_B") - F.col("n_bg"))})
    g = g.withColumn("lift", F.try_divide(F.col("precision"), F.try_divide(F.col("_N"), F.col("_N") + F.col("_B"))))
    g = stats.settled(stats.hypergeom_upper(g, "n_extreme", "_N", "_B", "support"))  # a row for each rule, read several times below
    return stats.bh_adjust(g.drop("_N", "_B"), "pval", "rule_str")


def rule_order(rules: DataFrame) -> DataFrame:
    return rules.orderBy("qval", F.desc("lift"), F.desc("odds_ratio"), F.desc("precision"), F.desc("recall"), "rule_str")


def validate(leaves: DataFrame, rules: DataFrame, candidates: DataFrame, **options) -> DataFrame:
    """The harvest's statistics on other rows, for candidate rules only (support from 1)."""
    return harvest(leaves, rules.join(candidates.select("rule_str"), "rule_str", "left_semi"), **{"min_support": 1, **options})


def tree_paths(nodes: DataFrame, max_depth: int = 32) -> DataFrame:
    """(tree, id, depth, path) from nodes (tree, id, yes, no): a join with the edges for each level."""
    edges = nodes.select("tree", F.col("id").alias("parent"), F.explode(F.array("yes", "no")).alias("id")).where("id is not null")
    roots = nodes.select("tree", "id").join(edges.select("tree", "id"), ["tree", "id"], "left_anti")
    level = roots.select("tree", "id", F.lit(0).alias("depth"), F.col("id").cast("string").alias("path"))
    out = level
    for _ in range(max_depth):
        level = stats.settled(edges.join(level.withColumnRenamed("id", "parent"), ["tree", "parent"]).select("tree", "id", (F.col("depth") + 1).alias("depth"), F.concat_ws(">", "path", F.col("id").cast("string")).alias("path")))
        if not level.limit(1).count():
            break
        out = out.union(level)
    return out
