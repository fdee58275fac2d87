"""Host-level quality rules (operator 4), in DataFrame functions alone.

Documents get exact counts and a base verdict; failures are summed by host; the hosts' rates
are shrunk with a beta prior fitted to them by moments; a host whose shrunk rate is too high
fails, with all its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MAX_RATE = 0.5
_GAP = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null and empty texts have no words and fail.  Windows of three words are compared by
    64-bit hashes within a text; only texts in which a hash recurs look for the places.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    a = docs.withColumn("_t", text)
    a = a.withColumn("_w", F.array_remove(F.split("_t", shared.SEPARATORS), ""))
    a = a.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, _GAP, "")) > 0))
    a = a.withColumn("n_words", F.size("_w").cast("long"))
    a = a.withColumn("word_chars", F.length(F.translate("_t", _GAP, "")).cast("long"))
    a = a.withColumn("n_symbols", (F.length("_t") - F.length(F.translate("_t", _SYMBOLS, ""))).cast("long"))
    a = a.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    windows = F.expr(
        "CASE WHEN n_words > 3 THEN transform(sequence(0, cast(n_words AS int) - 3),"
        " i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))) ELSE array() END"
    )
    a = a.withColumn("_h", windows.cast("array<bigint>"))
    # places of the windows in order of their hashes, then those equal to a neighbour
    a = a.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h, i))) END"))
    a = a.withColumn("_p", F.expr("transform(filter(transform(_s, (x, i) -> IF(x.h = get(_s, i - 1).h OR x.h = get(_s, i + 1).h, x.i, -1)), i -> i >= 0), i -> array(i, i + 1, i + 2))"))
    a = a.withColumn("n_repeat_words", F.expr("CASE WHEN _p IS NULL THEN 0 ELSE size(array_distinct(flatten(_p))) END").cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return a.withColumn("base_failed", failed).drop("_t", "_w", "_lines", "_h", "_s", "_p")


def host_rates(counted: DataFrame, host: str = "source") -> DataFrame:
    """(host, n, failures, rate): failure rates shrunk towards a beta prior fitted by moments.

    With one host, equal rates or more variance than a beta can have, the prior is worth one
    document at the mean rate.  A null host is a host of its own.
    """
    per = counted.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    p = F.col("failures") / F.col("n")
    moments = per.agg(F.sum("failures").alias("f"), F.sum("n").alias("d"), F.avg(p).alias("m"), F.var_pop(p).alias("v"))
    moments = moments.select(F.try_divide("f", "d").alias("mean"), (F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1).alias("k"))
    moments = moments.select("mean", F.when(F.col("k") > 1, F.col("k")).otherwise(1.0).alias("weight"))
    rate = (F.col("failures") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    # one row: its size is proven
    return per.join(F.broadcast(moments)).select(host, "n", "failures", rate.alias("rate"))


def apply_host_rules(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The counts of ``text_counts`` plus host_rate and kept, one row for each row of ``docs``."""
    own = docs.select("doc_id", "text", F.col(host).alias("_host"))
    counted = shared.stage(text_counts(own).drop("text"), "counts")
    rates = host_rates(counted, "_host").select(F.col("_host").alias("_h2"), "rate")
    out = counted.join(rates, F.col("_host").eqNullSafe(F.col("_h2")), "left")
    kept = ~F.col("base_failed") & (F.col("rate") <= max_rate)
    return out.select(*[c for c in counted.columns if c != "_host"], F.col("rate").alias("host_rate"), kept.alias("kept"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_host_rules(shared.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
c AS (SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, w FROM w),
g AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM c WHERE len(w) > 2)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM r) GROUP BY 1),
b AS (SELECT c.doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
             n_words < 50 OR 100 * coalesce(p.n, 0) > 50 * n_words AS base_failed FROM c LEFT JOIN p USING (doc_id)),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY 1),
m AS (SELECT sum(f) / sum(n) AS mean, avg(f / n) AS m, var_pop(f / n) AS v FROM h),
k AS (SELECT mean, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 1 THEN m * (1 - m) / v - 1 ELSE 1.0 END AS weight FROM m),
s AS (SELECT source, (f + mean * weight) / (n + weight) AS rate FROM h, k)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source
"""
