"""Mixing sources to target weights (operator 9), in DataFrame functions alone.

Token shares p of the sources are raised to an exponent and normalised: w ~ p**a.  A lower
exponent flattens the mixture: entropy rises, and small sources are repeated more.  The
exponent is bisected to meet a target entropy, a repetition limit or both.  The budget is the
least at which the weights leave no document out; it is dealt source by source as epochs,
each a permutation of the source's blocks of documents and of the documents in a block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

REPEATS, STEPS = 2.0, 40
#: Blocks of a source: BLOCKS and one more for each BLOCK_ROWS documents of the corpus.
BLOCKS, BLOCK_ROWS = 32, 100_000


def token_count(text) -> Column:
    """Words, at least 1: what budgets count."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.greatest(F.size(F.array_remove(F.split(t, shared.SEPARATORS), "")), F.lit(1)).cast("long")


def bisect_exponent(shares: DataFrame, repeats: float | None = REPEATS, entropy: float | None = None, steps: int = STEPS) -> float:
    """Exponent in [0, 1] for ``shares`` (ln_p); each step is one aggregation to one row.

    ``repeats``: the most epochs of any source when the most favoured has one; the exponent
    is the least that respects it.  ``entropy``: nats to reach; the exponent is the largest
    that does.  With both, the repetition limit wins.  0 where there is no source.
    """
    low_p, high_p = shares.agg(F.min("ln_p"), F.max("ln_p")).first()
    if low_p is None:
        return 0.0
    floor = 0.0
    if repeats is not None:
        lo, hi = 0.0, 1.0  # the rarest source is repeated (p_max / p_min) ** (1 - a) times
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if (1 - mid) * (high_p - low_p) <= math.log(repeats) else (mid, hi)
        floor = hi
    if entropy is None:
        return floor
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        x = F.exp(mid * (F.col("ln_p") - high_p))
        z, s = shares.agg(F.sum(x), F.sum(x * mid * (F.col("ln_p") - high_p))).first()
        lo, hi = (mid, hi) if math.log(z) - s / z >= entropy else (lo, mid)
    return max(lo, floor)


def source_weights(sizes: DataFrame, repeats: float | None = REPEATS, entropy: float | None = None) -> DataFrame:
    """``sizes`` (source, tokens) plus weight and epochs (a double from 1 up)."""
    total = F.broadcast(sizes.agg(F.sum("tokens").alias("_all")))  # one row
    shares = sizes.join(total).select("source", "tokens", F.ln(F.col("tokens") / F.col("_all")).alias("ln_p"))
    a = bisect_exponent(shares, repeats, entropy)
    raised = shares.withColumn("_x", F.exp(a * F.col("ln_p")))
    least = F.broadcast(raised.agg(F.sum("_x").alias("_z"), F.max(F.col("tokens") / F.col("_x")).alias("_b")))  # one row
    epochs = F.col("_b") * F.col("_x") / F.col("tokens")
    return raised.join(least).select("source", "tokens", (F.col("_x") / F.col("_z")).alias("weight"), F.greatest(F.round(epochs, 9), F.lit(1.0)).alias("epochs"))


def _rank(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def mix_sources(docs: DataFrame, repeats: float | None = REPEATS, entropy: float | None = None, seed: str = "mix") -> DataFrame:
    """``docs`` (doc_id, text, source, further columns) repeated by weight: adds epoch, block, place, mix_tokens.

    Epochs before a source's last are whole; its last takes blocks, then documents, in that
    epoch's order while the tokens before them lie under the budget's remainder.  A source's
    blocks are hash slices, whose number grows with the corpus, so no source is one task's.  A null source is a source; null
    texts count one token; repeated rows are dealt one by one.  Columns named like the four new
    ones are replaced, all others come back as they were.
    """
    docs = docs.drop("epoch", "block", "place", "mix_tokens")
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    slim = docs.select("doc_id", "source", token_count(F.col("text")).alias("mix_tokens"))
    # one row for each distinct (id, source, size): repeated rows share a place in the order
    slim = shared.stage(slim.groupBy("doc_id", "source", "mix_tokens").agg(F.count("*").alias("_same")), "mix")
    blocks = BLOCKS + slim.count() // BLOCK_ROWS
    slim = slim.withColumn("block", (F.conv(F.substring(_rank(seed, id_text), 1, 12), 16, 10).cast("long") % blocks).cast("int"))
    per_block = slim.groupBy("source", "block").agg(F.sum(F.col("mix_tokens") * F.col("_same")).alias("_t"))
    sizes = shared.stage(per_block.groupBy("source").agg(F.sum("_t").alias("tokens")), "sizes")  # a row for each source: the search reads it at each step
    weights = shared.stage(source_weights(sizes, repeats, entropy), "weights").withColumnRenamed("source", "_ws")

    # blocks of each epoch in its order, with the tokens of the epoch before them
    whole = F.floor("epochs").cast("int")
    share = (F.col("epochs") - F.floor("epochs")) * F.col("tokens")
    turns = per_block.join(weights, F.col("source").eqNullSafe(F.col("_ws")))
    turns = turns.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil("epochs").cast("int"))))
    turns = turns.withColumn("_order", _rank(seed, F.col("epoch"), F.col("block")))
    run = Window.partitionBy("_ws", "epoch").orderBy("_order", "block").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("_before", F.coalesce(F.sum("_t").over(run), F.lit(0)))
    turns = turns.withColumn("_room", F.when(F.col("epoch") <= whole, F.col("tokens").cast("double")).otherwise(share) - F.col("_before"))
    turns = turns.where("_room > 0").select(F.col("_ws"), F.col("block").alias("_b"), "epoch", "_before", "_room")

    dealt = slim.join(turns, F.col("source").eqNullSafe(F.col("_ws")) & (F.col("block") == F.col("_b")))
    dealt = dealt.withColumn("_order", _rank(seed, F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    run = Window.partitionBy("_ws", "block", "epoch").orderBy("_order", "doc_id", "mix_tokens").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_in", F.coalesce(F.sum(F.col("mix_tokens") * F.col("_same")).over(run), F.lit(0)))
    dealt = dealt.where(F.col("_in") < F.col("_room"))
    turn = F.struct("epoch", (F.col("_before") + F.col("_in")).alias("place"))
    # one row again for each document, with its turns
    dealt = dealt.groupBy("doc_id", "source", "mix_tokens", "block").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    dealt = dealt.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), "block", "mix_tokens", "_turns")
    # the caller's columns travel in one struct, so no name of theirs meets one of ours
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_own_d"), F.col("source").alias("_own_s"), token_count(F.col("text")).alias("_own_n"))
    same = F.col("_own_d").eqNullSafe(F.col("_d")) & F.col("_own_s").eqNullSafe(F.col("_s")) & (F.col("_own_n") == F.col("mix_tokens"))
    out = keyed.join(dealt, same).withColumn("_turn", F.explode("_turns"))
    return out.select("_row.*", F.col("_turn.epoch").alias("epoch"), "block", F.col("_turn.place").alias("place"), "mix_tokens")


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "source", "epoch", "block", "place", "mix_tokens")


SQL = r"""
WITH w AS (SELECT doc_id, source, greatest(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')), 1) AS n FROM documents),
d AS (SELECT *, (('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, 'null'))[1:12])::BIGINT) % (32 + (SELECT count(*) FROM (SELECT DISTINCT * FROM w)) // 100000) AS block FROM w),
z AS (SELECT source, sum(n) AS tokens FROM d GROUP BY 1),
p AS (SELECT source, tokens, ln(tokens / (SELECT sum(tokens) FROM z)) AS ln_p FROM z),
a AS (SELECT greatest(0, 1 - ln(2.0) / nullif(max(ln_p) - min(ln_p), 0)) AS a FROM p),
x AS (SELECT source, tokens, exp(coalesce((SELECT a FROM a), 0) * ln_p) AS x FROM p),
e AS (SELECT source, tokens, greatest(round((SELECT max(tokens / x) FROM x) * x / tokens, 9), 1.0) AS epochs FROM x),
b AS (SELECT source, block, sum(n) AS t FROM d GROUP BY 1, 2),
t AS (SELECT b.source, block, t, tokens, epochs, unnest(generate_series(1, ceil(epochs)::INT)) AS epoch FROM b JOIN e ON b.source IS NOT DISTINCT FROM e.source),
o AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY source, epoch ORDER BY md5('mix:' || epoch || ':' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
r AS (SELECT *, CASE WHEN epoch <= floor(epochs) THEN tokens ELSE (epochs - floor(epochs)) * tokens END - before AS room FROM o),
k AS (SELECT d.doc_id, d.source, r.epoch, d.block, d.n, r.before, r.room,
             coalesce(sum(d.n) OVER (PARTITION BY d.source, d.block, r.epoch ORDER BY md5('mix:' || r.epoch || ':' || coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id, d.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.block = r.block WHERE r.room > 0)
SELECT doc_id, source, epoch::INT AS epoch, block::INT AS block, (before + inside)::BIGINT AS place, n::BIGINT AS mix_tokens FROM k WHERE inside < room
"""
