"""Read-level operators: mapping-quality caps and the alignment walk behind them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.sources.alignments import with_reference


def alignment_cost(sub_q: Column, mismatches: Column, matched: Column, clip_q: Column) -> Column:
    """Quality of the mismatches less their expectation, plus a fifth of the clipped quality."""
    log_fact = F.aggregate(F.sequence(F.lit(0), F.coalesce(mismatches, F.lit(0)).cast("int")), F.lit(0.0), lambda a, i: a + F.ln(F.greatest(i, F.lit(1))))
    return sub_q - 4.343 * (F.when(mismatches > 0, mismatches * F.ln(matched)).otherwise(0.0) - log_fact) + clip_q / 5


#: Caps tried by default (fixed values).
CAPS = (0, 50, 60, 75, 100)


def recap(reads: DataFrame, caps: tuple[int, ...] = CAPS, digits: int | None = None) -> DataFrame:
    """(name, orig_mq, new_mq, sub_q, clip_q, c, t): a row for each mapped read and cap.

    ``reads`` (name, orig_mq, sub_q, mismatches, matched, clip_q and, if known, is_unmapped).  The new
    quality is the one the cap allows, whatever the read's own; a cap of 0 leaves that.  A read's
    cost is computed once for all caps; ``digits``: its doubles are rounded, also once.
    """
    reads = reads.where(~F.coalesce("is_unmapped", F.lit(False))) if "is_unmapped" in reads.columns else reads
    costs = reads.withColumn("t", alignment_cost(*[F.col(c) for c in ("sub_q", "mismatches", "matched", "clip_q")]))
    one = lambda c: F.struct(F.lit(c).alias("c"), F.coalesce(cap_of(F.col("t"), c), F.col("orig_mq")).cast("int").alias("new_mq"))
    shown = {c: F.col(c) if digits is None else F.round(c, digits) + F.lit(0.0) for c in ("sub_q", "clip_q", "t")}
    rows = costs.select("name", "orig_mq", F.array(*[one(c) for c in caps]).alias("_caps"), *[e.alias(c) for c, e in shown.items()])
    return rows.withColumn("_c", F.explode("_caps")).select("name", "orig_mq", "_c.new_mq", "sub_q", "clip_q", "_c.c", "t")


def cap_of(t: Column, cap: float) -> Column:
    """Cap of the mapping quality of a read of cost ``t`` for coefficient ``cap``; 0 means no cap (null)."""
    if cap == 0:
        return F.lit(None).cast("int")
    capped = F.floor(cap * F.sqrt((F.lit(float(cap)) - F.greatest(t, F.lit(0.0))) / cap) + 0.499)
    return F.when(t > cap, F.lit(0)).otherwise(capped.cast("int"))


def mapq_cap(sub_q: Column, mismatches: Column, matched: Column, clip_q: Column, cap: float) -> Column:
    """``cap_of`` of a read's alignment."""
    return cap_of(alignment_cost(sub_q, mismatches, matched, clip_q), cap)


#: (matched, mismatches, substitution quality, clip quality)
WALK = "matched int, mismatches int, sub_q double, clip_q double"


def walk_batch(seqs: list[bytes], quals: list[np.ndarray], ops: list[np.ndarray], lens: list[np.ndarray], refs: list[bytes], fold_case: bool = False) -> np.ndarray:
    """(matched, mismatches, sub_q, clip_q) of each read, all operations and bases of a batch at once.

    Aligned bases of quality 13 and more where neither side is N count as matched; those that
    differ are mismatches, whose qualities count up to 33.  Soft clips add their qualities to the
    clip quality, hard clips 13 a base.  Runs of stated equality or difference move along both
    sides uncounted, skips along the reference.  Case tells unless ``fold_case``; bases beyond
    the end of either side, and reads without qualities, don't count.
    """
    n = len(seqs)
    read = np.repeat(np.arange(n), [len(o) for o in ops])
    op = np.concatenate([np.zeros(0, np.int64), *ops]).astype(np.int64)
    size = np.concatenate([np.zeros(0, np.int64), *lens]).astype(np.int64)

    def begins(kinds: tuple[int, ...]) -> np.ndarray:
        """Place on one side before each operation, from 0 in each read."""
        step = np.where(np.isin(op, kinds), size, 0)
        total = np.cumsum(step) - step
        first = np.searchsorted(read, read)  # each read's first operation
        return total - total[first] if len(total) else total

    q_at, r_at = begins((0, 1, 4, 7, 8)), begins((0, 2, 3, 7, 8))

    def bases(kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Read, place in the read and in the reference of every base of one kind of operation."""
        of = np.flatnonzero(op == kind)
        within = np.arange(size[of].sum()) - np.repeat(np.cumsum(size[of]) - size[of], size[of])
        of = np.repeat(of, size[of])
        return read[of], q_at[of] + within, r_at[of] + within

    start = lambda parts: np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    s_at, u_at, f_at = start(seqs), start(quals), start(refs)
    seq, ref = (np.frombuffer(b"".join(x).upper() if fold_case else b"".join(x), np.uint8) for x in (seqs, refs))
    qual = np.concatenate([np.zeros(0, np.int64), *quals]).astype(np.int64)
    length = lambda at, of: at[of + 1] - at[of]

    of, i, j = bases(0)
    ok = (i < np.minimum(length(s_at, of), length(u_at, of))) & (j < length(f_at, of))
    of, i, j = of[ok], i[ok], j[ok]
    q, a, b = qual[u_at[of] + i], seq[s_at[of] + i], ref[f_at[of] + j]
    ok = (q >= 13) & (a != ord("N")) & (b != ord("N"))
    of, q, wrong = of[ok], q[ok], (a != b)[ok]
    sum_of = lambda of, w=None: np.bincount(of, weights=w, minlength=n)
    clipped, i, _ = bases(4)
    ok = i < length(u_at, clipped)
    clip = sum_of(clipped[ok], qual[u_at[clipped[ok]] + i[ok]]) + sum_of(read[op == 5], 13.0 * size[op == 5])
    return np.stack([sum_of(of), sum_of(of[wrong]), sum_of(of[wrong], np.minimum(q[wrong], 33)), clip], axis=1)


def walk_column(seq: Column, quals: Column, ops: Column, lens: Column, ref: Column, fold_case: bool = False) -> Column:
    """``WALK`` of each read; qualities as binary or as an array of numbers, null values as empty ones."""

    def run(s: pd.Series, q: pd.Series, o: pd.Series, n: pd.Series, r: pd.Series) -> pd.DataFrame:
        text = lambda x: [(v or "").encode() for v in x]
        numbers = lambda x: [np.zeros(0, np.int64) if v is None else np.frombuffer(v, np.uint8) if isinstance(v, (bytes, bytearray)) else np.asarray(v, np.int64) for v in x]
        got = walk_batch(text(s), numbers(q), numbers(o), numbers(n), text(r), fold_case)
        out = pd.DataFrame(got, columns=["matched", "mismatches", "sub_q", "clip_q"])
        return out.astype({"matched": int, "mismatches": int})

    run.__annotations__ = dict.fromkeys("sqonr", pd.Series) | {"return": pd.DataFrame}
    return F.pandas_udf(run, WALK)(seq, quals, ops, lens, ref)


def recap_alignments(reads: DataFrame, pieces: DataFrame, caps: tuple[int, ...] = CAPS, piece_size: int = 1 << 16, fold_case: bool = False) -> DataFrame:
    """(name, orig_mq, new_mq, as1, sub_q, clip_q, rl, c, t): a row for each mapped alignment and cap.

    ``reads`` as ``alignments`` gives them, ``pieces`` of ``piece_size`` as ``reference_pieces`` does.
    """
    mapped = with_reference(reads.where((F.col("flag").bitwiseAND(4) == 0)), pieces, piece_size)
    walked = mapped.withColumn("w", walk_column(F.col("seq"), F.col("quals"), F.col("ops"), F.col("lens"), F.col("ref_part"), fold_case))
    rows = walked.select("name", F.col("mapq").alias("orig_mq"), "w.*", F.col("score").alias("as1"), F.length("seq").alias("rl"))
    kept = rows.select(F.struct("as1", "rl").alias("name_"), "*")
    out = recap(kept.select(F.struct("name", "name_").alias("name"), "orig_mq", "sub_q", "mismatches", "matched", "clip_q"), caps)
    return out.select("name.name", "orig_mq", "new_mq", "name.name_.as1", "sub_q", "clip_q", "name.name_.rl", "c", "t")
