"""Best-fit packing (operator 1) by exact-complement hashing over a histogram of lengths.

Lengths are at most ``capacity``, so the whole corpus is described by at most ``capacity``
counts: the plan is made on the driver from those, whatever the input's size, and each
document finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, tokens

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: A length's pieces are ranked in hash slices of about so many, so no length is one task's.
SLICE_ROWS = 250_000
#: If rows carry texts or ids, in slices of about so many tokens: a slice's rows are sorted and ranked in memory.
SLICE_TOKENS = 4_000_000


def tokenize_pieces(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id"
) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and ``end_id``, cut if over ``capacity``.

    Null and empty texts become the end id alone.  The first piece takes the remainder, the
    others are full.  Null ids and repeated rows are kept as they are; other columns go.
    """
    path = path or tokens.tokenizer_path(VOCABULARY)
    shared.text_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            enc = tokens.encoder(path)
            rows = []
            for doc, ids in zip(pdf["doc_id"], enc.encode(pdf["text"].tolist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, i, a, b - a, ids[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids binary")


def ids_crc32(ids):
    """Unsigned crc32 of little-endian unsigned 32-bit ids held in a binary column."""
    return F.crc32(ids)


# --- plan ---------------------------------------------------------------------------------


class SumIndex:
    """Single, pair and triple sums of the lengths that are left, under their counts.

    Entry s of the pair (triple) index is the largest length that may still head a combination
    of sum s.  Counts only fall, so entries only move down: all look-ups together take about
    ``capacity ** 2`` steps, whatever the number of documents.
    """

    def __init__(self, free: np.ndarray):
        self.free = free.tolist()
        self.pair_head = list(range(-1, len(free) - 1))
        self.triple_head = list(range(-2, len(free) - 2))

    def _pair_ok(self, total: int, high: int) -> bool:
        low = total - high
        return self.free[high] > 0 and self.free[low] > (low == high)

    def pair(self, total: int) -> tuple[int, int] | None:
        high = self.pair_head[total]
        while 2 * high >= total and high > 0 and not self._pair_ok(total, high):
            high -= 1
        self.pair_head[total] = high
        return (high, total - high) if high > 0 and 2 * high >= total else None

    def _beside(self, a: int, total: int) -> tuple[int, int] | None:
        """A pair of sum ``total`` that is left when one piece of length ``a`` is taken."""
        two = self.pair(total)
        if two is None or self.free[a] > (a == two[0]) + (a == two[1]):
            return two
        for high in range(two[0] - 1, (total - 1) // 2, -1):
            if self._pair_ok(total, high) and self.free[a] > (a == high) + (a == total - high):
                return high, total - high
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        a = self.triple_head[total]
        while 3 * a >= total and a > 0:
            if self.free[a] and (two := self._beside(a, total - a)):
                self.triple_head[total] = a
                return a, *two
            a -= 1
        self.triple_head[total] = a
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill ``gap`` exactly, longest first."""
        if self.free[gap]:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Segments (length, first rank, how many, first sequence, offset) for a histogram of lengths.

    Piece number r of its length, in [first rank, first rank + how many), lies in sequence
    first sequence + r - first rank at the offset.  The longest length left opens sequences;
    single, pair and triple sums that fill the gap exactly are consumed under the counts;
    where none does, the longest fitting length is added and the look-up repeated.
    """
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        free[length] = n
    index = SumIndex(free)
    left, segments, used, sequences = index.free, [], [0] * (capacity + 1), 0
    fitting = list(range(capacity + 1))  # entry g: the longest length that may be left and fits g

    def fits(gap: int) -> int:
        length = gap
        while not left[length] and length:
            length = min(length - 1, fitting[length])
        at = gap
        while at > length:  # entries only move down
            fitting[at], at = length, max(length, min(at - 1, fitting[at]))
        return length

    while first := fits(capacity):
        pattern = [first]
        left[first] -= 1
        gap = capacity - first
        while gap:
            more = index.exact(gap)
            if more is None:
                more = (fits(gap),)
                if not more[0]:
                    break
            for length in more:
                left[length] -= 1
                gap -= length
            pattern += more
        lengths, times = np.unique(pattern, return_counts=True)
        n = 1 + min(left[k] // t for k, t in zip(lengths.tolist(), times.tolist(), strict=True))
        at = 0
        for length in pattern:
            segments.append((length, used[length], n, sequences, at))
            used[length] += n
            left[length] -= n - 1
            at += length
        sequences += n
    return segments


# --- placement ----------------------------------------------------------------------------


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (any columns, with long ``length`` from 1 to ``capacity``) plus sequence_id and offset.

    Ranks within a length are counted slice by slice; a length gets slices by its count, and by
    its tokens where rows carry them, so one that a third of all pieces share is spread over as
    many tasks as it needs.  Repeated rows
    each get a place of their own; an empty table gives none; clashing sequence_id or offset
    columns are replaced; names that begin with ``_pack_`` are kept for this function's use.
    """
    order_cols = [F.col(c) for c in order]
    rows = shared.stage(pieces.drop("sequence_id", "offset"), "pieces")
    total = dict(rows.groupBy("length").count().collect())  # at most capacity rows
    carried = any(kind in ("binary", "string") for _, kind in rows.dtypes)
    slices = {k: -(-n // (min(SLICE_ROWS, max(1, SLICE_TOKENS // k)) if carried else SLICE_ROWS)) for k, n in total.items()}
    by_length: dict[int, list] = {}
    for length, *rest in plan_packing(total, capacity):
        by_length.setdefault(length, []).append(rest)
    segments = {k: np.array(v, np.int64) for k, v in by_length.items()}

    several = [F.lit(x) for k, n in slices.items() if n > 1 for x in (k, n)]
    own = F.coalesce(F.try_element_at(F.create_map(*several), F.col("length")), F.lit(1)) if several else F.lit(1)
    rows = rows.withColumn("_pack_slice", F.pmod(F.xxhash64(*order_cols), own).cast("int"))
    starts: dict[tuple[int, int], int] = {}
    if several:
        # about one row for each SLICE_ROWS pieces, or SLICE_TOKENS tokens, of the frequent lengths
        sizes = rows.where(own > 1).groupBy("length", "_pack_slice").count().collect()
        before: dict[int, int] = {}
        for r in sorted(sizes, key=lambda r: (r["length"], r["_pack_slice"])):
            starts[r["length"], r["_pack_slice"]] = before.get(r["length"], 0)
            before[r["length"]] = before.get(r["length"], 0) + r["count"]
    given = shared.broadcast(rows.sparkSession, (segments, starts))

    def place(length: pd.Series, part: pd.Series, rank: pd.Series) -> pd.DataFrame:
        tokens.forget()  # a worker of the encoding tasks, all of which are over
        segments, starts = given.value
        length, part, rank = length.to_numpy(), part.to_numpy(), rank.to_numpy()
        seq, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for value in np.unique(length):
            for k in np.unique(part[length == value]):
                own = np.flatnonzero((length == value) & (part == k))
                seg, r = segments[int(value)], rank[own] + starts.get((int(value), int(k)), 0)
                k = np.searchsorted(seg[:, 0], r, side="right") - 1
                seq[own], at[own] = seg[k, 2] + r - seg[k, 0], seg[k, 3]
        return pd.DataFrame({"sequence_id": seq, "offset": at})

    place.__annotations__ = {"length": pd.Series, "part": pd.Series, "rank": pd.Series, "return": pd.DataFrame}
    placed = F.pandas_udf(place, "sequence_id long, offset long")
    rank = F.row_number().over(Window.partitionBy("length", "_pack_slice").orderBy(*order_cols)) - 1
    out = rows.withColumn("_pack_rank", rank.cast("long")).withColumn("_pack_at", placed("length", "_pack_slice", "_pack_rank"))
    keep = [c for c in rows.columns if c != "_pack_slice"]
    return out.select(*keep, F.col("_pack_at.sequence_id").alias("sequence_id"), F.col("_pack_at.offset").alias("offset"))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    pieces = tokenize_pieces(shared.table(spark, sf_dir, "documents"))
    keyed = pieces.select("doc_id", "piece", "start", "length", ids_crc32(F.col("ids")).alias("ids_crc32"))
    return best_fit_pack(keyed)
