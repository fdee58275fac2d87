"""The dip of a sample: its distance from the nearest unimodal distribution, exactly, ties included."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gap_left_of(x: np.ndarray, low: np.ndarray, high: np.ndarray, mode: int) -> float:
    """Largest height of the steps left of the mode over the convex minorant of the points (x, low) up to it."""
    at, worst = 0, 0.0
    while at < mode:
        slope = (low[at + 1 : mode + 1] - low[at]) / (x[at + 1 : mode + 1] - x[at])
        least = slope.min()
        nxt = at + 1 + int(np.flatnonzero(slope == least)[-1])
        worst = max(worst, float((high[at:nxt] - low[at] - least * (x[at:nxt] - x[at])).max()))
        at = nxt
    return worst


def dip_of_counts(values: np.ndarray, counts: np.ndarray) -> float:
    """Dip of distinct ascending values with their counts.

    A distribution with its mode (and perhaps an atom) at one value is convex left of it and
    concave right of it, so the least distance for that mode is half the larger of two gaps:
    of the steps over their convex minorant, and of their concave majorant over the steps.
    The left gap grows with the mode and the right one falls, so the best mode lies where they
    cross.  No sample's dip is under 1 / (2 n).
    """
    n = int(counts.sum())
    high = np.cumsum(counts).astype(float)
    low = high - counts
    turned = -values[::-1], n - high[::-1], n - low[::-1]
    last = len(values) - 1
    left = lambda m: gap_left_of(values, low, high, m)
    right = lambda m: gap_left_of(*turned, last - m)
    a, b = 0, last  # the first mode whose left gap is at least its right one
    while a < b:
        m = (a + b) // 2
        a, b = (a, m) if left(m) >= right(m) else (m + 1, b)
    best = min(max(left(m), right(m)) for m in (a, max(0, a - 1)))
    return max(1.0, best) / (2 * n)


def dip(values) -> float:
    """Dip of a sample; NaN for an empty one."""
    x, counts = np.unique(np.asarray(values, float), return_counts=True)
    return dip_of_counts(x, counts) if len(x) else float("nan")


def dip_of(values: Column, least: int = 5) -> Column:
    """Dip of an array of doubles, null under ``least`` values; nulls and values that aren't finite don't count."""

    def run(rows: pd.Series) -> pd.Series:
        kept = (np.asarray(v, float) if v is not None else np.zeros(0) for v in rows)
        kept = (v[np.isfinite(v)] for v in kept)
        return pd.Series([dip(v) if len(v) >= least else None for v in kept], dtype=float)

    run.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(values)
