"""Joins, unions, sorts and reshapes of whole tables by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import ranks


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns that both sides have; none in common is an error."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("the two sides share no column")
    return a.join(b, shared, how)


def left_many(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Left join in which keys may repeat on both sides; without ``keys``, on all shared columns."""
    return natural_join(a, b, "left") if keys is None else a.join(b, keys, "left")


def filled_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join; a further column that both sides have takes the right side's value where the left's is null."""
    twice = [c for c in a.columns if c in b.columns and c not in keys]
    j = a.join(b.withColumnsRenamed({c: f"{c}_y" for c in twice}), keys, "left")
    return j.withColumns({c: F.coalesce(c, f"{c}_y") for c in twice}).drop(*[f"{c}_y" for c in twice]) if twice else j


def anti_join(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return df.join(names.select(key), key, "left_anti")


def without_pattern(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column does not contain ``text``; a null column stays."""
    return df.where(~F.coalesce(F.col(column).contains(text), F.lit(False)))


def share(a: Column, b: Column) -> Column:
    """a / (a + b); null where the sum is 0."""
    return F.try_divide(a, a + b)


def stack(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables, by name; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def concat_beds(tables: list[DataFrame]) -> DataFrame:
    """(chrom, start, end) rows of several interval tables, by place, repeats kept."""
    return reduce(lambda a, b: a.union(b), [t.select(*t.columns[:3]).toDF("chrom", "start", "end") for t in tables])


def common_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """Distinct keys that every table has: one aggregation, however many tables."""
    tagged = reduce(lambda a, b: a.union(b), [t.select(key, F.lit(1 << i).alias("_bit")) for i, t in enumerate(tables)])
    return tagged.groupBy(key).agg(F.bit_or("_bit").alias("_all")).where(F.col("_all") == (1 << len(tables)) - 1).select(key)


def union_keys(tables: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.union(b), [t.select(key) for t in tables]).distinct()


def minus_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def membership_counts(df: DataFrame, key: str, member: str, members: list[str], top: int = 15) -> DataFrame:
    """(mask, n): how many keys have exactly this set of members, bit i being ``members[i]``; the ``top`` largest."""
    bit = F.coalesce(*[F.when(F.col(member) == m, F.lit(1 << i)) for i, m in enumerate(members)], F.lit(0)).cast("long")
    per = df.groupBy(key).agg(F.bit_or(bit).alias("mask"))
    return per.groupBy("mask").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mask").limit(top)


def arrange(df: DataFrame, *keys: str) -> DataFrame:
    """Sorted by all keys; ``-key`` is descending.  Text sorts by bytes."""
    return df.orderBy(*[F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys])


def sorted_export(df: DataFrame, path: str, chrom: str = "chrom", start: str = "start") -> None:
    """Tab-separated files whose names sort as their rows do: text by bytes, then start by number."""
    arrange(df, chrom, start).write.csv(path, sep="\t", header=False, quote="", emptyValue="")


def longer(df: DataFrame, ids: list[str], columns: list[str], name: str = "stat", value: str = "value") -> DataFrame:
    """A row for each id and column; columns become doubles."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(ids, columns, name, value)


def longer_by_suffix(df: DataFrame, ids: list[str], suffix: str, name: str = "stat", value: str = "value") -> DataFrame:
    """``longer`` over the columns whose name ends in ``suffix``, which the names then lack."""
    found = [c for c in df.columns if c.endswith(suffix) and c not in ids]
    return longer(df.withColumnsRenamed({c: c.removesuffix(suffix) for c in found}), ids, [c.removesuffix(suffix) for c in found], name, value)


def levels(df: DataFrame, ids: list[str], params: list[str]) -> DataFrame:
    """(ids, parameter, level): parameter columns as text levels, a row each."""
    return df.select(*ids, *[F.col(p).cast("string").alias(p) for p in params]).unpivot(ids, params, "parameter", "level")


def unlist(df: DataFrame, column: str) -> DataFrame:
    """A row for each entry of a list column; empty and null lists give none."""
    return df.withColumn(column, F.explode(column))


def checked_measure(df: DataFrame, column: str) -> DataFrame:
    """``df``, or an error at once where the column has no finite mean, or its standard or median absolute deviation is 0."""
    x = F.col(column).cast("double")
    m = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("bad")).first()
    if m["m"] is None or m["bad"] or not m["s"]:
        raise ValueError(f"{column} has no finite mean or doesn't vary")
    median = ranks.exact_medians(df, [x])[0]
    if not ranks.exact_medians(df, [F.abs(x - median)])[0]:
        raise ValueError(f"half of {column} or more is one value")
    return df
