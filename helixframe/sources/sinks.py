"""Writers: compressed text, plain lists, per-threshold folders, wide matrices."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import stats


def tsv_gz(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep="\t", header=True, compression="gzip", nullValue="NA")


def plain(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated without header or quotes."""
    df.write.mode(mode).csv(path, sep="\t", header=False, quote="", emptyValue="", nullValue="NA")


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True, nullValue="NA")


def by_threshold(sites: DataFrame, path: str, threshold: str = "threshold") -> None:
    """A folder for each threshold, named by its tenths (0.4: ct=4, 0.35: ct=3.5, 1: ct=10)."""
    tenths = F.round(F.col(threshold).cast("double") * 10, 6)
    name = F.when(tenths == F.floor(tenths), F.floor(tenths).cast("string")).otherwise(tenths.cast("string"))
    sites.withColumn("ct", name).drop(threshold).write.partitionBy("ct").csv(path, sep="\t")


def model_results(results: DataFrame, folder: str, base: str = "results") -> list[str]:
    """Three tables of models: formulas, variance components and marginal means; the paths written.

    ``results`` (statistic, formula, var_components, marginal_means: arrays of structs or null)
    is computed once.  The tables are written aside and appear under their names together, all
    or none of them where one can't be written.
    """
    spark = results.sparkSession
    once = stats.settled(results)
    inner = lambda c: once.where(F.col(c).isNotNull()).select(F.explode(c).alias("_"), "statistic", "formula").select("_.*", "statistic", "formula")
    tables = {"all_formulas": once.select("statistic", "formula"), "var_components": inner("var_components"), "marginal_means": inner("marginal_means")}
    path = spark._jvm.org.apache.hadoop.fs.Path
    aside = f"{folder}/.{base}-{uuid.uuid4().hex}"
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    taken = [n for n in tables if fs.exists(path(f"{folder}/{base}_{n}.csv"))]
    if taken:
        raise FileExistsError(f"{folder} has {', '.join(taken)} of {base}")
    moved = []
    try:
        for name, df in tables.items():
            df.write.csv(f"{aside}/{name}", header=True, nullValue="NA")
        for name in tables:
            if not fs.rename(path(f"{aside}/{name}"), path(f"{folder}/{base}_{name}.csv")):
                raise OSError(f"{name} of {base} can't be put into {folder}")
            moved.append(f"{folder}/{base}_{name}.csv")
    except Exception:
        for p in moved:
            fs.delete(path(p), True)
        raise
    finally:
        fs.delete(path(aside), True)
    return moved


def with_common(df: DataFrame, path: str, least: float = 0.05, maf: str = "maf") -> None:
    """All rows, and those with a common allele beside them, from one staged table."""
    df.write.parquet(f"{path}/all")
    df.sparkSession.read.parquet(f"{path}/all").where((F.col(maf) > least) & (F.col(maf) < 1 - least)).write.parquet(f"{path}/common")


def wide(cells: DataFrame, samples: list[str], path: str, value: str = "depth", keys: tuple[str, ...] = ("site",)) -> None:
    """One row a site and one column a sample, in the order given; absent cells are 0."""
    cells.groupBy(*keys).pivot("sample", samples).agg(F.first(value)).na.fill(0).write.csv(path, sep="\t", header=True, compression="gzip")
