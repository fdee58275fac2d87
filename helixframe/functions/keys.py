"""Site codes, parameter ids, packed fields and other text keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def site_code(scaffold, pos) -> Column:
    """``scaffold_pos``."""
    return F.concat_ws("_", scaffold, F.col(pos).cast("string") if isinstance(pos, str) else pos.cast("string"))


def split_code(code: Column) -> tuple[Column, Column]:
    """(scaffold, pos) split at the last underscore; a code without one is (code, '')."""
    has = code.contains("_")
    head = F.when(has, F.regexp_extract(code, r"^(.*)_([^_]*)$", 1)).otherwise(code)
    return head, F.when(has, F.regexp_extract(code, r"^(.*)_([^_]*)$", 2)).otherwise(F.lit(""))


def merge_code(line: Column) -> Column:
    """Two tab-separated fields joined by an underscore; any other line passes."""
    parts = F.split(line, "\t")
    return F.when(F.size(parts) == 2, F.concat_ws("_", parts)).otherwise(line)


def parse_param(pid: Column) -> dict[str, Column]:
    """domain, baq, C, q, mq, ct of ids such as ``dom_baq0_C50_q20_mq30_ct.4``; absent parts are null."""
    part = lambda p: F.nullif(F.regexp_extract(pid, p, 0), F.lit(""))
    after = lambda k, p: F.nullif(F.regexp_extract(pid, f"_{k}({p})", 1), F.lit(""))
    return {"domain": part("^[^_]+"), **{k: after(k, r"\d+").cast("int") for k in ("baq", "C", "q", "mq")}, "ct": after("ct", "[0-9.]+").cast("double")}


def base_name(path: Column, suffix: str | None = None) -> Column:
    """File name without folders, and without ``suffix`` or, if None, all from the first dot."""
    name = F.regexp_replace(path, "^.*/", "")
    return F.substring_index(name, ".", 1) if suffix is None else F.regexp_replace(name, suffix.replace(".", r"\.") + "$", "")


def packed_numbers(packed: Column, k: int) -> list[Column]:
    """First ``k`` numbers of ``a:b:c``; fewer fields are an error, text that isn't a number is null."""
    parts = F.split(packed, ":")
    ok = F.when(F.size(parts) >= k, parts).otherwise(F.raise_error(F.lit("packed field is too short")).cast("array<string>"))
    return [F.get(ok, F.lit(i)).try_cast("double") for i in range(k)]


def rename_site_columns(df: DataFrame) -> DataFrame:
    """Columns whose name contains chr or pos become scaffold and pos."""
    low = [c.lower() for c in df.columns]
    return df.toDF(*["scaffold" if "chr" in n else "pos" if "pos" in n else c for n, c in zip(low, df.columns, strict=True)])


def one_hot(base: Column, prefix: str, levels: tuple[str, ...] = ("A", "C", "G", "T")) -> list[Column]:
    """0/1 columns for fixed levels; a null base is 0 in all."""
    return [F.coalesce((base == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in levels]
