"""Intervals, half open: islands, padded subtraction, overlap, running cut-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import stats


def by_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` computed once, with _part: its range of ``order``, of which there are as many as shuffle partitions.

    Running values then go within a range, and from range to range by one row for each range
    and chromosome, so that one long chromosome is many tasks' work.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stats.settled(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def islands(positions: DataFrame) -> DataFrame:
    """Maximal runs of consecutive 1-based positions as [first - 1, last)."""
    p = positions.select(F.col("scaffold").alias("chrom"), (F.col("pos") - 1).alias("start"), F.col("pos").alias("end")).distinct()
    return merge(p).withColumnRenamed("chrom", "scaffold")


def island_sites(beds: DataFrame) -> DataFrame:
    """The 1-based positions of half-open 0-based intervals."""
    return beds.where("end > start").select("scaffold", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("pos"))


def merge(iv: DataFrame, pad: int = 0) -> DataFrame:
    """Union of padded intervals: touching ones join."""
    x = by_ranges(iv.select("chrom", (F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end")), "chrom", "start", "end")
    within = Window.partitionBy("chrom", "_part").orderBy("start", "end")
    parts = Window.partitionBy("chrom").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    reach = x.groupBy("chrom", "_part").agg(F.max("end").alias("_e")).select("chrom", "_part", F.max("_e").over(parts).alias("_before"))
    x = x.join(reach, ["chrom", "_part"])
    x = x.withColumn("_m", F.greatest("_before", F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))))
    x = x.withColumn("_new", (F.col("_m").isNull() | (F.col("start") > F.col("_m"))).cast("long")).drop("_before", "_m")
    begun = x.groupBy("chrom", "_part").agg(F.sum("_new").alias("_c")).select("chrom", "_part", F.coalesce(F.sum("_c").over(parts), F.lit(0)).alias("_before"))
    x = x.join(begun, ["chrom", "_part"])
    # of equal intervals the one that begins an island comes first, however the join left them
    within = Window.partitionBy("chrom", "_part").orderBy("start", "end", F.desc("_new"))
    x = x.withColumn("_k", F.col("_before") + F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("chrom", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_k")


def with_next_start(iv: DataFrame) -> DataFrame:
    """Adds next_start, the start of the chromosome's following interval (starts are distinct)."""
    x = by_ranges(iv, "chrom", "start")
    later = Window.partitionBy("chrom").orderBy("_part").rowsBetween(1, Window.unboundedFollowing)  # a row for each range
    after = x.groupBy("chrom", "_part").agg(F.min("start").alias("_s")).select("chrom", "_part", F.min("_s").over(later).alias("_after"))
    own = F.lead("start").over(Window.partitionBy("chrom", "_part").orderBy("start"))
    return x.withColumn("next_start", own).join(after, ["chrom", "_part"]).withColumn("next_start", F.coalesce("next_start", "_after")).drop("_part", "_after")


def subtract(references: DataFrame, iv: DataFrame, pad: int = 500, least: int = 1000) -> DataFrame:
    """What is left of [0, length) without the padded intervals, in pieces of at least ``least``.

    A chromosome that ``references`` give repeatedly counts once, with its greatest length.
    """
    references = references.groupBy("chrom").agg(F.max("length").alias("length"))
    m = with_next_start(merge(iv, pad))
    j = references.join(m, "chrom", "left")
    first = j.groupBy("chrom").agg(F.lit(0).cast("long").alias("start"), F.least(F.coalesce(F.min("start"), F.max("length")), F.max("length")).alias("end"))
    after = j.where("start is not null").select("chrom", F.greatest("end", F.lit(0)).alias("_s"), F.coalesce("next_start", "length").alias("_e"), "length")
    after = after.select("chrom", F.col("_s").alias("start"), F.least("_e", "length").alias("end"))
    return first.union(after).where(F.col("end") - F.col("start") >= least)


#: Width of the finest bins, and how much wider each level is than the one below.
FINEST, WIDER, LEVELS = 128, 8, 10


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that overlap any of ``b``: an equi-join on hierarchical bins, then the exact test.

    An interval's own level is the first whose bins are as wide as it, so it touches at most two
    bins there and at each level above.  Two intervals meet at the coarser of their own levels:
    a row is repeated at most twice a level, however long it is.  A row of ``a`` comes back once.
    """

    def binned(df: DataFrame, own: str) -> DataFrame:
        x = df.where("end > start").withColumn(own, sum((F.when(F.col("end") - F.col("start") > FINEST * WIDER**k, 1).otherwise(0) for k in range(LEVELS - 1)), F.lit(0)))
        x = x.withColumn("_level", F.explode(F.sequence(F.col(own), F.lit(LEVELS - 1))))
        width = F.lit(FINEST).cast("long") * F.pow(F.lit(float(WIDER)), "_level").cast("long")
        return x.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))

    x = binned(a.select("chrom", "start", "end").distinct(), "_own")
    y = binned(b.select("chrom", "start", "end").distinct(), "_its").select("chrom", "_level", "_bin", "_its", F.col("start").alias("_s"), F.col("end").alias("_e"))
    meet = F.col("_level") == F.greatest("_own", "_its")
    hit = x.join(y, ["chrom", "_level", "_bin"]).where(meet & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")))
    return a.join(hit.select("chrom", "start", "end").distinct(), ["chrom", "start", "end"], "left_semi")


def length_cutoff(lengths: DataFrame, total: int) -> DataFrame:
    """Longest first until the running total exceeds ``total``; the crossing row is in. Ties by name.

    The running sum goes by distinct length first, so that ranges can be summed apart.
    """
    per = lengths.groupBy("length").agg((F.count("*") * F.col("length")).alias("_t"))
    before = stats.running_total(per, ["length"], "_t", "_upto", descending=True).select("length", (F.col("_upto") - F.col("_t")).alias("_b"))
    w = Window.partitionBy("length").orderBy("name")
    x = lengths.join(before, "length").withColumn("_rank", F.row_number().over(w) - 1)
    return x.where(F.col("_b") + F.col("_rank") * F.col("length") <= total).select("name", "length")


def split_evenly(df: DataFrame, n: int, order: str) -> DataFrame:
    """Adds chunk 1..n: contiguous in ``order`` (unique values), sizes differing by at most one."""
    one = df.select(order).withColumn("_one", F.lit(1))
    r = stats.running_total(one, [order], "_one", "_r").drop("_one")
    total = F.broadcast(df.agg(F.count("*").alias("_n")))  # one row
    big, small = F.col("_n") % n, F.floor(F.col("_n") / n)
    edge = big * (small + 1)
    chunk = F.when(F.col("_r") <= edge, F.floor((F.col("_r") - 1) / (small + 1)) + 1).otherwise(big + F.floor(F.try_divide(F.col("_r") - 1 - edge, small)) + 1)
    return df.join(r, order).join(total).withColumn("chunk", chunk.cast("int")).drop("_r", "_n")


def reference_targets(bed: DataFrame, contaminants: DataFrame, total: int = 100_000_000, parts: int = 10, without: str = "chloroplast") -> tuple[DataFrame, DataFrame]:
    """Scaffolds to work on, (chunk, scaffold, length), and their intervals, (chunk, scaffold, start, end, first_site).

    Intervals' lengths are summed by scaffold; contaminants (chrom) and names that contain
    ``without`` go; the longest come first until ``total`` is exceeded, the crossing one
    included; they are then split in that order into ``parts`` of even numbers.
    """
    lengths = bed.groupBy(F.col("chrom").alias("name")).agg(F.sum(F.col("end") - F.col("start")).alias("length"))
    clean = lengths.join(contaminants.select(F.col("chrom").alias("name")).distinct(), "name", "left_anti")
    clean = clean.where(~F.coalesce(F.col("name").cast("string").contains(without), F.lit(False)))
    kept = stats.settled(length_cutoff(clean, total))
    # longest first, ties by name: a rank by distinct length, then within it
    per = kept.groupBy("length").agg(F.count("*").alias("_n"))
    before = stats.running_total(per, ["length"], "_n", "_upto", descending=True).select("length", (F.col("_upto") - F.col("_n")).alias("_b"))
    ranked = kept.join(before, "length").withColumn("_rank", F.col("_b") + F.row_number().over(Window.partitionBy("length").orderBy("name")))
    chunks = split_evenly(ranked.select("_rank"), parts, "_rank")
    scaffolds = ranked.join(chunks, "_rank").select("chunk", F.col("name").alias("scaffold"), "length")
    pieces = bed.select(F.col("chrom").alias("scaffold"), "start", "end").join(scaffolds.select("scaffold", "chunk"), "scaffold")
    return scaffolds, pieces.select("chunk", "scaffold", "start", "end", (F.col("start") + 1).alias("first_site"))


def experiment_reference(positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference of the sites that were seen: (scaffold, start, end, first_site) of its runs, and its distinct scaffolds."""
    runs = stats.settled(islands(positions))
    return runs.withColumn("first_site", F.col("start") + 1), runs.select("scaffold").distinct()
