"""Selection of populations for an experiment: samples, library make-up, close pairs, status."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import ranks
from helixframe.operators.distances import geodesic_km

#: Kilometres, just under the earth's least radius of curvature: the angle between two places' coordinates is at most their distance over it.
RADIUS_KM = 6335.0


def enough_reads(depths: DataFrame, meta: DataFrame, read_quantile: float = 0.25, scaffold_quantile: float = 0.25) -> DataFrame:
    """``depths`` (sample, n_reads, n_scaffolds) with ``meta`` (sample, ...), above both quantiles of the logarithms of all rows."""
    x = depths.withColumns({"_r": F.ln("n_reads"), "_s": F.ln("n_scaffolds")})
    cuts = {"_r": read_quantile, "_s": scaffold_quantile}
    found = [ranks.exact_quantiles(x, [], c, [q]).collect() for c, q in cuts.items()]  # a number each
    if not all(found):
        return x.drop("_r", "_s").join(meta, "sample", "left").limit(0)
    kept = x.where((F.col("_r") > found[0][0]["q"][0]) & (F.col("_s") > found[1][0]["q"][0]))
    return kept.drop("_r", "_s").join(meta, "sample", "left")


def library_makeup(samples: DataFrame, least: int = 5, most_share: float = 0.8, mixed_only: bool = True, keep: list[str] = ("domain",)) -> DataFrame:
    """(pop_code, keep, majority_library, max_library_prop, total_samples) of populations of ``least`` samples.

    The commonest library of equal ones is the first by name.  ``mixed_only``: where its share is
    under ``most_share``.
    """
    n = samples.groupBy(*keep, "pop_code", "library").agg(F.count("*").alias("n"))
    by = n.withColumn("_k", F.row_number().over(Window.partitionBy(*keep, "pop_code").orderBy(F.desc("n"), "library")))
    out = by.groupBy("pop_code", *keep).agg(F.max(F.when(F.col("_k") == 1, F.col("library"))).alias("majority_library"), (F.max("n") / F.sum("n")).alias("max_library_prop"), F.sum("n").alias("total_samples"))
    out = out.where(F.col("total_samples") >= least)
    return out.where(F.col("max_library_prop") < most_share) if mixed_only else out


def pairs_within(places: DataFrame, km: float, id_: str = "pop_code") -> DataFrame:
    """(pop1, pop2, distance_km) with pop1 < pop2 and at most ``km`` apart, of ``places`` (id, latitude, longitude).

    Places lie in cells of a grid in space as wide as the longest chord asked for, so partners
    are in the same or a neighbouring cell: 27 rows a place and an equality join, then the exact
    distance.  Neither the poles nor the date line are special.
    """
    if km >= math.pi * RADIUS_KM / 2:
        raise ValueError("pairs are found up to a quarter of the way around")
    width = 2 * math.sin(1.01 * km / 2 / RADIUS_KM) + 1e-9
    lat, lon = F.radians("latitude"), F.radians("longitude")
    axes = {"_x": F.cos(lat) * F.cos(lon), "_y": F.cos(lat) * F.sin(lon), "_z": F.sin(lat)}
    at = places.where("latitude is not null and longitude is not null").select(F.col(id_).alias("p"), "latitude", "longitude", *[F.floor(v / width).alias(c) for c, v in axes.items()])
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    a = at.toDF("pop1", "_lat1", "_lon1", *axes)
    b = at.toDF("pop2", "_lat2", "_lon2", *axes)
    for c in axes:
        b = b.withColumn("_d", near).withColumn(c, F.col(c) + F.col("_d")).drop("_d")
    found = a.join(b, list(axes)).where("pop1 < pop2").withColumn("distance_km", geodesic_km("_lat1", "_lon1", "_lat2", "_lon2"))
    return found.where(F.col("distance_km") <= km).select("pop1", "pop2", "distance_km")


def cross_library_pairs(distances: DataFrame, lookup: DataFrame, wide_domain: str = "siberia", wide_km: float = 250, km: float = 100) -> DataFrame:
    """``distances`` (pop1, pop2, distance_km) between populations of ``lookup`` whose majority libraries differ.

    Pairs with a side in ``wide_domain`` may be ``wide_km`` apart, others ``km``.  A pair comes
    once, with pop1 < pop2 and its smaller distance.
    """
    d = distances.where("pop1 <> pop2 and distance_km is not null").groupBy(F.least("pop1", "pop2").alias("pop1"), F.greatest("pop1", "pop2").alias("pop2")).agg(F.min("distance_km").alias("distance_km"))
    side = lambda k: lookup.select(F.col("pop_code").alias(f"pop{k}"), F.col("domain").alias(f"_d{k}"), F.col("majority_library").alias(f"_l{k}"))
    j = d.join(side(1), "pop1").join(side(2), "pop2")
    wide = (F.col("_d1") == wide_domain) | (F.col("_d2") == wide_domain)
    return j.where((F.col("_l1") != F.col("_l2")) & (F.col("distance_km") <= F.when(wide, wide_km).otherwise(km))).select("pop1", "pop2", "distance_km")


def population_status(mixed: DataFrame, pairs: DataFrame, lookup: DataFrame) -> DataFrame:
    """A row for each mixed or paired population, one for each partner: make-up, is_mixed, is_paired, paired_pop, distance_km.

    The domain and share are those of mixed populations alone; sizes and libraries come from ``lookup`` too.
    """
    both = pairs.select(F.col("pop1").alias("pop_code"), F.col("pop2").alias("paired_pop"), "distance_km").union(pairs.select("pop2", "pop1", "distance_km"))
    every = mixed.select("pop_code").union(both.select("pop_code")).distinct()
    out = every.join(mixed.select("pop_code", "domain", "max_library_prop", F.col("total_samples").alias("_own")), "pop_code", "left")
    out = out.join(lookup.select("pop_code", "majority_library", "total_samples"), "pop_code", "left").join(both, "pop_code", "left")
    return out.select(
        "pop_code", "domain", "majority_library", "max_library_prop", F.coalesce("_own", "total_samples").alias("total_samples"), F.col("max_library_prop").isNotNull().alias("is_mixed"),
        F.col("paired_pop").isNotNull().alias("is_paired"), "paired_pop", "distance_km",
    )


def select_populations(depths: DataFrame, meta: DataFrame, distances: DataFrame | None = None, least: int = 5, most_share: float = 0.8, wide_domain: str = "siberia", wide_km: float = 250, km: float = 100, **quantiles) -> DataFrame:
    """The four steps together.  Without ``distances`` these come from the populations' mean coordinates in ``meta``."""
    samples = enough_reads(depths, meta, **quantiles)
    mixed, lookup = (library_makeup(samples, least, most_share, m) for m in (True, False))
    if distances is None:
        places = meta.groupBy("pop_code").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
        distances = pairs_within(places.join(lookup.select("pop_code"), "pop_code", "left_semi"), max(km, wide_km))
    return population_status(mixed, cross_library_pairs(distances, lookup, wide_domain, wide_km, km), lookup)
