"""Hotspots: ranked places of high share, disagreement or entropy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import first_region
from ..sources.store import checkpoint
from .contract import hotspot_id
from .neighbours import above_percentile, components, local_maxima, spaced
from .selection import as_table, spread_out

ORDER = ["score", "lat", "lon"]


def ranked_top(rows: DataFrame, group: str, order: list[Column], n: int, name: str = "hotspot_rank") -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("int")).filter(F.col(name) <= n)


def percentage_hotspots(cells: DataFrame, group: str, value: str = "value", n: int = 10, distance: float | None = None) -> DataFrame:
    """Local maxima of each group by value, then latitude from the north, then longitude; spaced if a distance is given."""
    peaks = local_maxima(cells, (group,), value).withColumn("score", F.col(value).cast("double"))
    if distance:
        peaks = spaced(peaks, group, ORDER, distance, n)
    return ranked_top(peaks, group, [F.desc("score"), F.desc("lat"), F.asc("lon")], n)


def trend_hotspots(agreement: DataFrame, group: str, n: int = 10) -> DataFrame:
    """Cells where datasets' trends disagree most, then those whose slopes do, to nine places; cells without a deviation of slopes take no part."""
    scored = agreement.filter(F.col("disputed") & F.col("agreement_ratio").isNotNull() & F.col("slope_std").isNotNull()).withColumn("score", 1 - F.col("agreement_ratio"))
    return ranked_top(scored, group, [F.desc("score"), F.desc(F.round("slope_std", 9)), F.desc("lat"), F.asc("lon")], n)


def entropy_clusters(entropy: DataFrame, q: float, min_cells: int, value: str = "entropy") -> DataFrame:
    """4-connected clusters of the cells at or above a percentile of all: size, mean and largest value, centre."""
    everywhere = entropy.withColumn("_all", F.lit(0))
    high = above_percentile(everywhere, q, ("_all",), value)
    labels = components(high, ("_all",)).withColumnsRenamed({"lat_idx": "_a", "lon_idx": "_b"}).drop("_all")
    met = high.join(labels, (F.col("lat_idx") == F.col("_a")) & (F.col("lon_idx") == F.col("_b")))
    stats = met.groupBy("seed_lat_idx", "seed_lon_idx").agg(F.count(F.lit(1)).alias("n_cells"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return stats.filter(F.col("n_cells") >= min_cells)


def entropy_hotspots(entropy: DataFrame, regions: list[tuple[str, float, float, float, float]], q: float = 0.95, min_cells: int = 4, distance: float = 3.0, n: int = 10, per_region: int = 3, value: str = "entropy") -> DataFrame:
    """Clusters by their mean, spaced over all chosen ones, so many of a region; a cluster is in the first region that holds its centre."""
    placed = checkpoint(first_region(entropy_clusters(entropy, q, min_cells, value), regions))
    order = [F.desc(F.round("mean_value", 9)), F.asc("seed_lat_idx"), F.asc("seed_lon_idx")]
    made = as_table(placed, spread_out(placed, order, n, distance, per_region))
    return made.withColumn("hotspot_id", hotspot_id("entropy", F.col("region_id"), None, F.col("hotspot_rank")))


def regional_selection(windows: DataFrame, quotas: DataFrame, refine: Callable[[DataFrame], DataFrame], q: float = 0.95, min_cells: int = 16, distance: float = 3.0, multiplier: int = 5) -> tuple[DataFrame, DataFrame]:
    """Hotspots and a summary of each region.

    ``windows`` has region_id, cell, lat, lon, score, n_cells: a window's mean
    around each valid cell. Windows at or above the region's percentile with
    enough cells are spaced, ``multiplier`` times the quota; ``refine`` scores
    these anew (candidate_id, score, n_cells; without cells none), and the
    quota is spaced out of them.
    """
    valid = windows.filter("score is not null")
    high = above_percentile(valid, q, ("region_id",), "score")
    coarse = high.filter(F.col("n_cells") >= min_cells).join(F.broadcast(quotas.select("region_id", "quota")), "region_id")
    first = spaced(coarse, "region_id", ORDER, distance, F.col("quota") * multiplier)
    first = first.withColumn("candidate_id", F.concat_ws(":", "region_id", "lat_idx", "lon_idx"))
    again = refine(first.select("candidate_id", "lat", "lon")).select(F.col("candidate_id").alias("_c"), F.col("score").alias("_score"), F.col("n_cells").alias("_n"))
    refined = first.join(again.filter("_n > 0"), F.col("candidate_id") == F.col("_c")).withColumns({"score": F.col("_score"), "n_cells": F.col("_n")}).drop("_c", "_score", "_n")
    chosen = ranked_top(spaced(refined, "region_id", ORDER, distance, F.col("quota")), "region_id", [F.desc("score"), F.desc("lat"), F.asc("lon")], 1 << 30)
    count = lambda df, name: df.groupBy(F.col("region_id").alias(f"_{name}")).agg(F.count(F.lit(1)).cast("int").alias(name))
    made = quotas.select("region_id", "quota")
    for df, name in ((windows, "n_windows"), (valid, "n_valid"), (high, "n_candidates"), (first, "n_coarse"), (refined, "n_refined"), (chosen, "n_selected")):
        made = made.join(F.broadcast(count(df, name)), F.col("region_id") == F.col(f"_{name}"), "left").drop(f"_{name}").withColumn(name, F.coalesce(name, F.lit(0)))
    status = F.when(F.col("n_windows") == 0, "no_spatial_overlap").when(F.col("n_valid") == 0, "no_valid_wetland_cells").when(F.col("n_selected") == 0, "no_eligible_candidates").otherwise("ok")
    return chosen, made.withColumns({"shortfall": F.greatest(F.lit(0), F.col("quota") - F.col("n_selected")), "status": status}).drop("n_windows")
