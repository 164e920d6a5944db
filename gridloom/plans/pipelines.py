"""Whole comparisons as one plan each: what goes in are cell tables, what comes out are result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from ..functions.scalars import clip, nan_to_null
from ..operators import agreement, contract, regrid, selection, series, trends
from ..sources.store import participants

CELL = ["lat_idx", "lon_idx"]


@dataclass(frozen=True)
class Rough:
    cells: DataFrame
    pairs: DataFrame
    statuses: DataFrame
    scored: DataFrame
    regions: list[tuple[str, float, float, float, float]]

    def focus(self, n: int = 8, per_region: int = 2, distance: float = 3.0) -> DataFrame:
        """Places to look at: one job for each of them."""
        return selection.focus_areas(self.scored, [r[0] for r in self.regions], n, per_region, distance)


def rough(surfaces: DataFrame, regions: list[tuple[str, float, float, float, float]], threshold: float = 0.5) -> Rough:
    """Binary comparison of surfaces (dataset_id, cell, lat, lon, value): votes, pairs, statuses, places to look at."""
    every = nan_to_null(surfaces).withColumn("value", clip(F.col("value")))
    taking_part = participants(every)
    votes = agreement.binary_votes(taking_part, threshold)
    at = every.groupBy(*CELL).agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    scored = votes.join(at, CELL).withColumn("score", F.col("disagreement")).filter("score > 0")
    excluded = F.col("dataset_id").isin("berkeley_rwawc", "lstm_wetland")
    statuses = every.groupBy("dataset_id").agg(F.count("value").alias("n_values")).withColumn("status", F.when(excluded, "skipped_not_eligible").when(F.col("n_values") == 0, "failed_empty_harmonized_surface").otherwise("participating"))
    return Rough(votes, agreement.pair_metrics(taking_part, threshold), statuses, grid.first_region(scored, regions), regions)


def classification(fractions: DataFrame, datasets: int = 3) -> tuple[DataFrame, DataFrame]:
    """Source class shares (dataset_id, cell, class_id, fraction) to unified shares and the entropy of dominant classes in cells that all share."""
    unified = series.unified_fractions(fractions)
    valid = agreement.joint_valid(unified, datasets).filter("joint_valid").select(*CELL)
    ruled = lambda own, rule: rule(own.filter("fraction is not null"))
    tiered = ruled(unified.filter("dataset_id = 'gwd30'"), agreement.tiered_dominant_class).withColumn("dataset_id", F.lit("gwd30"))
    out = tiered
    for d in ("g2017", "glwd_v2"):
        out = out.unionByName(ruled(unified.filter(F.col("dataset_id") == d), agreement.dominant_class).withColumn("dataset_id", F.lit(d)))
    return unified, agreement.vote_entropy3(out.join(valid, CELL, "left_semi"), "dominant_class")


def regional(cells: DataFrame, regions: DataFrame, step: float) -> DataFrame:
    """Monthly, annual and climatological series of every region from cells with lat and lon of centres."""
    half = step / 2
    area = grid.cell_area_km2(F.col("lat") - half, F.col("lat") + half, F.col("lon") - half, F.col("lon") + half)
    placed = grid.all_regions(cells.withColumn("weight", area), regions)
    monthly = series.regional_monthly(placed, "weight")
    return series.series_union(monthly=monthly, annual=series.complete_years(monthly, "wetland_percentage"), climatology=series.climatology(monthly, "wetland_percentage"))


def trend(cells: DataFrame, datasets: int, min_years: float = 5.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trends of annual means, their agreement over datasets, and the window that datasets share."""
    tested = trends.pixel_trends(series.by_year(cells))
    spans = cells.groupBy("dataset_id").agg(F.min("ts").cast("date").alias("start"), F.max("ts").cast("date").alias("stop"))
    return tested, trends.trend_agreement(tested.filter("status = 'computed'"), datasets), trends.overlap_window(spans, min_years)


def standardize(cells: DataFrame, lat_weights: DataFrame, lon_weights: DataFrame, keys: tuple[str, ...], classes: bool = False) -> DataFrame:
    """Cells on a common grid: class shares of classes, clipped means of fractions."""
    if classes:
        return regrid.class_fractions(cells, lat_weights, lon_weights, keys)
    made = regrid.regrid(nan_to_null(cells), lat_weights, lon_weights, keys)
    return made.withColumn("value", clip(F.col("value")))


def evidence(regions: DataFrame, percentage: DataFrame, classes: DataFrame, trend_rows: DataFrame) -> DataFrame:
    """The regions' rows of all three families side by side."""
    return contract.evidence_rows(regions, percentage=percentage, classification=classes, trend=trend_rows)
