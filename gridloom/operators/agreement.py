"""Agreement between datasets: dispersion, binary votes, pairs, class votes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import priority
from ..functions.scalars import mean, pop_std, ratio

CELL = ("lat_idx", "lon_idx")
# Datasets left out of the standard deviation, the land mask's dataset.
STD_EXCLUDED = ("berkeley_rwawc", "g2017", "glwd_v2")
LANDMASK = "glwd_v2"


def cell_dispersion(surfaces: DataFrame, min_participants: int = 2, excluded: tuple[str, ...] = STD_EXCLUDED, value: str = "value") -> DataFrame:
    """Per cell: mean over all datasets; deviation and count over those not excluded.

    The deviation is null below ``min_participants``.
    """
    may = ~F.col("dataset_id").isin(*excluded) if excluded else F.lit(True)
    n = F.count(F.when(may, F.col(value)))
    return surfaces.groupBy(*CELL).agg(mean(surfaces, value).alias("mean_value"), F.when(n >= min_participants, pop_std(surfaces, value, may)).alias("std_value"), n.alias("participant_count"))


def landmask(surfaces: DataFrame, dataset_id: str = LANDMASK, value: str = "value") -> DataFrame:
    """Surfaces with values only in cells where the mask's dataset has one."""
    land = surfaces.filter((F.col("dataset_id") == dataset_id) & F.col(value).isNotNull()).select(*[F.col(c).alias(f"_{c}") for c in CELL]).distinct().withColumn("_land", F.lit(True))
    met = surfaces.join(land, (F.col("lat_idx") == F.col("_lat_idx")) & (F.col("lon_idx") == F.col("_lon_idx")), "left")
    return met.withColumn(value, F.when(F.col("_land"), F.col(value))).select(*surfaces.columns)


def binary_votes(surfaces: DataFrame, threshold: float = 0.5, value: str = "value") -> DataFrame:
    """Per cell: participants, share of votes, disagreement 1 - abs(2p - 1) from two participants on."""
    n, yes = F.count(value), F.count_if(F.col(value) >= threshold)
    p = ratio(yes, n)
    return surfaces.groupBy(*CELL).agg(n.alias("participant_count"), p.alias("vote_fraction"), F.when(n >= 2, 1 - F.abs(2 * p - 1)).alias("disagreement"))


def pair_counts(surfaces: DataFrame, threshold: float = 0.5, value: str = "value") -> DataFrame:
    """dataset_a < dataset_b with tp, tn, fp (a alone), fn (b alone) over cells that both have.

    Votes of a cell are collected once, a row a cell and as many entries as
    datasets; pairs come from that short array and not from a self-join of cells.
    """
    votes = surfaces.filter(F.col(value).isNotNull()).groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("dataset_id", (F.col(value) >= threshold).alias("yes")))).alias("v"))
    pairs = votes.select(F.explode(F.expr("flatten(transform(v, (a, i) -> transform(slice(v, i + 2, size(v)), b -> struct(a, b))))")).alias("p"))
    a, b = F.col("p.a.yes"), F.col("p.b.yes")
    counted = pairs.groupBy(F.col("p.a.dataset_id").alias("dataset_a"), F.col("p.b.dataset_id").alias("dataset_b"))
    return counted.agg(F.count_if(a & b).alias("tp"), F.count_if(~a & ~b).alias("tn"), F.count_if(a & ~b).alias("fp"), F.count_if(~a & b).alias("fn"))


def kappa(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Cohen's kappa; null without cells or where agreement by chance is certain."""
    n = (tp + tn + fp + fn).cast("double")
    po = F.try_divide(tp + tn, n)
    pe = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return F.when(F.abs(1 - pe) > 1e-8, F.try_divide(po - pe, 1 - pe))


def pair_metrics(surfaces: DataFrame, threshold: float = 0.5, value: str = "value") -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return pair_counts(surfaces, threshold, value).withColumns({
        "n_cells": tp + tn + fp + fn,
        "overall_accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "producer_accuracy": ratio(tp, tp + fn),
        "user_accuracy": ratio(tp, tp + fp),
        "iou": ratio(tp, tp + fp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "kappa": kappa(tp, tn, fp, fn),
    })


def _class_counts(votes: DataFrame, class_id: str) -> DataFrame:
    return votes.filter(F.col(class_id).isNotNull()).groupBy(*CELL, class_id).agg(F.count(F.lit(1)).alias("n"))


def class_agreement(votes: DataFrame, class_id: str = "class_id") -> DataFrame:
    """Per cell: votes, the class with most (ties to the lowest id) and how many those are."""
    c = _class_counts(votes, class_id)
    return c.groupBy(*CELL).agg(F.sum("n").alias("valid_count"), F.max_by(class_id, F.struct("n", -F.col(class_id))).alias("majority_class"), F.max("n").alias("agreement_count"))


def class_entropy(votes: DataFrame, classes: int, class_id: str = "class_id") -> DataFrame:
    """Per cell: Shannon entropy of votes over log2(classes); other votes count in the denominator alone."""
    c = _class_counts(votes, class_id)
    total = F.sum("n").over(Window.partitionBy(*CELL))
    p = c.withColumn("p", ratio(F.col("n"), total))
    term = F.when(F.col(class_id).between(0, classes - 1), -F.col("p") * F.log2("p")).otherwise(0.0)
    # a handful of terms a cell, added from small to large in one order
    return p.groupBy(*CELL).agg((F.aggregate(F.array_sort(F.collect_list(term)), F.lit(0.0), lambda a, x: a + x) / math.log2(classes)).alias("entropy"))


def vote_entropy3(votes: DataFrame, class_id: str = "class_id") -> DataFrame:
    """Per cell that three datasets share: entropy of the three votes over log2(3), majority by priority, votes for it."""
    whole = votes.filter(F.col(class_id).isNotNull()).groupBy(*CELL, class_id).agg(F.count(F.lit(1)).alias("n"))
    of_cell = whole.groupBy(*CELL).agg(F.sum("n").alias("votes"), F.max("n").alias("agreement_count"), F.max_by(class_id, F.struct("n", -priority(F.col(class_id)))).alias("majority_class")).filter("votes = 3")
    two = (-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3)) / math.log2(3)
    value = F.when(F.col("agreement_count") == 3, 0.0).when(F.col("agreement_count") == 2, two).otherwise(1.0)
    return of_cell.select(*CELL, value.alias("entropy"), "majority_class", "agreement_count")


def dominant_class(fractions: DataFrame, value: str = "fraction", tolerance: float = 1e-12, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Per cell (``keys``) the class with the largest share; shares within ``tolerance`` of it go by priority."""
    top = F.max(value).over(Window.partitionBy(*keys))
    near = fractions.withColumn("_top", top).filter(F.col(value) >= F.col("_top") - tolerance)
    return near.groupBy(*keys).agg(F.min_by("class_id", priority(F.col("class_id"))).alias("dominant_class"))


def tiered_dominant_class(fractions: DataFrame, value: str = "fraction", keys: tuple[str, ...] = CELL) -> DataFrame:
    """As dominant_class, among wetland classes where any has a share, else between water and dry land."""
    wet = ~F.col("class_id").isin(0, 1) & (F.col(value) > 0)
    tiered = fractions.withColumn("_any", F.max(wet.cast("int")).over(Window.partitionBy(*keys)))
    return dominant_class(tiered.filter(F.when(F.col("_any") == 1, ~F.col("class_id").isin(0, 1)).otherwise(F.col("class_id").isin(0, 1))), value, keys=keys)


def source_dominant_class(fractions: DataFrame, value: str = "fraction") -> DataFrame:
    """Per dataset and cell the source class with the largest share, ties to the lowest id."""
    return fractions.filter(F.col(value).isNotNull()).groupBy("dataset_id", *CELL).agg(F.max_by("class_id", F.struct(value, -F.col("class_id"))).alias("dominant_class"))


def temporal_mode(classes: DataFrame, class_id: str = "class_id") -> DataFrame:
    """Per dataset and cell the class seen most often, the lowest where they tie."""
    c = classes.filter(F.col(class_id).isNotNull()).groupBy("dataset_id", *CELL, class_id).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("dataset_id", *CELL).agg(F.max_by(class_id, F.struct("n", -F.col(class_id))).alias("mode_class"))


def joint_valid(fractions: DataFrame, datasets: int, value: str = "fraction") -> DataFrame:
    """Cells in which each of ``datasets`` datasets has shares that add up to more than zero."""
    of = fractions.groupBy("dataset_id", *CELL).agg(F.sum(value).alias("s"))
    return of.groupBy(*CELL).agg(F.count_if(F.col("s") > 0).alias("valid_datasets")).withColumn("joint_valid", F.col("valid_datasets") == datasets)


def transitions(left: DataFrame, right: DataFrame, class_id: str) -> DataFrame:
    """from_class, to_class, n_cells over the cells that both have."""
    b = right.select(*[F.col(c).alias(f"_{c}") for c in CELL], F.col(class_id).alias("to_class"))
    met = left.select(*CELL, F.col(class_id).alias("from_class")).join(b, (F.col("lat_idx") == F.col("_lat_idx")) & (F.col("lon_idx") == F.col("_lon_idx")))
    return met.groupBy("from_class", "to_class").agg(F.count(F.lit(1)).alias("n_cells"))


def cube_difference(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per class of two aligned cubes: cells, largest and mean absolute difference, changed cells."""
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_v"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    gap = F.abs(F.col(value) - F.col("_v"))
    met = left.join(b, on).withColumn("gap", gap)
    return met.groupBy("class_id").agg(F.count("gap").alias("n_cells"), F.max("gap").alias("max_abs_diff"), mean(met, "gap").alias("mean_abs_diff"), F.count_if(F.col("gap") > 0).alias("changed_cells"))
