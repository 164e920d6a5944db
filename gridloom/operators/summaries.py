"""Summaries: of regions, classes, surfaces and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import mean, pop_std, ratio

CELL = ("lat_idx", "lon_idx")


def surface_statistics(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Per key: cells, values, mean, population deviation, extremes and sum."""
    c = F.col(value)
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.count(c).alias("n_values"), mean(cells, value).alias("mean_value"), pop_std(cells, value).alias("std_value"), F.min(c).alias("min_value"), F.max(c).alias("max_value"), F.sum(c).alias("total"))


def classification_summary(entropy: DataFrame, keys: list[str]) -> DataFrame:
    """Per region over jointly valid cells: count, mean and largest entropy, mean agreement, how often 1, 2 or 3 agree."""
    a = F.col("agreement_count")
    return entropy.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.avg("entropy").alias("mean_entropy"),
        F.max("entropy").alias("max_entropy"),
        ratio(F.sum(a), F.count(a)).alias("mean_agreement"),
        *[F.count_if(a == k).alias(f"n_agree_{k}") for k in (1, 2, 3)],
    )


def agreement_summary(agreement: DataFrame, keys: list[str]) -> DataFrame:
    """Per region: cells, mean agreement, shares of unanimous increase and decrease and of dispute."""
    n = F.count(F.lit(1))
    return agreement.groupBy(*keys).agg(
        n.alias("n_cells"),
        F.avg("agreement_ratio").alias("mean_agreement"),
        ratio(F.count_if("robust_increase"), n).alias("share_robust_increase"),
        ratio(F.count_if("robust_decrease"), n).alias("share_robust_decrease"),
        ratio(F.count_if("disputed"), n).alias("share_disputed"),
    )


def class_profile(fractions: DataFrame, value: str = "fraction") -> DataFrame:
    """Per class: mean and largest share, cells where it has one, and their share of its cells."""
    f = F.col(value)
    return fractions.groupBy("class_id").agg(mean(fractions, value).alias("mean_fraction"), F.max(f).alias("max_fraction"), F.count_if(f > 0).alias("n_positive"), ratio(F.count_if(f > 0), F.count(f)).alias("positive_share"))


def vote_classification(fractions: DataFrame, value: str = "fraction") -> DataFrame:
    """Per cell the class with the largest sum of shares over all datasets, the lowest where they tie."""
    s = fractions.groupBy(*CELL, "class_id").agg(F.sum(F.coalesce(value, F.lit(0))).alias("s"), F.count(value).alias("n"))
    return s.groupBy(*CELL).agg(F.sum("n").alias("n"), F.max_by("class_id", F.struct("s", -F.col("class_id"))).alias("class_id")).filter("n > 0").select(*CELL, "class_id")


def vote_shares(votes: DataFrame, keys: list[str], class_id: str = "class_id") -> DataFrame:
    """Per group the classes' shares of its votes, to four places, as a map in the order of classes."""
    n = votes.filter(F.col(class_id).isNotNull()).groupBy(*keys, class_id).agg(F.count(F.lit(1)).alias("n"))
    share = F.round(ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*keys))), 4)
    return n.select(*keys, class_id, share.alias("share")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(class_id).cast("string"), "share")))).alias("shares"))


def weighted_entropy_summary(entropy: DataFrame, lat: Column) -> DataFrame:
    """Mean entropy and share of valid cells, each cell weighing as the cosine of its latitude."""
    w = F.cos(F.radians(lat))
    has = F.col("entropy").isNotNull()
    return entropy.agg(ratio(F.sum(F.col("entropy") * w), F.sum(F.when(has, w))).alias("mean_entropy"), ratio(F.sum(F.when(has, w)), F.sum(w)).alias("valid_share"))


def dominant_shares(ha: DataFrame, value: str = "ha", keys: tuple[str, ...] = CELL) -> DataFrame:
    """Areas by class as shares of their cell's (``keys``) total; cells without area are null."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return ha.withColumn("fraction", F.when(total > 0, ratio(F.col(value), total)))


def wetland_fraction(fractions: DataFrame, classes: list[int] | None) -> DataFrame:
    """Per dataset and cell the sum of the wetland classes' shares, clipped to [0, 1]; null if one of them is.

    ``classes`` None means all but class 0.
    """
    own = fractions.filter(F.col("class_id").isin(*classes) if classes is not None else F.col("class_id") != 0)
    s = own.groupBy("dataset_id", *CELL).agg(F.sum("fraction").alias("s"), F.count_if(F.col("fraction").isNull()).alias("holes"))
    return s.select("dataset_id", *CELL, F.when(F.col("holes") == 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "s"))).alias("value"))


def failure_counts(runs: DataFrame, priority: DataFrame) -> DataFrame:
    """Nested results of runs (run_id, results: dataset_id, status) as counts by status, and how many are of priority runs."""
    flat = runs.select("run_id", F.explode("results").alias("r")).select("run_id", "r.*")
    p = priority.select(F.col("run_id").alias("_p")).distinct().withColumn("urgent", F.lit(True))
    met = flat.join(p, F.col("run_id") == F.col("_p"), "left")
    return met.groupBy("dataset_id", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("urgent", F.lit(False))).alias("n_priority"))


def refined_scores(candidates: DataFrame, cells: DataFrame, half: float, value: str = "value") -> DataFrame:
    """Candidates (candidate_id, lat, lon) with the mean of the cells in the square of ``half`` degrees around each.

    Candidates and cells meet by a hash of squares of that size, never all with all.
    """
    side = 2 * half
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    c = candidates.select("candidate_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).withColumn("_dy", near).withColumn("_dx", near)
    c = c.withColumns({"_gy": F.floor(F.col("_lat") / side) + F.col("_dy"), "_gx": F.floor(F.col("_lon") / side) + F.col("_dx")})
    own = cells.withColumns({"_hy": F.floor(F.col("lat") / side), "_hx": F.floor(F.col("lon") / side)})
    met = own.join(c, (F.col("_hy") == F.col("_gy")) & (F.col("_hx") == F.col("_gx"))).filter((F.abs(F.col("lat") - F.col("_lat")) <= half) & (F.abs(F.col("lon") - F.col("_lon")) <= half))
    return met.groupBy("candidate_id").agg(mean(met, value).alias("score"), F.count(value).alias("n_cells"))


def has_fraction_columns(df: DataFrame) -> bool:
    """Whether a table has a share a column, as standardized classes do."""
    return any(c.startswith("frac_") for c in df.columns)


def valid_wetland(cells: DataFrame) -> DataFrame:
    """Cells that all datasets share, with an entropy, and whose majority is wet."""
    e = F.col("entropy")
    return cells.filter(F.col("joint_valid") & e.isNotNull() & ~F.isnan(e) & (F.col("majority_class") != 0))


def shown_entropy(cells: DataFrame) -> DataFrame:
    """Cells with their entropy where they are valid and wet, null elsewhere."""
    good = F.col("joint_valid") & (F.col("majority_class") != 0)
    return cells.withColumn("entropy", F.when(good, F.col("entropy")))


def disagreement(votes: DataFrame, items: int) -> tuple[DataFrame, DataFrame]:
    """The ``items`` cells of most disagreement with what is known of them, and the extremes and mean of all scores."""
    top = votes.filter("disagreement is not null").orderBy(F.desc("disagreement"), F.desc("participant_count"), "lat_idx", "lon_idx").limit(items)
    return top, votes.agg(F.count("disagreement").alias("n_scores"), F.min("disagreement").alias("min_score"), F.max("disagreement").alias("max_score"), F.avg("disagreement").alias("mean_score"))


def profile(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """What a loader has delivered: rows, values, missing ones, extent in time and on the grid."""
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n_values"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
        F.min("ts").cast("date").alias("first_day"),
        F.max("ts").cast("date").alias("last_day"),
        F.min("lat_idx").alias("top"),
        F.max("lat_idx").alias("bottom"),
        F.min("lon_idx").alias("left"),
        F.max("lon_idx").alias("right"),
    )


def review_manifest(areas: DataFrame, artefacts: DataFrame, summary: DataFrame) -> DataFrame:
    """Areas with their artefact, null where there is none, and the run's summary, which is one row, beside each."""
    a = artefacts.select(F.col("aoi_id").alias("_a"), *[c for c in artefacts.columns if c != "aoi_id"])
    return areas.join(a, F.col("aoi_id") == F.col("_a"), "left").drop("_a").join(F.broadcast(summary.limit(1)))


def lineage(points: DataFrame, stages: dict[str, DataFrame], keys: list[str], value: str = "value") -> DataFrame:
    """For each point what every stage has there, side by side, and the first stage without a value."""
    out = points
    for name, df in stages.items():
        own = df.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias(name))
        on = F.lit(True)
        for k in keys:
            on = on & (F.col(k) == F.col(f"_{k}"))
        out = out.join(own, on, "left").drop(*[f"_{k}" for k in keys])
    lost = F.lit(None).cast("string")
    for name in reversed(list(stages)):
        lost = F.when(F.col(name).isNull(), name).otherwise(lost)
    return out.withColumn("lost_at", lost)


def class_shares(cells: DataFrame, keys: tuple[str, ...] = ("dataset_id", *CELL), class_id: str = "class_id") -> DataFrame:
    """Per cell (``keys``) how often each class occurs and its share of all."""
    n = cells.groupBy(*keys, class_id).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("fraction", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*keys))))


def json_validity(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Per key the rows and those whose text is JSON."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(F.expr(f"try_parse_json({text})")).alias("n_valid"))


def first_rows(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order, for a review."""
    return rows.orderBy(*order).limit(n)


def vector_lengths(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Per key the vectors and the least of their lengths."""
    return vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vector)).alias("dims"))
