"""Series over time: buckets, regional area-weighted series, climatologies, ensembles, partial sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import in_box
from ..functions.scalars import mean, month, ratio, season

CELL = ("lat_idx", "lon_idx")


def by_month(cells: DataFrame, how: str = "mean", value: str = "value") -> DataFrame:
    """Values of finer steps as one a month, by their mean or maximum."""
    agg = mean(cells, value) if how == "mean" else F.max(value).cast("double")
    return cells.groupBy("dataset_id", *CELL, month(F.col("ts")).alias("month")).agg(agg.alias("value"), F.count(value).alias("n"))


def by_year(cells: DataFrame, value: str = "value") -> DataFrame:
    return cells.groupBy("dataset_id", *CELL, F.year("ts").alias("year")).agg(mean(cells, value).alias("value"), F.count(value).alias("n"))


def by_season(cells: DataFrame, value: str = "value") -> DataFrame:
    """The four seasons' means over all years."""
    return cells.groupBy("dataset_id", *CELL, season(F.col("ts")).alias("season")).agg(mean(cells, value).alias("value"), F.count(value).alias("n"))


def ensemble_joint(members: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The mean over all members of an ensemble at once."""
    return members.groupBy(*keys).agg(mean(members, value).alias("value"))


def ensemble_two_step(members: DataFrame, keys: list[str], first: str, second: str, value: str = "value") -> DataFrame:
    """The mean over ``first`` for each ``second``, then over ``second``; differs from the joint mean where members lack."""
    inner = members.groupBy(*keys, second).agg(mean(members, value).alias("_inner"))
    # one term a member of ``second``, in one order
    return inner.filter("_inner is not null").groupBy(*keys).agg(F.array_sort(F.collect_list("_inner")).alias("_all")).select(*keys, (F.aggregate("_all", F.lit(0.0), lambda a, x: a + x) / F.size("_all")).alias("value"))


def regional_monthly(cells: DataFrame, weight: str, value: str = "value", scale: float = 1.0) -> DataFrame:
    """Per dataset, region and month: area of wetland and of valid cells, and their ratio in percent.

    ``cells`` has region_id and ``weight``, a cell's area times its share in the mask.
    """
    wet = F.coalesce(F.sum(F.col(value) * F.col(weight)), F.lit(0))
    valid = F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col(weight))), F.lit(0))
    grouped = cells.groupBy("dataset_id", "region_id", month(F.col("ts")).alias("month"))
    return grouped.agg(wet.alias("_wet"), valid.alias("_valid")).select("dataset_id", "region_id", "month", (F.col("_wet").cast("double") / scale).alias("wetland_area"), F.col("_valid").cast("double").alias("valid_area"), (100 * ratio(F.col("_wet"), F.col("_valid")) / scale).alias("wetland_percentage"))


def complete_years(monthly: DataFrame, value: str = "value") -> DataFrame:
    """Unweighted means of the monthly values of years that have all twelve months."""
    y = monthly.groupBy("dataset_id", "region_id", F.year("month").alias("year"))
    made = y.agg(F.countDistinct("month").alias("n_months"), mean(monthly, value).alias("value"))
    return made.filter("n_months = 12").select("dataset_id", "region_id", "year", "value", F.lit(12).cast("long").alias("observation_count"))


def climatology(monthly: DataFrame, value: str = "value") -> DataFrame:
    """Means of each calendar month over the years; their time is that month of the year 2000."""
    m = F.month("month")
    return monthly.groupBy("dataset_id", "region_id", F.make_date(F.lit(2000), m, F.lit(1)).alias("month")).agg(mean(monthly, value).alias("value"), F.count(value).alias("observation_count"))


def series_union(**parts: DataFrame) -> DataFrame:
    """Monthly, annual and climatology tables as one, told apart by series_type."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("series_type", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def merged_partials(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles' partial sums (weighted, coverage) as fractions; sums merge in any order, none is lost."""
    return partials.groupBy(*keys).agg(F.sum("weighted").alias("weighted"), F.sum("coverage").alias("coverage")).withColumn("fraction", ratio(F.col("weighted"), F.col("coverage")))


def first_valid(tiles: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """Where tiles overlap the first one with a value wins."""
    return tiles.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def unified_fractions(fractions: DataFrame, value: str = "fraction") -> DataFrame:
    """Source classes' time means, added up by unified class; cells whose shares add up to nothing are null."""
    from ..functions.classes import mapped

    timed = fractions.groupBy("dataset_id", *CELL, "class_id").agg(mean(fractions, value).alias("f"))
    made = mapped(timed, "yaml8").filter("target_class is not null").groupBy("dataset_id", *CELL, F.col("target_class").alias("class_id")).agg(F.sum("f").alias("f"))
    total = F.sum("f").over(Window.partitionBy("dataset_id", *CELL))
    return made.withColumn("fraction", F.when(total > 0, F.col("f"))).drop("f")


def best_month(starts: DataFrame, windows: DataFrame) -> DataFrame:
    """The month that most datasets cover, the earliest of those.

    ``starts`` (month) are candidates, ``windows`` (dataset_id, start, stop) a
    row a dataset, which is broadcast for the range test.
    """
    met = starts.select("month").distinct().join(F.broadcast(windows), F.col("month").between(F.col("start"), F.col("stop")))
    scored = met.groupBy("month").agg(F.countDistinct("dataset_id").alias("n_datasets"))
    return scored.agg(F.max_by(F.col("month"), F.struct(F.col("n_datasets"), -F.datediff("month", F.lit("1970-01-01").cast("date")))).alias("month"), F.max("n_datasets").alias("n_datasets"))


def footprint(cells: DataFrame, value: str = "value") -> DataFrame:
    """Per dataset the cells that have a value in its first time step."""
    first = F.min("ts").over(Window.partitionBy("dataset_id"))
    return cells.withColumn("_first", first).filter((F.col("ts") == F.col("_first")) & F.col(value).isNotNull()).select("dataset_id", *CELL).distinct()


def year_surface(tiles: DataFrame, year: int, bbox: tuple[float, float, float, float], value: str = "value") -> DataFrame:
    """Tiles' cells of one year inside a box as one surface of means over time."""
    own = tiles.filter((F.col("ts") >= F.make_timestamp_ntz(F.lit(year), *map(F.lit, (1, 1, 0, 0, 0)))) & (F.col("ts") < F.make_timestamp_ntz(F.lit(year + 1), *map(F.lit, (1, 1, 0, 0, 0)))))
    own = own.filter(in_box(F.col("lat"), F.col("lon"), *bbox))
    return own.groupBy(*CELL).agg(mean(own, value).alias("value"), F.count(value).alias("n"))


def bundle(surfaces: dict[str, DataFrame]) -> DataFrame:
    """Surfaces of several datasets as one table, told apart by dataset_id."""
    return reduce(DataFrame.unionByName, [df.withColumn("dataset_id", F.lit(d)) for d, df in sorted(surfaces.items())])


def concatenated(parts: list[DataFrame], time: str = "ts") -> DataFrame:
    """Parts of a series after one another, in time order."""
    return reduce(DataFrame.unionByName, parts).orderBy(time)
