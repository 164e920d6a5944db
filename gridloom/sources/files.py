"""Files by their names: months, years and members in paths, choices among rasters, tables of places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_integer_token, month, tile_code_token, year_month_token
from .store import current, dataset_ids


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, name, length, modified of the files under a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def by_month(files: DataFrame, start: str, stop: str) -> DataFrame:
    """Files whose name's month lies in the closed range of months."""
    m = year_month_token(F.col("name"))
    return files.withColumn("month", m).filter(m.between(month(F.lit(start).cast("date")), month(F.lit(stop).cast("date"))))


def members(files: DataFrame) -> DataFrame:
    """config and forcing from a member's folders, year from its name."""
    parts = F.split("path", "/")
    return files.withColumns({"config": F.element_at(parts, -3), "forcing": F.element_at(parts, -2), "year": first_integer_token(F.regexp_extract("name", r"_(\d{4})\D", 1))})


def tiles(files: DataFrame) -> DataFrame:
    return files.withColumn("tile_code", tile_code_token(F.col("name")))


def available(spark: SparkSession, root: str) -> DataFrame:
    """Datasets of a store: years, or static."""
    parts = [spark.read.parquet(current(spark, root, d)).filter(F.col("dataset_id") == d).select("dataset_id", "year").distinct() for d in dataset_ids(spark, root)]
    c = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "dataset_id string, year int")
    return c.groupBy("dataset_id").agg(F.array_sort(F.collect_set("year")).alias("years")).withColumn("is_static", F.size("years") == 0)


def date_range(cells: DataFrame, time: str = "ts") -> DataFrame:
    """Per dataset the first and the last day that it has."""
    return cells.groupBy("dataset_id").agg(F.min(time).cast("date").alias("start"), F.max(time).cast("date").alias("stop"))


def selected_years(found: list[int], wanted: list[int] | None) -> list[int]:
    """The wanted years in order, all of which must be there."""
    if wanted is None:
        return sorted(found)
    lacking = sorted(set(wanted) - set(found))
    if lacking:
        raise ValueError(f"no data for {lacking}")
    return sorted(set(wanted))


def best_raster(rasters: DataFrame) -> DataFrame:
    """Of rasters (group, name, priority, valid_count) one a group: by priority, then most valid values, then name."""
    w = Window.partitionBy("group").orderBy("priority", F.desc("valid_count"), "name")
    return rasters.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def places(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table of places with bbox as JSON text; rows whose box does not parse or is inside out are an error on use."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    box = F.from_json("bbox", "array<double>")
    good = (F.size(box) == 4) & (box[0] < box[2]) & (box[1] < box[3])
    sides = [F.when(good, box[i]).otherwise(F.raise_error(F.concat(F.lit("not a box: "), F.col("bbox")))).cast("double").alias(n) for i, n in enumerate(("west", "south", "east", "north"))]
    return raw.select(*[c for c in raw.columns if c != "bbox"], *sides)


def in_order(rows: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """The rows with the wanted keys, in that order."""
    return rows.filter(F.col(key).isin(*wanted)).orderBy(F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col(key)))


def deduplicated(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
