"""Tiles: user transforms a tile, array-to-rows, first-valid mosaics, coverage partials."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def transform_tiles(tiles: DataFrame, key: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, name: str, version: int) -> DataFrame:
    """A user's function on each tile's rows, its name and version beside what it returns.

    A tile is bounded by its size, whatever the number of tiles.
    """
    made = tiles.groupBy(key).applyInPandas(function, schema)
    return made.withColumns({"transform_name": F.lit(name), "transform_version": F.lit(version)})


def unrolled(arrays: DataFrame, keys: list[str], values: str, columns: int) -> DataFrame:
    """An array of a grid's values, row by row, as cells."""
    each = arrays.select(*keys, F.posexplode(values).alias("i", "value"))
    return each.select(*keys, F.expr(f"cast(i div {columns} as int)").alias("lat_idx"), F.expr(f"cast(i % {columns} as int)").alias("lon_idx"), "value")


def band_partials(pixels: DataFrame, keys: list[str], cell: list[Column], class_id: str = "class_id") -> DataFrame:
    """Per band and coarse cell: pixels with a class (coverage) and those of each class (weighted)."""
    named = [c.alias(n) for c, n in zip(cell, ("lat_idx", "lon_idx"), strict=True)]
    seen = pixels.filter(F.col(class_id).isNotNull())
    part = seen.groupBy(*keys, *named, class_id).agg(F.count(F.lit(1)).alias("weighted"))
    whole = seen.groupBy(*keys, *named).agg(F.count(F.lit(1)).alias("coverage"))
    return part.join(whole, [*keys, "lat_idx", "lon_idx"])


def binary_surface(pixels: DataFrame, wet_classes: list[int], cell: list[Column], how: str = "mean") -> DataFrame:
    """Per coarse cell the mean over pixels of each pixel's mean or maximum over bands of wet or not; unmapped classes are missing."""
    wet = F.when(F.col("class_id").isNotNull(), F.col("class_id").isin(*wet_classes).cast("int"))
    own = F.avg(wet) if how == "mean" else F.max(wet).cast("double")
    per_pixel = pixels.groupBy("tile_id", "pixel_y", "pixel_x").agg(own.alias("v"))
    named = [c.alias(n) for c, n in zip(cell, ("lat_idx", "lon_idx"), strict=True)]
    return per_pixel.groupBy(*named).agg(ratio(F.sum("v"), F.count("v")).alias("value"))


def pixel_statistics(stacks: DataFrame, keys: list[str]) -> DataFrame:
    """Per pixel over time from partial sums: valid steps, mean and population deviation of the wetland fraction."""
    f = stacks.withColumn("fraction", ratio(F.col("weighted"), F.col("coverage")))
    return f.groupBy(*keys).agg(F.count("fraction").alias("n_valid"), F.avg("fraction").alias("mean_fraction"), F.stddev_pop("fraction").alias("std_fraction"))


def chunk_key(lat_idx: Column, lon_idx: Column, cells: int) -> Column:
    """The chunk of a grid that a cell is in, as a partitioning key."""
    return F.concat_ws("_", F.floor(lat_idx / cells).cast("string"), F.floor(lon_idx / cells).cast("string"))


# Named transforms of a staged tile's rows (weighted, coverage, ...), which users may add to.
TRANSFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fraction": lambda t: t.withColumn("value", ratio(F.col("weighted"), F.col("coverage"))),
    "covered": lambda t: t.withColumn("value", (F.col("coverage") > 0).cast("double")),
    "wet": lambda t: t.withColumn("value", F.when(F.col("coverage") > 0, (F.col("weighted") > 0).cast("double"))),
}


def transformed(tiles: DataFrame, name: str) -> DataFrame:
    """Tiles' rows by a named transform."""
    if name not in TRANSFORMS:
        raise KeyError(f"no transform {name!r}, but {sorted(TRANSFORMS)}")
    return TRANSFORMS[name](tiles)


def tree_merged(parts: DataFrame, keys: list[str], merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str, fan: int = 64) -> DataFrame:
    """A user's associative merge of a key's rows into one, in two levels.

    ``merge`` takes rows of one key and returns one row of the same columns; a
    key's rows are dealt over ``fan`` buckets, merged there, and then together,
    so that a key with most of the rows is no single task's work.
    """
    names = parts.columns
    dealt = parts.withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(fan)))
    first = dealt.groupBy(*keys, "_bucket").applyInPandas(lambda rows: merge(rows[names]), schema)
    return first.groupBy(*keys).applyInPandas(merge, schema)


def tile_audit(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, length, content) against a manifest (path, size): missing, size_mismatch, not_tiff, or ok; files not listed are extra.

    Only a file's first four bytes are looked at: the byte order and the mark of a TIFF or a BigTIFF.
    """
    head = F.hex(F.substring("content", 1, 4))
    m = manifest.select(F.col("path").alias("_p"), F.col("size").alias("_size"))
    met = files.select("path", "length", head.alias("_head")).join(m, F.col("path") == F.col("_p"), "full_outer")
    status = F.when(F.col("path").isNull(), "missing").when(F.col("_p").isNull(), "extra").when(F.col("length") != F.col("_size"), "size_mismatch").when(~F.col("_head").isin("49492A00", "4D4D002A", "49492B00", "4D4D002B"), "not_tiff").otherwise("ok")
    return met.select(F.coalesce("path", "_p").alias("path"), status.alias("status"))
