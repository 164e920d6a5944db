"""Regridding by separable axis weights: average, bilinear, nearest and mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def coarsen(cells: DataFrame, factor: int, keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Means of blocks of ``factor`` by ``factor`` cells, empty ones left out."""
    block = [F.expr(f"cast({c} div {factor} as int)").alias(c) for c in ("lat_idx", "lon_idx")]
    return cells.groupBy(*keys, *block).agg(ratio(F.sum(value), F.count(value)).alias("value"), F.count(value).alias("n_source"))


def _binned(axis: DataFrame, low: str, high: str, width: Column, name: str) -> DataFrame:
    """An axis with a row for each bin of ``width`` that an interval touches, and the first of its bins."""
    first, last = F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long")
    return axis.withColumn(f"_first_{name}", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_weights(source: DataFrame, target: DataFrame) -> DataFrame:
    """src, dst, weight: the lengths that axis intervals (idx, low, high) share.

    Intervals meet by the bins that they touch, bins as wide as the widest
    interval on average, and are kept in the first bin that they share.
    """
    s = source.select(F.col("idx").alias("src"), F.col("low").alias("s0"), F.col("high").alias("s1"))
    t = target.select(F.col("idx").alias("dst"), F.col("low").alias("t0"), F.col("high").alias("t1"))
    mean_width = lambda df, a, b: df.agg(F.avg(F.col(b) - F.col(a))).first()[0] or 1.0
    width = F.lit(max(mean_width(s, "s0", "s1"), mean_width(t, "t0", "t1")))
    met = _binned(s, "s0", "s1", width, "s").join(_binned(t, "t0", "t1", width, "t"), "_bin")
    met = met.filter((F.col("s0") < F.col("t1")) & (F.col("t0") < F.col("s1")) & (F.col("_bin") == F.greatest("_first_s", "_first_t")))
    return met.select("src", "dst", (F.least("s1", "t1") - F.greatest("s0", "t0")).alias("weight"))


def linear_weights(source: DataFrame, target: DataFrame) -> DataFrame:
    """src, dst, weight for linear interpolation between centres (idx, at) of a regular axis; nothing outside the hull."""
    s = source.select(F.col("idx").alias("src"), F.col("at").alias("s"))
    t = target.select(F.col("idx").alias("dst"), F.col("at").alias("t"))
    span = source.agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not span["n"]:
        return s.select("src", F.lit(0).alias("dst"), F.lit(0.0).alias("weight")).filter("false")
    step = (span["hi"] - span["lo"]) / max(1, span["n"] - 1) or 1.0
    # centres nearer than a step are in the same bin or next to it
    near = s.withColumn("_bin", F.floor(F.col("s") / step)).join(t.filter(F.col("t").between(span["lo"], span["hi"])).withColumn("_bin", F.explode(F.array(*[F.floor(F.col("t") / step) + d for d in (-1, 0, 1)]))), "_bin")
    return near.filter(F.abs(F.col("s") - F.col("t")) < step).select("src", "dst", (1 - F.abs(F.col("s") - F.col("t")) / step).alias("weight"))


def nearest_weights(source: DataFrame, target: DataFrame) -> DataFrame:
    """src, dst, weight 1 for the nearest centre, the lower index where two are as near.

    Both axes are put in one order; a target's nearest centre is the last one
    before it or the first one after. An axis is one side of a grid.
    """
    both = source.select(F.col("at"), F.struct("at", F.col("idx").alias("src")).alias("_s"), F.lit(None).cast("int").alias("dst"))
    both = both.unionByName(target.select("at", F.lit(None).cast(both.schema["_s"].dataType).alias("_s"), F.col("idx").cast("int").alias("dst")))
    w = Window.partitionBy(F.lit(1)).orderBy("at")
    before = F.last("_s", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_s", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    placed = both.withColumns({"_before": before, "_after": after}).filter("dst is not null")
    far = lambda c: F.abs(F.col(f"{c}.at") - F.col("at"))
    earlier = F.col("_after").isNull() | (F.col("_before").isNotNull() & ((far("_before") < far("_after")) | ((far("_before") == far("_after")) & (F.col("_before.src") <= F.col("_after.src")))))
    return placed.select(F.when(earlier, F.col("_before.src")).otherwise(F.col("_after.src")).alias("src"), "dst", F.lit(1.0).alias("weight"))


def _weighted(cells: DataFrame, lat: DataFrame, lon: DataFrame) -> DataFrame:
    a = lat.select(F.col("src").alias("lat_idx"), F.col("dst").alias("_lat"), F.col("weight").alias("_a"))
    b = lon.select(F.col("src").alias("lon_idx"), F.col("dst").alias("_lon"), F.col("weight").alias("_b"))
    return cells.join(a, "lat_idx").join(b, "lon_idx").withColumn("_w", F.col("_a") * F.col("_b"))


def regrid(cells: DataFrame, lat: DataFrame, lon: DataFrame, keys: tuple[str, ...] = (), value: str = "value", missing_as: Column | None = None) -> DataFrame:
    """Weighted means on the target grid over the source cells that have a value.

    ``missing_as`` gives missing cells a value instead of leaving them out.
    """
    v = F.col(value) if missing_as is None else F.coalesce(F.col(value), missing_as)
    made = _weighted(cells, lat, lon).groupBy(*keys, F.col("_lat").alias("lat_idx"), F.col("_lon").alias("lon_idx"))
    return made.agg(ratio(F.sum(v * F.col("_w")), F.sum(F.when(v.isNotNull(), F.col("_w")))).alias("value"))


def regrid_mode(cells: DataFrame, lat: DataFrame, lon: DataFrame, keys: tuple[str, ...] = (), class_id: str = "class_id") -> DataFrame:
    """The class with most weight in each target cell, the lowest where they tie."""
    w = _weighted(cells.filter(F.col(class_id).isNotNull()), lat, lon).groupBy(*keys, F.col("_lat").alias("lat_idx"), F.col("_lon").alias("lon_idx"), class_id).agg(F.sum("_w").alias("w"))
    return w.groupBy(*keys, "lat_idx", "lon_idx").agg(F.max_by(class_id, F.struct(F.round("w", 9), -F.col(class_id))).alias(class_id))


def class_fractions(cells: DataFrame, lat: DataFrame, lon: DataFrame, keys: tuple[str, ...] = (), class_id: str = "class_id", missing_counts: bool = True) -> DataFrame:
    """Each class's share of every target cell; missing cells are in the whole unless ``missing_counts`` is false."""
    w = _weighted(cells if missing_counts else cells.filter(F.col(class_id).isNotNull()), lat, lon)
    target = [*keys, F.col("_lat").alias("lat_idx"), F.col("_lon").alias("lon_idx")]
    whole = w.groupBy(*target).agg(F.sum("_w").alias("whole"))
    part = w.filter(F.col(class_id).isNotNull()).groupBy(*target, class_id).agg(F.sum("_w").alias("part"))
    return part.join(whole, [*keys, "lat_idx", "lon_idx"]).select(*keys, "lat_idx", "lon_idx", class_id, ratio(F.col("part"), F.col("whole")).alias("fraction"))


def stride(cells: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row and column."""
    return cells.filter((F.col("lat_idx") % step == 0) & (F.col("lon_idx") % step == 0))


def histogram_quantile(values: DataFrame, q: float, bins: int = 1000, value: str = "value") -> DataFrame:
    """The middle of the bin of [0, 1] at which the counts first reach q of all."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    counts = values.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # at most ``bins`` rows
    w = Window.partitionBy(F.lit(1))
    cum = F.sum("n").over(w.orderBy("bin"))
    return counts.withColumns({"cum": cum, "all": F.sum("n").over(w)}).filter(F.col("cum") >= q * F.col("all")).agg(((F.min("bin") + 0.5) / bins).alias("quantile"))
