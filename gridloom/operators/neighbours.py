"""Neighbourhoods on a grid: box windows, local maxima, components, spacing, quotas, ranks."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import ratio

#: Candidates of a group that spaced() goes through in one call.
AT_ONCE = 20_000


def box(cells: DataFrame, half: int, group: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Sum, count and maximum over the square of ``half`` cells each way, in two passes of windows."""
    rows = Window.partitionBy(*group, "lat_idx").orderBy("lon_idx").rangeBetween(-half, half)
    columns = Window.partitionBy(*group, "lon_idx").orderBy("lat_idx").rangeBetween(-half, half)
    first = cells.withColumns({"_s": F.sum(value).over(rows), "_n": F.count(value).over(rows), "_m": F.max(value).over(rows)})
    both = first.withColumns({"box_sum": F.sum("_s").over(columns), "box_count": F.sum("_n").over(columns), "box_max": F.max("_m").over(columns)})
    return both.drop("_s", "_n", "_m").withColumn("box_mean", ratio(F.col("box_sum"), F.col("box_count")))


def local_maxima(cells: DataFrame, group: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Cells that are as large as the largest of their eight neighbours and themselves; all of a plateau are."""
    near = F.abs(F.col(value) - F.col("box_max")) <= 1e-8 + 1e-5 * F.abs(F.col("box_max"))
    return box(cells, 1, group, value).filter(F.col(value).isNotNull() & near).select(*cells.columns)


def exact_percentile(cells: DataFrame, q: float, group: tuple[str, ...], value: str = "value", name: str = "threshold") -> DataFrame:
    """Per group the percentile of the values that are there, between ranks by linear interpolation.

    Approximate percentiles a little to either side bound the values among
    which the two ranks are, and only those, with their counts, are put in
    order: some ten-thousandths of a group, whatever its size.
    """
    accuracy, keys = 10_000, list(group)
    v = F.col(value).cast("double")
    there = cells.filter(F.col(value).isNotNull()).select(*keys, v.alias("_v"))
    sides = F.array(F.lit(max(0.0, q - 2 / accuracy)), F.lit(min(1.0, q + 2 / accuracy)))
    place = F.lit(q) * (F.col("_n") - 1)
    limits = there.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", sides, F.lit(accuracy)).alias("_b")).withColumn("_k", F.floor(place))
    limits = limits.select(*[F.col(k).alias(f"_g{k}") for k in keys], "_n", "_b", "_k", (place - F.col("_k")).alias("_f"))
    same = reduce(lambda a, b: a & b, [there[k].eqNullSafe(limits[f"_g{k}"]) for k in keys])
    side = F.when(F.col("_v") < F.col("_b")[0], -1).when(F.col("_v") > F.col("_b")[1], 1).otherwise(0)
    inside = F.when(side == 0, F.col("_v"))
    counts = there.join(limits, same).groupBy(*keys, "_n", "_k", "_f", side.alias("_side"), inside.alias("_in")).agg(F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_most"), F.min("_v").alias("_least"))
    # the nearest value stands for all below and for all above: the bounds may be off by a rank
    value = F.when(F.col("_side") < 0, F.col("_most")).otherwise(F.col("_least"))
    summed = counts.withColumn("_v", value).withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_side", "_in")))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    picked = summed.groupBy(*keys, "_f").agg(at(F.col("_k")).alias("_first"), at(F.least(F.col("_k") + 1, F.col("_n") - 1)).alias("_second"))
    return picked.select(*keys, ((1 - F.col("_f")) * F.col("_first") + F.col("_f") * F.col("_second")).alias(name))


def above_percentile(cells: DataFrame, q: float, group: tuple[str, ...], value: str = "value") -> DataFrame:
    """Cells at or above a percentile of their group, between ranks by linear interpolation."""
    limits = exact_percentile(cells, q, group, value)
    return cells.join(limits, list(group)).filter(F.col(value) >= F.col("threshold"))


def components(cells: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """4-connected components of each group's cells; a component's id is its least cell, row by row.

    Labels go along rows and columns by window functions, as runs share their
    least label, until none changes; each round is a DataFrame job and the
    number of rounds is bounded by the turns of the longest component.
    """
    from ..sources.store import checkpoint

    label = F.col("lat_idx").cast("long") * (1 << 31) + F.col("lon_idx")
    now = checkpoint(cells.select(*group, "lat_idx", "lon_idx").distinct().withColumn("component", label))

    def spread(df: DataFrame, along: str, across: str) -> DataFrame:
        w = Window.partitionBy(*group, across).orderBy(along)
        run = F.col(along) - F.row_number().over(w)
        return df.withColumn("_run", run).withColumn("component", F.min("component").over(Window.partitionBy(*group, across, "_run"))).drop("_run")

    while True:
        following = checkpoint(spread(spread(now, "lon_idx", "lat_idx"), "lat_idx", "lon_idx"))
        total = [df.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0] for df in (now, following)]
        now = following
        if total[0] == total[1]:
            break
    return now.withColumns({"seed_lat_idx": F.expr(f"cast(component div {1 << 31} as int)"), "seed_lon_idx": F.expr(f"cast(component % {1 << 31} as int)")}).drop("component")


def spaced(candidates: DataFrame, group: str, order: list[str], distance: float, keep: int | Column) -> DataFrame:
    """Greedy selection in each group: in order, a point is taken if none taken is nearer than ``distance`` degrees.

    A group's first ``AT_ONCE`` candidates are gone through in one call; if its
    ``keep`` are not found yet, the next ones of those that are far from all
    taken follow. No call sees more, and what comes to the driver is what was
    taken. ``keep`` may be a column that a group's rows share.
    """
    names, columns = candidates.columns, [F.desc(order[0]), F.desc(order[1]), F.asc(order[2])]
    wanted = keep if isinstance(keep, Column) else F.lit(keep)
    ranked = candidates.withColumn("_keep", wanted.cast("int"))
    schema = T.StructType([*candidates.schema.fields, T.StructField("_left", T.IntegerType())])

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ascending=[False, False, True], kind="mergesort")
        want, taken, points = int(rows["_keep"].iloc[0]), [], []
        for i, (lat, lon) in enumerate(zip(rows["lat"], rows["lon"], strict=True)):
            if len(taken) >= want:
                break
            if all(math.hypot(lat - a, lon - b) >= distance for a, b in points):
                taken.append(i)
                points.append((lat, lon))
        more = len(rows) == AT_ONCE and len(taken) < want
        return rows.iloc[taken].drop(columns="_keep").assign(_left=want - len(taken) if more else 0)

    spark, out, left = candidates.sparkSession, [], ranked
    while True:
        w = Window.partitionBy(group).orderBy(*columns)
        some = left.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= AT_ONCE).drop("_r")
        got = some.groupBy(group).applyInPandas(choose, schema).collect()
        out += [r[:-1] for r in got]
        again = {r[group]: r["_left"] for r in got if r["_left"]}
        if not again:
            return spark.createDataFrame(out, candidates.schema)
        taken = F.broadcast(spark.createDataFrame([(r[group], float(r["lat"]), float(r["lon"])) for r in got if r["_left"]], T.StructType([candidates.schema[group], T.StructField("_a", T.DoubleType()), T.StructField("_b", T.DoubleType())])).withColumnRenamed(group, "_g"))
        still = F.broadcast(spark.createDataFrame(list(again.items()), T.StructType([candidates.schema[group], T.StructField("_more", T.IntegerType())])).withColumnRenamed(group, "_g"))
        near = (F.hypot(F.col("lat") - F.col("_a"), F.col("lon") - F.col("_b")) < distance) | ((F.col("lat") == F.col("_a")) & (F.col("lon") == F.col("_b")))
        left = left.join(taken, (F.col(group) == F.col("_g")) & near, "left_anti").join(still, F.col(group) == F.col("_g")).select(*names, F.col("_more").alias("_keep"))


def rank_percentile(rank_order: list[Column], group: tuple[str, ...]) -> Column:
    """1 for the first of a group, 0 for the last, 1 if it is alone."""
    return 1 - F.percent_rank().over(Window.partitionBy(*group).orderBy(*rank_order))


def hamilton_quotas(regions: DataFrame, budget: int, weight: str = "area") -> DataFrame:
    """Largest-remainder shares of ``budget``, at least one each; regions are a catalogue of a few rows."""
    whole = Window.partitionBy(F.lit(1))
    n = F.count(F.lit(1)).over(whole)
    share = F.col(weight) / F.sum(weight).over(whole) * (F.lit(budget) - n)
    base = regions.withColumn("_share", share).withColumn("_base", F.floor(F.round("_share", 9)).cast("int")).withColumn("_rest", F.round(F.col("_share") - F.col("_base"), 9)).withColumn("_n", n)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("_rest"), F.desc(weight), "ord", "region_id"))
    left = F.lit(budget) - F.col("_n") - F.sum("_base").over(whole)
    return base.withColumn("quota", (1 + F.col("_base") + (place <= left).cast("int")).cast("int")).select(*regions.columns, "quota")
