"""Trends: Theil-Sen slopes, Mann-Kendall tests, agreement, year-over-year change."""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import accumulate
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .neighbours import exact_percentile

KEYS = ("dataset_id", "lat_idx", "lon_idx")
MIN_OBSERVATIONS, MIN_SAMPLES, CONFIDENCE = 5, 4, 0.95
#: Differences of pairs that a test holds at once.
PAIRS = 1 << 22


def _ordered(series: DataFrame, time: str, value: str) -> DataFrame:
    """Per key the values that are there, in time order."""
    got = series.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v"))))).alias("s"), F.count(F.lit(1)).alias("steps"))
    return got.select(*KEYS, "steps", F.transform("s", lambda x: x["v"]).alias("y"))


def sen_kendall(series: DataFrame, time: str = "year", value: str = "value") -> DataFrame:
    """Per key: observations, Kendall's S, tied pairs and the Theil-Sen slope over the index of the values that are there.

    Pairs are made inside a key's own short array, so that nothing is joined.
    """
    pairs = "flatten(transform(y, (a, i) -> transform(slice(y, i + 2, size(y)), (b, j) -> {})))"
    made = _ordered(series, time, value).withColumns({
        "signs": F.expr(pairs.format("cast(signum(b - a) as bigint)")),
        "slopes": F.expr(f"array_sort({pairs.format('cast(b - a as double) / (j + 1)')})"),
    })
    half = "size(slopes) div 2"
    median = F.expr(f"case when size(slopes) = 0 then null when size(slopes) % 2 = 1 then slopes[{half}] else (slopes[{half} - 1] + slopes[{half}]) / 2 end")
    return made.select(*KEYS, F.size("y").cast("long").alias("n_obs"), F.aggregate("signs", F.lit(0).cast("long"), lambda a, x: a + x).alias("kendall_s"), F.size(F.filter("signs", lambda x: x == 0)).cast("long").alias("n_ties"), median.alias("sens_slope"))


def inversion_counts(n: int) -> list[int]:
    """How many orders of ``n`` values have 0, 1, 2, ... inversions."""
    counts = [1]
    for k in range(2, n + 1):
        counts = [sum(counts[max(0, i - k + 1) : i + 1]) for i in range(len(counts) + k - 1)]
    return counts


@lru_cache
def _exact(n: int) -> list[float]:
    """The chance of at most 0, 1, 2, ... inversions of ``n`` values, twice."""
    total = math.factorial(n)
    return [min(1.0, 2 * x / total) for x in accumulate(inversion_counts(n))]


def kendall_p(n: int, s: int, ties: list[int]) -> float:
    """The two-sided p-value of Kendall's S: exact without ties up to 33 values and where at most one pair is against the rest, else by the normal with ties in the variance."""
    against = (n * (n - 1) // 2 - abs(s)) // 2
    if not ties and n <= 33:
        return _exact(n)[against]
    if not ties and against <= 1:
        return min(1.0, 2.0 * math.exp(-math.lgamma(n + 1 - against)))
    variance = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in ties)) / 18
    # the usual form for tau-b: no continuity correction
    return math.erfc(abs(s) / math.sqrt(2 * variance)) if variance > 0 else 1.0


def _tested(y: np.ndarray, alpha: float) -> list[tuple[float | None, float, float, bool, int]]:
    """slope, p, z, significant, direction of each row of ``y``, series of one length."""
    n = y.shape[1]
    if n < MIN_SAMPLES:
        return [(None, 1.0, 0.0, False, 0)] * len(y)
    i, j = np.triu_indices(n, 1)
    out = []
    step = max(1, PAIRS // len(i))
    for at in range(0, len(y), step):
        part = y[at : at + step]
        apart = part[:, j] - part[:, i]
        slopes, totals = np.median(apart / (j - i), axis=1), np.sign(apart).sum(axis=1).astype(int)
        tied = (apart == 0).any(axis=1)
        for row, slope, s, has_ties in zip(part, slopes.tolist(), totals.tolist(), tied.tolist(), strict=True):
            ties = [t for t in np.unique(row, return_counts=True)[1].tolist() if t > 1] if has_ties else []
            if ties == [n]:
                out.append((0.0, 1.0, 0.0, False, 0))
                continue
            p = kendall_p(n, s, ties)
            z = (8.0 if p <= 0 else 0.0 if p >= 1 else NormalDist().inv_cdf(1 - p / 2)) * np.sign(s)
            out.append((slope, p, float(z), p < alpha, int(np.sign(slope)) if p < alpha else 0))
    return out


def pixel_trends(series: DataFrame, time: str = "year", value: str = "value", min_observations: int = MIN_OBSERVATIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """Per key: slope, p-value, z-score, significance, direction and status.

    The gate counts time steps, empty ones included; below it the status is
    insufficient_observations. The test itself is a pandas UDF over arrays
    (an exact distribution and an inverse normal have no SQL form); series of
    one length are tested together, ``PAIRS`` differences at a time.
    """
    alpha = 1.0 - confidence

    @F.pandas_udf("slope double, p double, z double, significant boolean, direction int")
    def tested(y: pd.Series) -> pd.DataFrame:
        lengths = y.map(len).to_numpy()
        out: list = [None] * len(y)
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            rows = np.stack([np.asarray(y.iloc[k], float) for k in at]).reshape(len(at), n)
            for k, made in zip(at.tolist(), _tested(rows, alpha), strict=True):
                out[k] = made
        return pd.DataFrame(out, columns=["slope", "p", "z", "significant", "direction"])

    made = _ordered(series, time, value).withColumn("t", tested(F.transform("y", lambda v: v.cast("double"))))
    enough = F.col("steps") >= min_observations
    return made.select(
        *KEYS,
        F.when(enough, F.col("t.slope")).alias("sens_slope"),
        F.when(enough, F.col("t.p")).alias("p_value"),
        F.when(enough, F.col("t.z")).alias("z_score"),
        (enough & F.col("t.significant")).alias("significant"),
        F.when(enough, F.col("t.direction")).otherwise(0).alias("trend_direction"),
        F.when(enough, "computed").otherwise("insufficient_observations").alias("status"),
    )


def trend_agreement(trends: DataFrame, datasets: int, direction: str = "trend_direction") -> DataFrame:
    """Per cell over datasets: counts of each direction, the largest count's share of all datasets, unanimity, and the slopes' mean and deviation."""
    d, slope = F.col(direction), F.col("sens_slope")
    up, down, flat = F.count_if(d > 0), F.count_if(d < 0), F.count_if(d == 0)
    return trends.groupBy("lat_idx", "lon_idx").agg(up.alias("n_up"), down.alias("n_down"), flat.alias("n_stable"), F.avg(slope).alias("mean_slope"), F.stddev_pop(slope).alias("slope_std")).select(
        "lat_idx",
        "lon_idx",
        "n_up",
        "n_down",
        "n_stable",
        ratio(F.greatest("n_up", "n_down", "n_stable"), F.lit(datasets)).alias("agreement_ratio"),
        (F.col("n_up") == datasets).alias("robust_increase"),
        (F.col("n_down") == datasets).alias("robust_decrease"),
        (F.col("n_stable") == datasets).alias("robust_stable"),
        (F.greatest("n_up", "n_down", "n_stable") < datasets).alias("disputed"),
        "mean_slope",
        "slope_std",
    )


def gated_agreement(trends: DataFrame, spans: DataFrame, min_years: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """trend_agreement() of the datasets' computed trends, and the window they share with its status.

    Without a window of ``min_years`` in common there are no rows. ``spans``
    has dataset_id, start, stop, a row a dataset.
    """
    window = overlap_window(spans, min_years)
    status = window.first()["status"]
    computed = trends.filter("status = 'computed'")
    n = computed.select("dataset_id").distinct().count()
    status = "overlap_window_empty" if not n else status
    made = trend_agreement(computed, n)
    return made if status == "computed" else made.filter("false"), window.withColumn("status", F.lit(status))


def regional_summary(trends: DataFrame, direction: str = "trend_direction") -> DataFrame:
    """Per dataset and region (cells listed under each of their regions): cells with a slope, shares by direction, median slope."""
    d, has = F.col(direction), F.col("sens_slope").isNotNull()
    n, keys = F.count("sens_slope"), ["dataset_id", "region_id"]
    counts = trends.groupBy(*keys).agg(
        n.alias("n_valid"),
        ratio(F.count_if(has & (d > 0)), n).alias("share_increasing"),
        ratio(F.count_if(has & (d < 0)), n).alias("share_decreasing"),
        ratio(F.count_if(has & (d == 0)), n).alias("share_stable"),
    )
    return counts.join(exact_percentile(trends, 0.5, ("dataset_id", "region_id"), "sens_slope", "median_slope"), keys, "left")


def overlap_window(ranges: DataFrame, min_years: float = 5.0) -> DataFrame:
    """The latest start and the earliest stop of all rows, and whether they are far enough apart."""
    made = ranges.agg(F.max("start").alias("overlap_start"), F.min("stop").alias("overlap_end"))
    years = F.datediff("overlap_end", "overlap_start") / 365.25
    return made.withColumns({"overlap_years": years, "status": F.when(years >= min_years, "computed").otherwise("overlap_window_empty")})


def year_over_year(annual: DataFrame, value: str = "value") -> DataFrame:
    """Change from the year before, null if that year or its value is missing; its sign, zero for null."""
    w = Window.partitionBy(*KEYS).orderBy("year")
    before = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag(value).over(w))
    delta = F.col(value) - before
    return annual.withColumn("delta", delta).withColumn("direction", F.coalesce(F.signum("delta").cast("int"), F.lit(0)))
