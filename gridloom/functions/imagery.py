"""The arithmetic of reference imagery: quality bits, scaling, cloud-free medians, windows and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bit(flags: Column, position: int, width: int = 1) -> Column:
    """The value of ``width`` bits of a quality word."""
    return F.shiftright(flags, position).bitwiseAND((1 << width) - 1)


def clear_of(flags: Column, *positions: int) -> Column:
    """Whether none of the bits is set."""
    return flags.bitwiseAND(sum(1 << p for p in positions)) == 0


def scaled(digital: Column, factor: float, offset: float = 0.0) -> Column:
    return digital.cast("double") * factor + offset


def clear_median(pixels: DataFrame, keys: list[str], value: str, flags: str, *bad_bits: int) -> DataFrame:
    """Per key the median of the observations without a bad bit, and how many those are."""
    good = F.when(clear_of(F.col(flags), *bad_bits), F.col(value).cast("double"))
    return pixels.groupBy(*keys).agg(F.percentile(good, 0.5).alias(value), F.count(good).alias("n_clear"))


def eight_day_composite(day: Column, available_from: str) -> Column:
    """First day of the composite that holds ``day``, not before the product's first."""
    start = F.date_add(F.trunc(day, "YEAR"), (F.floor((F.dayofyear(day) - 1) / 8) * 8).cast("int"))
    return F.greatest(start, F.lit(available_from).cast("date"))


def fusion_window(month: Column, padding: int, first: str, last: str) -> Column:
    """Start and stop of the months around a month, within a product's span."""
    return F.struct(
        F.greatest(F.add_months(F.trunc(month, "MM"), -padding), F.lit(first).cast("date")).alias("start"),
        F.least(F.last_day(F.add_months(F.trunc(month, "MM"), padding)), F.lit(last).cast("date")).alias("stop"),
    )


def failure_status(message: Column) -> Column:
    """A download's status from its error's text."""
    m = F.lower(message)
    limits = m.contains("32 mb") | m.contains("10000") | m.contains("request too large")
    return F.when(limits, "download_limit_exceeded").otherwise("download_failed")


def annual_window(year: Column) -> Column:
    """First day of a year and of the next."""
    return F.struct(F.make_date(year, F.lit(1), F.lit(1)).alias("start"), F.make_date(year + 1, F.lit(1), F.lit(1)).alias("stop"))


def size_batches(files: DataFrame, group: str, order: str, size: str, most: int = 0, most_files: int = 0) -> DataFrame:
    """Files numbered into batches inside their group, in order: a batch ends before the file that would bring it over ``most`` bytes or ``most_files`` files.

    A file larger than ``most`` has a batch of its own; a limit of zero is none.
    A group is a listing that is gone through once; files of unknown size count as empty.
    """
    if most <= 0 and most_files <= 0:
        raise ValueError("a batch needs a limit")
    ordered = files.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
    sizes = ordered.groupBy(F.col(group).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce(F.col(size), F.lit(0)).cast("long").alias("s")))).alias("_all"))
    over = " or ".join(x for x, n in ((f"a.n >= {int(most_files)}", most_files), (f"a.n > 0 and a.b + x.s > {int(most)}", most)) if n > 0)
    # the state: files and bytes of the batch, and where batches begin
    fold = f"""aggregate(_all, named_struct('n', 0L, 'b', 0L, 'starts', array(0)),
        (a, x) -> if({over}, named_struct('n', 1L, 'b', x.s, 'starts', concat(a.starts, array(x._at))), named_struct('n', a.n + 1L, 'b', a.b + x.s, 'starts', a.starts)),
        a -> a.starts)"""
    starts = sizes.select("_g", F.posexplode(F.expr(fold)).alias("batch", "_start"))
    starts = starts.withColumn("_stop", F.lead("_start", 1, 1 << 30).over(Window.partitionBy("_g").orderBy("_start")))
    met = ordered.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_stop")))
    return met.select(*files.columns, "batch")
