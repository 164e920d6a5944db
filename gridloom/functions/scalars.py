"""Column expressions: guarded arithmetic, time buckets, tokens of file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEASONS = ("DJF", "MAM", "JJA", "SON")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in array sources and is a value in Spark."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats})


def sentinel_to_null(value: Column, *sentinels: float) -> Column:
    return F.when(~value.isin(*sentinels), value)


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clipping that keeps nulls; greatest and least alone skip them."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision, null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def exact(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def mean(df: DataFrame, name: str) -> Column:
    """The mean of a column; for integers one division of exact sums."""
    c = F.col(name)
    return ratio(F.sum(c), F.count(c)) if exact(df.schema[name].dataType) else F.avg(c)


def pop_std(df: DataFrame, name: str, where: Column | None = None) -> Column:
    """Population standard deviation; for integers from exact sums."""
    c = F.col(name) if where is None else F.when(where, F.col(name))
    if not exact(df.schema[name].dataType):
        return F.stddev_pop(c)
    n, s, q = F.count(c), F.sum(c), F.sum(c.cast("long") * c)
    return F.sqrt(ratio(n * q - s * s, n * n))


def month(ts: Column) -> Column:
    return F.trunc(ts, "MM")


def year(ts: Column) -> Column:
    return F.year(ts)


def season(ts: Column) -> Column:
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "DJF").when(m <= 5, "MAM").when(m <= 8, "JJA").otherwise("SON")


def four_day_axis(y: Column, band: Column) -> Column:
    """The date of a band: 1 January and four days for each band, from 0."""
    return F.date_add(F.make_date(y, F.lit(1), F.lit(1)), (band * 4).cast("int"))


def eight_day_bucket(ts: Column) -> Column:
    """The first day of the eight-day bucket; buckets begin anew each year."""
    return F.date_add(F.trunc(ts, "YEAR"), (F.floor((F.dayofyear(ts) - 1) / 8) * 8).cast("int"))


def padded_month_window(ts: Column, padding: int) -> tuple[Column, Column]:
    """First and last day of the months around ``ts``."""
    return F.add_months(month(ts), -padding), F.last_day(F.add_months(month(ts), padding))


def year_month_token(name: Column) -> Column:
    """The month that a file name gives as YYYYMM, YYYY-MM, YYYY_MM, YYYY.MM or YYYYmMM, else null."""
    pattern = r"(?<!\d)(\d{4})(?:[-_.]?|m)(\d{2})(?!\d)"
    y, m = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)
    return F.when((y != "") & m.between("01", "12"), F.to_date(F.concat_ws("-", y, m, F.lit("01"))))


def first_integer_token(name: Column) -> Column:
    found = F.regexp_extract(name, r"[0-9]+", 0)
    return F.when(found != "", found).cast("bigint")


def tile_code_token(name: Column) -> Column:
    """A grid tile's code (two digits, three capitals) in a file name, else null."""
    code = F.regexp_extract(name, r"(?:^|[^0-9A-Za-z])([0-9]{2}[A-Z]{3})(?:[^0-9A-Za-z]|$)", 1)
    return F.when(code != "", code)


def dataset_key(ids: Column) -> Column:
    """Sorted distinct ids joined by plus signs."""
    return F.array_join(F.array_sort(F.array_distinct(ids)), "+")


def normal_dataset_id(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"_\d{4}$", ""))


def iso_time(ts: Column) -> Column:
    """A time step as ISO text to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def named_variable(error: Column) -> Column:
    """The variable that an error's text names in quotes, else null."""
    found = F.regexp_extract(error, r"variable ['\"]([^'\"]+)['\"]", 1)
    return F.when(found != "", found)


def box_of_text(text: Column) -> Column:
    """west, south, east, north from text with commas; an error where they are not four numbers in order and on the globe."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    west, south, east, north = (F.get(parts, i) for i in range(4))
    good = (F.size(parts) == 4) & west.between(-180, 180) & east.between(-180, 180) & south.between(-90, 90) & north.between(-90, 90) & (west < east) & (south < north)
    box = F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))
    wrong = F.raise_error(F.concat(F.lit("not a box: "), text)).cast("struct<west:double,south:double,east:double,north:double>")
    return F.when(F.coalesce(good, F.lit(False)), box).otherwise(wrong)
