"""Helpers that the training-data operators share.

``read`` opens a table, ``cut`` ends a lineage in the cluster's shared
checkpoint folder, ``mapped`` runs a function over Arrow slices of bounded
size, and ``ranked`` numbers the rows of large groups without gathering any
group in one task.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None

#: Bytes of text that one step of a Python operator works on.
SLICE_BYTES = 4 << 20
#: Keys that are sent to all tasks, at most.
SENT = 50_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder in spark.checkpoint.dir and go on from there.

    Only where that setting is empty (tests, one machine) is a folder made here.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> None:
    """See that there is a checkpoint folder: the cluster's, or one of our own where none is set and the master is local."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        own = context.getConf().get("spark.checkpoint.dir")
        if not own and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="checkpoints-"))


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it again."""
    spark = df.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(stage: DataFrame) -> None:
    """Delete the files of staged(), once what was made of them is written."""
    spark = stage.sparkSession
    for file in stage.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("stage-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def released(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan refers to any more: Spark deletes them when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def as_documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text's UTF-8 bytes (null: empty) and the columns named."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``limit`` bytes of text, or of one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size + 16
        yield batch.slice(start)


def mapped(df: DataFrame, function: Callable[[pa.RecordBatch], dict | None], schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``function`` over slices of ``df``; it returns columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in slices(batches, column, limit):
            made = function(batch)
            if made is not None:
                yield pa.RecordBatch.from_arrays([made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow], schema=arrow)
        trimmed()

    return df.mapInArrow(run, schema)


def passed(df: DataFrame, function: Callable[[list[bytes | None]], dict], more: str = "") -> DataFrame:
    """All columns of ``df``, with what ``function`` makes of its texts.

    It returns columns by name, as in ``more``; one called ``_keep`` selects rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(more) if more else StructType()
    types = to_arrow_schema(added)

    def run(batches):
        for batch in slices(batches):
            texts = [None if t is None else t.encode() for t in column(batch, "text").to_pylist()]
            made = function(texts)
            out = pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(made[f.name], f.type) for f in types]], names=[*batch.schema.names, *types.names])
            yield out.filter(pa.array(made["_keep"])) if "_keep" in made else out
        trimmed()

    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def trimmed() -> None:
    """Give memory that is free back to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ranked(df: DataFrame, by: list[str], key: list[str], name: str) -> DataFrame:
    """Number the rows of each group ``by`` from 0, by the MD5 of ``key``, then ``key``.

    A group is dealt by the first digits of the MD5 over buckets, twice as many
    as shuffle partitions; buckets are numbered side by side and shifted by the
    rows of the buckets before them, so that no task gets more than a share of
    a large group. Rows move once, by group and bucket. Rows that share group and key (null or repeated ids) are one
    row with a weight there; among themselves they are numbered by the input
    partition they come from, whose counts are added up, so that no task gets
    all of them either. Nulls are values like any other.
    """
    parts = min(1 << 14, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key])
    hashed = df.withColumn("_md5", F.md5(text.cast("binary")))
    full, keys = [*by, *key], [*by, "_bucket"]

    def same(left: DataFrame, right: DataFrame, names: list[str]):
        return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_s{k}"]) for k in names])

    def aside(right: DataFrame, names: list[str], *more: str) -> DataFrame:
        return right.select(*[F.col(k).alias(f"_s{k}") for k in names], *more)

    # keys that occur more than once, from the keys alone; without any the rows are moved once
    repeated = cut(hashed.select(*full, "_md5").groupBy(*full, "_md5").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    some = repeated.limit(SENT + 1).count()
    single = hashed
    if some:
        known = aside(repeated, full)
        known = F.broadcast(known) if some <= SENT else known
        # stored, as a row's number among its likes depends on where it stands
        marked = hashed.withColumn("_part", F.spark_partition_id())
        several = cut(marked.join(known, same(marked, known, full), "left_semi"))
        single = hashed.join(known, same(hashed, known, full), "left_anti")

    weighed = single.withColumns({"_n": F.lit(1).cast("long"), "_one": F.lit(True)})
    if some:
        weighed = weighed.unionByName(repeated.withColumn("_one", F.lit(False)), allowMissingColumns=True)
    bucketed = weighed.withColumn("_bucket", F.shiftright(F.conv(F.substring("_md5", 1, 6), 16, 10).cast("long") * parts, 24).cast("int"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shifts = bucketed.groupBy(*keys).agg(F.sum("_n").alias("_n"))
    shifts = shifts.withColumn("_n", F.coalesce(F.sum("_n").over(before(Window.partitionBy(*by).orderBy("_bucket"))), F.lit(0)))
    # a bucket's shift is a row ahead of its rows and not joined to them: by nulls-are-equal keys they would move once more
    shifted = shifts.select(*keys, F.lit("").alias("_md5"), "_n", F.lit(False).alias("_one"))
    own = F.coalesce(F.sum("_n").over(before(Window.partitionBy(*keys).orderBy("_md5", *key))), F.lit(0))
    numbered = bucketed.unionByName(shifted, allowMissingColumns=True).withColumn(name, own.cast("long")).filter("_md5 != ''")
    columns = [*df.columns, name]
    if not some:
        return numbered.select(*columns)
    placed = [*full, "_part"]
    held = several.groupBy(*placed).agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(before(Window.partitionBy(*full).orderBy("_part"))), F.lit(0))
    ahead = aside(held.withColumn("_ahead", ahead), placed, "_ahead")
    nth = several.withColumn("_nth", F.row_number().over(Window.partitionBy(*placed).orderBy("_md5")) - 1)
    nth = nth.join(ahead, same(nth, ahead, placed)).select(*hashed.columns, (F.col("_nth") + F.col("_ahead")).alias("_nth"))
    first = aside(numbered.filter(~F.col("_one")).withColumn("_first", F.col(name)), full, "_first")
    rest = nth.join(first, same(nth, first, full)).withColumn(name, (F.col("_first") + F.col("_nth")).cast("long"))
    return numbered.filter("_one").select(*columns).unionByName(rest.select(*columns))
