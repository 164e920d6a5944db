"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in the order of their id's MD5, form blocks of
``BLOCK``. With weight w = k / Q, block j of a source is released at slot
floor(j / w) and due by slot ceil((j + 1) / w); each slot takes the released
block with the earliest deadline, ties to the smaller source. On one lane with
weights that add up to one this meets every deadline, so that after any number
of slots each source has had its share to within less than one block.

The schedule repeats every Q slots. One period is folded by SQL functions over
the sources' integer weights; documents are numbered within their source in
parallel and find their slot by arithmetic and a join with the period's Q
rows. Slots of a source that has run out stay empty, and the order of the rest
does not change. Nothing but DataFrame functions is used.

Defined results: every row is kept and gets a place; a null source is a source
like any other; repeated rows each get a place; no rows, no result rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ranked

#: Slots of a period, at least; four a source if that is more. Documents of a block.
PERIOD, BLOCK = 1000, 16
#: Slots of a period that are sent to all tasks, at most; longer ones are joined as Spark sees fit.
SENT = 100_000


def whole_period(targets: dict[str, float], period: int = PERIOD) -> int:
    """The least number of slots, from ``period`` to 20 times that, of which all targets are whole numbers; ``period`` if there is none."""
    total = sum(targets.values())
    whole = lambda q: all(abs(v / total * q - round(v / total * q)) < 1e-9 * q for v in targets.values())
    return next((q for q in range(period, 20 * period + 1) if whole(q)), period)


def weights(docs: DataFrame, targets: dict[str, float] | None = None, period: int = PERIOD) -> DataFrame:
    """One row: the sources in order, their integer weights, and Q, their sum.

    Weights follow ``targets`` (a source that is not there weighs least) or
    else the square root of the number of documents, by largest remainders;
    a source that asks for less than a slot of a period has one. Given targets
    are met exactly if a period of up to 20 times the length can.
    """
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if targets:
        period = whole_period(targets, period)
        pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))]
        size = F.coalesce(F.round(F.create_map(*pairs)[F.coalesce("source", F.lit(""))] * 1_000_000_000 / sum(targets.values())), F.lit(1))
    else:
        size = F.floor(F.sqrt("n") * 1000)
    sized = n.select("source", size.cast("long").alias("size"))
    listed = sized.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNotNull().alias("known"), "source", "size"))).alias("all")).filter(F.size("all") > 0)
    shared = listed.select(
        "all",
        F.greatest(F.lit(period), 4 * F.size("all")).cast("long").alias("q0"),
        F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("total"),
    )
    # sources that ask for less than a slot have one; the others share what is left
    shared = shared.withColumn("few", F.expr("filter(all, x -> q0 * x.size < total)"))
    shared = shared.withColumn("q1", F.expr("q0 - size(few)")).withColumn("left", F.expr("total - aggregate(few, 0L, (a, x) -> a + x.size)"))
    shared = shared.withColumn("base", F.expr("transform(all, x -> if(q0 * x.size < total, 1L, q1 * x.size div left))"))
    shared = shared.withColumn("rest", F.expr("transform(all, (x, i) -> struct(if(q0 * x.size < total, 1L, -(q1 * x.size % left)) as r, i as i))"))
    shared = shared.withColumn("lucky", F.expr("slice(transform(array_sort(rest), x -> x.i), 1, cast(greatest(0L, q0 - aggregate(base, 0L, (a, x) -> a + x)) as int))"))
    shared = shared.withColumn("ks", F.expr("transform(base, (k, i) -> greatest(1L, k + if(array_contains(lucky, i), 1L, 0L)))"))
    return shared.select(F.expr("aggregate(ks, 0L, (a, k) -> a + k)").alias("q"), F.expr("transform(all, x -> x.source)").alias("sources"), "ks")


def period(weighted: DataFrame) -> DataFrame:
    """(source, k, q, nth, slot): the slots of one period, by earliest deadline first."""
    fold = """aggregate(
        sequence(0L, q - 1),
        named_struct('done', transform(ks, k -> 0L), 'slots', cast(array() as array<int>)),
        (state, t) -> transform(
            array(array_min(transform(ks, (k, i) -> if(
                state.done[i] < k and state.done[i] * q div k <= t,
                named_struct('due', ((state.done[i] + 1) * q + k - 1) div k, 'i', i), null))).i),
            chosen -> named_struct(
                'done', transform(state.done, (d, i) -> d + if(i = chosen, 1L, 0L)),
                'slots', concat(state.slots, array(chosen))))[0],
        state -> state.slots)"""
    slots = weighted.withColumn("slots", F.expr(fold)).select("q", "sources", "ks", F.posexplode("slots").alias("slot", "chosen"))
    nth = F.row_number().over(Window.partitionBy("chosen").orderBy("slot")) - 1
    return slots.select(F.expr("sources[chosen]").alias("source"), F.expr("ks[chosen]").alias("k"), "q", nth.cast("long").alias("nth"), F.col("slot").cast("long").alias("slot"))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, block: int = BLOCK, slots: int = PERIOD) -> DataFrame:
    """The documents' columns with block, release, deadline, slot and position.

    Sorting by position gives the mixed order.
    """
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], F.col("doc_id").alias("_id"), F.col("source").alias("_source"))
    numbered = ranked(inner, ["_source"], ["_id"], "_rank")
    weighted = cut(weights(docs.select("source"), targets, slots))
    one = period(weighted).select(F.col("source").alias("_of"), "k", "q", "nth", F.col("slot").alias("at"))
    ks = weighted.select(F.explode(F.arrays_zip("sources", "ks")).alias("x")).select(F.col("x.sources").alias("_own"), F.col("x.ks").alias("_k"))
    sizes = weighted.select("q").first()
    if sizes is None or sizes["q"] <= SENT:  # rows of a period, and more than sources
        one, ks = F.broadcast(one), F.broadcast(ks)
    blocked = numbered.join(ks, F.col("_source").eqNullSafe(F.col("_own"))).withColumn("_block", F.expr(f"_rank div {int(block)}")).withColumn("_nth", F.col("_block") % F.col("_k"))
    placed = blocked.join(one, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_nth") == F.col("nth")))
    return placed.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)],
        F.col("_block").alias("block"),
        F.expr("_block * q div k").alias("release"),
        F.expr("((_block + 1) * q + k - 1) div k").alias("deadline"),
        F.expr("_block div k * q + at").alias("slot"),
        F.expr(f"(_block div k * q + at) * {int(block)} + _rank % {int(block)}").alias("position"),
    )


def in_order(docs: DataFrame, targets: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """The documents' columns, sorted into the mixed order."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("doc_id"), F.col("source"))
    return mix(inner, targets, block).orderBy("position").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
