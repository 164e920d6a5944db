"""Connected components of an edge table, in rounds of DataFrame operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges between longs that the driver joins itself, at most; a megabyte.
FEW = 1 << 16


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating-star algorithm on edges (a, b), a != b.

    large: every node links its larger neighbours to the least node that it
    knows; else its smaller ones. The minimum of a node is aggregated before
    rows meet, and the join back to its edges is one that Spark can split, so
    that a node with very many edges is no single task's work.
    """
    if large:
        from_node = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        from_node = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = from_node.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))
    met = from_node.join(least, F.col("u") == F.col("mu"))
    if large:
        made = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        made = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("mu").alias("a"), F.col("m").alias("b")))
    return made.filter("a != b").distinct()


def _joined(edges: pa.Table) -> pa.Table:
    """components() of a few edges."""
    a, b = (edges.column(c).to_numpy() for c in ("a", "b"))
    names, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, over = both[: len(a)], both[len(a) :], np.arange(len(names))
    while (over[x] != over[y]).any():
        low = np.minimum(over[x], over[y])
        np.minimum.at(over, over[x], low)
        np.minimum.at(over, over[y], low)
        over = over[over]
    return pa.table({"node": names, "root": names[over]})


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node that has an edge, and its component's least node.

    ``edges`` has two columns of one orderable type; nulls and loops are left
    out. Ends when a pair of steps changes nothing: every component is then a
    star around its least node. Each round goes to the shared checkpoint folder.
    Up to ``FEW`` edges are joined on the driver, with the same result.
    """
    first, second = edges.columns
    now = cut(edges.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b")).filter("a != b").distinct())
    mark = None
    while True:
        total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(total) == mark or not total[0]:
            break
        if total[0] <= FEW and mark is None and now.schema["a"].dataType.typeName() == "long":
            return edges.sparkSession.createDataFrame(_joined(now.toArrow()), "node long, root long")
        mark = tuple(total)
        now = cut(_stars(_stars(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
