"""Nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids and the residuals' codebooks are fitted on a sample that is a
bounded multiple of the lists: ``FIT`` vectors a list for the centroids, level
by level, and ``HELD`` more that these have not seen, for the codebooks and to
tell how many lists have to be probed. There are as many lists as the square
root of the vectors, up to ``MOST_LISTS`` and what ``SAMPLE_BYTES`` of sample
allow. Every valid vector is in the index. A vector belongs to
its nearest centroid's list and keeps the codes of its residual, a byte for
every four dimensions. A query probes the lists of its nearest centroids.
Consecutive lists make a cell of about ``CELL`` rows, to which a query is sent
once, with the lists that it probes there: it estimates the cosines of their
vectors from its asymmetric table and computes the exact cosines, in double
precision, of all that may reach the last of the nearest found so far (where
there are ``MANY``, of the ``RERANK`` with the highest first). An estimate is off by no more than the
length that coding has left of the residual, which the index keeps; so no near
vector of a probed list is lost. A query brings a floor to all its cells: what
the last of its nearest among ``FLOOR_BYTES`` of the sample, in the lists that
it probes, has reached. What is sent, tabulated and returned for a
query follows the rows that it probes and not the lists.

The number of probed lists is the least that found ``TARGET`` of the true
neighbours of held-out vectors among held-out vectors, so that it follows the
data and not their number. Large
cells are dealt over shards and many queries of one cell over blocks, which
keeps every task small whatever the sizes. Queries that found fewer neighbours
than there are search all lists.

Defined results: vectors that are null, zero, of another length than most, or
with null or non-finite parts take no part, nor do null ids. Rows that repeat
an id count once. No candidates, no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut

FIT, HELD, SAMPLE_BYTES, RERANK, MANY, TARGET = 40, 20, 128 << 20, 64, 1024, 0.985
MOST_LISTS, SUB, CODES, CODED = 1 << 12, 4, 256, 1 << 13
#: Centroids that are fitted at once; more are fitted in two levels.
AT_ONCE = 256
#: Rows of a shard: at least so many, else twice a cell's mean. Queries of a block, and of one step.
SHARD, QUERIES, STEP = 128, 1024, 64
#: Rows of a cell if lists are shorter, and numbers in them; numbers that are reranked at once.
CELL, CELL_VALUES, AT_HAND = 1 << 12, 1 << 18, 1 << 20
#: What single precision may take from an estimate. Bytes of the sample that give floors.
ROUNDED, FLOOR_BYTES = 1e-5, 8 << 20


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def levels(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centres: at once, or of parts that a first level of centres makes, each as many as its share of ``x``."""
    if k <= AT_ONCE:
        return k_means(x, k, rounds, rng)
    first = k_means(x, math.isqrt(k), rounds, rng)
    own = nearest(x, first)
    counts = np.bincount(own, minlength=len(first))
    share = np.maximum(counts > 0, counts * k // len(x))
    return np.concatenate([levels(x[own == i], int(n), rounds, rng) for i, n in enumerate(share) if n])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    step = max(1, (1 << 22) // max(1, len(centres)))
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T - half, axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Centroids, codebooks and the number of lists to probe."""

    def __init__(self, sample: np.ndarray, lists: int, top: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        x = unit(sample).astype(np.float32)[rng.permutation(len(sample))]
        self.dims = x.shape[1]
        self.parts = -(-self.dims // SUB)
        # a sample too small to be parted is fitted, coded and asked as a whole
        parted = len(x) >= 4 * (FIT + HELD)
        seen = x[: len(x) * FIT // (FIT + HELD)] if parted else x
        held = x[len(seen) :] if parted else x
        self.centres = levels(seen, max(1, min(lists, len(seen))), 8, rng).astype(np.float32)
        some = held[:CODED]
        rest = self._split(some - self.centres[nearest(some, self.centres)])
        self.books = np.stack([k_means(rest[:, m], CODES, 6, rng) for m in range(self.parts)]).astype(np.float32)
        self.probes = self._calibrated(held, top)

    def _split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.parts * SUB - self.dims))).reshape(len(x), self.parts, SUB)

    def _calibrated(self, x: np.ndarray, top: int) -> int:
        """Lists to probe so that TARGET of the neighbours of some of ``x`` in ``x`` are in them."""
        lists = len(self.centres)
        if len(x) <= top + 1:
            return lists
        own, needed = nearest(x, self.centres), []
        for i in range(0, min(512, len(x)), 64):
            asked = x[i : min(i + 64, 512)]
            near = asked @ x.T
            near[np.arange(len(asked)), np.arange(i, i + len(asked))] = -2
            best = np.argpartition(-near, top, axis=1)[:, :top]
            order = np.argsort(-(asked @ self.centres.T), axis=1)
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(lists)[None, :], axis=1)
            needed.append(np.take_along_axis(place, own[best], axis=1).ravel())
        needed = np.sort(np.concatenate(needed))
        return int(min(lists, needed[min(len(needed) - 1, int(TARGET * len(needed)))] + 1))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's list and codes, and the length of what these leave of it."""
        own = nearest(x, self.centres)
        rest = self._split(x - self.centres[own])
        codes = np.stack([nearest(rest[:, m], self.books[m]) for m in range(self.parts)], axis=1).astype(np.uint8)
        left = rest - self.books[np.arange(self.parts), codes]
        return own, codes, np.sqrt((left * left).sum(axis=(1, 2)))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """The queries' inner products with every code, by part: [part, code, query]."""
        return self.books @ np.ascontiguousarray(self._split(q).transpose(1, 2, 0))

    def floors(self, q: np.ndarray, asked: np.ndarray, probed: np.ndarray, top: int) -> np.ndarray:
        """What the nearest in the probed lists reach at least, by those of them that are in ``some``; -2 if too few are."""
        if len(self.ids) < top:
            return np.full(len(q), -2.0)
        near = np.where(probed[:, self.lists] & (self.ids != asked[:, None]), q @ self.some.T, np.float32(-2))
        least = np.partition(near, -top, axis=1)[:, -top].astype(np.float64)
        return np.where(least > -2, least - ROUNDED, -2.0)

    def keep(self, x: np.ndarray, ids: np.ndarray) -> None:
        """Rows of the index, one an id, by which floors are told."""
        ids, first = np.unique(ids, return_index=True)
        n = FLOOR_BYTES // (4 * self.dims)
        chosen = np.random.default_rng(7).permutation(len(ids))[:n]
        self.ids, self.some = ids[chosen], unit(x[first[chosen]]).astype(np.float32)
        self.lists = nearest(self.some, self.centres)

    def estimates(self, q: np.ndarray, lists: np.ndarray, codes: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """Cosines [query, row] from the tables, minus infinity outside a query's lists.

        ``lists`` ascend; ``probed`` tells for every query which of a cell's lists it probes.
        """
        tables, made = self.tables(q), np.full((len(lists), len(q)), -np.inf, np.float32)
        here, start = np.unique(lists, return_index=True)
        for own, a, b in zip(here, start, [*start[1:], len(lists)]):
            asks = probed[:, own % probed.shape[1]]
            # parted tables are copied, which pays where few ask
            some = slice(None) if 2 * asks.sum() > len(q) else np.flatnonzero(asks)
            sums = np.tile(self.centres[own] @ q[some].T, (b - a, 1))
            part = tables[:, :, some]
            for m in range(self.parts):
                sums += part[m][codes[a:b, m]]
            made[a:b, some] = np.where(asks[some], sums, -np.inf)
        return np.ascontiguousarray(made.T)

    def best(self, q: np.ndarray, asked: np.ndarray, probed: np.ndarray, x: np.ndarray, ids: np.ndarray, lists: np.ndarray, codes: np.ndarray, off: np.ndarray, top: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's nearest of its lists in a cell that reach its floor, as its place in ``q``, their ids and exact cosines."""
        guess = self.estimates(q.astype(np.float32), lists, codes, probed)
        guess[(guess + off < (floor - ROUNDED)[:, None]) | (ids == asked[:, None])] = -np.inf
        # where many are left, those with the highest estimates tell what others have to reach
        last, some = floor, min(RERANK, len(ids))
        many = np.flatnonzero(np.count_nonzero(guess > -np.inf, axis=1) > MANY)
        row = np.argpartition(guess[many], -some, axis=1)[:, -some:].ravel()
        by = np.repeat(many, some)
        found = _nearest(by, row, _cosines(q, by, x, row), ids, top)
        if len(many):
            least = np.full(len(q), np.inf)
            np.minimum.at(least, found[0], found[2])
            least[np.bincount(found[0], minlength=len(q)) < top] = -np.inf
            last = np.maximum(floor, least)
        guess[by, row] = -np.inf
        by, row = np.nonzero((guess > -np.inf) & (guess + off >= (last - ROUNDED)[:, None]))
        score = _cosines(q, by, x, row)
        near = score >= last[by]
        by, row, score = _nearest(*[np.concatenate(c) for c in zip(found, (by[near], row[near], score[near]))], ids, top)
        near = score >= floor[by]
        return by[near], ids[row[near]], score[near]


def _cosines(q: np.ndarray, by: np.ndarray, x: np.ndarray, row: np.ndarray) -> np.ndarray:
    out, step = np.empty(len(row)), max(1, AT_HAND // x.shape[1])
    for i in range(0, len(row), step):
        out[i : i + step] = (x[row[i : i + step]] * q[by[i : i + step]]).sum(axis=1)
    return out


def _nearest(by: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` ids with the highest scores for each of ``by``, each id by its best row."""
    order = np.lexsort((ids[row], -score, by))
    # an id that several rows have
    pair = np.stack([by[order], ids[row[order]]], axis=1)
    again = np.lexsort((np.arange(len(order)), pair[:, 1], pair[:, 0]))
    same = (pair[again[1:]] == pair[again[:-1]]).all(axis=1)
    order = np.delete(order, again[1:][same])
    place = np.arange(len(order)) - np.searchsorted(by[order], by[order])
    order = order[place < top]
    return by[order], row[order], score[order]


def valid(table: DataFrame) -> tuple[DataFrame, str, int]:
    """(vec_id, raw) of the vectors that take part, their number format and length."""
    kind = table.schema["embedding"].dataType.elementType.simpleString()
    x = table.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    fine = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    x = x.filter(fine)
    lengths = x.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return x.filter("false"), "<f8", 0
    return x.filter(F.size("embedding") == lengths[0]["d"]), "<f4" if kind == "float" else "<f8", lengths[0]["n"]


def _raw(batch: pa.RecordBatch, form: str) -> np.ndarray:
    values = column(batch, "embedding")
    return values.flatten().to_numpy(zero_copy_only=False).astype(form, copy=False).reshape(len(values), -1)


def _bytes(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.array([r.tobytes() for r in x], pa.binary())


def _matrix(cells, form: str) -> np.ndarray:
    return np.frombuffer(b"".join(cells), form).reshape(len(cells), -1)


def _search(x: DataFrame, queries: DataFrame, sent, form: str, top: int, every: bool) -> DataFrame:
    """(query_id, vec_id, score): the best of each probed cell."""

    def indexed(batches):
        for b in batches:
            if b.num_rows:
                raw = _raw(b, form)
                own, codes, off = sent.value.encode(unit(raw).astype(np.float32))
                own = own.astype(np.int32)
                yield pa.RecordBatch.from_arrays([column(b, "vec_id").cast(pa.int64()), pa.array(own // sent.value.together), pa.array(own), _bytes(codes), pa.array(off), _bytes(raw)], names=["vec_id", "cell", "list", "codes", "off", "raw"])

    def probing(batches):
        for b in batches:
            if b.num_rows:
                raw, ids = _raw(b, form), column(b, "vec_id").cast(pa.int64())
                centres, together = sent.value.centres, sent.value.together
                n = len(centres) if every else sent.value.probes
                for i in range(0, len(raw), STEP):
                    part = raw[i : i + STEP]
                    q = unit(part).astype(np.float32)
                    lists = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :n]
                    probed = np.zeros((len(part), -(-len(centres) // together) * together), bool)
                    np.put_along_axis(probed, lists, True, axis=1)
                    floor = sent.value.floors(q, ids.slice(i, STEP).to_numpy(), probed, top)
                    probed = probed.reshape(len(part), -1, together)
                    owner, cell = np.nonzero(probed.any(axis=2))
                    yield pa.RecordBatch.from_arrays([ids.slice(i, STEP).take(pa.array(owner)), pa.array(cell.astype(np.int32)), _bytes(probed[owner, cell]), pa.array(floor[owner]), _bytes(part).take(pa.array(owner))], names=["query_id", "cell", "probed", "floor", "query"])

    def compared(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        left = left.sort_values("list", kind="stable")
        ids, lists, codes, off = left["vec_id"].to_numpy(), left["list"].to_numpy(), _matrix(left["codes"].tolist(), np.uint8), left["off"].to_numpy()
        x, q = unit(_matrix(left["raw"].tolist(), form)), unit(_matrix(right["query"].tolist(), form))
        asked, probed = right["query_id"].to_numpy(), _matrix(right["probed"].tolist(), np.bool_)
        floor = right["floor"].to_numpy()
        out = []
        for i in range(0, len(q), STEP):
            by, near, score = sent.value.best(q[i : i + STEP], asked[i : i + STEP], probed[i : i + STEP], x, ids, lists, codes, off, top, floor[i : i + STEP])
            out.append(pd.DataFrame({"query_id": asked[i + by], "vec_id": near, "score": score}))
        return pd.concat(out)

    index = cut(x.mapInArrow(indexed, "vec_id long, cell int, list int, codes binary, off float, raw binary"))
    probes = cut(queries.mapInArrow(probing, "query_id long, cell int, probed binary, floor double, query binary"))
    mean = max(SHARD, 2 * -(-sent.value.total * sent.value.together // len(sent.value.centres)))
    rows = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / mean).cast("int").alias("shards"))
    asked = probes.groupBy(F.col("cell").alias("of")).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    # a row a cell, of which there are MOST_LISTS at most
    sizes = cut(rows.join(asked, F.col("cell") == F.col("of")).select("of", "shards", "blocks"))
    here = lambda: F.broadcast(sizes.select(*[F.col(c).alias(c) for c in sizes.columns]))
    several = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(here(), F.col("cell") == F.col("of")).withColumn("shard", F.pmod(F.xxhash64("vec_id", "raw"), "shards").cast("int")).withColumn("block", several("blocks"))
    right = probes.join(here(), F.col("cell") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("query_id", "query"), "blocks").cast("int")).withColumn("shard", several("shards"))
    keys = ["cell", "shard", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compared, "query_id long, vec_id long, score double")


def _best(found: DataFrame, top: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def search(table: DataFrame, every: int = 50, top: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``."""
    spark = table.sparkSession
    x, form, total = valid(table)
    empty = spark.range(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    if not total:
        return empty
    dims = x.select(F.size("embedding")).first()[0]
    lists = max(1, min(math.isqrt(total), MOST_LISTS, SAMPLE_BYTES // (4 * dims * (FIT + HELD))))
    whole = 1 << 30
    share = min(whole, -(-whole * max(1024, (FIT + HELD) * lists) // total))
    # by id and vector, and each of these once, so that repeated ids or rows do not all come
    rows = x.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(whole)) < share).select("vec_id", "embedding").distinct().toArrow()
    if not len(rows):
        rows = x.select("vec_id", "embedding").limit(1024).toArrow()
    values = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(form, copy=False).reshape(len(rows), -1)
    # an order that does not depend on how the rows came
    order = np.lexsort((*values.T[:2], rows.column("vec_id").to_numpy()))
    model = Index(values[order], lists, top)
    model.keep(values, rows.column("vec_id").to_numpy())
    model.total = total
    # lists that a cell has: all rows may be in fewer lists than there were to be
    model.together = max(1, min(CELL, CELL_VALUES // dims) * len(model.centres) // total)
    sent = spark.sparkContext.broadcast(model)
    queries = x.filter(F.col("vec_id") % every == 0)
    found = cut(_best(_search(x, queries, sent, form, top, False), top))
    if model.probes == len(model.centres):
        return found
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(top, total - 1)).select(F.col("query_id").alias("done"))
    short = cut(queries.join(full, F.col("vec_id") == F.col("done"), "left_anti"))
    if short.isEmpty():
        return found
    again = _best(_search(x, short, sent, form, top, True), top)
    ids = short.select(F.col("vec_id").alias("done")).distinct()
    return found.join(ids, F.col("query_id") == F.col("done"), "left_anti").unionByName(again)
