"""SimHash near-duplicate detection with bit-sliced comparison.

A text's fingerprint is the majority, bit by bit, of the XXH64 values of its
word shingles. Distinct fingerprints are dealt into buckets by the bits of two
of four equal blocks: two fingerprints within two bits of each other agree on
two blocks at least, so no link is lost. A bucket above ``BUCKET`` is dealt
again by the blocks of its remaining bits, as often as needed, which bounds
every bucket without comparing all pairs of a large group.

Inside a bucket bit planes are stored vertically, 64 fingerprints a word. All
of a word's distances to a fingerprint are updated together by carry-save
counters (ones, twos, more), and a word is abandoned once all its 64 distances
exceed the radius. A bucket returns a star for each set of linked
fingerprints, never all of its pairs.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; fewer words than a shingle make one shingle; repeated rows each get
their row. A null doc_id takes part; a component of nulls alone has a null id.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import as_documents, column, cut, mapped
from .components import components

BUCKET = 256
#: Fingerprints that are compared in one step, of one bucket or more.
TOGETHER = 8192
SEED = 42


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, in small letters."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        return np.array([xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = map(slice, starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), np.uint64, len(found) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of ``hashes``."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes)))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def run(batch):
        made = np.array([majority(shingle_hashes(t, words)) for t in column(batch, "text").to_pylist()], np.uint64)
        return {"doc_id": column(batch, "doc_id"), "fp": pa.array(made.view(np.int64))}

    return mapped(as_documents(docs), run, "doc_id long, fp long")


def _levels():
    """Bit positions by level: 16-bit blocks, then 8-bit, then 4-bit ones of what is left."""
    return (16, 8, 4)


def _dealt(rows: DataFrame, level: int, fixed: str | None) -> DataFrame:
    """(fp, mask, key): one row for every two of the four blocks not yet fixed."""
    size = _levels()[level]
    if fixed is None:
        masks = [sum(((1 << size) - 1) << (size * b) for b in pair) for pair in combinations(range(4), 2)]
        each = F.explode(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks]))
    else:
        each = F.explode(F.col("more"))
    made = rows.withColumn("add", each)
    mask = F.col("add") if fixed is None else F.col("add").bitwiseOR(F.col("mask"))
    return made.select("fp", mask.alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def _further(level: int) -> dict[int, list[int]]:
    """For every mask of ``level``, the masks that fix two more blocks."""
    masks = {0: list(range(64))}
    for k in range(level + 1):
        following = {}
        size = _levels()[k]
        for mask, free in masks.items():
            blocks = [free[i * size : (i + 1) * size] for i in range(4)]
            for pair in combinations(range(4), 2):
                add = sum(1 << b for i in pair for b in blocks[i])
                following[mask | add] = [b for i in range(4) if i not in pair for b in blocks[i]]
        masks = following
    size = _levels()[level + 1]
    return {mask: [sum(1 << b for i in pair for b in free[i * size : (i + 1) * size]) for pair in combinations(range(4), 2)] for mask, free in masks.items()}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(keys: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of rows that link, as stars: rows of one key are one bucket, side by side."""
    n = len(prints)
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, n))
    bucket = np.cumsum(new) - 1
    place = np.arange(n) - first[bucket]
    words = -(-sizes // 64)
    base = np.cumsum(words) - words
    word, lane = base[bucket] + place // 64, (place % 64).astype(np.uint64)
    total = int(words.sum())
    valid = np.zeros(total, np.uint64)
    np.bitwise_or.at(valid, word, np.uint64(1) << lane)
    order = np.argsort(word, kind="stable")
    heads = np.flatnonzero(np.diff(word[order], prepend=-1))
    # each row against each word of its bucket from its own on
    own = place // 64
    reps = words[bucket] - own
    row = np.repeat(np.arange(n), reps)
    at = word[row] + np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
    counters = [np.zeros(len(row), np.uint64) for _ in range(radius)]  # at least 1, 2, ... differing bits
    over = np.zeros(len(row), np.uint64)
    full = ~np.uint64(0)
    for b in range(64):
        bit = (prints >> np.uint64(b)) & np.uint64(1)
        plane = np.bitwise_or.reduceat((bit << lane)[order], heads) if n else valid
        differs = plane[at] ^ (np.uint64(0) - bit)[row]
        for i in range(radius):  # a unary carry-save chain: each counter takes the carry of the one before
            counters[i], differs = counters[i] | differs, counters[i] & differs
        over |= differs
        if b % 16 == 15:
            left = (over | ~valid[at]) != full
            row, at, over = row[left], at[left], over[left]
            counters = [c[left] for c in counters]
            if not len(row):
                break
    near = ~over & valid[at]
    lanes = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(near) else np.zeros((0, 64), np.uint8)
    pair, lane_at = np.nonzero(lanes)
    left, where = row[pair], at[pair]
    right = first[np.searchsorted(base, where, side="right") - 1] + (where - base[np.searchsorted(base, where, side="right") - 1]) * 64 + lane_at
    keep = left < right
    left, right = left[keep], right[keep]
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        if (label == before).all():
            break
    own = np.flatnonzero(label != np.arange(n))
    return np.stack([own, label[own]], axis=1)


def _compared(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) inside the buckets of (fp, mask, key), each of at most 256 fingerprints.

    A bucket is gathered into one row, as repartition() does not hold it together:
    after a join by the same key Spark leaves the dealing out, and reads the join's
    input map by map if the other side turns out small enough to be broadcast.
    """

    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(column(batch, "fps")).to_numpy()
            prints = column(batch, "fps").flatten().to_numpy()
            ends = np.cumsum(sizes)
            begin = 0
            while begin < len(sizes):
                before = int(ends[begin] - sizes[begin])
                end = max(begin + 1, int(np.searchsorted(ends, before + TOGETHER, side="right")))
                made = prints[before : ends[end - 1]]
                pairs = linked(np.repeat(np.arange(end - begin), sizes[begin:end]), made.view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(made[pairs[:, 0]]), pa.array(made[pairs[:, 1]])], names=["a", "b"])
                begin = end

    return rows.groupBy("mask", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps")).select("fps").mapInArrow(run, "a long, b long")


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Star links (a, b) between distinct fingerprints ``fp`` within ``radius`` (at most 2) bits."""
    if not 0 <= radius <= 2:
        raise ValueError("two of four blocks agree only up to a radius of 2")
    rows, level, found = _dealt(prints.select("fp"), 0, None), 0, None
    while True:
        counts = cut(rows.groupBy("mask", "key").count().filter("count > 1").select(F.col("mask").alias("cm"), F.col("key").alias("ck"), "count"))
        met = rows.join(counts, (F.col("mask") == F.col("cm")) & (F.col("key") == F.col("ck")))
        last = level + 1 == len(_levels())
        near = _compared(met if last else met.filter(F.col("count") <= BUCKET), radius)
        found = near if found is None else found.union(near)
        if last or counts.filter(F.col("count") > BUCKET).isEmpty():
            return found
        more = [x for mask, adds in _further(level).items() for x in (F.lit(_signed(mask)), F.array(*[F.lit(_signed(a)) for a in adds]))]
        large = met.filter(F.col("count") > BUCKET).withColumn("more", F.create_map(*more)[F.col("mask")])
        rows, level = cut(_dealt(large, level + 1, "mask").distinct()), level + 1


def _rooted(made: DataFrame, radius: int) -> DataFrame:
    """(fp, root, first): each fingerprint's component and the first document that has it.

    ``first`` orders documents by id, those without one last.
    """
    first = cut(made.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "fp")).alias("first")))
    roots = components(links(first, radius))
    return first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id: one row a document."""
    made = cut(fingerprints(docs, words))
    by_root = _rooted(made, radius)
    of_root = by_root.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least"))
    of_print = cut(by_root.join(of_root, F.col("root") == F.col("r")).select(F.col("fp").alias("print"), F.col("least.doc_id").alias("component_id")))
    return made.join(of_print, F.col("fp") == F.col("print")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
