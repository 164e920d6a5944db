"""Exact removal of long byte strings that occur elsewhere, by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else in the table. Strings to compare are found by anchors: of all ``GRAM``-byte
grams in a window of LENGTH bytes, the one with the least hash. Equal windows
have equal anchors at equal places, so only windows whose anchor occurs more
than once have to meet. Neighbouring windows with one anchor form a run.

* Equal runs are counted by 64 bits of a digest beside the 64 of their anchor: all
  windows of a run that occurs twice are repeated, and nothing else of it has to be sent.
* Runs that share an anchor without being equal meet, one of each, and are cut
  into pieces of ``PIECE`` windows, by place from the anchor. The bytes that
  all windows of a piece have in common are its core; pieces whose core occurs
  once are done, and so are equal pieces.
* What is left is sorted in suffix arrays: two-stage sorting directly sorts
  only the suffixes smaller than their successors and induces the rest by
  scanning buckets; windows whose common prefix with a neighbour has LENGTH
  bytes are repeated.
* An anchor with more than ``TOGETHER`` different runs is never gathered: its
  pieces are counted by digests, those with one core meet as above, and where
  even a core has more than TOGETHER pieces, its windows are counted.

Texts travel compressed, and only to be joined by their digest.

Passages are found in the same way: a text's words, each as a number of 32
bits, are a string in which a passage of over 50 words that occurs elsewhere is
a repeated window of ``WORDS`` numbers. They are reported and not removed.
Windows and places then count words; where strings meet in a suffix array, the
numbers that occur there are named anew by one byte, or two or more if there
are so many.

Defined results: a null or empty text has no bytes, no spans and no passages;
repeated rows count as copies of each other; matches never cross rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import as_documents, column, cut, deleted, mapped, released, staged

LENGTH, GRAM, PIECE, TOGETHER = 400, 32, 32, 256
#: Words of a passage, at least, and of the grams among which its anchor is.
WORDS, WORD_GRAM = 51, 8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SIZE_BITS = 28


def _digest(data: bytes) -> bytes:
    return xxh3_128_digest(data)


def name_of(doc_id: int | None, text: bytes) -> int:
    """A signed 64-bit digest of a document's id and text, which names the text wherever its rows go."""
    return int.from_bytes(xxh3_128_digest(text + (b"" if doc_id is None else doc_id.to_bytes(8, "little", signed=True)))[:8], "little", signed=True)


def gram_hashes(text: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` symbols."""
    n = len(text)
    up = np.cumprod(np.full(n, _BASE, np.uint64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[width:] - sums[:-width]) * np.cumprod(np.full(n - width + 1, _BACK, np.uint64))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(text: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of symbols with one anchor: first and last window, the anchor's place and hash."""
    n, wide = len(text), length - gram + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if n >> _SIZE_BITS:
        # runs of parts that overlap by a window less a byte, one after another
        step, parts = (1 << _SIZE_BITS) - length, []
        for at in range(0, n - length + 1, step):
            first, last, place, h = anchors(text[at : min(n, at + step + length - 1)], length, gram)
            parts.append((first + at, last + at, place + at, h))
        first, last, place, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        new = np.append(True, place[1:] != place[:-1])
        return first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(last) - 1)], place[new], h[new]
    h = gram_hashes(text, gram)
    key = (h & ~np.uint64((1 << _SIZE_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(key) // wide)
    grid = np.full(rows * wide, ~np.uint64(0))
    grid[: len(key)] = key
    grid = grid.reshape(rows, wide)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    windows = n - length + 1
    place = (np.minimum(ahead[:windows], behind[wide - 1 : wide - 1 + windows]) & np.uint64((1 << _SIZE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return first, np.append(first[1:], windows) - 1, place[first], h[place[first]]


def two_stage(text: np.ndarray, owner: np.ndarray, windows: np.ndarray | None = None) -> np.ndarray:
    """The order of suffixes of several texts laid end to end; a text's end closes its suffixes.

    With ``windows``, only that many suffixes from each text's start on are
    wanted, and those after them up to the next of type B, from which the
    wanted ones can be induced.

    A suffix is of type B if it is smaller than its successor, the suffix one
    byte on in the same text, and of type A otherwise. B suffixes are sorted
    directly. Buckets by first byte are then scanned upwards: each suffix that
    is met puts its predecessor, if of type A, at the next free place of the
    predecessor's bucket; A suffixes stand before B suffixes there.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    closes = np.zeros(n, bool)
    closes[ends] = True
    following = np.append(text[1:], 0).astype(np.int16)
    following[ends] = -1
    equal = following == text
    # a run of equal bytes has the type of its last byte
    last = np.where(~equal, np.arange(n), n)
    last = np.minimum.accumulate(last[::-1])[::-1]
    is_b = (text.astype(np.int16) < following)[last]
    member = np.ones(n, bool)
    if windows is not None:
        starts = np.append(0, ends[:-1] + 1)
        following_b = np.where(is_b | closes, np.arange(n), n)
        following_b = np.minimum.accumulate(following_b[::-1])[::-1]
        wanted = windows > 0
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, starts[wanted], 1)
        np.add.at(steps, following_b[starts[wanted] + windows[wanted] - 1] + 1, -1)
        member = np.cumsum(steps[:-1]) > 0
    raw = text.tobytes()
    stop = (ends + 1)[owner - owner[0]] if len(ends) == owner[-1] - owner[0] + 1 else np.repeat(ends + 1, np.diff(np.append(-1, ends)))
    direct = np.flatnonzero(is_b & member)
    tails = {int(i): raw[i:e] for i, e in zip(direct.tolist(), stop[direct].tolist(), strict=True)}
    b_order = np.array(sorted(direct.tolist(), key=tails.__getitem__), np.int64)
    b_bucket = np.split(b_order, np.searchsorted(text[b_order], np.arange(1, 256)))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    # suffixes of one byte precede all others of their bucket
    closing = ends[member[ends]]
    for c in np.unique(text[closing]).tolist():
        waiting[c].append(closing[text[closing] == c])
    out = []
    first = np.append(True, closes[:-1])  # a text's first suffix has no predecessor

    def induced(of: np.ndarray) -> np.ndarray:
        before = of[~first[of]] - 1
        return before[~is_b[before]]

    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        own = []
        while len(wave):
            own.append(wave)
            made = induced(wave)
            wave = made[text[made] == c]
        bucket = np.concatenate([*own, b_bucket[c]])
        out.append(bucket)
        made = induced(bucket)
        made = made[text[made] > c]
        if len(made):
            by = made[np.argsort(text[made], kind="stable")]
            for part in np.split(by, np.flatnonzero(np.diff(text[by])) + 1):
                waiting[int(text[part[0]])].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    """The common prefix, up to ``most``, of each suffix in ``order`` and the one before; ``left``: bytes to its text's end."""
    out = np.zeros(len(order), np.int64)
    padded = np.append(text, np.zeros(most, np.uint8))
    at = np.arange(1, len(order))
    done = 0
    while len(at) and done < most:
        step = min(32, most - done)
        a, b = order[at] + done, order[at - 1] + done
        same = padded[a[:, None] + np.arange(step)] == padded[b[:, None] + np.arange(step)]
        run = np.where(same.all(axis=1), step, np.argmin(same, axis=1))
        out[at] += run
        at = at[run == step]
        done += step
    return np.minimum(out, np.minimum(left[order], np.append(0, left[order[:-1]])) if len(order) else out)


def _renamed(text: np.ndarray) -> np.ndarray:
    """Numbers as rows of bytes: their rank among those that occur, in as few bytes as that takes."""
    kinds, rank = np.unique(text, return_inverse=True)
    size = max(1, -(-max(1, len(kinds) - 1).bit_length() // 8))
    return rank.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - size :]


def repeated_windows(pieces: list[bytes], length: int = LENGTH, width: int = 1) -> list[np.ndarray]:
    """For each piece of symbols of ``width`` bytes, which of its windows occur in another piece or place."""
    counts = np.array([len(p) // width for p in pieces], np.int64)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    if width > 1:
        made = _renamed(text.view("<u4"))
        text, width = made.ravel(), made.shape[1]
    sizes = counts * width
    owner = np.repeat(np.arange(len(pieces)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
    order = two_stage(text, owner, np.where(counts >= length, (counts - length) * width + 1, 0))
    if width > 1:  # only suffixes that begin with a symbol count
        order = order[(order - (np.cumsum(sizes) - sizes)[owner[order]]) % width == 0]
    shared = common_prefixes(text, order, left, length * width) >= length * width
    hit = np.zeros(len(text), bool)
    hit[order[shared]] = True
    hit[order[np.flatnonzero(shared) - 1]] = True
    starts = np.cumsum(sizes) - sizes
    return [hit[s : s + max(0, n - length + 1) * width : width] for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of true flags."""
    edges = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def _cut_up(low: int, high: int):
    """Pieces (number, low, high) of the windows low to high."""
    for k in range(low // PIECE, high // PIECE + 1):
        yield k, max(low, k * PIECE), min(high, k * PIECE + PIECE - 1)


def _core(data: bytes, base: int, k: int, length: int, width: int) -> bytes:
    """What all windows of piece ``k`` have in common; ``data`` begins at window ``base``."""
    return data[(k * PIECE + PIECE - 1 - base) * width : (k * PIECE + length - base) * width]


def _runs(docs: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """name, anchor, run (64 bits of its digest: with the anchor it names the run) and place of each run of a text.

    The place is the first window, and by bits the first and last window by
    place from the anchor, which the digest knows too.
    """
    given = "packed" in docs.columns

    def run(batch):
        owner, rows = [], []
        names = column(batch, "name").to_pylist() if given else column(batch, "doc_id").to_pylist()
        for i, t in enumerate(column(batch, "packed" if given else "text").to_pylist()):
            t = zstandard.ZstdDecompressor().decompress(t) if given else t
            first, last, place, h = anchors(np.frombuffer(t, np.uint8 if width == 1 else "<u4"), length, gram)
            if len(first):
                owner.append(np.full(len(first), names[i] if given else name_of(names[i], t), np.int64))
                low = first - place
                runs = b"".join(_digest(t[a * width : (b + length) * width] + x.to_bytes(8, "little", signed=True))[:8] for a, b, x in zip(first.tolist(), last.tolist(), low.tolist(), strict=True))
                rows.append((h.view(np.int64), np.frombuffer(runs, np.int64), (first << 32) | ((low + 32768) << 16) | (last - place + 32768)))
        if not rows:
            return None
        h, runs, place = (np.concatenate(x) for x in zip(*rows, strict=True))
        return {"name": np.concatenate(owner), "anchor": h, "run": runs, "place": place}

    return mapped(docs, run, "name long, anchor long, run long, place long", column="packed" if given else "text")


def _fetched(texts: DataFrame, length: int, width: int) -> DataFrame:
    """(anchor, kinds, run, low, high, data): the bytes of the runs wanted of each text."""

    def run(batch):
        out = {k: [] for k in ("anchor", "kinds", "run", "low", "high", "data")}
        for packed, wanted in zip(column(batch, "text").to_pylist(), column(batch, "wanted").to_pylist(), strict=True):
            t = zstandard.ZstdDecompressor().decompress(packed)
            for w in wanted:
                for k in out:
                    if k != "data":
                        out[k].append(w[k])
                out["data"].append(t[w["at"] * width : (w["at"] + w["high"] - w["low"] + length) * width])
        return out

    return mapped(texts, run, "anchor long, kinds long, run long, low int, high int, data binary", limit=1 << 20)


def _meeting(rows: list[tuple[object, int, int, bytes]], length: int, width: int) -> list[tuple[int, int, int]]:
    """Stretches (row, low, high) of windows that rows (group, low, high, data) of one group share."""
    cores: dict[tuple, dict[tuple, list[int]]] = {}
    for n, (group, low, high, data) in enumerate(rows):
        for k, a, b in _cut_up(low, high):
            cores.setdefault((group, k, _core(data, low, k, length, width)), {}).setdefault((a, data[(a - low) * width : (b - low + length) * width]), []).append(n)
    out, left = [], []
    for forms in cores.values():
        for (a, data), owners in forms.items():
            if len(owners) > 1:
                out += [(n, a, a + len(data) // width - length) for n in owners]
            if len(forms) > 1:
                left.append((a, data, owners))
    for (a, _, owners), hit in zip(left, repeated_windows([x[1] for x in left], length, width), strict=True):
        for x, y in zip(*(v.tolist() for v in _ranges(hit)), strict=True):
            out += [(n, a + x, a + y) for n in owners]
    return out


def _compared(rows: DataFrame, group: str, length: int, width: int) -> DataFrame:
    """(run, low, high): stretches of repeated windows among the rows of each group (at most TOGETHER rows)."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def emit(table):
            ids = table.column("run").to_pylist()
            found = _meeting(list(zip(*(table.column(c).to_pylist() for c in ("group", "low", "high", "data")), strict=True)), length, width)
            return pa.RecordBatch.from_arrays([pa.array([ids[n] for n, _, _ in found], pa.int64()), pa.array([a for _, a, _ in found], pa.int32()), pa.array([b for _, _, b in found], pa.int32())], names=["run", "low", "high"])

        # a group's rows are side by side; a suffix array takes some hundred rows, of one group or more
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            if len(table) < 2 * TOGETHER:
                continue
            of = table.column("group").to_pylist()
            begin = 0
            for e in [i for i in range(1, len(of)) if of[i] != of[i - 1]]:
                if e - begin >= TOGETHER:
                    yield emit(table.slice(begin, e - begin))
                    begin = e
            held = table.slice(begin).to_batches()
        if held:
            yield emit(pa.Table.from_batches(held))

    return rows.select(F.col(group).alias("group"), "run", "low", "high", "data").repartition("group").sortWithinPartitions("group").mapInArrow(run, "run long, low int, high int")


def _pieces(rows: DataFrame, length: int, width: int) -> DataFrame:
    """(run, low, high, core, same): the pieces of runs, with digests of their core and of all of them."""

    def run(batch):
        out = {k: [] for k in ("run", "low", "high", "core", "same")}
        for name, low, high, data in zip(*(column(batch, c).to_pylist() for c in ("run", "low", "high", "data")), strict=True):
            for k, a, b in _cut_up(low, high):
                for key, value in zip(out, (name, a, b, _digest(_core(data, low, k, length, width) + k.to_bytes(8, "little", signed=True)), _digest(data[(a - low) * width : (b - low + length) * width] + a.to_bytes(8, "little", signed=True))), strict=True):
                    out[key].append(value)
        return out

    return mapped(rows, run, "run long, low int, high int, core binary, same binary", column="data")


def _windows(rows: DataFrame, length: int, width: int) -> DataFrame:
    """(window, run, low): each window of the rows by digest."""

    def run(batch):
        out = {"window": [], "run": [], "low": []}
        for name, low, data in zip(*(column(batch, c).to_pylist() for c in ("run", "low", "data")), strict=True):
            for k in range(len(data) // width - length + 1):
                out["window"].append(_digest(data[k * width : (k + length) * width]))
                out["run"].append(name)
                out["low"].append(low + k)
        return out

    return mapped(rows.select("run", "low", "data"), run, "window binary, run long, low int", column="data")


def _large(rows: DataFrame, length: int, width: int) -> DataFrame:
    """(run, low, high) for anchors with more than TOGETHER runs, without gathering any."""
    pieces = cut(_pieces(rows, length, width))
    same = cut(pieces.groupBy("core", "same").agg(F.count(F.lit(1)).alias("times"), F.min("run").alias("least")).select(F.col("core").alias("c"), F.col("same").alias("s"), "times", "least"))
    cores = cut(same.groupBy("c").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1").withColumnRenamed("c", "cc"))
    counted = pieces.join(same, (F.col("core") == F.col("c")) & (F.col("same") == F.col("s")))
    equal = counted.filter("times > 1").select("run", "low", "high")
    # one of equal pieces stands for them: equal ones are repeated as a whole, whatever it meets
    left = cut(counted.filter(F.col("run") == F.col("least")).join(cores, F.col("core") == F.col("cc")).select(F.col("run").alias("of"), F.col("low").alias("a"), F.col("high").alias("b"), "core", "forms"))
    data = rows.join(left, F.col("run") == F.col("of")).select("run", F.col("a").alias("low"), F.col("b").alias("high"), "core", "forms", F.expr(f"substring(data, (a - low) * {width} + 1, (b - a + {length}) * {width})").alias("data"))
    single = cut(_windows(data.filter(F.col("forms") > TOGETHER), length, width))
    twice = cut(single.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("window").alias("w")))
    return equal.union(_compared(data.filter(F.col("forms") <= TOGETHER), "core", length, width)).union(single.join(twice, F.col("window") == F.col("w")).select("run", "low", F.col("low").alias("high")))


def repeated(docs: DataFrame, packed: DataFrame, length: int = LENGTH, gram: int = GRAM, width: int = 1) -> DataFrame:
    """(name, first, last): stretches of windows that occur elsewhere.

    ``docs`` has doc_id and text (bytes), or is ``packed``, which has name and
    packed (the bytes, compressed). Symbols have ``width`` bytes, 1 or 4.
    """
    if not 0 < length - gram < 32768:
        raise ValueError(f"windows of {length} and grams of {gram} have no places of 16 bits")
    spark = docs.sparkSession
    every = staged(_runs(docs, length, gram, width))
    # anchors that occur once, four in five, go before anything else is done with their runs
    # (stored, so that rows meet them in a join that Spark can split for an anchor with very many)
    shared = cut(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("anchor").alias("of")))
    runs = staged(every.join(shared, F.col("anchor") == F.col("of"), "left_semi"))
    deleted(every)
    released(spark)
    # run and anchor name a run; from here on one number does
    runs = runs.select("name", "anchor", F.xxhash64("anchor", "run").alias("run"), F.shiftright("place", 32).alias("at"), *[(F.shiftright("place", k).bitwiseAND(65535) - 32768).cast("int").alias(c) for c, k in (("low", 16), ("high", 0))])
    # a row of those that share a run stands for them: the first of all its columns, which come together
    one = [F.first(c).alias(c) for c in ("name", "at", "low", "high")]
    by_run = runs.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("n"), *one)
    by_anchor = by_run.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select(F.col("anchor").alias("of"), "kinds")
    kept = cut(by_run.join(by_anchor, F.col("anchor") == F.col("of"), "left").drop("of"))
    whole = kept.filter("n > 1").select("run", "low", "high")
    wanted = kept.filter("kinds > 1").groupBy(F.col("name").alias("want")).agg(F.collect_list(F.struct("at", "low", "high", "anchor", "kinds", "run")).alias("wanted"))
    data = cut(_fetched(packed.join(wanted, F.col("name") == F.col("want")).select(F.col("packed").alias("text"), "wanted"), length, width))
    released(spark)
    met = _compared(data.filter(F.col("kinds") <= TOGETHER), "anchor", length, width)
    large = data.filter(F.col("kinds") > TOGETHER)
    if not large.isEmpty():
        met = met.union(_large(large, length, width))
    hits = cut(whole.union(met).groupBy("run").agg(F.collect_set(F.struct("low", "high")).alias("hits")).withColumnRenamed("run", "r"))
    placed = runs.join(hits, F.col("run") == F.col("r")).select("name", "at", F.col("low").alias("base"), F.explode("hits").alias("h"))
    found = cut(placed.select("name", (F.col("at") + F.col("h.low") - F.col("base")).alias("first"), (F.col("at") + F.col("h.high") - F.col("base")).alias("last")).distinct())
    for stage in runs.inputFiles()[:1]:
        deleted(spark.read.parquet(stage))
    released(spark)
    return found


def word_numbers(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's words, as 32 bits of their hash."""
    text = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = (text == 32) | ((text >= 9) & (text <= 13))
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    ends = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
    # hashes of any width from running sums, shifted back by the powers before them
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * np.cumprod(np.full(len(text), _BASE, np.uint64)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * np.cumprod(np.full(len(text), _BACK, np.uint64))[starts]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    marks = (h >> np.uint64(32)).astype("<u4")
    edges = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts])).tolist()
    return [marks[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(name, first, last): stretches of windows of ``words`` words that occur elsewhere; ``docs`` as for repeated()."""

    def run(batch):
        ids, values = column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()
        long = [(i, m.tobytes()) for i, m in enumerate(word_numbers(values)) if len(m) >= words]
        if not long:
            return None
        pack = zstandard.ZstdCompressor(level=1)
        return {"name": [name_of(ids[i], values[i]) for i, _ in long], "packed": [pack.compress(m) for _, m in long]}

    marked = staged(mapped(docs, run, "name long, packed binary", limit=1 << 20))
    found = repeated(marked, marked, words, WORD_GRAM, 4)
    deleted(marked)
    return found


def _covered(first: np.ndarray, last: np.ndarray, size: int, width: int) -> np.ndarray:
    """Which of ``size`` symbols the windows of ``width`` from first to last cover."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, last + width, -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage_words (and the text that is left).

    passage_words: words in passages of over 50 words that occur elsewhere,
    whether or not their bytes are long enough to be removed.
    """

    def packing(batch):
        ids, values = column(batch, "doc_id"), column(batch, "text").to_pylist()
        pack = zstandard.ZstdCompressor(level=3)
        return {"doc_id": ids, "name": [name_of(i, t) for i, t in zip(ids.to_pylist(), values, strict=True)], "packed": [pack.compress(t) for t in values]}

    plain = as_documents(docs)
    packed = mapped(plain, packing, "doc_id long, name long, packed binary")
    kinds = [passages(plain).withColumn("words", F.lit(True)), repeated(plain, packed, length).withColumn("words", F.lit(False))]
    spans = kinds[0].union(kinds[1]).groupBy(F.col("name").alias("of")).agg(F.collect_list(F.struct("words", "first", "last")).alias("spans"))
    joined = packed.join(cut(spans), F.col("name") == F.col("of"), "left").select("doc_id", "packed", "spans")

    def removing(batch):
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_words", "text")}
        spans = column(batch, "spans")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)).tolist()
        flat = spans.flatten()
        words, first, last = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("words", "first", "last"))
        begin, open_ = 0, zstandard.ZstdDecompressor()
        for raw, end in zip(column(batch, "packed").to_pylist(), ends, strict=True):
            t = open_.decompress(raw)
            told, byte = words[begin:end].astype(bool), slice(begin, end)
            a, b = first[byte], last[byte]
            begin, gone, inside, kept, runs = end, 0, 0, t, 0
            if told.any():
                inside = int(_covered(a[told], b[told], int(b[told].max()) + WORDS, WORDS).sum())
            if len(told) and not told.all():
                flags = _covered(a[~told], b[~told], len(t), length)
                gone, runs, kept = int(flags.sum()), len(_ranges(flags)[0]), np.frombuffer(t, np.uint8)[~flags].tobytes()
            for k, v in zip(out, (len(t), gone, runs, hashlib.sha256(kept).hexdigest(), inside, kept.decode("utf-8", "ignore") if texts else None), strict=True):
                out[k].append(v)
        return out | {"doc_id": column(batch, "doc_id")}

    made = mapped(joined, removing, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_words long, text string", column="packed")
    return made if texts else made.drop("text")
