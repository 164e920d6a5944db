"""One document of each group of near copies, by SimHash and the Jaccard similarity of word shingles.

Fingerprints of ``words``-word shingles are linked by simhash.links(), the
bit-sliced comparison, and texts that they link are candidates. A fingerprint
differs in some ten bits at a similarity of 0.8, and links of that width have no
blocks that would find them all; other candidates come from shared shingles. All
are held against the exact similarity. Two texts are linked if their sets of ``words``-word shingles have a Jaccard
similarity of at least 4/5. No pair is lost: a text's shingles are put in an
order that holds for all texts, rare ones first, and two texts that are linked
share one of the first n - ceil(4 n / 5) + 1 of their n. Texts that share such
a shingle are candidates if their sizes, the shingle's places and the parities
of their shingles' counts in 64 cells allow the similarity, which none of these
rules out wrongly; then the sets themselves are compared. The order is by a
bounded sample's counts, which is a matter of speed and not of results.

Groups are not compared pair by pair: first texts that fingerprints link, as
stars, and each text with the ``NEAR`` next ones of each of its shingles, by size.
In shingles with more texts than that the components found so far are joined by
a few spanning forests of the pairs that parities put closest, and only then all
pairs compared that are still in two components. Sets are compared group by group:
texts that pairs join, up to ``GROUP`` and ``HELD`` shingles, move once to one place;
in larger groups sets are joined to each pair. What a step has shuffled is let go before the
next.

Defined results: a null or empty text, or one of white space, has one empty
shingle and is linked to others like it; fewer words than a shingle make one
shingle; of repeated rows one stays. Texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, deleted, fresh, mapped, released, staged, trimmed
from .components import components
from .simhash import links as linked_prints
from .simhash import majority, shingle_hashes

#: Texts that one is compared with in the first round; of the sample, and common shingles kept of it; pairs made at once;
#: bits of the table of wanted texts.
NEAR, SAMPLE, COMMON, PAIRS, MARKS = 2, 8192, 1 << 16, 1 << 18, 1 << 23
#: Bytes of text that are made into shingles at once.
SLICE = 1 << 20
#: Forests without common edges before all pairs are compared; texts of a bucket above which they are made of the ``BESIDE``
#: next ones in eight orders of the parities.
FORESTS, WIDE, BESIDE = 4, 2048, 32
#: Cells of a text's parities that tell most pairs apart, and finer ones, at least, that what is left is held against.
CELLS, FINE = 512, 2048
#: Texts of a group of candidates that are compared in one place, and their shingles, at most; texts whose groups are sent to all tasks.
GROUP, HELD, SENT = 256, 1 << 20, 1 << 20
_EMPTY = np.zeros(1, np.uint64)


def _key(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key(docs).alias("key"), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("text"))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    made = np.unique(shingle_hashes(text, words))
    return made if len(made) else _EMPTY


def alike(shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether ``shared`` of n and m shingles make a similarity of 4/5."""
    return 9 * shared >= 4 * (n + m)


def _common(keyed: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, in order, and how many have them."""
    total = keyed.count()

    def run(batch):
        made = [shingle_set(t, words) for t in column(batch, "text").to_pylist()]
        return {"h": np.concatenate(made).view(np.int64)}

    some = keyed.filter(F.pmod("key", F.lit(max(1, total // SAMPLE))) == 0).dropDuplicates(["key"])
    counts = mapped(some.select("text"), run, "h long").groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, n = counts.column("h").to_numpy().view(np.uint64), counts.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def parities(hashes: np.ndarray, cells: int) -> bytes:
    """Whether each of ``cells`` cells has an odd number of the hashes; two sets differ in as many members as cells, at least."""
    return np.packbits((np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def fine(hashes: np.ndarray) -> bytes:
    """Parities of ``FINE`` cells, or of as many as there are hashes: fewer would differ in less than a ninth of two long sets, whatever these are."""
    return parities(hashes, max(FINE, 1 << (len(hashes) - 1).bit_length()))


def _firsts(keyed: DataFrame, words: int) -> DataFrame:
    """(token, key, size): the first shingles of each text; size holds the number of shingles and the place."""
    common, often = _common(keyed, words)
    sent = keyed.sparkSession.sparkContext.broadcast((common, often))
    seen: set[int] = set()

    def run(batch):
        common, often = sent.value
        out = []
        for key, text in zip(column(batch, "key").to_pylist(), column(batch, "text").to_pylist(), strict=True):
            if key in seen:  # a copy that this task has had
                continue
            seen.add(key)
            h = shingle_set(text, words)
            n = len(h)
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                count = np.where(common[at] == h, often[at], 0)
                h_first = h[np.argsort(count, kind="stable")] if count.any() else h
            else:
                h_first = h
            h_first = h_first[: n - (4 * n + 4) // 5 + 1]
            out.append((h_first, key, (n << 32) | np.arange(len(h_first))))
        trimmed()
        if not out:
            return None
        sizes = [len(x[0]) for x in out]
        return {
            "token": np.concatenate([x[0] for x in out]).view(np.int64),
            "key": np.repeat(np.array([x[1] for x in out], np.int64), sizes),
            "size": np.concatenate([x[2] for x in out]).astype(np.int64),
        }

    made = mapped(keyed, run, "token long, key long, size long", limit=SLICE)
    many = F.count(F.lit(1)).over(Window.partitionBy("token"))
    return made.withColumn("many", many).filter("many > 1")


def _possible(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether rows a and b may be alike: by sizes and by what follows the shingle they share."""
    n, m = size[a] >> 32, size[b] >> 32
    left = np.minimum(n - (size[a] & 0xFFFFFFFF), m - (size[b] & 0xFFFFFFFF))
    return alike(np.minimum(n, m), n, m) & alike(left, n, m)


def _odd(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many cells rows of parities differ."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _differ(x: pa.Array, y: pa.Array) -> np.ndarray:
    """In how many cells parities differ; of two numbers of cells, powers of two, the larger is folded to the less."""
    n, m = (pc.binary_length(c).to_numpy(zero_copy_only=False) for c in (x, y))
    out = np.zeros(len(n), np.int64)
    for p, q in set(zip(n.tolist(), m.tolist(), strict=True)):
        rows, least = np.flatnonzero((n == p) & (m == q)), min(p, q) // 8
        folded = [np.bitwise_xor.reduce(np.frombuffer(b"".join(c.take(pa.array(rows)).to_pylist()), np.uint64).reshape(len(rows), -1, least), axis=1) for c in (x, y)]
        out[rows] = _odd(*folded)
    return out


def _words_of(cells: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), np.uint64).reshape(-1, width // 64)


def _buckets(batches):
    """Tables of whole buckets, rows of one token side by side."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        token = table.column("token").to_numpy()
        edge = np.flatnonzero(token != token[-1])  # the last bucket may go on in the next batch
        if len(edge):
            yield table.slice(0, int(edge[-1]) + 1)
            held = table.slice(int(edge[-1]) + 1).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _bounds(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bucket's first row and end."""
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    sizes = np.diff(np.append(first, len(token)))
    return np.repeat(first, sizes), np.repeat(first + sizes, sizes)


def _emitted(key, a, b):
    pairs = np.unique(np.stack([np.minimum(key[a], key[b]), np.maximum(key[a], key[b])], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _next_ones(near: int):
    """Candidates among the ``near`` next texts of a bucket."""

    def run(batches):
        for table in _buckets(batches):
            token, key, size = (table.column(c).to_numpy() for c in ("token", "key", "size"))
            new = np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1]))  # copies that other tasks had
            token, key, size = token[new], key[new], size[new]
            _, end = _bounds(token)
            for d in range(1, near + 1):
                a = np.flatnonzero(np.arange(len(token)) + d < end)
                a = a[_possible(a, a + d, size)]
                yield _emitted(key, a, a + d)

    return run


def _forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The edges (x, y) of a spanning forest, by place; earlier ones go first."""
    names, both = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = both[: len(x)], both[len(x) :]
    label, left, chosen = np.arange(len(names)), np.arange(len(x)), []
    while True:
        left = left[label[x[left]] != label[y[left]]]
        if not len(left):
            return np.sort(np.concatenate(chosen)) if chosen else left
        best = np.full(len(names), len(x))
        np.minimum.at(best, label[x[left]], left)
        np.minimum.at(best, label[y[left]], left)
        chosen.append(np.unique(best[best < len(x)]))
        over = np.arange(len(names))
        p, q = label[x[chosen[-1]]], label[y[chosen[-1]]]
        while (over[p] != over[q]).any():
            low = np.minimum(over[p], over[q])
            np.minimum.at(over, over[p], low)
            np.minimum.at(over, over[q], low)
            over = over[over]
        label = over[label]


def _met(table: pa.Table):
    """Rows (a, b) of one bucket and two components: those outside the bucket's largest one with all."""
    root = table.column("root").to_numpy()
    first, end = _bounds(table.column("token").to_numpy())
    outside = np.zeros(len(root), bool)
    for i in np.unique(first).tolist():
        names, counts = np.unique(root[i : end[i]], return_counts=True)
        outside[i : end[i]] = root[i : end[i]] != names[np.argmax(counts)]
    rows = np.flatnonzero(outside)
    reps = (end - first)[rows]
    part = np.cumsum(reps) // PAIRS
    for p in np.unique(part).tolist():
        r, k = rows[part == p], reps[part == p]
        a = np.repeat(r, k)
        b = np.repeat(first[r], k) + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
        keep = root[a] != root[b]
        yield a[keep], b[keep]


def _beside(table: pa.Table, cells: np.ndarray, least: int):
    """_met() for a forest: of a bucket above ``least`` rows the ``BESIDE`` next ones by each eighth of the parities."""
    root = table.column("root").to_numpy()
    first, end = _bounds(table.column("token").to_numpy())
    wide = end - first > least
    for i in np.unique(first[wide]).tolist():
        for c in range(0, cells.shape[1], max(1, cells.shape[1] // 8)):
            order = i + np.argsort(cells[i : end[i], c], kind="stable")
            for d in range(1, BESIDE + 1):
                a, b = order[:-d], order[d:]
                keep = root[a] != root[b]
                yield a[keep], b[keep]
    others = np.flatnonzero(~wide)
    for a, b in _met(table.take(pa.array(others))):
        yield others[a], others[b]


def _across(forests: int, wide: int):
    """Candidates of a bucket from different components: all, or those of so many spanning forests, pairs whose parities differ least first."""

    def run(batches):
        held = np.zeros((0, 4), np.int64)  # the task's forests: keys and roots
        far = np.zeros(0)
        for table in _buckets(batches):
            token, key = table.column("token").to_numpy(), table.column("key").to_numpy()
            table = table.filter(pa.array(np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1]))))
            key, size, root = (table.column(c).to_numpy() for c in ("key", "size", "root"))
            cells = _words_of(table.column("cells"), CELLS)
            for a, b in _beside(table, cells, wide) if forests else _met(table):
                keep = _possible(a, b, size)
                a, b = a[keep], b[keep]
                odd, both = _odd(cells[a], cells[b]), (size[a] >> 32) + (size[b] >> 32)
                keep = 9 * odd <= both
                a, b, share = a[keep], b[keep], odd[keep] / both[keep]
                if not forests:
                    yield _emitted(key, a, b)
                elif len(a):
                    swap = key[a] > key[b]
                    a, b = np.where(swap, b, a), np.where(swap, a, b)
                    edges, by = np.concatenate([held, np.stack([key[a], key[b], root[a], root[b]], axis=1)]), np.append(far, share)
                    order = np.lexsort((edges[:, 1], edges[:, 0], by))
                    order = order[np.append(True, (edges[order[1:], :2] != edges[order[:-1], :2]).any(axis=1))]
                    chosen = []
                    for _ in range(forests):
                        tree = _forest(edges[order, 2], edges[order, 3])
                        chosen.append(order[tree])
                        order = np.delete(order, tree)
                    order = np.concatenate(chosen)
                    held, far = edges[order], by[order]
        if forests:
            yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], names=["a", "b"])

    return run


def _allowed(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs whose finer parities allow the similarity."""

    def apart(batches):
        for batch in batches:
            odd = _differ(column(batch, "ca"), column(batch, "cb"))
            yield batch.select(["a", "b"]).filter(pa.array(9 * odd <= column(batch, "na").to_numpy() + column(batch, "nb").to_numpy()))

    side = lambda x: signed.select(F.col("key").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"c{x}"))
    met = pairs.join(side("a"), F.col("a") == F.col("ka")).join(side("b"), F.col("b") == F.col("kb"))
    return cut(met.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(apart, "a long, b long"))


def _wanted(pairs: DataFrame, keyed: DataFrame, made: Callable[[bytes], object], kind: str) -> DataFrame:
    """(key, value): what ``made`` makes of each text of the pairs, and of some too many; a task has a text once, copies may be in several."""
    # texts are not sent: a table of fixed size tells, with some too many, which are wanted
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select("b"))
    marks = np.zeros(MARKS, bool)
    marks[wanted.select(F.pmod("w", F.lit(MARKS)).cast("int").alias("i")).distinct().toArrow().column("i").to_numpy()] = True
    sent = keyed.sparkSession.sparkContext.broadcast(np.packbits(marks))
    seen: set[int] = set()

    def run(batch):
        keys, texts = column(batch, "key"), column(batch, "text")
        at = keys.to_numpy() % MARKS
        held, values = [], []
        for i in np.flatnonzero(sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).tolist():
            key = keys[i].as_py()
            if key not in seen:
                seen.add(key)
                held.append(key)
                values.append(made(texts[i].as_py()))
        trimmed()
        return {"key": held, "value": values} if held else None

    return mapped(keyed, run, f"key long, value {kind}", limit=SLICE)


def _together(pairs: DataFrame, homes: DataFrame, keyed: DataFrame, words: int) -> DataFrame:
    """_verified() for pairs (root, a, b) of small groups: a group's texts meet in one place and move once, its pairs carry none."""
    few = homes.limit(SENT + 1).count() <= SENT
    texts = _wanted(pairs, keyed, bytes, "binary").join(F.broadcast(homes) if few else homes, F.col("key") == F.col("node"))
    rows = texts.select("root", F.lit(0).alias("kind"), F.col("key").alias("a"), F.lit(None).cast("long").alias("b"), "value")
    rows = rows.union(pairs.select("root", F.lit(1), "a", "b", F.lit(None).cast("binary")))

    def compared(batches):
        at, sets = None, {}
        for batch in batches:
            x, y, texts = [], [], column(batch, "value")
            for i, (root, kind, a, b) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("root", "kind", "a", "b")), strict=True)):
                if root != at:
                    at, sets = root, {}
                if kind:
                    s, t = sets[a], sets[b]
                    if alike(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)):
                        x.append(a)
                        y.append(b)
                elif a not in sets:
                    sets[a] = shingle_set(texts[i].as_py(), words)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])
        trimmed()

    return cut(rows.repartition("root").sortWithinPartitions("root", "kind").mapInArrow(compared, "a long, b long"))


def _apart(pairs: DataFrame, keyed: DataFrame, words: int) -> DataFrame:
    """_verified() for pairs of large groups: sets are joined to each pair, so that no group is one task's."""
    stored = staged(_wanted(pairs, keyed, lambda text: shingle_set(text, words).view(np.int64), "array<long>"))
    made = stored.dropDuplicates(["key"])
    met = pairs.join(made.select(F.col("key").alias("ka"), F.col("value").alias("ha")), F.col("a") == F.col("ka")).join(made.select(F.col("key").alias("kb"), F.col("value").alias("hb")), F.col("b") == F.col("kb"))

    def compared(batches):
        for batch in batches:
            x, y = column(batch, "ha"), column(batch, "hb")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                s, t = x[i].values.to_numpy(), y[i].values.to_numpy()
                keep[i] = alike(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    found = cut(met.select("a", "b", "ha", "hb").mapInArrow(compared, "a long, b long"))
    deleted(stored)
    return found


def _verified(pairs: DataFrame, keyed: DataFrame, signed: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike; those of groups of up to ``GROUP`` texts and ``HELD`` shingles group by group."""
    roots = components(pairs)
    sizes = signed.select(F.col("key").alias("k"), "n")
    small = roots.join(sizes, F.col("node") == F.col("k")).groupBy(F.col("root").alias("r")).agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("load")).filter((F.col("texts") <= GROUP) & (F.col("load") <= HELD))
    homes = cut(roots.join(small, F.col("root") == F.col("r"), "left_semi").select("node", "root"))
    near = cut(pairs.join(homes, F.col("a") == F.col("node")).select("root", "a", "b"))
    far = cut(pairs.join(homes, F.col("a") == F.col("node"), "left_anti").select("a", "b"))
    found = _together(near, homes, keyed, words)
    if not far.isEmpty():
        found = found.union(_apart(far, keyed, words))
    released(keyed.sparkSession)
    return found


def _signed(keyed: DataFrame, words: int) -> DataFrame:
    """(key, fp, n, cells, fine): each text's fingerprint, the number of its shingles, and their parities."""

    def run(batch):
        out = {"key": column(batch, "key"), "fp": [], "n": [], "cells": [], "fine": []}
        for t in column(batch, "text").to_pylist():
            h = shingle_hashes(t, words)
            every = np.unique(h) if len(h) else _EMPTY
            out["fp"].append(majority(h))
            out["n"].append(len(every))
            out["cells"].append(parities(every, CELLS))
            out["fine"].append(fine(every))
        trimmed()
        return out | {"fp": pa.array(np.array(out["fp"], np.uint64).view(np.int64))}

    return cut(mapped(keyed, run, "key long, fp long, n long, cells binary, fine binary", limit=SLICE).dropDuplicates(["key"]))


def _printed(signed: DataFrame, radius: int = 2) -> DataFrame:
    """Candidates (a, b) by SimHash: texts of one fingerprint, and of those that are linked, as stars."""
    first = cut(signed.groupBy("fp").agg(F.min("key").alias("least")))
    of = lambda name: first.select(F.col("fp").alias(f"f{name}"), F.col("least").alias(name))
    same = signed.join(of("b"), F.col("fp") == F.col("fb")).select(F.col("key").alias("a"), "b")
    near = linked_prints(first.select("fp"), radius).toDF("x", "y")
    near = near.join(of("a"), F.col("x") == F.col("fa")).join(of("b"), F.col("y") == F.col("fb")).select("a", "b")
    return same.union(near).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(keyed: DataFrame, words: int = 5) -> DataFrame:
    """(a, b): links that join all texts ``key`` of a component, each between two texts that are alike."""
    signed = _signed(keyed, words)
    dealt = staged(_firsts(keyed, words))
    released(keyed.sparkSession)
    by_size = lambda df, *more: df.withColumn("n", F.shiftright("size", 32)).repartition("token").sortWithinPartitions("token", "n", "key").select("token", "key", "size", *more)
    pairs = cut(by_size(dealt).mapInArrow(_next_ones(NEAR), "a long, b long").union(_printed(signed)).distinct())
    released(keyed.sparkSession)
    found = _verified(_allowed(pairs, signed), keyed, signed, words)
    large = dealt.filter(F.col("many") > NEAR + 1)
    for forests in () if large.isEmpty() else (FORESTS, 0):
        roots = components(found)
        rooted = large.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
        mixed = rooted.groupBy(F.col("token").alias("t")).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
        # components only grow, so that later steps need no other shingles
        large = cut(rooted.join(mixed, F.col("token") == F.col("t"), "left_semi").select("token", "key", "size", "root"))
        celled = large.join(signed.select(F.col("key").alias("k"), "cells"), F.col("key") == F.col("k"))
        others = cut(by_size(celled, "root", "cells").mapInArrow(_across(forests, WIDE), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti"))
        large = large.drop("root")
        released(keyed.sparkSession)
        if not others.isEmpty():
            pairs = pairs.union(others)
            found = found.union(_verified(_allowed(others, signed), keyed, signed, words))
    deleted(dealt)
    return found


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """The documents' columns, for the first document of each component.

    Documents are ordered by id, those without one last. Of rows that share
    that document's id and text one stays.
    """
    own, name, first, mark = (fresh(docs, x) for x in ("_key", "_name", "_first", "_mark"))
    by_text = docs.select("doc_id", _key(docs).alias("key")).groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")).alias("first"))
    roots = components(links(_keyed(docs), words))
    of_root = by_text.join(roots, F.col("key") == F.col("node"), "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("least"))
    # nulls as text, so that rows meet and are told apart under the same two keys
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    kept = cut(of_root.select(named("least.doc_id").alias(first), F.col("least.key").alias(mark)))
    keyed = docs.withColumns({own: _key(docs), name: named("doc_id")})
    one = keyed.join(kept, (F.col(name) == F.col(first)) & (F.col(own) == F.col(mark)), "left_semi")
    return one.dropDuplicates([name, own]).drop(name, own)
