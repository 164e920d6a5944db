"""Vector best-fit packing of token sequences.

A piece of ``l`` tokens asks for ``l`` tokens, one document and ``l * l`` of
attention cost; a bin has a capacity for each. What a packing looks like
depends only on how many pieces there are of each length, so the plan is made
on the driver from at most ``size`` counts, whatever the number of pieces:
lengths go from long to short, bins in the same state are one group with a
multiplicity, and a group is chosen by the least weighted norm of what would be
left (``rule="norm"``) or the largest weighted dot product of demand and
residual (``rule="dot"``), among those that every constraint admits.

The plan is a list of runs: pieces number r0 to r1 of a length go, k to a bin,
to bins b0, b0 + 1, ... Pieces are numbered within their length in parallel and
find their run by a join.

``pack_mixed`` does so for documents of consecutive positions of a mix at a time.

Defined results: a null or empty text is one piece of the end id alone. A
repeated row is packed as often as it occurs. A null doc_id is kept.
"""

from __future__ import annotations

import zlib
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import mixing
from .common import as_documents, column, cut, mapped, ranked, trimmed

#: Above this many runs the plan is joined by a shuffle instead of a broadcast.
BROADCAST_RUNS = 200_000
#: Sequences' worth of tokens that are packed together along a mixed order.
WINDOW = 64
#: Bytes of text that pack_mixed encodes at once, beside what workers hold from other stages.
SLICE = 2 << 20
#: Words that a worker keeps with their ids, at most.
CACHED = 600_000
#: The mark of a token that ends a run of letters, digits or other characters.
WORD_END = "</w>"
#: Characters after a word that make a run of their own.
MARKS = ".,;:!?#$%&*|"
_ALL_LETTERS = regex.compile(r"\p{L}+")


class Words:
    """Token ids of whole texts, by way of their distinct words.

    White space always ends a token of the tokenizer, so that a text's ids are
    those of its words one after another. Words already met are looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # letters of long standing, which the tokenizer makes letters of too: some become a letter and a mark
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        safe = [c for c in map(chr, range(65, 0x530)) if _ALL_LETTERS.fullmatch(c) and _ALL_LETTERS.fullmatch(normal(c))]
        self.lettered = f"^[{''.join(safe)}]+$"
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.number: dict[bytes, int] = {}
        self.ids, self.held = np.zeros(1 << 16, np.uint32), 0
        self.starts = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int32)

    def _add(self, words: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.held + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.held : self.held + len(flat)] = flat
        self.starts = np.concatenate([self.starts, (self.held + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.held += len(flat)
        self.number.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])

    def _gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, and how many each has."""
        sizes = self.sizes[at].astype(np.int64)
        return self.ids[_ragged(self.starts[at], sizes)], sizes

    def _encode_runs(self, runs: list[bytes]) -> None:
        """Learn runs of letters, which are one run for the tokenizer.

        They are encoded as one text and told apart by the tokens that end a
        run; should their number not be as expected, each is a text.
        """
        for i in range(0, len(runs), 16_384):
            some = runs[i : i + 16_384]
            texts = [w.decode("utf-8", "replace") for w in some]
            flat = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[flat]) + 1
            if len(ends) == len(some):
                self._add(some, flat, np.diff(ends, prepend=0))
            else:
                self._encode_each(some)

    def _encode_each(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 16_384):
            some = words[i : i + 16_384]
            made = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)]
            self._add(some, np.array(list(chain.from_iterable(made)), np.uint32), np.fromiter(map(len, made), np.int64, len(made)))

    def _numbers(self, names: list[bytes], learn) -> np.ndarray:
        """The numbers under which the ids of ``names`` are kept; new ones are learnt."""
        numbers = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        unknown = np.flatnonzero(numbers < 0).tolist()
        if unknown:
            learn(list(dict.fromkeys(names[i] for i in unknown)))
            numbers[unknown] = [self.number[names[i]] for i in unknown]
        return numbers

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and each text's number of ids, its end id included.

        A distinct word of letters and marks after them is the ids of its
        letters in small case and those of its marks; any other word is
        encoded as a whole.
        """
        as_text = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)
        words = pc.ascii_split_whitespace(as_text)
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        before = (len(self.number), len(self.sizes), self.held)
        core = pc.ascii_lower(pc.ascii_rtrim(coded.dictionary, MARKS))
        lettered = pc.match_substring_regex(core, self.lettered).to_numpy(zero_copy_only=False)
        length = lambda x: pc.binary_length(x).to_numpy(zero_copy_only=False)
        raw = lambda x: pa.Array.from_buffers(pa.binary(), len(x), x.buffers(), offset=x.offset).to_pylist()
        parts = np.full((len(core), 2), self._numbers([b""], self._encode_each)[0])
        at, others = np.flatnonzero(lettered), np.flatnonzero(~lettered)
        runs = core.take(pa.array(at)).dictionary_encode()
        parts[at, 0] = self._numbers(raw(runs.dictionary), self._encode_runs)[runs.indices.to_numpy(zero_copy_only=False)]
        parts[others, 0] = self._numbers(raw(coded.dictionary.take(pa.array(others))), self._encode_each)
        sizes = length(core)
        marked = np.flatnonzero(lettered & (length(coded.dictionary) > sizes))
        parts[marked, 1] = self._numbers([w[n:] for w, n in zip(raw(coded.dictionary.take(pa.array(marked))), sizes[marked].tolist(), strict=True)], self._encode_each)
        flat, of_part = self._gathered(parts.ravel())
        of_word = of_part[0::2] + of_part[1::2]
        words_at = coded.indices.to_numpy(zero_copy_only=False)
        ids = flat[_ragged((np.cumsum(of_word) - of_word)[words_at], of_word[words_at])]
        if len(self.number) > CACHED:  # full: what came last is not kept
            for w in list(islice(reversed(self.number), len(self.number) - before[0])):
                del self.number[w]
            self.starts, self.sizes, self.held = self.starts[: before[1]], self.sizes[: before[1]], before[2]
        ends = np.append(0, np.cumsum(of_word[words_at]))[np.cumsum(counts)]
        return np.insert(ids, ends, np.uint32(end)), np.diff(ends, prepend=0) + 1


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` many, one run after another."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


_words: dict[str, Words] = {}


def pieces(docs: DataFrame, path: str, size: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as pieces of at most ``size`` tokens."""

    def run(batch):
        if path not in _words:
            _words.clear()
            _words[path] = Words(path)
        ids, sizes = _words[path].encode(column(batch, "text"), end)
        parts = -(-sizes // size)
        owner = np.repeat(np.arange(len(sizes)), parts)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        length = np.minimum(size, sizes[owner] - piece * size)
        begin = ((np.cumsum(sizes) - sizes)[owner] + piece * size) * 4
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[b : b + 4 * n]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
        trimmed()
        return {"doc_id": column(batch, "doc_id").take(owner), "piece": piece.astype(np.int32), "start": piece * size, "length": length, "ids_crc32": crc}

    return mapped(as_documents(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int, most_docs: int | None = None, most_cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] | None = None) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, r0, r1, b0, k, offset) for ``counts`` pieces of each length."""
    if rule not in ("norm", "dot"):
        raise ValueError(rule)
    most_docs, most_cost = most_docs or size, most_cost or size * size
    caps = np.array([size, most_docs, most_cost], float)
    asked = {n: np.array([n, 1, n * n], float) for n in counts}
    if any((d > caps).any() for d in asked.values()):
        raise ValueError("a piece asks for more than a whole bin has")
    if weights is None:
        # a dimension weighs as its load, the share of its capacity that all pieces together ask for
        load = sum((d * counts[n] for n, d in asked.items()), np.zeros(3)) / caps
        weigh = load / max(load.max(), 1e-300)
    else:
        weigh = np.array(weights, float)
    need_of = {n: np.array([n, 1, n * n], np.int64) for n in counts}
    whole_bin = np.array([size, most_docs, most_cost], np.int64)
    # a row a group of bins in one state: tokens, documents and cost left, first bin, bins, tokens filled
    state, groups, bins, runs = np.zeros((64, 6), np.int64), 0, 0, []
    least = min(counts, default=1)

    def add(left, at, number, filled):
        nonlocal state, groups
        if not number or left[0] < least or left[1] < 1:
            return
        if groups == len(state):
            alive = state[:groups][state[:groups, 4] > 0]
            groups = len(alive)
            state = np.concatenate([alive, np.zeros((groups + 64, 6), np.int64)])
        state[groups] = [*left, at, number, filled]
        groups += 1

    for n in sorted(counts, reverse=True):
        todo, done, need = counts[n], 0, need_of[n]
        while todo:
            fits = np.flatnonzero((state[:groups, 4] > 0) & (state[:groups, :3] >= need).all(axis=1))
            if len(fits):
                left = state[fits, :3] / caps
                score = ((left - need / caps) ** 2) @ weigh if rule == "norm" else -(left @ (weigh * need / caps))
                g = fits[np.argmin(score)]
                have, (at, number, filled) = state[g, :3].copy(), state[g, 3:].tolist()
                state[g, 4] = 0
                k = int((have // need).min())
                take = min(number, -(-todo // k))
            else:
                have, at, filled = whole_bin, bins, 0
                k = int((have // need).min())
                take = number = -(-todo // k)
                bins += number
            some = min(todo, take * k)
            whole, over = divmod(some, k)
            runs.append((n, done, done + some, at, k, filled))
            add(have - k * need, at, whole, filled + k * n)
            add(have - over * need, at + whole, 1 if over else 0, filled + over * n)
            add(have, at + take, number - take, filled)
            done, todo = done + some, todo - some
    return runs


def pack(docs: DataFrame, path: str, size: int = 4096, end: int = 1, most_docs: int | None = None, most_cost: int | None = None, rule: str = "norm") -> DataFrame:
    """pieces() with sequence_id and offset."""
    spark = docs.sparkSession
    made = cut(pieces(docs, path, size, end))
    counts = {r[0]: r[1] for r in made.groupBy("length").count().collect()}  # at most ``size`` rows
    runs = plan(counts, size, most_docs, most_cost, rule)
    table = spark.createDataFrame(runs, "n long, r0 long, r1 long, b0 long, k long, filled long")
    if len(runs) <= BROADCAST_RUNS:
        table = F.broadcast(table)
    placed = ranked(made, ["length"], ["doc_id", "piece"], "rank").join(table, (F.col("length") == F.col("n")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
    nth = F.col("rank") - F.col("r0")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("b0") + F.expr("(rank - r0) div k")).alias("sequence_id"), (F.col("filled") + nth % F.col("k") * F.col("length")).alias("offset"))


def _ahead(df: DataFrame, key: str, n: str) -> DataFrame:
    """``df``, a row a ``key``, with the sum of ``n`` over lesser keys as ``ahead``; far keys are summed by ranges first."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranged = df.withColumn("_range", F.expr(f"{key} div 4096"))
    totals = ranged.groupBy("_range").agg(F.sum(n).alias("_n"))
    totals = totals.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before(Window.orderBy("_range"))), F.lit(0)).alias("_shift"))
    own = F.coalesce(F.sum(n).over(before(Window.partitionBy("_range").orderBy(key))), F.lit(0))
    return ranged.withColumn("_own", own).join(totals, F.col("_range") == F.col("_r")).select(*df.columns, (F.col("_own") + F.col("_shift")).cast("long").alias("ahead"))


def _stand(docs: DataFrame) -> tuple:
    """file and nth: a row's file, or else its partition, and its place there; files and partitions in order."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias("file"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth")
    return F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth")


def _in_place(made: DataFrame) -> DataFrame:
    """``made`` with position, its rows' number over all files."""
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    files = made.groupBy(F.col("file").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    files = files.select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return made.join(files, F.col("file") == F.col("of")).withColumn("position", F.col("nth") + F.col("shift"))


def pack_mixed(docs: DataFrame, path: str, size: int = 4096, end: int = 1, targets: dict[str, float] | None = None, window: int = WINDOW, ordered: bool = False) -> DataFrame:
    """pack() along the mixed order: with each piece's source and its document's position in the mix.

    Documents with consecutive positions, about ``window`` sequences of tokens,
    are packed together; sequences are numbered by window and within it by the
    least position in them, so that over sequence_id sources have their shares.
    ``ordered``: the documents are in the mixed order as they stand, and a
    position is a row's place in them.
    """

    def encoded(batch):
        if path not in _words:
            _words.clear()
            _words[path] = Words(path)
        ids, sizes = _words[path].encode(column(batch, "text"), end)
        raw = memoryview(ids.astype("<u4").tobytes())
        ends = np.cumsum(sizes).tolist()
        crcs = [[zlib.crc32(raw[4 * b : 4 * min(b + size, e)]) for b in range(e - n, e, size)] for e, n in zip(ends, sizes.tolist(), strict=True)]
        trimmed()
        return {"doc_id": column(batch, "doc_id"), "source": column(batch, "source"), "tokens": sizes.astype(np.int64), "crcs": pa.array(crcs, pa.list_(pa.int64()))} | {c: column(batch, c) for c in ("file", "nth") if ordered}

    made = cut(mapped(as_documents(docs, F.col("source").cast("string").alias("source"), *(_stand(docs) if ordered else ())), encoded, f"doc_id long, source string, tokens long, crcs array<long>{', file string, nth long' if ordered else ''}", limit=SLICE))
    # texts stay behind: a document's place depends on where it stands, or on its id and source
    placed = cut((_in_place(made) if ordered else mixing.mix(made, targets)).select("doc_id", "source", "tokens", "crcs", "position", F.expr(f"position div {4 * mixing.BLOCK}").alias("part")))
    parts = _ahead(placed.groupBy("part").agg(F.sum("tokens").alias("n")), "part", "n").select(F.col("part").alias("of"), F.expr(f"ahead div {window * size}").alias("window"))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        tokens = table.column("tokens").to_numpy()
        pieces_of = -(-tokens // size)
        owner = np.repeat(np.arange(len(tokens)), pieces_of)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
        length = np.minimum(size, tokens[owner] - piece * size)
        by = np.argsort(length, kind="stable")  # pieces of a length by position
        lengths, first, counts = np.unique(length[by], return_index=True, return_counts=True)
        at = dict(zip(lengths.tolist(), first.tolist(), strict=True))
        bins, offset = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        for n, r0, r1, b0, k, filled in plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), size):
            rows, nth = by[at[n] + r0 : at[n] + r1], np.arange(r1 - r0)
            bins[rows], offset[rows] = b0 + nth // k, filled + nth % k * n
        _, least, bins = np.unique(bins, return_index=True, return_inverse=True)
        order = np.empty(len(least), np.int64)
        order[np.argsort(least, kind="stable")] = np.arange(len(least))
        return pa.table({
            "window": pa.array(np.full(len(owner), table.column("window")[0].as_py(), np.int64)),
            "doc_id": table.column("doc_id").take(owner),
            "piece": piece.astype(np.int32),
            "start": piece * size,
            "length": length,
            "ids_crc32": pa.array([x for c in table.column("crcs").to_pylist() for x in c], pa.int64()),
            "own": order[bins],
            "offset": offset,
            "source": table.column("source").take(owner),
            "position": table.column("position").take(owner),
        })

    windowed = placed.join(parts, F.col("part") == F.col("of")).select("doc_id", "source", "tokens", "crcs", "position", "window")
    done = cut(windowed.groupBy("window").applyInArrow(packed, "window long, doc_id long, piece int, start long, length long, ids_crc32 long, own long, offset long, source string, position long"))
    shifts = _ahead(done.groupBy("window").agg((F.max("own") + 1).alias("n")), "window", "n").select(F.col("window").alias("of"), "ahead")
    return done.join(shifts, F.col("window") == F.col("of")).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("ahead")).alias("sequence_id"), "offset", "source", "position")
