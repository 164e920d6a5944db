"""Quality rules with suffix-array repetition.

Words of a slice's texts are numbered, a document's end closing every suffix.
Suffixes are sorted by doubling: a round orders the suffixes that still tie by
the rank of what follows, so that texts without long repeats need few rounds
and a text of one word repeated needs a logarithm of its length. Common
prefixes of neighbours come from the rounds' ranks. The interval of suffixes
that share a prefix of ``l`` words stands for a repeated substring; the longest
one at a position is the larger of its two neighbours' prefixes, and these
spans together are the union of all maximal repeats.

A text fails the method's verdict if repeats of ``MIN_WORDS`` words or more
cover over ``MOST_COVERED`` percent of its words or one is longer than
``LONGEST`` words.

Defined results: a null or empty text has no words and fails. Every row gets a
row. All counts are of whole texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import as_documents, column, mapped

MIN_WORDS, MOST_COVERED, LONGEST = 8, 40, 200

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
_NOT_COUNTED = _SPACES + bytes(range(0x80, 0xC0))


def suffix_ranks(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of several texts, and the ranks of prefixes of 1, 2, 4, ... codes.

    ``ends`` has for each position where its text ends; equal codes of
    different texts must differ. A rank is the place of the first suffix that
    shares the prefix.
    """
    n = len(codes)
    kind = np.int32 if n < 1 << 31 else np.int64  # a round's ranks are kept: half the memory matters
    order = np.argsort(codes, kind="stable").astype(kind)
    new = np.ones(n, bool)
    new[1:] = codes[order[1:]] != codes[order[:-1]]
    rank = np.empty(n, kind)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, width = [rank], 1
    while True:
        sorted_rank = rank[order]
        starts = np.flatnonzero(np.diff(sorted_rank, prepend=-1))
        sizes = np.diff(np.append(starts, n))
        tied = np.repeat(sizes > 1, sizes)
        if not tied.any():
            return order, levels
        at = np.flatnonzero(tied)
        active = order[at]
        following = active + width
        second = np.where(following < ends[active], rank[np.minimum(following, n - 1)] + 1, 0)
        first = sorted_rank[at]
        by = np.lexsort((second, first))
        active, second, first = active[by], second[by], first[by]
        order = order.copy()
        order[at] = active
        fresh = np.ones(len(at), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank = rank.copy()
        rank[active] = np.maximum.accumulate(np.where(fresh, at, 0))
        levels.append(rank)
        width *= 2


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix in ``order`` and the one before it."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    same = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[same].astype(np.int64), order[same - 1].astype(np.int64)
    start = a.copy()
    last_a, last_b = ends[a], ends[b]
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < last_a) & (b < last_b)
        equal = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        a += equal << k
        b += equal << k
    out[same] = a - start
    return out


def repeats(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the documents, one after another, the longest repeat that starts there; each document's number of words."""
    counts = np.fromiter(map(len, documents), np.int64, len(documents))
    total = int(counts.sum())
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for d in documents for w in d), np.int64, total)
    codes = np.repeat(np.arange(len(documents)), counts) * (len(number) + 1) + ids
    ends = np.repeat(np.cumsum(counts), counts)
    if not total:
        return ids, counts
    order, levels = suffix_ranks(codes, ends)
    shared = neighbour_prefixes(order, levels, ends)
    longest = np.empty(total, np.int64)
    longest[order] = np.maximum(shared, np.append(shared[1:], 0))
    return longest, counts


def covered(longest: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """Whether each word lies in a repeat of ``least`` words (spans cut to ``most`` words)."""
    start = np.flatnonzero(longest >= least)
    length = longest[start] if most is None else np.minimum(longest[start], most)
    steps = np.zeros(len(longest) + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps[:-1]) > 0


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def rules(docs: DataFrame, min_words: int = MIN_WORDS, most_covered: int = MOST_COVERED, longest_words: int = LONGEST) -> DataFrame:
    """The base measures of each document, its repeats, and the verdict."""

    def run(batch):
        texts = column(batch, "text").to_pylist()
        words = [t.split() for t in texts]
        longest, counts = repeats(words)
        of = np.repeat(np.arange(len(texts)), counts)
        total = lambda flags: np.bincount(of[flags], minlength=len(texts)).astype(np.int64)
        windows = total(covered(longest, 3, 3))
        inside = total(covered(longest, min_words))
        most = np.zeros(len(texts), np.int64)
        np.maximum.at(most, of, longest)
        failed = (counts < 50) | (100 * windows > 50 * counts)
        return {
            "doc_id": column(batch, "doc_id"),
            "n_words": counts,
            "word_chars": [len(t.translate(None, _NOT_COUNTED)) for t in texts],
            "n_symbols": [len(t) - len(t.translate(None, _SYMBOLS)) for t in texts],
            "n_dup_lines": [_repeated_lines(t) for t in texts],
            "n_repeat_words": windows,
            "base_failed": failed,
            "kept": ~failed & (100 * inside <= most_covered * counts) & (most <= longest_words),
            "covered_words": inside,
            "longest_repeat": most,
        }

    return mapped(as_documents(docs), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long", limit=2 << 20)
