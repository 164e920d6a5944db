"""Language identification by cross-parsing entropy.

One suffix automaton per language is made from a bounded sample of labelled
text. A text is parsed greedily into the longest phrases that occur in a
language's sample; the language that needs the fewest phrases for its length,
weighted by the logarithm of the sample's length, wins.

The parse runs over all texts of a slice side by side: texts are cut into
segments of ``SEGMENT`` bytes, and one numpy step moves every segment by one
byte. A phrase goes on over a segment's edge: segments are first parsed as if
one began there, then again from the state that the one before ends in, until
both parses are in the same state, which is soon.

The sample has ``DOC_BYTES`` characters from a place in each of its documents
that a hash gives. Languages beyond the ``LANGS`` that most documents have are
not learnt.

Defined results: a null text or one without letters gives ``und`` and score 0,
and so does every text if there is nothing to learn from. Equal costs go to
the smaller language name. Extra columns are ignored, repeated rows each get
their row.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_documents, column, mapped, passed

#: Bounds of the sample that the automata are made from: languages, documents a language,
#: characters of each, bytes a language, bytes of all languages together.
LANGS, SAMPLE_DOCS, DOC_BYTES, LANG_BYTES, ALL_BYTES = 64, 192, 200, 32_000, 320_000
SEGMENT = 512
#: Bits a byte beyond which a text of at least LEAST folded bytes is in none of the languages. Held-out documents take 2 to 5, random letters 9 or more.
MOST_BITS, LEAST = 7.0, 64
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: ASCII capitals become small, all other ASCII characters but letters spaces.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def folded(text: bytes) -> bytes:
    """Lower-case letters and single spaces."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return b" ".join(text.translate(_FOLD).split())


def automaton(text: bytes, classes: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton as a flat table of ``width`` columns.

    An entry is the next state times ``width``. Where the phrase cannot go on,
    it is the state after starting anew with that byte, with the sign bit set.
    The last state is where nothing has begun: before the first byte, and after
    a byte that the sample does not have, which is a phrase of its own.
    """
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in classes[np.frombuffer(text, np.uint8)].tolist():
        state = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = state
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    nothing = len(following) * width
    table = np.zeros((len(following) + 1, width), np.int64)
    for state, ways in enumerate(following):
        for c, to in ways.items():
            table[state, c] = to * width
    again = np.where(table[0] == 0, nothing, table[0]) | (1 << 31)
    flat = np.where(table == 0, again[None, :], table)
    return flat.astype(np.uint32).view(np.int32).ravel()


class Model:
    """The languages' automata, which are small enough to be sent to all tasks."""

    def __init__(self, samples: dict[str, bytes]):
        samples = {k: v for k, v in sorted(samples.items()) if v}
        self.langs = list(samples)
        used = sorted(set(b"".join(samples.values())))
        self.classes = np.zeros(256, np.uint8)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.tables = [automaton(v, self.classes, self.width) for v in samples.values()]
        self.bits = np.array([np.log2(max(2, len(v))) for v in samples.values()])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each folded text, by language."""
        lengths = np.array([len(t) for t in texts], np.int64)
        parts = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        sizes = np.minimum(SEGMENT, lengths[owner] - index * SEGMENT)
        starts = (np.cumsum(lengths) - lengths)[owner] + index * SEGMENT
        order = np.argsort(-sizes, kind="stable")
        owner, sizes, starts = owner[order], sizes[order], starts[order]
        flat = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        steps = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(steps), side="left")
        out = np.zeros((len(self.langs), len(texts)))
        counts = np.zeros((len(self.langs), len(owner)), np.int32)
        states = np.repeat(np.array([[len(t) - self.width] for t in self.tables], np.int32), len(owner), axis=1).reshape(len(self.langs), len(owner))
        for t in range(steps):
            n = active[t]
            at = flat[starts[:n] + t]
            for k, table in enumerate(self.tables):
                to = table.take(states[k, :n] + at)
                counts[k, :n] -= to >> 31
                states[k, :n] = to & 0x7FFFFFFF
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        before, later = np.full(len(order), -1), np.flatnonzero(index > 0)
        before[later] = at[later - 1]  # a text's segments stood one after another
        self._joined(flat, starts, sizes, before[order], states, counts)
        for k in range(len(self.langs)):
            out[k] = np.bincount(owner, counts[k], len(texts))
        return out

    def _joined(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray, states: np.ndarray, counts: np.ndarray) -> None:
        """Correct the counts of segments for the states that the segments ``before`` them end in."""
        for k, table in enumerate(self.tables):
            entered = np.full(len(sizes), len(table) - self.width, np.int32)
            later = np.flatnonzero(before >= 0)
            while True:
                todo = later[states[k, before[later]] != entered[later]]
                if not len(todo):
                    break
                old, new = entered[todo], states[k, before[todo]]
                entered[todo] = new
                run, step = todo, 0
                while True:
                    # a segment that has ended in another state than before changes what follows it
                    over = sizes[run] <= step
                    states[k, run[over]] = new[over]
                    go = ~over & (old != new)
                    run, old, new = run[go], old[go], new[go]
                    if not len(run):
                        break
                    byte = flat[starts[run] + step]
                    a, b = table.take(old + byte), table.take(new + byte)
                    counts[k, run] += (a >> 31) - (b >> 31)
                    old, new = a & 0x7FFFFFFF, b & 0x7FFFFFFF
                    step += 1

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and whether a text may be in its language at all."""
        lettered = [bool(t) and bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in texts]
        plain = [folded(t) if ok else b"" for t, ok in zip(texts, lettered, strict=True)]
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        cost = self.phrases(plain) * self.bits[:, None]
        best = np.argmin(cost, axis=0)
        low = cost[best, np.arange(len(texts))]
        rest = cost.copy()
        rest[best, np.arange(len(texts))] = np.inf
        second = rest.min(axis=0) if len(self.langs) > 1 else np.full(len(texts), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(np.isinf(second), 1.0, 1 - low / second)
        known = np.array(lettered, bool)
        sizes = np.array([len(t) for t in plain], np.int64)
        likely = known & ((sizes < LEAST) | (low <= MOST_BITS * sizes))
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], np.where(known, np.clip(np.nan_to_num(score), 0, 1), 0.0), likely


def held_out():
    """The documents that nothing is learnt from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def fit(docs: DataFrame) -> Model:
    """Make the automata from a sample bounded by the constants above.

    A document is in the sample by a hash of its id and text, at a rate set by
    the number of documents of its language; copies of a row count once.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()}
    if not counts:
        return Model({})
    whole = 1 << 30
    rates = [x for k, n in counts.items() for x in (F.lit(k), F.lit(min(whole, whole * SAMPLE_DOCS // n)))]
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(whole))
    begin = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - DOC_BYTES + 1)).cast("int") + 1
    chosen = labelled.filter((place < F.create_map(*rates)[F.col("lang")]) & F.col("text").isNotNull())
    rows = chosen.select("lang", place.alias("place"), F.substring("text", begin, F.lit(DOC_BYTES)).alias("text")).distinct().collect()
    most = min(LANG_BYTES, ALL_BYTES // len(counts))
    samples: dict[str, bytes] = {}
    for lang, _, text in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        held = samples.get(lang, b"")
        if len(held) < most:
            samples[lang] = (held + b" " + folded(text.encode()))[:most].strip()
    return Model(samples)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row a document."""
    model = model or fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batch):
        langs, score, _ = sent.value.predict(column(batch, "text").to_pylist())
        return {"doc_id": column(batch, "doc_id"), "lang_pred": langs, "score": score}

    found = mapped(as_documents(docs), predict, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents, without those that are in none of the languages.

    These have no letter, or take more than MOST_BITS a byte in every language:
    the phrases times the logarithm of the sample, over the text's length.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    return passed(docs, lambda texts: {"_keep": sent.value.predict(texts)[2].tolist()})
