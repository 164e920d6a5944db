"""One text larger than any slice or block, beside short ones, through every operator on texts."""

import random

import public_tokenizers
import pytest

from gridloom.llm import common, jaccard, lang_id, licenses, lm_scoring, mixing, packing, pii, quality, simhash, substrings

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def made():
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]
    long = " ".join(rng.choices(words, k=1_500_000))
    assert len(long) > max(common.SLICE_BYTES, lm_scoring.BLOCK_BYTES)
    short = " ".join(rng.choices(words, k=80))
    return {1: long, 2: short, 3: f"{short} me@site.org", 4: long[3_000_000:3_002_000]}


@pytest.fixture(scope="module")
def docs(spark, made):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in made.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_counts_and_spans(docs, made):
    q = rows(quality.rules(docs))
    assert {i: r["n_words"] for i, r in q.items()} == {i: len(t.split()) for i, t in made.items()}
    assert {i: r["word_chars"] for i, r in q.items()} == {i: len(t.replace(" ", "")) for i, t in made.items()}
    p = rows(pii.detect(docs))
    assert [p[i]["n_email"] for i in made] == [0, 0, 1, 0] and len(rows(licenses.scan(docs))) == 4


def test_bytes_and_words_that_repeat(docs, made):
    r = rows(substrings.remove_repeats(docs))
    assert {i: x["n_bytes"] for i, x in r.items()} == {i: len(t) for i, t in made.items()}
    assert r[4]["n_removed"] == 2000 and r[1]["n_removed"] == 2000 and r[2]["n_removed"] >= 400
    assert r[2]["passage_words"] == 80 and r[3]["passage_words"] == 80


def test_models(docs, made):
    s = rows(lm_scoring.score(docs))
    assert {i: x["n_tokens"] for i, x in s.items()} == {i: len(t.split()) + 1 for i, t in made.items()} and all(x["score"] < 0 for x in s.values())
    assert {x["lang_pred"] for x in rows(lang_id.identify(docs)).values()} == {"en"}


def test_copies_and_packing(docs, made):
    groups = rows(simhash.near_duplicates(docs))
    assert len(groups) == 4 and groups[1]["component_id"] == 1
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(docs).select("doc_id").collect()) == [1, 2, 4]
    packed = packing.pack(docs, PATH).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096 and set(packed.doc_id) == set(made)
    assert (packed[packed.doc_id == 1].sort_values("piece").length.iloc[:-1] == 4096).all()
    assert mixing.mix(docs).count() == 4
