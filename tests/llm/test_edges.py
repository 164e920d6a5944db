"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and no rows."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import ann, lang_id, licenses, lm_scoring, mixing, packing, pii, quality, simhash, substrings

PATH = public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "identify": lang_id.identify,
    "near_duplicates": simhash.near_duplicates,
    "detect": pii.detect,
    "scan": licenses.scan,
    "rules": quality.rules,
    "remove_repeats": substrings.remove_repeats,
    "score": lm_scoring.score,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(name, edge, nothing):
    made = OPERATORS[name](edge).collect()
    assert sorted(r["doc_id"] or -1 for r in made) == [-1, -1, 1, 1, 2, 3, 4, 5, 6, 7]
    assert OPERATORS[name](nothing).collect() == []


def test_packing_keeps_every_row(edge, nothing):
    made = packing.pack(edge, PATH, size=64).collect()
    assert sorted(r["doc_id"] or -1 for r in made if r["piece"] == 0) == [-1, -1, 1, 1, 2, 3, 4, 5, 6, 7]
    assert packing.pack(nothing, PATH).collect() == []


def test_mixing_keeps_every_row(edge, nothing):
    slim = edge.select("doc_id", "text", "lang", "source", "n_chars")
    made = mixing.mix(slim).collect()
    assert len(made) == 10 and len({r["position"] for r in made}) == 10
    assert mixing.mix(nothing.select("doc_id", "source")).collect() == []
    assert sorted(mixing.in_order(edge).columns) == sorted(edge.columns)


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, edge, nothing, stage):
    name, f = corpus_pipeline.STAGES[stage]
    made = f(spark, edge, "")
    if stage < 4:
        assert made.columns == edge.columns
    # packing: a piece for every row, and more for what the long text has beyond a sequence
    ids = len(Tokenizer.from_file(PATH).encode(edge.filter("doc_id = 5").first()["text"], add_special_tokens=False).ids) + 1
    assert made.count() == {"language": 6, "near_duplicates": 6, "personal_data": 10, "mixing": 10, "packing": 9 + -(-ids // 4096)}[name]
    assert f(spark, nothing, "").count() == 0


def test_vectors_with_clashing_columns_and_repeated_ids(spark):
    """Rows of one id and different vectors are candidates each; equal rows count once; a null id takes no part."""
    schema = "vec_id long, embedding array<float>, list string, shard string, block string, codes string, raw string, query string, of string"
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(120)] + [(3, [9.0, -9.0, 1.0])] * 2 + [(3, [-1.0, 5.0, 2.0]), (None, [1.0, 1.0, 1.0]), (4, None), (5, [])]
    table = spark.createDataFrame([(*r, *["x"] * 7) for r in rows], schema)
    made = ann.search(table).collect()
    assert sorted({r["query_id"] for r in made}) == [0, 50, 100] and len(made) == 15
    assert all(r["query_id"] != r["vec_id"] and r["vec_id"] is not None for r in made)
    assert len({(r["query_id"], r["vec_id"]) for r in made}) == 15
    assert ann.search(table.filter("vec_id is null")).collect() == []


def test_language_of_noise(spark):
    """Text that is cheap in no language goes, clean text stays; a repeated id does not fill the sample."""
    r = random.Random(4)
    words = ["der", "und", "die", "haus", "baum", "wasser", "licht", "stein", "gehen", "sehen"]
    rows = [(None, " ".join(r.choices(words, k=40)), "de") for _ in range(60)]
    noise = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400))
    docs = spark.createDataFrame([*rows, (1, noise, "de"), (2, "kurz", "de")], "doc_id long, text string, lang string")
    model = lang_id.fit(docs.filter("doc_id is null"))
    kept = [x["text"] for x in lang_id.keep_identified(docs, model).collect()]
    assert noise not in kept and len(kept) == 61


def test_phrases_cross_segments(monkeypatch):
    """A long text has as many phrases as a parse from its first byte to its last."""
    model = lang_id.Model({"x": b"the cat sat on the mat and the dog", "y": b"abababab abab ab"})
    r = random.Random(6)
    texts = [lang_id.folded(" ".join(r.choices(["the", "cat", "mat", "abab", "dog sat on", "zz"], k=n)).encode()) for n in (1, 3, 40, 400, 900)] + [b"", b"ab" * 3000]
    monkeypatch.setattr(lang_id, "SEGMENT", 1 << 30)
    want = model.phrases(texts)
    for size in (1, 2, 7, 64, 512):
        monkeypatch.setattr(lang_id, "SEGMENT", size)
        assert (model.phrases(texts) == want).all()
