"""The pipeline's near-copy stage against brute force."""

import random
import time

import pytest

import corpus_pipeline
from gridloom.llm import components, jaccard
from tests.conftest import SF


def shingles(text, words=5):
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def brute(rows):
    """Least id of each component of pairs at a similarity of 0.8."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sorted({top(i) for i in ids})


def planted():
    """Near copies with few and many changes, a large group, a chain, a common line, copies, short and empty texts."""
    r = random.Random(3)
    name = lambda: "".join(r.choices("abcdefghij", k=6))
    line = " ".join(name() for _ in range(12))
    out = []
    for _ in range(60):
        base = [name() for _ in range(r.choice((8, 40, 150, 600)))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            new = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                new[r.randrange(len(new))] = name()
            out.append(" ".join(new))
    group = [name() for _ in range(200)]
    for _ in range(40):
        new = list(group)
        for _ in range(r.randint(1, 5)):
            new[r.randrange(200)] = name()
        out.append(" ".join(new))
    chain = [name() for _ in range(100)]
    for i in range(40):
        chain[i * 2 % 100] = name()
        out.append(" ".join(chain))
    out += [f"{line} {' '.join(name() for _ in range(r.randint(1, 9)))}" for _ in range(40)]
    out += [out[0], out[5].upper(), "", None, " \n", "a b", "a b", "A  B", "a b c"]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("near, common", [(8, 1 << 16), (1, 4)])
def test_near_copies_planted(spark, monkeypatch, near, common):
    monkeypatch.setattr(jaccard, "NEAR", near)
    monkeypatch.setattr(jaccard, "COMMON", common)
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    want = brute(rows)
    assert len(want) < len(rows) - 60
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(docs).select("doc_id").collect()) == want


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    made = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in made.collect()) == want


@pytest.mark.parametrize("wide", (16, 1 << 20))
def test_few_pairs_of_a_large_group_meet(spark, monkeypatch, wide):
    """A group in which all texts share shingles and some pairs are alike: sets are compared for a few pairs a text, not for all."""
    met, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "WIDE", wide)
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *more: met.append(pairs.count()) or verified(pairs, *more))
    r = random.Random(8)
    name = lambda: "".join(r.choices("abcdefghij", k=6))
    base, rows = [name() for _ in range(120)], []
    for i in range(400):
        new = list(base)
        for _ in range(r.randint(1, 4)):
            new[r.randrange(120)] = name()
        rows.append((i, " ".join(new)))
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(x["doc_id"] for x in jaccard.one_of_each(docs).collect()) == want
    assert 1 < len(want) < 200 and sum(met) < 10 * len(rows)


def test_few_edges_have_the_same_components(spark, monkeypatch):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    frame = spark.createDataFrame(edges, "x long, y long")
    few = sorted(map(tuple, components.components(frame).collect()))
    monkeypatch.setattr(components, "FEW", 0)
    assert few == sorted(map(tuple, components.components(frame).collect())) and len(few) > 100


def moved(spark):
    """Bytes that have been shuffled so far."""
    time.sleep(1)
    found = spark._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.mark.parametrize("group", (256, 2))
def test_pairs_carry_no_sets(spark, monkeypatch, group):
    """Groups of texts that all meet are compared in one place: a text moves once, however many pairs it is in."""
    monkeypatch.setattr(jaccard, "GROUP", group)
    r = random.Random(11)
    name = lambda: "".join(r.choices("abcdefghij", k=4))
    rows = []
    for g in range(30):
        base = [name() for _ in range(1500)]
        for k in range(6):
            new = list(base)
            for _ in range(6 if k % 2 else 40):
                new[r.randrange(1500)] = name()
            rows.append((6 * g + k, " ".join(new)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = jaccard._keyed(docs).localCheckpoint()
    signed = jaccard._signed(keyed, 5)
    key = {x["text"].decode(): x["key"] for x in keyed.collect()}
    sets = {key[t]: shingles(t) for _, t in rows}
    pairs = [tuple(sorted((key[rows[i][1]], key[rows[j][1]]))) for i in range(len(rows)) for j in range(i // 6 * 6, i)]
    want = sorted((a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    before, size = moved(spark), 8 * sum(map(len, sets.values()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sets would be sent to all tasks instead
    try:
        links = jaccard._verified(spark.createDataFrame(pairs, "a long, b long"), keyed, signed, 5)
        assert sorted(map(tuple, links.collect())) == want and 30 < len(want) < len(pairs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    if group > 6:
        assert moved(spark) - before < 1.5 * size


def test_parities_tell_long_texts_apart(spark):
    """Long texts that share a passage and no more are not held against whole sets; alike ones of other numbers of cells are."""
    r = random.Random(12)
    name = lambda: "".join(r.choices("abcdefghij", k=6))
    line = [name() for _ in range(30)]
    texts = [" ".join(line + [name() for _ in range(6000)]) for _ in range(12)]
    texts += [" ".join(texts[i].split() + [name() for _ in range(n)]) for i, n in ((0, 50), (1, 900), (2, 2300))]
    long = " ".join(name() for _ in range(4090))
    texts += [long, f"{long} {' '.join(name() for _ in range(400))}"]  # 4096 cells and 8192
    keyed = jaccard._keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).localCheckpoint()
    signed = jaccard._signed(keyed, 5)
    keys = [{x["text"].decode(): x["key"] for x in keyed.collect()}[t] for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    sets = [shingles(t) for t in texts]
    alike = {(keys[i], keys[j]) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    left = set(map(tuple, jaccard._allowed(spark.createDataFrame([(keys[i], keys[j]) for i, j in pairs], "a long, b long"), signed).collect()))
    assert len(alike) == 3 and alike <= left and len(left) <= 5
