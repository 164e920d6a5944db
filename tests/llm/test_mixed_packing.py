"""The mix in the pipeline's sequences."""

import random
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import mixing, packing
from gridloom.llm.common import staged
from tests.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_shares_over_sequences_follow_the_weights(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["word"] * r.randint(5, 60)), s) for i, s in enumerate(["a"] * 1500 + ["b"] * 700 + ["c"] * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    targets = {"a": 0.5, "b": 0.3, "c": 0.2}
    made = packing.pack_mixed(docs, PATH, size=64, targets=targets, window=32).collect()
    places = {x["doc_id"]: x["position"] for x in mixing.mix(docs, targets).collect()}
    assert {x["doc_id"]: x["position"] for x in made} == places
    plain = {(x["doc_id"], x["piece"]): (x["start"], x["length"], x["ids_crc32"]) for x in packing.pieces(docs, PATH, 64).collect()}
    assert {(x["doc_id"], x["piece"]): (x["start"], x["length"], x["ids_crc32"]) for x in made} == plain and len(made) == len(plain)
    by_sequence = defaultdict(list)
    for x in made:
        by_sequence[x["sequence_id"]].append(x)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for xs in by_sequence.values():
        xs.sort(key=lambda x: x["offset"])
        assert [x["offset"] for x in xs] == [sum(y["length"] for y in xs[:k]) for k in range(len(xs))] and xs[-1]["offset"] + xs[-1]["length"] <= 64
    # until the first source runs out, any hundred sequences have the sources at their weights
    ends = min(max(x["sequence_id"] for x in made if x["source"] == s) for s in targets) // 100 * 100
    assert ends >= 300
    for low in range(0, ends, 100):
        tokens = Counter()
        for k in range(low, low + 100):
            for x in by_sequence[k]:
                tokens[x["source"]] += x["length"]
        for s, w in targets.items():
            assert abs(tokens[s] / tokens.total() - w) < 0.15


def test_run_follows_the_mix(spark):
    made = corpus_pipeline.run(spark, SF)
    least = [x["p"] for x in made.groupBy("sequence_id").agg(F.min("position").alias("p")).orderBy("sequence_id").collect()]
    assert len(least) > 1 and least == sorted(least)


def test_packing_follows_what_mixing_wrote(spark):
    """Positions are those of the order that the stage before has stored, by files and rows in them, or of the frame it returned."""
    docs = spark.createDataFrame([(i, f"word {i}", "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string").repartition(7)
    in_order = mixing.in_order(docs, targets={"a": 0.9, "b": 0.1}, block=2)
    want = [x["doc_id"] for x in in_order.collect()]
    backwards = docs.repartitionByRange(4, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"))
    for given, ids in ((staged(in_order), want), (in_order, want), (staged(backwards), list(range(299, -1, -1)))):
        made = corpus_pipeline.packed(spark, given, "").orderBy("position").collect()
        assert [x["position"] for x in made] == list(range(300)) and [x["doc_id"] for x in made] == ids


def test_texts_move_twice_in_the_mix(spark):
    """By source and bucket, and by position; the buckets' shifts do not make them move again."""
    docs = spark.createDataFrame([(i, f"word {i}", "ab"[i % 2], i) for i in range(300)], "doc_id long, text string, source string, n long").repartition(7).select("doc_id", F.concat("text", F.lit("!")).alias("text"), "source", "n")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = mixing.in_order(docs)
        plan = made._jdf.queryExecution().executedPlan()
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        said = made._jdf.queryExecution().explainString(mode)
        assert plan.toString().count("Exchange rangepartitioning") == 1
        # the exchanges that have all columns of the documents, and the one that the test itself makes
        wide = [x for x in said.split("\n\n") if ") Exchange\n" in x and "_c1#" in x]
        assert len(wide) == 2
        assert sorted(r["doc_id"] for r in made.collect()) == list(range(300))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
