"""Percentiles of large and small groups, spaced selection and batches against plain code."""

import math
import random

import numpy as np

from gridloom.functions import imagery
from gridloom.operators import neighbours, selection


def test_exact_percentile(spark):
    rng = np.random.default_rng(2)
    groups = {f"g{n}": rng.normal(size=n).round(int(d)) for n, d in ((1, 3), (2, 3), (3, 0), (16, 5), (17, 1), (400, 0), (30_000, 9), (30_000 + 1, 2))}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("g16", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(5)
    for q in (0.0, 0.05, 0.5, 0.6, 0.95, 1.0):
        made = {r["g"]: r["threshold"] for r in neighbours.exact_percentile(df, q, ("g",)).collect()}
        assert made.keys() == {*groups, None} and made[None] == 4.0
        for g, vs in groups.items():
            assert math.isclose(made[g], float(np.percentile(vs, 100 * q)), rel_tol=1e-12, abs_tol=1e-12), (g, q)


def walked(points, distance, keep):
    taken = []
    for p in points:
        if len(taken) < keep and all(math.hypot(p[1] - t[1], p[2] - t[2]) >= distance for t in taken):
            taken.append(p)
    return taken


def test_spaced_in_rounds(spark, monkeypatch):
    """However few candidates are gone through at once, the choice is that of one walk in order."""
    rng = random.Random(5)
    rows = [(g, rng.random(), rng.uniform(-9, 9), rng.uniform(-9, 9)) for g in "ab" for _ in range(300)]
    df = spark.createDataFrame(rows, "region string, score double, lat double, lon double")
    want = {g: walked(sorted([r[1:] for r in rows if r[0] == g], key=lambda r: (-r[0], -r[1], r[2])), 3.0, 12) for g in "ab"}
    for at_once in (20_000, 7):
        monkeypatch.setattr(neighbours, "AT_ONCE", at_once)
        made = neighbours.spaced(df, "region", ["score", "lat", "lon"], 3.0, 12).collect()
        for g in "ab":
            assert sorted((r["score"], r["lat"], r["lon"]) for r in made if r["region"] == g) == sorted(want[g])


def test_two_pass_areas(spark):
    """Best of each region in turn, spaced over all chosen; then all, at most so many of a region."""
    rows = [("b", 0.9, 3, 0.0, 0.0), ("a", 1.0, 3, 0.0, 1.0), ("b", 0.8, 3, 0.0, 9.0), ("other", 0.95, 3, 20.0, 0.0), ("a", 0.7, 3, 0.0, 30.0), ("a", 0.6, 3, 0.0, 40.0), ("b", 0.0, 3, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "region_id string, score double, participant_count int, lat double, lon double")
    made = selection.focus_areas(df, ["a", "b"], 4, 2, 3.0).orderBy("hotspot_rank").collect()
    assert [(r["region_id"], r["score"]) for r in made] == [("a", 1.0), ("b", 0.8), ("other", 0.95), ("a", 0.7)]
    assert [r["aoi_id"] for r in selection.named_areas(selection.as_table(df, []), "2001-05-01").collect()] == []


def test_batches_stay_below_their_limits(spark):
    rows = [("g", i, 60) for i in range(4)] + [("h", 0, 500), ("h", 1, None), ("h", 2, 90), ("h", 3, 20)]
    df = spark.createDataFrame(rows, "g string, i int, size long")
    made = {(r["g"], r["i"]): r["batch"] for r in imagery.size_batches(df, "g", "i", "size", 100).collect()}
    assert [made["g", i] for i in range(4)] == [0, 1, 2, 3] and [made["h", i] for i in range(4)] == [0, 1, 1, 2]
    made = {(r["g"], r["i"]): r["batch"] for r in imagery.size_batches(df, "g", "i", "size", 0, 3).collect()}
    assert [made["g", i] for i in range(4)] == [0, 0, 0, 1]
