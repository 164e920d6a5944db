"""Cells of lists (op1): what travels, and that no near vector of a probed list is lost."""

import numpy as np

from gridloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], SCHEMA)


def truth(x, ids, query, top=5):
    """Ids by their best row, nearest first, ties to smaller ids."""
    unit = ann.unit(x)
    best = {}
    for i, s in zip(ids, (unit * unit[query]).sum(axis=1), strict=True):
        best[int(i)] = max(best.get(int(i), -2.0), s)
    best.pop(int(ids[query]))
    return sorted(best, key=lambda i: (-best[i], i))[:top]


def test_what_is_found_follows_the_rows_and_not_the_lists(spark, monkeypatch):
    """Without structure most lists are probed; a query meets them by cells, and returns its nearest of each."""
    x = np.random.default_rng(5).normal(size=(6000, 16)).astype(np.float32)
    rows, best = [], ann._best
    monkeypatch.setattr(ann, "_best", lambda found, top: rows.append(found.count()) or best(found, top))
    assert ann.search(table(spark, x)).count() == 600
    # 77 lists are three cells, which are one shard each or two
    assert rows[0] <= 120 * 5 * 6


def test_neighbours_in_a_tight_group(spark):
    """Near copies have alike codes: those that coding cannot tell apart are all held against the query."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x[:1500] = x[0] + 0.06 * rng.normal(size=(1500, 64))
    found = {}
    for r in ann.search(table(spark, x)).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    ids = np.arange(len(x))
    hits = sum(len(found[q] & set(truth(x, ids, q))) for q in range(0, 1500, 50))
    assert hits >= 0.985 * 150


def test_rows_of_one_id_do_not_displace_others(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    ids = np.arange(40)
    x[1:31] = x[0] + 0.01 * rng.normal(size=(30, 8))
    ids[1:21] = 1
    made = sorted((r["rank"], r["vec_id"]) for r in ann.search(table(spark, x, ids)).collect() if r["query_id"] == 0)
    assert [i for _, i in made] == truth(x, ids, 0)


def test_cell_by_brute_force():
    """Of the lists that a query probes it gets the nearest, exactly; of others none."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 22)).astype(np.float32)
    x[200:400] = x[200]  # ties
    x[400:900] = x[400] + 0.05 * rng.normal(size=(500, 22))
    ids = rng.permutation(3000)
    model = ann.Index(x, 20, 5)
    unit = ann.unit(x)
    lists, codes, off = model.encode(unit.astype(np.float32))
    order = np.argsort(lists, kind="stable")
    asked = np.arange(0, 3000, 60)
    probed = rng.random((len(asked), 20)) < np.linspace(0, 1, 20)
    model.keep(x[::7], ids[::7])
    floors = model.floors(unit[asked].astype(np.float32), ids[asked], probed, 5)
    assert (floors > -2).sum() > len(asked) / 2
    for floor in (floors, np.full(len(asked), -2.0)):
        by, near, score = model.best(unit[asked], ids[asked], probed, unit[order], ids[order], lists[order], codes[order], off[order], 5, floor)
        for k, q in enumerate(asked):
            s = (unit * unit[q]).sum(axis=1)
            there = np.flatnonzero(probed[k][lists] & (ids != ids[q]))
            want = there[np.lexsort((ids[there], -s[there]))][:5]
            assert near[by == k].tolist() == ids[want].tolist()
            assert score[by == k].tolist() == s[want].tolist()
