"""Near-duplicates against all pairs; sketches; large clusters; components."""

import os
import random

import numpy as np
import pytest

from conftest import SMALL
from llm_cases import awkward_rows, clashing, docs, prose
from millrun.llm import minhash, queries
from millrun.llm.components import connected
from millrun.session import Scratch


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    n = max(1, len(w) - size + 1)
    return frozenset(tuple(w[i:i + size]) for i in range(n))


def brute_force(rows, size, percent):
    """{id: (set size, least id reachable)} by comparing all pairs."""
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in
            spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op1_minhash(spark, SMALL)
    assert result(got) == brute_force(rows, 3, 85)
    assert got.where("kept <> (doc_id = component_id)").count() == 0


def near_copies(n, seed):
    """Copies of one text with more and more words replaced, and some other texts."""
    rng = random.Random(seed)
    base = prose(60, seed).split()
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows + [(n + i, prose(50, 100 + seed + 17 * i)) for i in range(10)]


@pytest.mark.parametrize("block", [8, 256])
def test_large_clusters_by_blocks(spark, block):
    rows = near_copies(150, 3)
    df = docs(spark, [(i, t, "en", "s", len(t)) for i, t in rows])
    got = minhash.near_duplicates(df, size=3, percent=85, bands=48, rows=8, block=block)
    assert result(got) == brute_force(rows, 3, 85)


def test_awkward_rows(spark):
    df = clashing(docs(spark, awkward_rows()))
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(awkward_rows())
    named = [(r[0], r[1]) for r in awkward_rows()[:-4]]
    want = brute_force(named, 5, 80)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(
        i for i, (_, c) in want.items() if i == c)
    assert ids.count(None) == 2


def test_keep_one_of_rows_that_share_or_lack_an_id(spark):
    """Unlike texts under one id all stay; of copies one stays, the least id, with or without."""
    a, b, c, d = (prose(60, 40 + k) for k in range(4))
    rows = [(1, a), (1, b), (None, c), (None, c), (7, d), (3, d), (None, d), (5, None), (5, ""),
            (2, a)]
    df = docs(spark, [(i, t, "en", "s", None) for i, t in rows])
    kept = sorted(map(str, ((r["doc_id"], r["text"]) for r in minhash.keep_one(df).collect())))
    assert kept == sorted(map(str, [(1, a), (1, b), (None, c), (3, d), (5, None), (5, "")]))


def test_keep_one_exchanges_blocks_not_texts(spark, monkeypatch):
    """Rows come from small blocks as they were; no text is exchanged or written by itself."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 3000)
    rows = [(i % 90, prose(60, i % 70) if i % 11 else None, "en", str(i), i) for i in range(150)]
    df = docs(spark, rows)
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(root))
    kept = minhash.keep_one(df)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<block:bigint,body:binary>" in plan and "text:" not in plan, plan
    folder, = (f"{root}/{f}" for f in set(os.listdir(root)) - before if "-kept-" in f)
    assert {n for t in os.listdir(folder) for n in spark.read.parquet(f"{folder}/{t}").columns} == {
        "block", "ids", "body", "__row"}
    assert spark.read.parquet(f"{folder}/blocks").count() > 10
    want = brute_force(list(enumerate(r[1] for r in rows)), 5, 80)
    least = {}
    for i, (_, c) in want.items():
        least[c] = min(least.get(c, (999,)), (rows[i][0],))
    got = [tuple(r) for r in kept.collect()]
    assert set(got) <= set(rows) and len(got) == len(set(got)) == len(least)
    assert sorted(r[0] for r in got) == sorted(i for i, in least.values())


def test_empty_table(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    assert minhash.keep_one(docs(spark, [])).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 400).astype(np.uint64)
    a = np.unique(np.concatenate([common, rng.integers(0, 2**63, 50).astype(np.uint64)]))
    b = np.unique(np.concatenate([common, rng.integers(0, 2**63, 50).astype(np.uint64)]))
    one = np.array([7], dtype=np.uint64)
    s = minhash.sketches([a, b, one, one], 384)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.08
    assert (s[2] == s[3]).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    edges += [(300 + i, 301 + i) for i in range(40)] + [(500, 500 + i) for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = connected(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t"), "t")
    rows = got.collect()
    assert {r["node"]: r["component"] for r in rows} == {x: find(x) for x in parent}
    assert len(rows) == len(parent)
