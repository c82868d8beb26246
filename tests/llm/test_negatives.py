"""Hard negatives against a plain search over all pairs; packed products against plain ones."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from millrun.llm import negatives, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, anchor, few=5, many=10, low=30, high=90, scale=256):
    """All result rows for rows (id, vector, label), each a row of its own."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
            if i is not None and label is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, v, label) in enumerate(kept):
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other)
                        for n, (j, w, other) in enumerate(kept) if n != k)
        for s, j, _ in [x for x in scored if x[2] == label][:few]:
            found = [(t, q) for t, q, other in scored if other != label
                     and low * -s <= 100 * -t <= high * -s][:many]
            out += [(i, j, r, q, -s, -t) for r, (t, q) in enumerate(found, 1)]
    return out


def as_rows(df):
    return sorted(tuple(r) for r in df.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score",
        "negative_score").collect())


@pytest.mark.parametrize("size", [3, 8, 70])
@pytest.mark.parametrize("reach", [1, 200, 10**6])
def test_packed_scores(size, reach):
    rng = np.random.default_rng(size)
    rows = rng.integers(-reach, reach + 1, (size, 17))
    anchors = rng.integers(-reach, reach + 1, (5, 17))
    anchors[0] = 0
    got = np.stack(list(negatives.packed_scores(anchors, rows)))
    assert (got == anchors @ rows.T).all()


def test_packed_scores_at_the_edges():
    """Fields keep apart at their widest, with one sign only, and without rows or components."""
    top = np.full((4, 64), 2**28)
    assert (np.stack(list(negatives.packed_scores(-top, top))) == -64 * 2**56).all()
    assert (np.stack(list(negatives.packed_scores(top, -top))) == -64 * 2**56).all()
    assert [list(x) for x in negatives.packed_scores(np.zeros((2, 0), int), np.zeros((3, 0), int))] \
        == [[0] * 3] * 2
    assert [len(x) for x in negatives.packed_scores(top, np.zeros((0, 64), int))] == [0] * 4
    with pytest.raises(OverflowError):
        list(negatives.packed_scores(np.full((1, 64), 2**31 - 1), np.full((2, 64), 2**31 - 1)))


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + (r["vec_id"] % 7 == 0)) % 10)
            for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert as_rows(queries.op12_hard_negatives(spark, SMALL)) == sorted(
        plain(rows, lambda i: i % 100 == 0))


def random_rows(seed, n, labels=4, dims=3):
    rng = random.Random(seed)
    return [(rng.randrange(n), [rng.randrange(-3, 6) / 4 for _ in range(dims)],
             0 if rng.random() < 1 / 3 else rng.randrange(labels)) for _ in range(n)]


@pytest.mark.parametrize("seed,block", [(1, 5), (2, 16), (3, 1000)])
def test_ties_repeated_ids_and_blocks_of_any_size(spark, seed, block):
    """Few distinct scores, ids that repeat, a label with a third of the rows."""
    rows = random_rows(seed, 120)
    got = negatives.hard_negatives(
        spark.createDataFrame(rows, SCHEMA).repartition(3), anchor=F.col("vec_id") % 6 == 0,
        positives=3, negatives=4, rows_a_block=block, anchors_a_block=max(2, block // 3))
    # of rows with equal score and id either may come first: they give equal rows
    want = plain(rows, lambda i: i % 6 == 0, 3, 4)
    assert Counter(as_rows(got)) == Counter(want)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (3, [0.25, 0.5], 2),
            (3, [0.25, 0.5], 2), (0, [1.0, 1.0], 1), (4, None, 1), (5, [1.0, None], 2),
            (6, [nan, 1.0], 2), (7, [inf, 1.0], 2), (None, [1.0, 1.0], 2), (8, [1.0, 1.0], None),
            (9, [0.5], 2), (10, [], 3), (12, [0.5, 0.5, 9.0], 3), (14, [-1.0, -1.0], 3),
            (16, [-1.0, -1.0], 3)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "'x' as row", "'x' as id", "'x' as v", "'x' as anchor", "'x' as part", "'x' as rank")
    padded = [(i, v and v + [0.0] * (3 - len(v)) if v is not None and None not in v else v, label)
              if v else (i, [0.0] * 3 if v == [] else v, label) for i, v, label in rows]
    got = negatives.hard_negatives(df, anchor=F.col("vec_id") % 2 == 0)
    assert Counter(as_rows(got)) == Counter(plain(padded, lambda i: i % 2 == 0))
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1)], SCHEMA)
    assert negatives.hard_negatives(alone).count() == 0


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 1)], SCHEMA)
    with pytest.raises(Exception, match="2\\*\\*31"):
        negatives.hard_negatives(df).collect()
