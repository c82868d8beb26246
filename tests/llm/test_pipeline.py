"""The pipeline's stages one by one, and all together."""

import importlib.util
from collections import Counter

import pytest

import __spark_entry__ as E
import corpus_pipeline
from conftest import SMALL
from llm_cases import DOCS, awkward_rows, docs
from millrun.llm import minhash, quality
from test_quality import plain_score
from test_rules import brute_force as rules_by_force
from test_suffix import brute_force


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents that each stage of the pipeline was given and returned."""
    root = tmp_path_factory.mktemp("stages")
    current = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, current, SMALL).write.parquet(f"{root}/{name}")
        result = spark.read.parquet(f"{root}/{name}")
        out[name] = (current, result)
        current = result
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    for name, (given, got) in stages.items():
        if name != "packing":
            assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert 0 < got.count() <= given.count()


def test_filters_keep_rows_as_they_were(stages):
    for name in ("quality_classifier", "quality_rules", "minhash_near_dedup"):
        given, got = stages[name]
        before = {r["doc_id"]: r for r in given.collect()}
        assert all(before[r["doc_id"]] == r for r in got.collect())


def test_classifier_keeps_what_plain_scores_keep(spark, stages):
    given, got = stages["quality_classifier"]
    model = quality.fit(given, quality.graded(spark.read.parquet(f"{SMALL}/labels.parquet")))
    want = set()
    for r in given.collect():
        score = plain_score(r["text"], model.weights) - model.thresholds[-1]
        assert abs(score) > 1e-4  # none so near the limit that rounding decides
        if score >= 0:
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in got.collect()} == want


def test_rules_keep_what_brute_force_keeps(stages):
    given, got = stages["quality_rules"]
    want = rules_by_force([(r["doc_id"], r["text"], r["lang"]) for r in given.collect()])
    assert {r["doc_id"] for r in got.collect()} == {i for i, v in want.items() if v[-1]}


def test_one_of_each_group_stays(stages):
    given, got = stages["minhash_near_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    from test_minhash import brute_force as groups
    want = groups(rows, 5, 80)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(
        i for i, (_, c) in want.items() if i == c)


def test_no_passage_is_left_twice(stages):
    given, got = stages["suffix_array_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    want = {i: (removed, kept) for i, _, removed, _, kept in brute_force(rows, 50)}
    for r in got.collect():
        removed, kept = want[r["doc_id"]]
        # characters that are covered in part stay, so whole characters give the same or more
        assert len(r["text"].encode()) >= len(kept)
        assert len(r["text"].encode()) <= len(kept) + 6 * removed // 50 + 6
        assert r["n_chars"] == len(r["text"])


def test_packing_holds_all(stages):
    given, got = stages["packing"]
    covered = Counter()
    total = {}
    for r in got.collect():
        covered[r["doc_id"]] += r["length"]
        total[r["doc_id"]] = r["doc_tokens"]
    assert covered == total and len(total) == given.count()


def test_run_is_all_stages(spark, stages):
    final = stages["packing"][1]
    cols = ["doc_id", "doc_tokens"]
    got = corpus_pipeline.run(spark, SMALL).select(*cols).distinct()
    assert sorted(map(tuple, got.collect())) == sorted(
        map(tuple, final.select(*cols).distinct().collect()))


@pytest.mark.parametrize("rows", [[], awkward_rows()], ids=["empty", "awkward"])
def test_awkward_tables(spark, tmp_path, rows):
    labels = [(4, 1, 0), (6, 1, 0), (8, 0, 1), (9, 0, 0), (11, 1, 0)] if rows else []
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    current = spark.read.schema(DOCS).parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, current, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        current = spark.read.parquet(f"{tmp_path}/{name}")
    assert (current.count() == 0) == (not rows)


def test_registered():
    names = set(E.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
    assert importlib.util.find_spec("corpus_pipeline") is not None
    assert minhash.near_duplicates.__defaults__[2:4] == (5, 80)
