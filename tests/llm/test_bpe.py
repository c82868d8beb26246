"""Encoding against whole-text encoding, exact round trips."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SMALL
from llm_cases import awkward_rows, clashing, docs
from millrun.llm import bpe, queries

RANKS = P.path("byte_bpe_50k.tiktoken")
PLAIN = bpe.encoder(RANKS, P.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1\n\t'.,!sé日。  \x1c\x85"), max_size=400),
       st.integers(1, 20))
def test_safe_chunks_change_no_id(text, size):
    parts = bpe.safe_chunks(text, size)
    assert "".join(parts) == text
    assert [i for p in parts for i in PLAIN.encode_ordinary(p)] == PLAIN.encode_ordinary(text)


def test_json_vocabulary_is_the_same_encoder():
    other = bpe.encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    for row in awkward_rows():
        assert other.encode_ordinary(row[1] or "") == PLAIN.encode_ordinary(row[1] or "")


def test_whole_table_matches_library(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in
             spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op3_byte_bpe(spark, SMALL).collect():
        ids = PLAIN.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = bpe.round_trip_digests(clashing(docs(spark, rows)), RANKS, P.PATTERN).collect()
    want = sorted((str(r[0]), len(PLAIN.encode_ordinary(r[1] or "")),
                   hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert sorted((str(r[0]), r["n_tokens"], r["decoded_sha256"]) for r in got) == want


def test_empty_table(spark):
    got = bpe.round_trip_digests(docs(spark, []), RANKS, P.PATTERN)
    assert got.count() == 0 and got.columns == ["doc_id", "n_tokens", "ids_sha256",
                                                "decoded_sha256"]


@pytest.mark.parametrize("text", ["a" * 200_000, "!" * 200_000, "ab1" * 70_000, "日" * 100_000])
def test_long_runs(text):
    assert bpe.encode_text(PLAIN, text) == PLAIN.encode_ordinary(text)
