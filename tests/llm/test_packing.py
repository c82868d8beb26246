"""Packing: exact cover, gapless sequences, least cost on small streams."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from conftest import SMALL
from llm_cases import awkward_rows, clashing, docs, prose
from millrun.llm import bpe, packing, queries

JSON = P.path("byte_bpe_50k.json")
OWN = Tokenizer.from_file(JSON)


def check(rows, ids_of):
    """Every id in exactly one piece, pieces' checksums right, sequences without gaps."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids_of)
    for doc, pieces in by_doc.items():
        at, ids = 0, np.array(ids_of[doc], "<u4")
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sizes = []
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 1024
        sizes.append(at)
    return sizes


def test_whole_table_by_the_tokenizers_library(spark):
    ids = {r["doc_id"]: OWN.encode(r["text"] or "", add_special_tokens=False).ids + [0]
           for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sizes = check(queries.op9_packing(spark, SMALL).collect(), ids)
    padding = sum(0 if s & (s - 1) == 0 else 1024 - s for s in sizes)
    assert padding <= 0.01 * sum(sizes)


def test_awkward_rows(spark):
    rows = [r for r in awkward_rows() if r[0] is not None][:-2]
    ids = {r[0]: OWN.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows}
    check(packing.pack(clashing(docs(spark, rows)), JSON, P.PATTERN).collect(), ids)
    check(packing.pack(docs(spark, rows), JSON, P.PATTERN, segment=300).collect(), ids)
    everything = packing.pack(docs(spark, awkward_rows()), JSON, P.PATTERN)
    assert everything.where("start = 0").count() == len(awkward_rows())
    assert packing.pack(docs(spark, []), JSON, P.PATTERN).count() == 0


def test_added_tokens_in_texts_by_the_tokenizers_library(spark):
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"{mark}{mark}  x", f"a  {mark}\n\nb", "<|endoftext|",
             f"word's{mark}'s 12{mark}34", (f"{prose(900)}{mark} " * 20)]
    rows = [r for r in awkward_rows() if r[0] is not None][:-2]
    rows += [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    ids = {r[0]: OWN.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows}
    assert len(texts[-1]) > bpe.CHUNK_CHARS and 50256 in ids[100]
    check(packing.pack(docs(spark, rows), JSON, P.PATTERN).collect(), ids)


def brute_force(ends, penalties, window, truncation):
    """Least cost over all choices of ends: padded windows, or full ones and a last whole,
    half or quarter one."""
    best = {0: 0.0}
    for p, penalty in zip(ends, penalties):
        options = []
        for i, cost in best.items():
            rest = (p - i) % window
            cuts = (p - i - 1) // window
            if rest in (0, window // 2, window // 4):
                options.append(cost + cuts * truncation)
            elif p - i < window or i == max(best):
                options.append(cost + cuts * truncation + window - rest)
        best[p] = min(options) + penalty
    return best[ends[-1]]


@pytest.mark.parametrize("seed", range(12))
def test_cost_is_least(seed):
    rng = np.random.default_rng(seed)
    window, truncation = 16, 3.0
    ends = np.cumsum(rng.integers(1, 12, 12))
    penalties = np.where(rng.random(12) < 0.5, 0.0, 1.0)
    penalties[-1] = 0.0
    cuts = packing.window_cuts(ends, penalties, window, truncation, final=True)
    assert cuts[0] == 0 and cuts[-1] == ends[-1]
    pen = dict(zip(ends.tolist(), penalties))
    cost = 0.0
    for a, b in itertools.pairwise(cuts):
        size = b - a
        assert 0 < size <= window
        cost += 0 if size & (size - 1) == 0 else window - size
        cost += pen.get(b, truncation)
    # padding is saved where windows have other powers of two, so the cost may be less
    assert cost <= brute_force(ends.tolist(), penalties.tolist(), window, truncation) + 1e-9
