"""Fingerprints against plain counting, neighbours against sorting, block tables against all pairs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from llm_cases import awkward_rows, clashing, docs
from millrun.llm import queries, simhash
from millrun.session import Scratch


def plain_edited(rows):
    """{id: (characters, digest of the edited text)} of distinct ids."""
    order = sorted(rows, reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(t)
        edited = t[:n - n // 3] + following[:n // 3]
        out[i] = (n, hashlib.sha256(edited.encode()).hexdigest(), edited)
    return out


def plain_print(text, hashes):
    """Majority votes of the words' 128 bits as hex."""
    votes, total = [0] * 128, 0
    for word in text.translate(str.maketrans("\t\n\r\x0b\x0c", "     ")).split(" "):
        if word:
            weight = 1 + max(0, len(word) - 3)
            total += weight
            for bit in range(128):
                votes[bit] += weight * (hashes[word][bit // 64] >> bit % 64 & 1)
    parts = [sum(1 << b for b in range(64) if 2 * votes[64 * w + b] > total) for w in (0, 1)]
    return "".join(f"{p:016x}" for p in parts)


def word_hashes(spark, texts):
    words = sorted({w for t in texts for w in t.translate(
        str.maketrans("\t\n\r\x0b\x0c", "     ")).split(" ")})
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", F.xxhash64("w", F.lit(0)).alias("a"), F.xxhash64("w", F.lit(1)).alias("b")).collect()
    return {r["w"]: (r["a"] % 2**64, r["b"] % 2**64) for r in rows}


def likeness(a, b):
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"] or "") for r in
            spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain_edited(rows)
    texts = dict(rows)
    hashes = word_hashes(spark, [*texts.values(), *(w[2] for w in want.values())])
    got = {r["doc_id"]: r for r in queries.op10_simhash(spark, SMALL).collect()}
    assert len(got) == len(rows)
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == want[i][:2]
        assert r["fingerprint"] == plain_print(texts[i], hashes)
        assert r["edited_fingerprint"] == plain_print(want[i][2], hashes)
        following = got[order[(k + 1) % len(order)]]["fingerprint"]
        assert r["near_edited"] == pytest.approx(likeness(r["fingerprint"],
                                                          r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(likeness(r["fingerprint"], following))


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = simhash.edited_likeness(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    want = plain_edited({r[0]: r[1] or "" for r in rows if r[0] is not None}.items())
    for r in got:
        if r["doc_id"] is None:
            assert r["edited_sha256"] is None and r["near_edited"] is None
            assert r["near_next"] is None and len(r["fingerprint"]) == 32
        else:
            assert (r["n_chars"], r["edited_sha256"]) == want[r["doc_id"]][:2]
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (4, 5)}) == 1
    assert simhash.edited_likeness(docs(spark, [])).count() == 0


@pytest.mark.parametrize("words,radius,blocks", [(1, 3, 5), (2, 5, 7), (1, 0, 2)])
def test_block_tables_find_all(spark, words, radius, blocks):
    import random
    rng = random.Random(radius)
    prints = []
    for _ in range(30):
        base = rng.getrandbits(64 * words)
        prints.append(base)
        for _ in range(5):
            p = base
            for _ in range(rng.randrange(radius + 3)):
                p ^= 1 << rng.randrange(64 * words)
            prints.append(p)

    def signed(x):
        return x - 2**64 if x >= 2**63 else x
    rows = [(i, *[signed(p >> 64 * w & (2**64 - 1)) for w in range(words)])
            for i, p in enumerate(prints)]
    parts = [f"f{w}" for w in range(words)]
    table = spark.createDataFrame(rows, "doc_id bigint, " + ", ".join(
        f"{p} bigint" for p in parts))
    got = simhash.near_prints(table.where("doc_id % 3 = 0"), table, parts, radius, blocks)
    want = {(a, b, (a ^ b).bit_count()) for i, a in enumerate(prints) if i % 3 == 0
            for b in prints if (a ^ b).bit_count() <= radius}

    def whole(r, prefix):
        return sum((r[f"{prefix}_{p}"] % 2**64) << 64 * w for w, p in enumerate(parts))
    rows = [(whole(r, "q"), whole(r, "t"), r["distance"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    counted = simhash.neighbour_counts(table, F.col("doc_id") % 3 == 0, parts,
                                       Scratch(spark, "t"), radius, blocks).collect()
    near = {sum((r[p] % 2**64) << 64 * w for w, p in enumerate(parts)): r["n_near"]
            for r in counted}
    assert near == {a: sum((a ^ b).bit_count() <= radius for b in prints) - 1
                    for a in prints[::3]}


def test_recall_of_the_search_on_the_whole_table(spark):
    """The counts of the registered query are those of all pairs: recall 1."""
    rows = queries.op10_simhash(spark, SMALL).collect()
    prints = [int(r["fingerprint"], 16) for r in rows]
    for r in rows:
        if r["doc_id"] % 20:
            assert r["n_near"] is None
        else:
            own = int(r["fingerprint"], 16)
            assert r["n_near"] == sum((own ^ p).bit_count() <= 3 for p in prints) - 1


def test_rows_that_repeat_and_a_large_group_of_copies(spark):
    text = "the same words again and again in every copy of this text"
    rows = [(i, text, "en", "s", 1) for i in range(200)] + [(7, text, "en", "s", 1)] * 3
    rows += [(20, "another text under an id that repeats", "en", "s", 1)]
    got = simhash.edited_likeness(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sum(r["doc_id"] == 7 for r in got) == 4
    asked = [r for r in got if r["doc_id"] % 20 == 0]
    assert sorted(r["n_near"] for r in asked) == [0] + [202] * 10
