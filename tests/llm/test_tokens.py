"""Token attribution against the tokenizers library's offsets and plain allocation."""

import bisect

import numpy as np
import public_tokenizers as P
import pytest

from conftest import SMALL
from llm_cases import awkward_rows, clashing, docs
from millrun.llm import bpe, queries, tokens

RANKS = P.path("byte_bpe_50k.tiktoken")


def plain_allocate(spans, sections, rule):
    counts, crossing = [0.0] * len(sections), [0] * len(sections)
    for a, b in spans:
        over = [max(0, min(b, hi) - max(a, lo)) for lo, hi in sections]
        hit = [k for k, o in enumerate(over) if o]
        whole = len(hit) == 1 and over[hit[0]] == b - a
        for k in hit:
            crossing[k] += not whole
        if rule == "share":
            for k in hit:
                counts[k] += over[k] / (b - a)
        elif rule == "largest" and hit:
            counts[max(hit, key=lambda k: (over[k], -k))] += 1
        else:
            at = a if rule == "first" else b - 1
            for k, (lo, hi) in enumerate(sections):
                counts[k] += lo <= at < hi
    return counts, crossing


@pytest.mark.parametrize("rule", tokens.RULES)
@pytest.mark.parametrize("seed", range(15))
def test_allocate(rule, seed):
    rng = np.random.default_rng(seed)
    cuts = np.cumsum(rng.integers(1, 5, 40))
    spans = [(a, b) for a, b in zip(np.concatenate([[0], cuts[:-1]]), cuts)]
    if seed % 2:  # several tokens of one character's bytes
        spans += [(a, a + 1) for a in cuts[:5]]
        spans.sort()
    edges = np.unique(rng.integers(0, cuts[-1], 16))
    sections = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:]) if rng.random() < 0.8]
    got = tokens.allocate(np.array([s[0] for s in spans]), np.array([s[1] for s in spans]),
                          np.array(sections, np.int64).reshape(-1, 2), rule)
    want = plain_allocate(spans, sections, rule)
    assert np.allclose(got[0], want[0]) and got[1].tolist() == want[1]


def test_spans_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    sizes = tokens._bytes_of_ids(RANKS, P.PATTERN)
    for row in awkward_rows():
        text = (row[1] or "")[:3000]
        enc = own.encode(text, add_special_tokens=False)
        start, end = tokens.token_spans(np.array(enc.ids, np.int64), text.encode(), sizes)
        # the library leaves the space before a word out of its span
        assert end.tolist() == [b for _, b in enc.offsets]
        assert all(a <= x for a, (x, _) in zip(start.tolist(), enc.offsets))
        assert all(x == y for x, y in zip(start.tolist()[1:], end.tolist())) or not text.isascii()


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in
             spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    enc = bpe.encoder(RANKS, P.PATTERN)
    total, lines = {}, {}
    for r in queries.op7_token_counts(spark, SMALL).collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        lines.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["end"]))
        assert r["doc_tokens"] == len(enc.encode_ordinary(texts[r["doc_id"]]))
    for i, text in texts.items():
        assert total[i] == len(enc.encode_ordinary(text))
        parts = [text[a:b] for _, a, b in sorted(lines[i])]
        assert parts == text.splitlines(keepends=True) or "".join(parts) == text


def test_lines_of_the_whole_table_by_plain_allocation(spark):
    """Counts and crossings of every line, from the tokens' own bytes."""
    enc = bpe.encoder(RANKS, P.PATTERN)
    got = {}
    for r in queries.op7_token_counts(spark, SMALL).collect():
        got.setdefault(r["doc_id"], []).append(
            (r["start"], r["end"], r["n_tokens"], r["n_crossing"]))
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        raw = (r["text"] or "").encode()
        char_of = [i for i, c in enumerate(r["text"] or "") for _ in c.encode()]
        at, spans = 0, []
        for token in enc.encode_ordinary(r["text"] or ""):
            size = len(enc.decode_single_token_bytes(token))
            spans.append((char_of[at], char_of[at + size - 1] + 1))
            at += size
        assert at == len(raw)
        ends = [i + 1 for i, c in enumerate(r["text"] or "") if c == "\n"]
        if not ends or ends[-1] < len(r["text"] or ""):
            ends.append(len(r["text"] or ""))
        sections = list(zip([0, *ends[:-1]], ends))
        counts, crossing = line_counts(spans, sections)
        assert sorted(got[r["doc_id"]]) == [(a, b, n, x) for (a, b), n, x in zip(
            sections, counts, crossing)]


def line_counts(spans, sections):
    """Plain allocation by first character over sections that cover the text."""
    starts = [a for a, _ in sections]
    counts, crossing = [0] * len(sections), [0] * len(sections)
    for a, b in spans:
        first, last = bisect.bisect(starts, a) - 1, bisect.bisect(starts, b - 1) - 1
        counts[first] += 1
        for k in range(first, last + 1):
            crossing[k] += first != last
    return counts, crossing


def test_sections_from_a_column_and_awkward_rows(spark):
    df = clashing(docs(spark, awkward_rows()))
    counted = tokens.tokens_by_section(df, RANKS, P.PATTERN, rule="share")
    assert counted.select("doc_id").distinct().count() == len({r[0] for r in awkward_rows()})
    spans = df.selectExpr("doc_id", "text", "array(struct(0L as a, 3L as b), "
                          "struct(5L as a, 9L as b)) as parts")
    got = tokens.tokens_by_section(spans, RANKS, P.PATTERN, sections="parts", rule="last")
    assert got.count() == 2 * len(awkward_rows())
    assert tokens.tokens_by_section(docs(spark, []), RANKS, P.PATTERN).count() == 0
    nothing = tokens.tokens_by_section(
        spans.selectExpr("doc_id", "text", "slice(parts, 1, 0) as parts"), RANKS, P.PATTERN,
        sections="parts")
    assert nothing.count() == 0


def test_unknown_rule():
    with pytest.raises(ValueError):
        tokens.tokens_by_section(None, RANKS, P.PATTERN, rule="middle")
