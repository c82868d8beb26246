"""Token counts by section: whole documents are encoded once, then tokens are attributed.

A document's ids give byte spans (each id stands for known bytes), and these character
spans: from the character of its first byte to that of its last. The spans are joined
with the sections' character intervals. A token across a boundary is allocated by rule:

* ``first``: to the section with its first character;
* ``last``: to the section with its last character;
* ``largest``: to the section with most of its characters, the earlier of equals;
* ``share``: to every section it touches, in proportion to its characters there.

Sections are ascending, don't overlap and may leave gaps; tokens that touch none count
nowhere. So with sections that cover the text, the counts add up to the document's.

Defined cases: a null text is empty; an empty text's only line has no tokens; very long
texts are read whole, one at a time, and encoded in pieces; ids may be null and repeat, every
row is counted by itself; an empty table gives an empty result; other columns have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.llm.arrow import byte_values, slices
from millrun.llm.bpe import encode_text, encoder

RULES = ("first", "last", "largest", "share")


def line_spans(text: str) -> np.ndarray:
    """(start, end) of every line, with its line feed; an empty text is one empty line."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.column_stack([[0, *ends[:-1]], ends])


@lru_cache(maxsize=4)
def _bytes_of_ids(ranks_path: str, pattern: str) -> np.ndarray:
    enc = encoder(ranks_path, pattern)
    sizes = np.zeros(enc.n_vocab, dtype=np.int64)
    for raw, i in enc._mergeable_ranks.items():
        sizes[i] = len(raw)
    return sizes


def token_spans(ids: np.ndarray, raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one character of each token of a text given in UTF-8."""
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    end = np.cumsum(sizes[ids])
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    return char[end - sizes[ids]], char[end - 1] + 1


def allocate(start: np.ndarray, end: np.ndarray, sections: np.ndarray,
             rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens across a boundary) of each section."""
    n = len(sections)
    tokens, crossing = np.zeros(n), np.zeros(n, dtype=np.int64)
    if not n or not len(start):
        return tokens, crossing
    lo, hi = sections[:, 0], sections[:, 1]
    first = np.searchsorted(hi, start, side="right")  # first section that ends after the token's start
    last = np.searchsorted(lo, end, side="left") - 1  # last one that starts before its end
    touches = first <= last
    inside = touches & (first == last) & (lo[np.minimum(first, n - 1)] <= start) \
        & (end <= hi[np.minimum(first, n - 1)])
    tokens += np.bincount(first[inside], minlength=n)
    for a, b, x, y in zip(*(v[touches & ~inside].tolist() for v in (first, last, start, end))):
        over = np.minimum(hi[a:b + 1], y) - np.maximum(lo[a:b + 1], x)
        crossing[a:b + 1] += over > 0
        if rule == "share":
            tokens[a:b + 1] += np.maximum(over, 0) / (y - x)
        elif rule == "largest":
            tokens[a + int(over.argmax())] += 1
        else:
            at = x if rule == "first" else y - 1
            held = np.flatnonzero((lo[a:b + 1] <= at) & (at < hi[a:b + 1]))
            if len(held):
                tokens[a + int(held[0])] += 1
    return tokens, crossing


def tokens_by_section(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                      text_col: str = "text", sections: str | Callable = line_spans,
                      rule: str = "first") -> DataFrame:
    """One row a section: (id, section, start, end, n_tokens, n_crossing, doc_tokens).

    ``sections`` is a column of arrays of ascending (start, end) structs, or a function
    from a text to such pairs. ``n_tokens`` is a double (whole unless the rule is ``share``).
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                    *([] if callable(sections) else [F.col(sections).alias("spans")]))
    kind = src.schema["id"].dataType.simpleString()
    names = ["id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches):
        enc, sizes = encoder(ranks_path, pattern), _bytes_of_ids(ranks_path, pattern)
        for batch in slices(batches, "text", max_bytes=4 << 20):
            given = None if callable(sections) else batch.column("spans").to_pylist()
            owner, parts = [], []
            for i, raw in enumerate(byte_values(batch.column("text"))):
                text = (raw or b"").decode("utf-8", "replace")
                ids = np.array(encode_text(enc, text), dtype=np.int64)
                spans = sections(text) if given is None else np.array(
                    [tuple(x.values())[:2] for x in given[i] or []], np.int64).reshape(-1, 2)
                counted, crossing = allocate(
                    *token_spans(ids, text.encode("utf-8"), sizes), spans, rule)
                n = len(spans)
                owner.append(np.full(n, i))
                parts.append((np.arange(n), spans[:, 0], spans[:, 1], counted, crossing,
                              np.full(n, len(ids))))
            columns = [np.concatenate(c) for c in zip(*parts)]
            types = [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(np.concatenate(owner))),
                 *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return src.mapInArrow(
        run, f"id {kind}, section bigint, start bigint, end bigint, n_tokens double, "
             "n_crossing bigint, doc_tokens bigint").withColumnRenamed("id", id_col)
