"""Order-preserving packing of documents into fixed windows by dynamic programming.

The documents of a task, in their stored order, form one token stream (each
document's ids, then an end id). Windows are cut out of the stream in order. The
places to cut are document ends (free), sentence ends (``sentence`` tokens) and,
when a window is filled to the last token, anywhere (``truncation`` tokens). A
window shorter than the full size costs the padding it needs; half and quarter
windows need none. For every document or sentence end ``j`` the least cost comes
from an earlier end ``i``:

* one padded window: ``f(i) + i`` is least at the front of a monotone queue over
  the ends at most a window back;
* full windows cut anywhere, then a last one that is whole, a half or a quarter:
  the least ``f(i) - truncation * i / window`` of each residue of ``i`` is kept.

A padded window is cut further where lengths that are powers of two, which need no
padding, cost less.

Long streams are solved in segments of ``segment`` tokens that end at document
ends; the windows after the segment's best last cut are carried over, so memory
is bounded. Nothing is shuffled: each task packs its own partition.

Defined cases: a null text is empty (its document is the end id alone); ids may be null and
repeat, every row is packed by itself; an empty table gives no pieces; a document longer than
a window spans several, however long; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.llm.arrow import byte_values, slices
from millrun.llm.bpe import encode_text, encoder

PIECES = ("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, `offset` bigint")


def _power_of_two(n: int) -> bool:
    return n & (n - 1) == 0


def window_cuts(ends: np.ndarray, penalties: np.ndarray, window: int, truncation: float,
                final: bool) -> list[int]:
    """Cuts of the stream ``[0, ends[-1])`` into windows, the first at 0.

    ``ends`` are the document and sentence ends, ascending; ``penalties`` what a cut
    there costs. With ``final`` the last cut is the end of the stream, else the
    cheapest end within the last window.
    """
    pos, pen = [0, *ends.tolist()], [0.0, *penalties.tolist()]
    n, inf = len(pos), float("inf")
    cost, back = [inf] * n, [0] * n
    cost[0] = 0.0
    per_token = truncation / window
    residues, from_residue = [inf] * window, [0] * window
    residues[0] = 0.0
    short = [r for r in (window // 2, window // 4) if r and _power_of_two(r)]
    queue: deque = deque([(0.0, 0)])
    for j in range(1, n):
        p = pos[j]
        while queue and pos[queue[0][1]] < p - window:
            queue.popleft()
        if queue:
            best, at = queue[0][0] + window - p, queue[0][1]
        else:  # no end in the last window: fill windows from the end before
            at = j - 1
            rest = (p - pos[at]) % window
            best = cost[at] + per_token * (p - pos[at]) + \
                (0 if _power_of_two(rest) else window - rest)
        c = p % window
        full = residues[c] + per_token * p - truncation
        if full < best:
            best, at = full, from_residue[c]
        for r in short:
            c2 = c - r if c >= r else c - r + window
            x = residues[c2] + per_token * (p - r)
            if x < best:
                best, at = x, from_residue[c2]
        best += pen[j]
        cost[j], back[j] = best, at
        x = best - per_token * p
        if x < residues[c]:
            residues[c], from_residue[c] = x, j
        x = best + p
        while queue and queue[-1][0] >= x:
            queue.pop()
        queue.append((x, j))
    j = n - 1
    if not final:
        low = np.searchsorted(ends, ends[-1] - window) + 1
        j = min(range(min(low, n - 1), n), key=lambda k: (cost[k] + pos[-1] - pos[k], k))
    cuts = [pos[j]]
    while j:
        i = back[j]
        cuts.extend(reversed(_windows(pos[i], pos[j], window, truncation)))
        j = i
    return cuts[::-1]


def _windows(i: int, j: int, window: int, truncation: float) -> list[int]:
    """Starts of the windows from end ``i`` to end ``j``.

    A short last window becomes several with lengths that are powers of two
    where their cuts cost less than its padding.
    """
    starts = list(range(i, j, window))
    rest = j - starts[-1]
    if not _power_of_two(rest) and (bin(rest).count("1") - 1) * truncation < window - rest:
        at = starts[-1]
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                at += 1 << bit
                starts.append(at)
        starts.pop()
    return starts


@lru_cache(maxsize=2)
def _ends_sentence(ranks_path: str, pattern: str) -> np.ndarray:
    """For each id, whether its bytes end a sentence or a line."""
    enc = encoder(ranks_path, pattern)
    flags = np.zeros(enc.n_vocab + 1, dtype=bool)
    for token in range(enc.n_vocab):
        try:
            raw = enc.decode_single_token_bytes(token)
        except KeyError:
            continue
        flags[token] = raw.rstrip(b"\"')").endswith((b".", b"!", b"?")) or b"\n" in raw
    return flags


class _Stream:
    """The tokens of a task that aren't packed yet, and the pieces that are."""

    def __init__(self, ends_sentence, window, sentence, truncation, first_sequence):
        self.flags, self.window = ends_sentence, window
        self.sentence, self.truncation = sentence, truncation
        self.sequence = first_sequence
        self.tokens: list[np.ndarray] = []
        self.docs: list[tuple] = []  # (id, tokens before this part, tokens in all, in this part)
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.tokens.append(ids)
        self.docs.append((doc_id, 0, len(ids), len(ids)))
        self.size += len(ids)

    def pack(self, final: bool):
        """Pieces of all windows that can be fixed now; the rest is kept."""
        if not self.size:
            return None
        tokens = np.concatenate(self.tokens)
        starts = np.zeros(len(self.docs) + 1, dtype=np.int64)
        np.cumsum([d[3] for d in self.docs], out=starts[1:])
        ends = np.flatnonzero(self.flags[tokens]) + 1
        ends = np.union1d(ends, starts[1:])
        penalties = np.full(len(ends), float(self.sentence))
        penalties[np.searchsorted(ends, starts[1:])] = 0.0
        cuts = np.array(window_cuts(ends, penalties, self.window, self.truncation, final))
        stop = int(cuts[-1])
        at = np.union1d(cuts, starts[starts < stop])
        lengths = np.diff(at)
        at = at[:-1]
        doc = np.searchsorted(starts, at, side="right") - 1
        seq = np.searchsorted(cuts, at, side="right") - 1
        raw = memoryview(tokens.astype("<u4").tobytes())
        rows = (
            [self.docs[k][0] for k in doc],
            np.array([d[1] for d in self.docs])[doc] + at - starts[doc],
            lengths,
            [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), lengths.tolist())],
            np.array([d[2] for d in self.docs])[doc],
            self.sequence + seq,
            at - cuts[seq],
        )
        self.sequence += len(cuts) - 1
        k = int(np.searchsorted(starts, stop, side="right") - 1)  # the document that goes on
        self.tokens, kept = [tokens[stop:].copy()], self.docs[k:]
        if kept:
            d, gone = kept[0], stop - int(starts[k])
            kept[0] = (d[0], d[1] + gone, d[2], d[3] - gone)
        self.docs, self.size = kept, len(tokens) - stop
        return rows


def pack(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
         text_col: str = "text", window: int = 1024, end_id: int = 0, sentence: float = 2,
         truncation: float = 8, segment: int = 2_000_000) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's.
    Sequence ids are unique over all tasks and rise along a task's stream.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        enc = encoder(ranks_path, pattern)
        id_type = None
        stream = _Stream(_ends_sentence(ranks_path, pattern), window, sentence, truncation,
                         TaskContext.get().partitionId() << 40)

        def table(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], id_type), *(pa.array(x, pa.int64()) for x in rows[1:])],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in slices(batches, "text", max_bytes=2 << 20):
            id_type = batch.schema.field("id").type
            for doc_id, raw in zip(batch.column("id").to_pylist(),
                                   byte_values(batch.column("text"))):
                ids = encode_text(enc, (raw or b"").decode("utf-8", "replace"))
                ids.append(end_id)
                stream.add(doc_id, np.array(ids, dtype=np.uint32))
                if stream.size >= segment:
                    yield table(stream.pack(final=False))
        rows = stream.pack(final=True)
        if rows:
            yield table(rows)

    return src.mapInArrow(run, f"id {kind}, {PIECES}").withColumnRenamed("id", id_col)
