"""Repeated passages: every byte under a ``length``-byte string that also starts in an earlier document.

An index of all suffixes would be several times the text, so the suffix arrays are
sparse: of the ``length - K + 1`` grams in a window of ``length`` bytes the one with the
least hash (the leftmost of equals) is its *anchor*. Equal windows have equal anchors, so
only suffixes at anchors are indexed, and all windows of an anchor lie in one short
string, its *run*.

1. Documents are written in compressed blocks of some megabytes.
2. Every block sends its sorted distinct anchor fingerprints, dealt into key slices, and
   hears which of them other blocks have (:class:`Levels`), and which have more than
   ``SPREAD_RUNS`` distinct runs.
3. Blocks send the distinct runs of shared anchors with their least document. A slice takes
   them in batches into a logarithmic family of suffix arrays (:class:`SuffixLevels`): the
   suffixes of a batch are sorted by their bytes, merge-scanned against the levels for
   matches of ``length`` bytes, and become a level; levels of like size merge. So every
   window is told whether a smaller document has it.
   Of anchors with many distinct runs (at the ends of a frequent passage, or in a frequent
   phrase, where the text around differs by document) blocks send the distinct window
   fingerprints instead, dealt by themselves, each with the block's least document.
4. Blocks put the answers together and cut the covered bytes.

A block sends an anchor, a run or a window once, however many of its documents hold it, so
a passage in a third of all documents reaches a slice once a block, and a slice gets at
most about ``SPREAD_RUNS`` runs of one anchor. Matches between blocks are of bytes;
fingerprints of anchors only select what is compared. Runs of one block, and the windows of
anchors with many runs, count as equal by 64-bit fingerprints.

Defined cases: a null text is empty; texts shorter than ``length`` bytes keep all; rows
with equal ids are one document to each other; rows without id come after all others;
an empty table gives an empty result; other columns have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrun.llm.arrow import byte_values, restored, slices, stored
from millrun.llm.minhash import mix
from millrun.session import Scratch

BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 1 << 16  # arrays of 8 bytes a place then fit in a core's cache
BATCH_BYTES = 1 << 18  # of runs in a batch of a slice
ANCHORS_A_SLICE = 150_000
SPREAD_RUNS = 16_384  # distinct runs of an anchor, over all blocks, that one slice may get
_LAST = np.iinfo(np.int64).max  # stands for a null id
_U = np.uint64
_BASE = _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_POSITION = _U((1 << 24) - 1)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def gram_size(length: int) -> int:
    return max(4, min(18, length * 18 // 50))


class Levels:
    """A logarithmic family of sorted arrays: keys with the least and greatest owner of each.

    A new batch is a level; while the level before is less than twice as long, the two merge.
    So there are about log(batches) levels and each key is merged about as often.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        new = self._sorted(keys, low, high, np.argsort(keys))
        while self.levels and len(self.levels[-1][0]) < 2 * len(new[0]):
            new = self._merged(self.levels.pop(), new)
        self.levels.append(new)

    def _merged(self, a, b):
        keys, low, high = map(np.concatenate, zip(a, b))
        return self._sorted(keys, low, high, np.argsort(keys, kind="stable"))  # two rising runs

    def close(self) -> None:
        """Merges what is left, before many keys are looked up."""
        while len(self.levels) > 1:
            b = self.levels.pop()
            self.levels.append(self._merged(self.levels.pop(), b))

    @staticmethod
    def _sorted(keys, low, high, order):
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
        if not len(first):
            return keys, low, high
        if len(first) == len(keys):
            return keys, low[order], high[order]
        return (keys[first], np.minimum.reduceat(low[order], first),
                np.maximum.reduceat(high[order], first))

    def owners(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest owner of each of ``keys`` over all levels."""
        low = np.full(len(keys), _LAST)
        high = np.full(len(keys), -_LAST - 1)
        for level, least, greatest in self.levels:
            if not len(level):
                continue
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            hit = level[at] == keys
            low[hit] = np.minimum(low[hit], least[at[hit]])
            high[hit] = np.maximum(high[hit], greatest[at[hit]])
        return low, high


class SuffixLevels:
    """A logarithmic family of suffix arrays: sorted suffixes with their least owners.

    Suffixes are compared by their first ``length`` bytes. A new batch gets a suffix array,
    is scanned against every level for matches and becomes a level itself; while the level
    before is less than twice as long, the two merge. A match is noted for the side with the
    greater owner, so a batch may come at any time and in any order.
    """

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0
        self._beaten: list[np.ndarray] = []
        self._same: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, data: np.ndarray, places: np.ndarray,
            owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry number of the suffix at each of ``places``; whether the batch has a smaller owner."""
        if not len(places):
            return places, np.empty(0, dtype=bool)
        suffix = np.lib.stride_tricks.sliding_window_view(data, self.length)[places]
        suffix = suffix.view(f"S{self.length}").ravel()  # padded alike, so compared as bytes
        order = np.argsort(suffix)
        suffix = suffix[order]
        new = np.concatenate([[True], suffix[1:] != suffix[:-1]])
        first = np.flatnonzero(new)
        entry = np.empty(len(order), dtype=np.int64)
        entry[order] = np.cumsum(new) - 1
        suffix, low = suffix[first], np.minimum.reduceat(owner[order], first)
        number = self.n + np.arange(len(first))
        self.n += len(first)
        for level, least, holder in self.levels:
            at = np.minimum(np.searchsorted(level, suffix), len(level) - 1)
            hit = np.flatnonzero(level[at] == suffix)
            at, mine = at[hit], low[hit]
            self._beaten += [number[hit[least[at] < mine]], holder[at[mine < least[at]]]]
        level = suffix, low, number
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            level = self._merged(self.levels.pop(), level)
        self.levels.append(level)
        return number[entry], owner > low[entry]

    def _merged(self, a, b):
        suffix, low, holder = map(np.concatenate, zip(a, b))
        order = np.argsort(suffix, kind="stable")  # two rising runs
        suffix = suffix[order]
        twice = np.flatnonzero(suffix[1:] == suffix[:-1])
        i, j = order[twice], order[twice + 1]
        same = low[i] == low[j]
        self._same.append((holder[j[same]], holder[i[same]]))
        keep = np.ones(len(order), dtype=bool)
        keep[twice + (low[i] <= low[j])] = False
        order = order[keep]
        return suffix[keep], low[order], holder[order]

    def covered(self) -> np.ndarray:
        """For every entry so far, whether another batch has its suffix with a smaller owner."""
        out = np.zeros(self.n, dtype=bool)
        for numbers in self._beaten:
            out[numbers] = True
        for gone, kept in reversed(self._same):  # of equal owners one stands for both
            out[gone] |= out[kept]
        return out


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes from each place, by doubling."""
    parts = {1: _BYTES[data]}
    size = 1
    while 2 * size <= k:
        h = parts[size]
        parts[2 * size] = h[:-size] * _powers(int(_BASE), 64)[size] + h[size:]
        size *= 2
    out, covered = parts[size], size
    while covered < k:
        size = max(s for s in parts if covered + s <= k)
        tail = parts[size][covered:]
        out = out[:len(tail)] * _powers(int(_BASE), 64)[size] + tail[:len(out)]
        covered += size
    return mix(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


class _Prints:
    """Fingerprints of any stretch of ``data`` of ``k`` bytes or more."""

    def __init__(self, data: np.ndarray, k: int):
        self.grams, self.k = gram_hashes(data, k), k
        n = len(self.grams)
        size = max(1 << 16, 1 << n.bit_length())
        self.inverse = _powers(int(_INVERSE), size)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.grams * _powers(int(_BASE), size)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        total = self.sums[start + size - self.k + 1] - self.sums[start]
        return mix(total * self.inverse[start] + np.asarray(size).astype(np.uint64))


class Runs:
    """The anchors of a buffer of documents and the runs of windows around them."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int):
        k = gram_size(length)
        parts = []
        for lo, hi, doc_starts, doc_ends in self._chunks(starts, sizes, length):
            piece = data[lo:hi]
            if len(piece) < length:
                continue
            prints = _Prints(piece, k)
            rank = prints.grams & ~_POSITION | np.arange(len(prints.grams), dtype=np.uint64)
            place = (_sliding_min(rank, length - k + 1) & _POSITION).astype(np.int64)
            edge = np.zeros(len(place) + 1, dtype=np.int32)
            fits = doc_ends - doc_starts >= length
            np.add.at(edge, doc_starts[fits] - lo, 1)
            np.add.at(edge, doc_ends[fits] - lo - length + 1, -1)
            at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            if not len(at):
                continue
            place = place[at]
            cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            first = at[cut]
            windows = np.diff(np.concatenate([cut, [len(at)]]))
            parts.append((first + lo, windows, mix(prints.grams[place[cut]] + _U(1)),
                          prints.of(first, windows - 1 + length)))
        empty = [np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64)]
        self.first, self.windows, self.anchor, self.content = (
            map(np.concatenate, zip(*parts)) if parts else empty)

    @staticmethod
    def _chunks(starts, sizes, length) -> Iterator[tuple]:
        """Stretches of whole documents, or overlapping pieces of a long one."""
        i = 0
        while i < len(starts):
            lo = int(starts[i])
            if sizes[i] > CHUNK_BYTES:
                end = lo + int(sizes[i])
                for a in range(lo, end - length + 1, CHUNK_BYTES):
                    b = min(end, a + CHUNK_BYTES + length - 1)
                    yield a, b, np.array([a]), np.array([b])
                i += 1
                continue
            j = int(np.searchsorted(starts + sizes, lo + CHUNK_BYTES, side="right"))
            j = max(j, i + 1)
            yield lo, int(starts[j - 1] + sizes[j - 1]), starts[i:j], (starts + sizes)[i:j]
            i = j


class _Block:
    """The rows of one stored block."""

    def __init__(self, body: bytes, length: int):
        self.rows = restored(body)
        texts = byte_values(self.rows.column("__text").combine_chunks())
        raw = [t or b"" for t in texts]
        self.null = [t is None for t in texts]
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in raw], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        ids = self.rows.column("__id").combine_chunks()
        self.ids = ids.fill_null(_LAST).to_numpy()
        self.runs = Runs(self.data, self.starts, self.sizes, length)
        self.owner = self.ids[np.searchsorted(self.starts, self.runs.first, side="right") - 1] \
            if len(self.runs.first) else np.empty(0, np.int64)

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct anchor keys, the key of each run, whether two documents here share it)."""
        keys, of = np.unique(self.runs.anchor >> _U(64 - bits), return_inverse=True)
        low = np.full(len(keys), _LAST)
        high = np.full(len(keys), -_LAST - 1)
        np.minimum.at(low, of, self.owner)
        np.maximum.at(high, of, self.owner)
        return keys, of, low < high

    def run_counts(self, of: np.ndarray, n: int) -> np.ndarray:
        """The number of distinct runs of each of ``n`` keys."""
        counts = np.bincount(of, minlength=n)
        several = np.flatnonzero(counts[of] > 1)
        key, content = of[several], self.runs.content[several]
        order = np.lexsort((content, key))
        key, content = key[order], content[order]
        again = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
        return counts - np.bincount(key[1:][again], minlength=n)

    def shared_runs(self, bits: int, slices_n: int, answers: dict[int, bytes],
                    spread: dict[int, bytes]) -> tuple:
        """(runs of shared anchors, the entry of each, entries' first runs and slices, spread runs).

        Entries are the distinct runs, by slice and fingerprint. Spread runs are those of
        anchors whose windows are dealt; they have no entries.
        """
        keys, of, here = self.keys(bits)
        slice_of_key = _slice_of(keys, bits, slices_n)
        shared = here.copy()
        dealt = np.zeros(len(keys), dtype=bool)
        for mask, heard in ((shared, answers), (dealt, spread)):
            for s, answer in heard.items():
                lo, hi = np.searchsorted(slice_of_key, [s, s + 1])
                mask[lo:hi] |= np.unpackbits(
                    np.frombuffer(answer, np.uint8), count=hi - lo).astype(bool)
        spread_runs = np.flatnonzero((shared & dealt)[of])
        runs = np.flatnonzero((shared & ~dealt)[of])
        slice_of_run = slice_of_key[of[runs]]
        order = np.lexsort((self.owner[runs], self.runs.content[runs], slice_of_run))
        runs, slice_of_run = runs[order], slice_of_run[order]
        content = self.runs.content[runs]
        new = np.ones(len(runs), dtype=bool)
        new[1:] = (content[1:] != content[:-1]) | (slice_of_run[1:] != slice_of_run[:-1])
        entry = np.cumsum(new) - 1
        return runs, entry, runs[new], slice_of_run[new], spread_runs

    def spread_windows(self, runs: np.ndarray, length: int) -> tuple:
        """(start, owner and entry of every window of ``runs``, entries' fingerprints and owners).

        Entries are the distinct windows, by fingerprint, each with its least owner.
        """
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
        size = self.runs.windows[runs] - 1 + length
        piece = np.cumsum(size) // CHUNK_BYTES
        for some in np.split(np.arange(len(runs)), np.flatnonzero(np.diff(piece)) + 1):
            if not len(some):
                continue
            first, count = self.runs.first[runs[some]], self.runs.windows[runs[some]]
            text, _ = _windows(first, size[some])
            start = np.concatenate([[0], np.cumsum(size[some])[:-1]])
            within, of = _windows(start, count)
            prints = _Prints(self.data[text], gram_size(length)).of(within, length)
            parts.append((first[of] + within - start[of], self.owner[runs[some]][of], prints))
        places, owner, prints = map(np.concatenate, zip(*parts))
        keys, entry = np.unique(prints, return_inverse=True)
        least = np.full(len(keys), _LAST)
        np.minimum.at(least, entry, owner)
        return places, owner, entry, keys, least

    def removed(self, length: int, found: tuple, answers: dict[int, bytes],
                slices_n: int) -> np.ndarray:
        """Mask of the bytes that windows of smaller documents cover."""
        runs, entry, first, entry_slice, spread_runs = found
        edge = np.zeros(len(self.data) + 1, dtype=np.int64)
        later = self.owner[runs] > self.owner[first][entry]
        a = self.runs.first[runs[later]]
        np.add.at(edge, a, 1)
        np.add.at(edge, a + self.runs.windows[runs[later]] - 1 + length, -1)
        places, owner, of, keys, least = self.spread_windows(spread_runs, length)
        key_slice = slices_n + _slice_of(keys, 64, slices_n)
        covered = np.zeros(len(keys), dtype=bool)
        for s, answer in answers.items():
            if s >= slices_n:
                lo, hi = np.searchsorted(key_slice, [s, s + 1])
                covered[lo:hi] = np.unpackbits(
                    np.frombuffer(answer, np.uint8), count=hi - lo).astype(bool)
        places = places[covered[of] | (owner > least[of])]
        np.add.at(edge, places, 1)
        np.add.at(edge, places + length, -1)
        for s, answer in answers.items():
            if s >= slices_n:
                continue
            lo, hi = np.searchsorted(entry_slice, [s, s + 1])
            count = self.runs.windows[first[lo:hi]]
            hit = np.unpackbits(np.frombuffer(answer, np.uint8), count=int(count.sum())).astype(
                bool)
            a, b = np.searchsorted(entry, [lo, hi])  # entries rise with the runs
            least = ~later[a:b]  # runs of the document that was sent for the entry
            at, which = runs[a:b][least], entry[a:b][least] - lo
            offset = np.concatenate([[0], np.cumsum(count)])[:-1]
            places, of = _windows(self.runs.first[at], self.runs.windows[at])
            within = places - self.runs.first[at][of]
            places = places[hit[offset[which][of] + within]]
            np.add.at(edge, places, 1)
            np.add.at(edge, places + length, -1)
        return np.cumsum(edge[:-1]) > 0


def _windows(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of runs, and which run each is of."""
    of = np.repeat(np.arange(len(first)), count)
    offset = np.concatenate([[0], np.cumsum(count)])[:-1]
    return first[of] + np.arange(len(of)) - offset[of], of


def _slice_of(keys: np.ndarray, bits: int, slices_n: int) -> np.ndarray:
    """Slices are equal ranges of the keys' first 32 bits."""
    return (((keys >> _U(bits - 32)) * _U(slices_n)) >> _U(32)).astype(np.int64)


def _pack(keys: np.ndarray, bits: int) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :bits // 8].tobytes()


def _unpack(raw: bytes, bits: int) -> np.ndarray:
    cells = np.zeros((len(raw) // (bits // 8), 8), dtype=np.uint8)
    cells[:, :bits // 8] = np.frombuffer(raw, np.uint8).reshape(len(cells), -1)
    return cells.view("<u8").ravel().astype(np.uint64)


def _batch(**columns) -> pa.Table:
    types = {"slice": pa.int32(), "kind": pa.int32(), "block": pa.int64()}
    return pa.table({n: pa.array(v, types.get(n, pa.binary())) for n, v in columns.items()})


def stored_blocks(df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(block, n_bytes, body): the rows in compressed blocks, written once."""
    src = df.select("*", F.col(id_col).cast("bigint").alias("__id"),
                    F.col(text_col).cast("string").alias("__text"))
    if text_col in df.columns:
        src = src.drop(df[text_col])

    def run(batches):
        first = TaskContext.get().partitionId() << 32

        def row(number, kept, size):
            return pa.RecordBatch.from_arrays(
                [pa.array([first + number], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([stored(kept)], pa.binary())],
                ["block", "n_bytes", "body"])

        number = size = 0
        kept: list[pa.RecordBatch] = []
        for batch in slices(batches, "__text", max_bytes=BLOCK_BYTES // 4):
            part = sum(len(t or b"") for t in byte_values(batch.column("__text")))
            if kept and size + part > BLOCK_BYTES:
                yield row(number, kept, size)
                number, size, kept = number + 1, 0, []
            kept.append(batch)
            size += part
        if kept:
            yield row(number, kept, size)

    return scratch.write(src.mapInArrow(run, "block bigint, n_bytes bigint, body binary"), "blocks")


def _several(counts: np.ndarray) -> bytes:
    """Places and values of the counts over one."""
    at = np.flatnonzero(counts > 1)
    return np.stack([at, counts[at]]).astype("<u4").tobytes()


def _counts(raw: bytes, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.int64)
    at, values = np.frombuffer(raw, "<u4").reshape(2, -1)
    out[at] = values
    return out


def _anchor_keys(blocks: DataFrame, length: int, bits: int, n: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block, body in zip(*(batch.column(c).to_pylist() for c in ("block", "body"))):
                rows = _Block(body, length)
                keys, of, _ = rows.keys(bits)
                counts = rows.run_counts(of, len(keys))
                cut = np.searchsorted(_slice_of(keys, bits, n), np.arange(n + 1))
                some = np.flatnonzero(cut[1:] > cut[:-1])
                yield from _batch(
                    slice=some, block=[block] * len(some),
                    keys=[_pack(keys[cut[s]:cut[s + 1]], bits) for s in some],
                    several=[_several(counts[cut[s]:cut[s + 1]]) for s in some]).to_batches()

    return blocks.select("block", "body").mapInArrow(
        run, "slice int, block bigint, keys binary, several binary")


def _shared_keys(keys: DataFrame, bits: int, spread: int) -> DataFrame:
    """For each block and slice, which of its keys other blocks have (kind 1), and, where there
    are any, which have more than ``spread`` distinct runs (kind 3)."""
    def run(table: pa.Table) -> pa.Table:
        family = Levels()
        runs = [_unpack(raw, bits) for raw in table.column("keys").to_pylist()]
        blocks = table.column("block").to_numpy()
        for i in np.argsort(blocks):
            owner = np.full(len(runs[i]), blocks[i])
            family.add(runs[i], owner, owner)
        family.close()
        answers = []
        for own in runs:
            low, high = family.owners(own)
            answers.append(np.packbits(low < high).tobytes())
        out = _batch(slice=table.column("slice"), block=blocks,
                     answer=answers, kind=[1] * len(answers))
        counts = [_counts(raw, len(own))
                  for raw, own in zip(table.column("several").to_pylist(), runs)]
        if sum(int(c.max()) for c in counts) <= spread:
            return out
        total = np.zeros(len(family.levels[0][0]), dtype=np.int64)
        places = [np.searchsorted(family.levels[0][0], own) for own in runs]
        for at, count in zip(places, counts):
            total[at] += count
        masks = [total[at] > spread for at in places]
        some = [i for i, mask in enumerate(masks) if mask.any()]
        return pa.concat_tables([out, _batch(
            slice=[table.column("slice")[i].as_py() for i in some], block=blocks[some],
            answer=[np.packbits(masks[i]).tobytes() for i in some], kind=[3] * len(some))])

    return keys.groupBy("slice").applyInArrow(
        run, "slice int, block bigint, answer binary, kind int")


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {s: a for s, a, k in zip(*(table.column(c).to_pylist()
                                      for c in ("slice", "answer", "kind"))) if k == kind}


def _shared_runs(blocks: DataFrame, answers: DataFrame, length: int, bits: int,
                 n: int) -> DataFrame:
    """The distinct runs of shared anchors: their bytes, sizes and least documents.

    Slices from ``n`` on get windows of anchors with many runs: fingerprints in ``texts``.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"slice": [], "block": [], "texts": [], "sizes": [], "owners": []}
        for number, body in zip(left.column("block").to_pylist(), left.column("body").to_pylist()):
            block = _Block(body, length)
            _, _, first, entry_slice, spread = block.shared_runs(
                bits, n, _answers(right, 1), _answers(right, 3))
            start = block.runs.first[first]
            size = block.runs.windows[first] - 1 + length
            cut = np.searchsorted(entry_slice, np.arange(n + 1))
            for s in np.flatnonzero(cut[1:] > cut[:-1]):
                part = slice(cut[s], cut[s + 1])
                places, _ = _windows(start[part], size[part])
                out["slice"].append(int(s))
                out["block"].append(number)
                out["texts"].append(_zipped(block.data[places].tobytes()))
                out["sizes"].append(size[part].astype("<u4").tobytes())
                out["owners"].append(block.owner[first[part]].astype("<i8").tobytes())
            _, _, _, keys, least = block.spread_windows(spread, length)
            cut = np.searchsorted(_slice_of(keys, 64, n), np.arange(n + 1))
            for s in np.flatnonzero(cut[1:] > cut[:-1]):
                part = slice(cut[s], cut[s + 1])
                out["slice"].append(n + int(s))
                out["block"].append(number)
                out["texts"].append(keys[part].astype("<u8").tobytes())
                out["sizes"].append(b"")
                out["owners"].append(least[part].astype("<i8").tobytes())
        return _batch(**out)

    return blocks.select("block", "body").groupBy("block").cogroup(
        answers.groupBy("block")).applyInArrow(
        run, "slice int, block bigint, texts binary, sizes binary, owners binary")


def _zipped(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True) + len(raw).to_bytes(8, "little")


def _unzipped(raw: bytes) -> bytes:
    return pa.decompress(raw[:-8], int.from_bytes(raw[-8:], "little"), codec="zstd", asbytes=True)


def _covered_prints(table: pa.Table) -> pa.Table:
    """For each block, which of its window fingerprints a smaller document has."""
    windows = Levels()
    batches = [(np.frombuffer(keys, "<u8").astype(np.uint64), np.frombuffer(own, "<i8"))
               for keys, own in zip(*(table.column(c).to_pylist() for c in ("texts", "owners")))]
    for keys, mine in batches:
        windows.add(keys, mine, mine)
    windows.close()
    answers = [np.packbits(windows.owners(keys)[0] < mine).tobytes() for keys, mine in batches]
    return _batch(slice=table.column("slice"), block=table.column("block").to_numpy(),
                  answer=answers, kind=[2] * len(answers))


def _batches(table: pa.Table) -> Iterator[tuple]:
    """(blocks' places in ``table``, texts, sizes and owners of runs), some blocks at a time."""
    columns = [table.column(c).to_pylist() for c in ("texts", "sizes", "owners")]
    some, parts, n_bytes = [], [], 0
    for i in np.argsort(table.column("block").to_numpy()):
        some.append(i)
        parts.append((np.frombuffer(_unzipped(columns[0][i]), dtype=np.uint8),
                      np.frombuffer(columns[1][i], dtype="<u4").astype(np.int64),
                      np.frombuffer(columns[2][i], dtype="<i8").astype(np.int64)))
        n_bytes += len(parts[-1][0])
        if n_bytes >= BATCH_BYTES:
            yield some, parts
            some, parts, n_bytes = [], [], 0
    if some:
        yield some, parts


def _covered_windows(runs: DataFrame, length: int, n: int) -> DataFrame:
    """For each block and slice, which windows of its runs a smaller document has."""
    def run(table: pa.Table) -> pa.Table:
        if table.column("slice")[0].as_py() >= n:
            return _covered_prints(table)
        family, found = SuffixLevels(length), []
        for some, parts in _batches(table):
            data, size, owner = map(np.concatenate, zip(*parts))
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            places, of = _windows(start, size - length + 1)
            found.append((some, [int((s - length + 1).sum()) for _, s, _ in parts],
                          *family.add(data, places, owner[of])))
        covered, answers = family.covered(), [b""] * table.num_rows
        for some, counts, entry, beaten in found:
            hits = np.split(covered[entry] | beaten, np.cumsum(counts)[:-1])
            for i, hit in zip(some, hits):
                answers[i] = np.packbits(hit).tobytes()
        return _batch(slice=table.column("slice"), block=table.column("block").to_numpy(),
                      answer=answers, kind=[2] * len(answers))

    return runs.groupBy("slice").applyInArrow(
        run, "slice int, block bigint, answer binary, kind int")


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` without the bytes of characters that are covered in part."""
    if not len(data):
        return gone
    lead = (data & 0xC0) != 0x80
    lead[0] = True
    at = np.flatnonzero(lead)
    whole = np.logical_and.reduceat(gone, at)
    return np.repeat(whole, np.diff(np.concatenate([at, [len(data)]])))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = 50, characters: bool = True) -> DataFrame:
    """``df`` without its text, plus n_bytes, n_removed, n_spans and kept (the bytes left).

    The added columns are named ``__n_bytes``, ``__n_removed``, ``__n_spans`` and
    ``__kept`` (binary, null for a null text). With ``characters`` the kept bytes are whole characters: one that
    is covered in part stays.
    """
    scratch = Scratch(df.sparkSession, "repeats")
    blocks = stored_blocks(df, id_col, text_col, scratch)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    anchors = 2 * total // (length - gram_size(length) + 2)
    n = anchors // ANCHORS_A_SLICE + 1
    bits = 8 * max(5, -(-(anchors.bit_length() + 8) // 8))
    keys = _anchor_keys(blocks, length, bits, n)
    first = scratch.write(_shared_keys(keys, bits, SPREAD_RUNS), "shared_keys")
    second = scratch.write(
        _covered_windows(_shared_runs(blocks, first, length, bits, n), length, n), "covered")
    rest = [f for f in df.schema.fields if f.name != text_col]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for body in left.column("body").to_pylist():
            block = _Block(body, length)
            found = block.shared_runs(bits, n, _answers(right, 1), _answers(right, 3))
            gone = block.removed(length, found, _answers(right, 2), n)
            removed, spans, kept = [], [], []
            for a, size, null in zip(block.starts.tolist(), block.sizes.tolist(), block.null):
                mask, data = gone[a:a + size], block.data[a:a + size]
                if characters:
                    mask = _whole_characters(data, mask)
                removed.append(int(mask.sum()))
                spans.append(int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(None if null else data[~mask].tobytes())
            table = block.rows.select([f.name for f in rest])
            for name, values, kind in (("__n_bytes", block.sizes, pa.int64()),
                                       ("__n_removed", removed, pa.int64()),
                                       ("__n_spans", spans, pa.int64()),
                                       ("__kept", kept, pa.binary())):
                table = table.append_column(name, pa.array(values, kind))
            tables.append(table)
        return pa.concat_tables(tables)

    schema = T.StructType([*rest, *[T.StructField(c, T.LongType()) for c in (
        "__n_bytes", "__n_removed", "__n_spans")], T.StructField("__kept", T.BinaryType())])
    return blocks.select("block", "body").groupBy("block").cogroup(
        first.unionByName(second).groupBy("block")).applyInArrow(run, schema)


def repeat_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = 50) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every document, byte by byte."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = remove_repeats(narrow, "id", "text", length, characters=False)
    return found.select(F.col("id").alias(id_col), F.col("__n_bytes").alias("n_bytes"),
                        F.col("__n_removed").alias("n_removed"),
                        F.col("__n_spans").alias("n_spans"),
                        F.sha2(F.coalesce("__kept", F.lit(b"")), 256).alias("kept_sha256"))


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                n_chars_col: str | None = "n_chars", length: int = 50) -> DataFrame:
    """The rows of ``df`` with repeated passages cut out of their text.

    Rows left without a word are dropped unless nothing was cut; a count of
    characters, where there is one, is brought up to date.
    """
    found = remove_repeats(df, id_col, text_col, length)
    text = F.decode("__kept", "UTF-8")
    names = {c: F.col(f"`{c}`") for c in df.columns}
    cut = F.col("__n_removed") > 0
    if n_chars_col in names:
        names[n_chars_col] = F.when(cut, F.length(text)).otherwise(names[n_chars_col]).cast(
            df.schema[n_chars_col].dataType)
    names[text_col] = text
    return (found.where(~cut | text.rlike(r"[^\x20\x09-\x0D]"))
            .select(*[v.alias(c) for c, v in names.items()]))
