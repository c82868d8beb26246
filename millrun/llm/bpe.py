"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Contract of :func:`encode` and :func:`decode`:

* a null text counts as empty (no ids); document ids may be null and repeat, every row is
  encoded by itself;
* texts are encoded whole; long ones are cut first, but only where no match of
  the split pattern can cross the cut, so the ids are those of the whole text;
* a ``.json`` vocabulary's added tokens are found in a text first, wherever they
  stand, as by the ``tokenizers`` library; a rank file has none;
* bytes that aren't UTF-8 are read as U+FFFD (Spark strings are UTF-8);
* only the id column and the text column are read, so other columns can have
  any name; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.llm.arrow import byte_values, slices

CHUNK_CHARS = 1 << 16

# Cuts that no match of the split pattern crosses. White space only ever starts a
# match that holds other characters, so the place between another character and
# white space is safe; so are changes between letters and digits and from a letter
# to one of these marks (an apostrophe could belong to a contraction).
_BEFORE_SPACE = re.compile(r"(?<=\S)(?=[ \t\n])")
_OTHER_CUT = re.compile(r"(?<=[A-Za-z])(?=[0-9.,;:!?、。，])|(?<=[0-9])(?=[A-Za-z.,;:!?])"
                        r"|(?<=[ぁ-鿿])(?=[、。，])")


def safe_chunks(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """``text`` in pieces of ``size`` characters or a little more, cut at safe places only."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        cut = _BEFORE_SPACE.search(text, start + size, start + 2 * size) or \
            _OTHER_CUT.search(text, start + size) or _BEFORE_SPACE.search(text, start + size)
        if cut is None or cut.start() >= len(text):
            break
        out.append(text[start:cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def _added_tokens(data: dict) -> dict[str, int]:
    for token in data["added_tokens"]:
        if any(token.get(flag) for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"added token {token['content']!r} doesn't match by its content alone")
    return {t["content"]: t["id"] for t in data["added_tokens"]}


@lru_cache(maxsize=4)
def encoder(ranks_path: str, pattern: str):
    """A tiktoken encoder for a rank file (``.tiktoken``) or a byte-level ``.json`` vocabulary."""
    import tiktoken
    added: dict[str, int] = {}
    if ranks_path.endswith(".json"):
        with open(ranks_path, encoding="utf-8") as f:
            data = json.load(f)
        added = _added_tokens(data)
        of = _byte_of_char()
        ranks = {bytes(of[c] for c in token): i
                 for token, i in data["model"]["vocab"].items() if token not in added}
    else:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def _at_added_tokens(enc):
    """A pattern that splits a text at the encoder's added tokens, or None without any."""
    longest_first = sorted(enc.special_tokens_set, key=len, reverse=True)
    return re.compile(f"({'|'.join(map(re.escape, longest_first))})") if longest_first else None


def _encode_rest(enc, text: str) -> list[int]:
    if len(text) <= CHUNK_CHARS:
        return enc.encode_ordinary(text)
    return [i for part in safe_chunks(text) for i in enc.encode_ordinary(part)]


def encode_text(enc, text: str) -> list[int]:
    """Ids of one text: its added tokens, if the encoder has any, and the text between them."""
    added = _at_added_tokens(enc)
    if added is None:
        return _encode_rest(enc, text)
    out: list[int] = []
    for i, part in enumerate(added.split(text)):
        out += [enc.encode_single_token(part)] if i % 2 else _encode_rest(enc, part)
    return out


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids_le binary: the ids as little-endian unsigned 32-bit integers)."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        enc = encoder(ranks_path, pattern)
        for batch in slices(batches, "text"):
            ids = [np.array(encode_text(enc, (t or b"").decode("utf-8", "replace")), dtype="<u4")
                   for t in byte_values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([x.tobytes() for x in ids], pa.binary())], ["id", "n_tokens", "ids_le"])

    kind = src.schema["id"].dataType.simpleString()
    return (src.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_le binary")
            .withColumnRenamed("id", id_col))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids_le",
           out: str = "decoded") -> DataFrame:
    """``df`` with ``out`` binary in place of ``ids_col``: the raw bytes of the ids (null: empty)."""
    rest = [c for c in df.columns if c != ids_col]
    src = df.select(*rest, ids_col)

    def run(batches):
        enc = encoder(ranks_path, pattern)
        for batch in slices(batches, ids_col):
            raw = [enc.decode_bytes(np.frombuffer(x or b"", dtype="<u4").tolist())
                   for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(raw, pa.binary())], [*rest, out])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema][:-1]
                       + [f"`{out}` binary"])
    return src.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of their decoded bytes."""
    ids = encode(df, ranks_path, pattern, id_col, text_col)
    digests = ids.select(id_col, "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), "ids_le")
    return (decode(digests, ranks_path, pattern)
            .withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded"))
