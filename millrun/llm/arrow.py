"""Small helpers for the operators that work on Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from millrun.session import share_package  # noqa: F401

WHITESPACE = b" \t\n\r\x0b\x0c"  # what bytes.split() splits on: x20 and x09-x0D


def byte_values(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column (null: None)."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str,
           max_bytes: int = 8 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``max_bytes`` in ``column`` each.

    Bounds what a task holds at once, however long the texts are; a single
    row above the bound makes a run of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and (total + size > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start, len(sizes) - start)


def stored(batches: list[pa.RecordBatch]) -> bytes:
    """The batches as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    option = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, batches[0].schema, options=option) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def restored(body: bytes) -> pa.Table:
    """The rows of a stream that :func:`stored` made, each column in one piece."""
    return pa.ipc.open_stream(body).read_all().combine_chunks()


def small_batches(spark, rows: int = 1000) -> None:
    """Let Spark send texts to Python workers ``rows`` at a time at most.

    Its usual 10,000 rows of long texts take some ten megabytes several times over in each
    task: twice where the JVM fills a batch, once in the worker, and what is made from it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
