"""Hard negatives by exact integer scores, computed with Kronecker-packed products.

Vectors are scaled to integers. In a block of candidates the values of one component, each
biased to be 0 or more, stand in separated fields of one wide integer. An anchor multiplies
each wide integer once, by its own component; the sum over the components holds, field by
field, the scores of all candidates of the block, and is unpacked in one go. Fields are as
wide as the block and the anchors need, so scores are exact.

Anchors are a stated set of rows and meet all rows in blocks. Rows are dealt into blocks by
ranges of label and id (a hot label has many blocks), anchors likewise; a cell is one block
of anchors with one of rows, and all cells are of like size. The first pass looks for
positives, only in cells that share a label; the second, knowing which scores are allowed,
for negatives. A cell returns the best few an anchor needs, so what is ranked at the end is
``few x blocks`` rows an anchor.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component,
take no part; vectors of unequal length are filled up with zeros; rows that repeat are rows
of their own (a copy of an anchor is another row, so it can be its positive); an anchor
without positives, and a positive without negatives, give no row; an empty table gives an
empty result; a scaled component of 2**31 or more, or a score beyond 63 bits, is an error;
other columns have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrun.operators import ranking
from millrun.session import Scratch

ROWS_A_BLOCK = 4096
ANCHORS_A_BLOCK = 512
_BLOCK = "seq bigint, n int, labels array<bigint>, held binary"


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """For each anchor (a row of integers) its inner products with all ``rows``."""
    n, dims = rows.shape
    if not n or not dims:
        for _ in anchors:
            yield np.zeros(n, np.int64)
        return
    bias = max(0, -int(rows.min()))
    top = int(rows.max()) + bias
    reach = top * max((sum(map(abs, a)) for a in anchors.tolist()), default=0)
    if reach.bit_length() > 63:
        raise OverflowError("a score needs more than 63 bits")
    field = np.dtype("<u4" if reach.bit_length() <= 32 else "<u8")
    wide = [int.from_bytes((rows[:, c] + bias).astype(field).tobytes(), "little")
            for c in range(dims)]
    ones = int.from_bytes(np.ones(n, field).tobytes(), "little")
    for a in anchors.tolist():
        raised = top * -sum(x for x in a if x < 0)  # so that no field is below 0
        total = sum(map(mul, a, wide), raised * ones)
        fields = np.frombuffer(total.to_bytes(n * field.itemsize, "little"), field)
        shift = np.uint64((raised + bias * sum(a)) % 2**64)
        yield (fields.astype(np.uint64) - shift).view(np.int64)


def prepared(df: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column,
             scale: int) -> DataFrame:
    """(row, id, label, v, anchor) of the rows that take part; ``row`` tells them apart."""
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x)
                   | (F.abs(x.cast("double")) == float("inf")))

    def scaled(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < float(1 << 31), F.floor(y).cast("int")).otherwise(
            F.raise_error(F.lit("a scaled component is 2**31 or more")).cast("int"))

    return df.where(F.col(id_col).isNotNull() & label.isNotNull() & vector.isNotNull()
                    & ~bad).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"),
        label.cast("bigint").alias("label"), F.transform(vector, scaled).alias("v"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of integers, filled up with zeros to the longest."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _batch_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _to_blocks(size: int):
    """Arrow function: runs of ``size`` rows, by id within a run, as one row each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0

        def block(table: pa.Table) -> pa.RecordBatch:
            nonlocal made
            made += 1
            seq = (table.column("task")[0].as_py() << 32) + made
            table = table.drop(["task"]).sort_by([("id", "ascending"), ("row", "ascending")])
            return pa.RecordBatch.from_pydict({
                "seq": pa.array([seq], pa.int64()), "n": pa.array([table.num_rows], pa.int32()),
                "labels": pa.array([table.column("label").unique().to_pylist()],
                                   pa.list_(pa.int64())),
                "held": pa.array([_batch_bytes(table)], pa.binary())})
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size))
                held = table.slice(size).to_batches()
                rows -= size
        if rows:
            yield block(pa.Table.from_batches(held))

    return pack


def _blocks(rows: DataFrame, n: int, size: int, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` (``n``) as blocks of at most ``size`` rows by label and id, in parts.

    A part has blocks of about ``size`` rows together, however many partitions they come from.
    """
    order = [F.col("label"), F.col("id"), F.col("row")]
    dealt = rows.repartitionByRange(n // size + 1, *order).sortWithinPartitions(*order).withColumn(
        "task", F.spark_partition_id())
    blocks = scratch.write(dealt.mapInArrow(_to_blocks(size), _BLOCK), name)
    until = ranking.running_total(blocks.select("seq", "n"), [F.col("seq").asc()], "n", ["seq"],
                                  "until", blocks.count() // ranking.BUCKET_ROWS + 1,
                                  Scratch(rows.sparkSession, name))
    parts = until.select("seq", F.expr(f"cast((until - n) div {size} as int)").alias("part"))
    return scratch.write(blocks.join(parts, "seq"), f"{name}_parts")


def _cells(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(anchors of a part, rows of a part)`` for every pair (a, b) of parts."""
    left = anchors.join(pairs, anchors["part"] == pairs["a"]).select("a", "b", "held")
    others = pairs.toDF("of", "with")
    right = rows.join(others, rows["part"] == others["with"]).select("of", "with", "held")
    return left.groupBy("a", "b").cogroup(right.groupBy("of", "with")).applyInArrow(fn, schema)


def _table(group: pa.Table) -> pa.Table:
    """The rows of a part's blocks, by id."""
    held = [pa.ipc.open_stream(h).read_all() for h in group.column("held").to_pylist()]
    return pa.concat_tables(held).sort_by([("id", "ascending"), ("row", "ascending")]) \
        .combine_chunks()


def _fill(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def _find_positives(few: int):
    """Arrow function: the best ``few`` rows of its own label for each anchor of a cell."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "id": [], "score": []}
        a, b = _table(left), _table(right)
        a_label, a_row = (a.column(c).to_numpy() for c in ("label", "row"))
        b_label, b_row, b_id = (b.column(c).to_numpy() for c in ("label", "row", "id"))
        mine, theirs = _fill(_matrix(a.column("v").chunk(0)), _matrix(b.column("v").chunk(0)))
        for label in np.intersect1d(a_label, b_label):
            here, there = a_label == label, np.flatnonzero(b_label == label)
            for row, scores in zip(a_row[here], packed_scores(mine[here], theirs[there])):
                other = b_row[there] != row
                scores, ids = scores[other], b_id[there][other]
                best = np.argsort(-scores, kind="stable")[:few]
                out["anchor"] += [row] * len(best)
                out["id"] += ids[best].tolist()
                out["score"] += scores[best].tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return find


def _find_negatives(few: int, low: int, high: int):
    """Arrow function: for each anchor and positive, the best ``few`` rows of other labels
    with a score of ``low`` to ``high`` hundredths of the positive's."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id",
                 "negative_score")
        out: dict[str, list] = {n: [] for n in names}
        a, b = _table(left), _table(right)
        facts = list(zip(*(a.column(c).to_pylist() for c in ("row", "id", "label", "positives"))))
        b_label, b_id = (b.column(c).to_numpy() for c in ("label", "id"))
        asked = np.array([(b_label != f[2]).any() for f in facts])
        mine, theirs = _fill(_matrix(a.column("v").chunk(0)), _matrix(b.column("v").chunk(0)))
        for (row, own, label, found), scores in zip(
                (f for f, q in zip(facts, asked) if q), packed_scores(mine[asked], theirs)):
            other = np.flatnonzero(b_label != label)
            order = other[np.argsort(-scores[other], kind="stable")]
            falling = -scores[order]
            for p in found:
                least, most = -(-low * p["score"] // 100), high * p["score"] // 100
                at = int(np.searchsorted(falling, -most, "left"))
                end = min(at + few, int(np.searchsorted(falling, -least, "right")))
                for i in order[at:end].tolist():
                    for name, value in zip(names, (row, own, p["place"], p["id"], p["score"],
                                                   int(b_id[i]), int(scores[i]))):
                        out[name].append(value)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return find


def _ranked(rows: DataFrame, keys: list[str], score: str, least: str, few: int,
            place: str) -> DataFrame:
    """The first ``few`` rows of each key by score, then id."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(least))
    return rows.withColumn(place, F.row_number().over(order)).where(F.col(place) <= few)


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                   label: Column | None = None, anchor: Column | None = None,
                   scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30,
                   high: int = 90, rows_a_block: int = ROWS_A_BLOCK,
                   anchors_a_block: int = ANCHORS_A_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label`` and ``anchor`` are expressions over ``df`` (the columns ``label`` and ids that
    100 divides by default). An anchor's positives are its best other rows of the same label;
    negatives have another label and ``low * positive <= 100 * negative <= high * positive``.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "negatives")
    label = F.col("label") if label is None else label
    anchor = F.col(id_col) % 100 == 0 if anchor is None else anchor
    rows = scratch.write(prepared(df, id_col, vector_col, label, anchor, scale), "rows")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("anchor"), 1))
                      .alias("anchors")).first()
    row_blocks = _blocks(rows.select("row", "id", "label", "v"), counts["n"], rows_a_block,
                         scratch, "row_blocks")
    asked = rows.where("anchor").select("row", "id", "label", "v")
    anchor_blocks = _blocks(asked, counts["anchors"], anchors_a_block, scratch, "anchor_blocks")

    def labels(blocks: DataFrame, name: str) -> DataFrame:
        return blocks.select(F.col("part").alias(name), F.explode("labels").alias("label"))

    sharing = labels(anchor_blocks, "a").join(labels(row_blocks, "b"), "label") \
        .select("a", "b").distinct()
    best = _cells(anchor_blocks, row_blocks, sharing, _find_positives(positives),
                  "anchor bigint, id bigint, score bigint")
    chosen = _ranked(best, ["anchor"], "score", "id", positives, "place")
    found = scratch.write(chosen.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(
        F.collect_list(F.struct(F.col("place").cast("bigint").alias("place"), "id", "score")))
        .alias("positives")), "positives")

    asking = _blocks(asked.join(found, "row"), counts["anchors"], anchors_a_block, scratch,
                     "asking_blocks")
    last = row_blocks.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    # every part of anchors with every part of rows: the stated query set, in blocks
    grid = asking.select(F.col("part").alias("a")).distinct().select(
        "a", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("b"))
    hard = _cells(asking, row_blocks, grid, _find_negatives(negatives, low, high),
                  "anchor bigint, anchor_id bigint, place bigint, positive_id bigint, "
                  "positive_score bigint, negative_id bigint, negative_score bigint")
    return _ranked(hard, ["anchor", "place"], "negative_score", "negative_id", negatives,
                   "rank").select("anchor_id", "positive_id", "rank", "negative_id",
                                  "positive_score", "negative_score")
