"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

1. **Sketch.** A document is the set of hashes of its word shingles. Its sketch has
   ``t`` bins. In rounds ``0 .. t-1`` every shingle falls into one hashed bin, in round
   ``t + k`` all fall into bin ``k``; a bin keeps the least (round, hash) that reaches
   it, and a document is done when all its bins are full. So every coordinate fills,
   usually within a few rounds, and agreement concentrates as for independent minima.
2. **Banding.** ``bands`` bands of ``rows`` coordinates; documents that agree in a band
   are candidates. Documents with equal sets are one node from here on.
3. **Verification.** Candidate clusters (components of the band graph) are compared on
   full shingle sets. Clusters up to ``block`` nodes are compared in one group. Larger
   ones are first compared with their leader, then in pairs of blocks, leaving out
   pairs of blocks that the leader already links and pairs whose distances to the
   leader differ by more than the allowed distance (Jaccard distance is a metric).
   No pair of documents is ever a row.
4. **Components** of the confirmed links.

A link at similarity ``s`` is missed with probability ``(1 - s**rows)**bands``, and only
when no other candidate joins the two clusters: 2e-7 at 0.85 for 8 rows and 48 bands,
2e-6 at 0.8 for 7 rows and 56 bands. Shingles are compared by 64-bit hashes.

Defined cases: null and empty texts, and texts without words, have an empty set, are
linked with nothing and stay. Rows without id are not linked and stay. Rows with equal
ids are one node; equal texts are linked. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrun.llm.arrow import byte_values, restored, slices, stored
from millrun.llm.components import connected
from millrun.session import Scratch

BLOCK_BYTES = 4 << 20  # of text in a block of stored rows
BLOCK_BITS, ROW_BITS = 24, 16  # blocks of a task and rows of a block have numbers of so many bits
_SIGNED = "id bigint, n_shingles bigint, set_key binary, bands array<bigint>"
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingles(raw: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a text, A-Z lower-cased.

    With fewer words the whole sequence is the one shingle; without words none.
    """
    words = (raw or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(size, len(words))
    n = len(words) - span + 1
    out = np.full(n, span, dtype=np.uint64)
    for k in range(span):
        out = mix(out * _GOLD + h[k:k + n])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of ``t`` coordinates for each (non-empty) set."""
    n = len(sets)
    out = np.full(n * t, _FULL, dtype=np.uint64)
    if not n:
        return out.reshape(0, t)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    open_docs = np.arange(n)
    for rnd in range(2 * t):
        x = mix(values + np.uint64(int(_GOLD) * (rnd + 1) & 0xFFFFFFFFFFFFFFFF))
        if rnd < t:
            bins = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        else:
            bins = rnd - t
        np.minimum.at(out, owner * t + bins,
                      np.uint64(rnd) << np.uint64(52) | (x * _M2) >> np.uint64(12))
        still = open_docs[(out.reshape(n, t)[open_docs] == _FULL).any(axis=1)]
        if len(still) < len(open_docs):
            if not len(still):
                break
            flag = np.zeros(n, dtype=bool)
            flag[still] = True
            mine = flag[owner]
            values, owner, open_docs = values[mine], owner[mine], still
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each document and band."""
    cells = sketch[:, :bands * rows].reshape(len(sketch), bands, rows)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sketch), bands))
    for k in range(rows):
        keys = mix(keys * _GOLD + cells[:, :, k])
    return keys.view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, size: int, bands: int,
               rows: int) -> DataFrame:
    """(id, n_shingles, set_key binary, bands array); key and bands null for empty sets."""
    src = df.select(F.col(id_col).cast("bigint").alias("id"),
                    F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", max_bytes=4 << 20):
            yield _signed(batch, size, bands, rows)

    return src.mapInArrow(run, _SIGNED)


def _signed(batch: pa.RecordBatch, size: int, bands: int, rows: int) -> pa.RecordBatch:
    """The signatures of a batch of (id, text)."""
    sets = [shingles(t, size) for t in byte_values(batch.column("text"))]
    full = [s for s in sets if len(s)]
    keys = iter(band_keys(sketches(full, bands * rows), bands, rows).tolist())
    return pa.RecordBatch.from_arrays([
        batch.column("id"),
        pa.array([len(s) for s in sets], pa.int64()),
        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                 pa.binary()),
        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
    ], ["id", "n_shingles", "set_key", "bands"])


class _Sets:
    """Shingle sets of a group, ready to be intersected with one set at a time."""

    def __init__(self, sets: list[np.ndarray], vocabulary: np.ndarray):
        self.ids = [np.searchsorted(vocabulary, s) for s in sets]
        self.sizes = np.array([len(s) for s in sets])
        self.flat = np.concatenate(self.ids)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])


def _links(a: _Sets, b: _Sets, flag: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Positions in ``b`` whose set is similar enough to set ``k`` of ``a``."""
    flag[a.ids[k]] = 1
    common = np.add.reduceat(flag[b.flat], b.starts)
    flag[a.ids[k]] = 0
    return np.flatnonzero(100 * common >= percent * (a.sizes[k] + b.sizes - common))


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def forest(nodes: list[int], sets: list[np.ndarray], left: list[int], right: list[int],
           joined: list[bool], percent: int) -> list[tuple[int, int]]:
    """Edges from each member to the first one it is linked with, by way of others or not.

    Links are looked for between the members ``left`` and ``right`` of a group; those
    flagged in ``joined`` are known to be linked with each other.
    """
    vocabulary = np.unique(np.concatenate(sets))
    flag = np.zeros(len(vocabulary), dtype=np.int64)
    a, b = (_Sets([sets[i] for i in side], vocabulary) for side in (left, right))
    parent, first = list(range(len(nodes))), None

    def join(i: int, j: int) -> None:
        x, y = _find(parent, i), _find(parent, j)
        parent[max(x, y)] = min(x, y)

    for i, known in enumerate(joined):
        if i and nodes[i] == nodes[i - 1]:  # rows with equal ids
            join(i, i - 1)
        if known:
            first = i if first is None else first
            join(i, first)
    for k, i in enumerate(left):
        for j in (right[x] for x in _links(a, b, flag, k, percent)):
            join(i, j)
    return [(n, nodes[_find(parent, i)]) for i, n in enumerate(nodes) if parent[i] != i]


def _texts_of(df: DataFrame, id_col: str, text_col: str, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given nodes.

    Their number grows with the documents, so they are not to be broadcast.
    """
    texts = df.select(F.col(id_col).cast("bigint").alias("node"),
                      F.col(text_col).cast("string").alias("text")).where("node is not null")
    return texts.join(nodes.select("node").hint("merge"), "node")


def _sets_of(table: pa.Table, size: int) -> tuple[list[int], list[np.ndarray]]:
    """Nodes, ascending, and their sets; ``table`` must be sorted by node."""
    return (table.column("node").to_pylist(),
            [shingles(t, size) for t in byte_values(table.column("text").combine_chunks())])


def _by_cluster(table: pa.Table) -> Iterator[pa.Table]:
    table = table.sort_by([("cluster", "ascending"), ("node", "ascending")])
    clusters = table.column("cluster").to_numpy()
    cuts = np.flatnonzero(clusters[1:] != clusters[:-1]) + 1
    for start, stop in zip([0, *cuts], [*cuts, len(clusters)]):
        yield table.slice(start, stop - start)


def _edge_table(edges: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()),
                     "b": pa.array([e[1] for e in edges], pa.int64())})


def _small_links(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links inside clusters that are compared whole; ``unit`` groups many of them."""
    def run(table: pa.Table) -> pa.Table:
        edges = []
        for cluster in _by_cluster(table):
            nodes, sets = _sets_of(cluster, size)
            keep = [i for i, s in enumerate(sets) if len(s)]
            if len(keep) > 1:
                nodes, sets = [nodes[i] for i in keep], [sets[i] for i in keep]
                every = list(range(len(nodes)))
                edges += forest(nodes, sets, every, every, [False] * len(nodes), percent)
        return _edge_table(edges)

    return members.groupBy("unit").applyInArrow(run, "a bigint, b bigint")


def _leader_likeness(members: DataFrame, size: int) -> DataFrame:
    """(node, cluster, shared, total): intersection and union of its set and its leader's."""
    def run(table: pa.Table) -> pa.Table:
        nodes, sets = _sets_of(table, size)
        cluster = table.column("cluster")[0].as_py()
        leader = sets[nodes.index(cluster)]
        shared = [len(np.intersect1d(s, leader, assume_unique=True)) for s in sets]
        return pa.table({
            "node": pa.array(nodes, pa.int64()),
            "cluster": pa.array([cluster] * len(nodes), pa.int64()),
            "shared": pa.array(shared, pa.int64()),
            "total": pa.array([len(s) + len(leader) - n for s, n in zip(sets, shared)],
                              pa.int64())})

    return members.groupBy("cluster", "chunk").applyInArrow(
        run, "node bigint, cluster bigint, shared bigint, total bigint")


def _tile_links(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the two blocks of each tile (or inside its one block)."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes, sets = _sets_of(table, size)
        side = table.column("side").to_pylist()
        left = [i for i, s in enumerate(side) if s <= 0 and len(sets[i])]
        right = [i for i, s in enumerate(side) if s >= 0 and len(sets[i])]
        if not left or not right:
            return _edge_table([])
        return _edge_table(forest(nodes, sets, left, right,
                                  table.column("linked").to_pylist(), percent))

    return members.groupBy("tile").applyInArrow(run, "a bigint, b bigint")


def _large_links(texts: DataFrame, large: DataFrame, scratch: Scratch, size: int, percent: int,
                 block: int) -> DataFrame:
    """Links inside clusters of more than ``block`` nodes (node, cluster, n)."""
    spread = large.where("node <> cluster").select(
        "node", "cluster", F.expr(f"pmod(xxhash64(node), n div {block} + 1)").alias("chunk"))
    leaders = large.where("node = cluster").select(
        "node", "cluster", F.explode(F.expr(f"sequence(0L, n div {block})")).alias("chunk"))
    likeness = scratch.write(
        _leader_likeness(texts.join(spread.unionByName(leaders), "node"), size)
        .groupBy("node", "cluster").agg(F.max("shared").alias("shared"),
                                        F.min("total").alias("total")), "likeness")
    linked = F.expr(f"100 * shared >= {percent} * total")
    star = likeness.where(linked).select(F.col("node").alias("a"), F.col("cluster").alias("b"))

    # blocks of nodes with like distances to the leader; links of the same block stay whole
    binned = likeness.select("node", "cluster", linked.alias("linked"),
                             F.expr("(20 * shared) div greatest(total, 1)").alias("bin"))
    sizes = binned.groupBy("cluster", "linked", "bin").agg(F.count("*").alias("in_bin"))
    blocks = scratch.write(
        binned.join(scratch.write(sizes, "bins"), ["cluster", "linked", "bin"])
        .withColumn("block", F.struct("linked", "bin", F.expr(
            f"pmod(xxhash64(node, 7), in_bin div {block} + 1)").alias("part")))
        .select("node", "cluster", "linked", "block"), "blocks")
    names = blocks.select("cluster", "block").distinct()
    other = names.select("cluster", F.col("block").alias("other"))
    apart = F.abs(F.col("block.bin") - F.col("other.bin")) - 1  # twentieths at least
    tiles = scratch.write(
        names.join(other, "cluster").where(F.col("block") <= F.col("other"))
        .where(~(F.col("block.linked") & F.col("other.linked")))
        .where(100 * apart <= 20 * (100 - percent))
        .withColumn("tile", F.xxhash64("cluster", "block", "other")), "tiles")
    same = F.col("block") == F.col("other")
    sides = tiles.select(
        "cluster", "block", "tile", F.when(same, 0).otherwise(-1).alias("side")
    ).unionByName(tiles.where(~same).select(
        "cluster", F.col("other").alias("block"), "tile", F.lit(1).alias("side")))
    members = blocks.join(sides, ["cluster", "block"]).select("node", "linked", "tile", "side")
    return star.unionByName(_tile_links(texts.join(members, "node"), size, percent))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = 5, percent: int = 80, bands: int = 56, rows: int = 7,
                    block: int = 256, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``df``.

    Documents with ``100 * intersection >= percent * union`` of their shingle sets are
    linked; ``component_id`` is the least id reachable, ``kept`` whether that is the own.
    The result reads tables of ``scratch``.
    """
    scratch = scratch or Scratch(df.sparkSession, "neardup")
    signed = scratch.write(signatures(df, id_col, text_col, size, bands, rows), "signatures")
    return _grouped(signed, lambda nodes: _texts_of(df, id_col, text_col, nodes), size, percent,
                    block, scratch).withColumnRenamed("id", id_col)


def _grouped(signed: DataFrame, texts_of: Callable[[DataFrame], DataFrame], size: int,
             percent: int, block: int, scratch: Scratch) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of the written ``signed``.

    ``texts_of`` gives the (node, text) of a table of nodes.
    """
    usable = signed.where("set_key is not null and id is not null")
    nodes = scratch.write(
        usable.groupBy("set_key").agg(F.min("id").alias("node"),
                                      F.first("bands").alias("bands")), "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    leaders = scratch.write(
        keyed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
        .where("leader <> last").select("key", "leader"), "leaders")
    candidates = connected(
        keyed.join(leaders, "key").select(F.col("node").alias("a"), F.col("leader").alias("b")),
        scratch, "clusters").withColumnRenamed("component", "cluster")
    clusters = scratch.write(candidates, "clusters")
    counted = scratch.write(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
    sized = scratch.write(clusters.join(counted, "cluster"), "sized")
    totals = sized.agg(F.sum(F.when(F.col("n") <= block, 1)).alias("small"),
                       F.sum(F.when(F.col("n") > block, 1)).alias("large")).first()
    component = clusters.select("node", F.col("node").alias("component")).limit(0)
    if totals["small"] or totals["large"]:
        texts = scratch.write(texts_of(clusters), "texts")
    if totals["small"]:  # a cluster is compared whole, so its stars are components
        units = totals["small"] // (block // 2) + 1
        small = sized.where(F.col("n") <= block).select(
            "node", "cluster", F.expr(f"pmod(xxhash64(cluster), {units})").alias("unit"))
        component = component.unionByName(
            _small_links(texts.join(small, "node"), size, percent).toDF("node", "component"))
    if totals["large"]:
        links = _large_links(texts, sized.where(F.col("n") > block), scratch, size, percent, block)
        component = component.unionByName(
            connected(scratch.write(links, "links"), scratch, "components"))
    component = component.groupBy("node").agg(F.min("component").alias("component"))
    labelled = scratch.write(
        nodes.select("set_key", "node").join(component, "node", "left")
        .select("set_key", F.coalesce("component", "node").alias("component")), "labelled")
    label = F.coalesce("component", "id")
    return (signed.select("id", "n_shingles", "set_key").join(labelled, "set_key", "left")
            .select("id", "n_shingles", label.alias("component_id"),
                    F.col("id").eqNullSafe(label).alias("kept")))


def _stored_rows(df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(block, ids, body): the rows in compressed blocks, written once.

    Row ``i`` of a block has the number ``block << ROW_BITS | i``; numbers rise with the
    partitions and along each.
    """
    n_bytes = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0))
    src = df.select("*", F.col(id_col).alias("__id"), n_bytes.alias("__bytes"))
    kind = src.schema["__id"].dataType.simpleString()

    def run(batches):
        number = TaskContext.get().partitionId() << BLOCK_BITS
        kept, size, n_rows = [], 0, 0

        def row():
            ids = pa.concat_arrays([b.column("__id") for b in kept])
            body = stored([b.drop_columns(["__id", "__bytes"]) for b in kept])
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids),
                 pa.array([body], pa.binary())], ["block", "ids", "body"])

        for batch in batches:
            start = 0
            for i, more in enumerate(batch.column("__bytes").to_pylist()):
                if n_rows and (size + more > BLOCK_BYTES or n_rows >> ROW_BITS):
                    if i > start:
                        kept.append(batch.slice(start, i - start))
                    yield row()
                    number, kept, size, n_rows, start = number + 1, [], 0, 0, i
                size, n_rows = size + more, n_rows + 1
            if batch.num_rows > start:
                kept.append(batch.slice(start))
        if kept:
            yield row()

    return scratch.write(src.mapInArrow(
        run, f"block bigint, ids array<{kind}>, body binary"), "blocks")


def _rows_of(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """(block, body, chosen): the blocks with some of ``numbers`` (``__row``), and which.

    Both sides grow with the documents, so neither is to be broadcast.
    """
    chosen = numbers.groupBy(F.shiftright("__row", ROW_BITS).alias("block")).agg(
        F.collect_list("__row").alias("chosen"))
    return blocks.select("block", "body").join(chosen.hint("merge"), "block")


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Table]]:
    """Numbers and rows of each stored block: the chosen ones where that column is."""
    for batch in batches:
        chosen = batch.column("chosen") if "chosen" in batch.schema.names else None
        for k in range(batch.num_rows):
            first = batch.column("block")[k].as_py() << ROW_BITS
            table = restored(batch.column("body")[k].as_py())
            at = np.arange(table.num_rows) if chosen is None else np.sort(
                chosen[k].values.to_numpy()) - first
            if chosen is not None:
                table = table.take(pa.array(at))
            yield pa.array(first + at, pa.int64()), table.combine_chunks()


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
             percent: int = 80, bands: int = 56, rows: int = 7, block: int = 256) -> DataFrame:
    """One row of ``df`` of each group, the one with the least id, all columns as they were.

    Rows are numbered in written blocks and linked by that number, so rows that share an id
    or have none are rows of their own: of exact copies one stays, texts that aren't alike
    all stay. A row without id comes after those with one. Only compressed blocks are
    exchanged to get at the texts of some rows.
    """
    spark = df.sparkSession
    own, work = Scratch(spark, "kept"), Scratch(spark, "neardup")
    blocks = _stored_rows(df, id_col, text_col, own)
    text_at = df.columns.index(text_col)

    def texts(table: pa.Table) -> pa.Array:
        return table.column(text_at).combine_chunks().cast(pa.string())

    def sign(batches):
        for numbers, table in _restored(batches):
            part = pa.RecordBatch.from_arrays([numbers, texts(table)], ["id", "text"])
            for some in slices([part], "text", max_bytes=BLOCK_BYTES):
                yield _signed(some, size, bands, rows)

    def pick(batches):
        for numbers, table in _restored(batches):
            yield pa.RecordBatch.from_arrays([numbers, texts(table)], ["node", "text"])

    def whole(batches):
        for _, table in _restored(batches):
            yield from table.to_batches()

    signed = work.write(blocks.select("block", "body").mapInArrow(sign, _SIGNED), "signatures")
    found = _grouped(
        signed, lambda nodes: _rows_of(blocks, nodes.select(F.col("node").alias("__row")))
        .mapInArrow(pick, "node bigint, text string"), size, percent, block, work)
    ids = blocks.select("block", F.posexplode("ids").alias("at", "__id")).select(
        (F.shiftleft("block", ROW_BITS) + F.col("at")).alias("__row"), "__id")
    first = F.min(F.struct(F.col("__id").isNull().alias("last"), "__id", "__row"))
    kept = own.write(
        found.select(F.col("id").alias("__row"), "component_id").join(ids, "__row")
        .groupBy("component_id").agg(first.alias("f")).select(F.col("f.__row").alias("__row")),
        "ids")
    work.clear()
    return _rows_of(blocks, kept).mapInArrow(whole, T.StructType(df.schema.fields))
