"""SimHash fingerprints and search within a Hamming radius, with DataFrame functions only.

Terms are the words of a text; every occurrence votes with the bits of its hashes, and
words of more than three characters with one vote more for each further character. A bit
of the fingerprint is set where more than half of the votes are. The votes of 64 bits are
added in 32 integers of two 32-bit lanes (a text has no more votes than characters), in
a partial aggregate before any exchange, so a long text doesn't reach one task word by
word.

:func:`near_prints` finds all fingerprints near given ones with permuted block tables:
a fingerprint's bits are cut into blocks, and of any two fingerprints that differ in at
most ``radius`` bits at least ``blocks - radius`` blocks agree; there is a table for each
choice of so many blocks. Queries are probed, then distances are computed in full. Only
distinct fingerprints are in the tables, so pairs are between classes of rows with equal
fingerprints; which rows those are is told by the fingerprint itself.

Defined cases: a null text is empty; texts without words have the fingerprint of all
zeros; rows without id have no neighbour (their edited columns are null); of rows with
equal ids the least text is the neighbour's; rows that repeat are counted and come back as
often; very long texts are split into words in their row, the votes are added up before any
exchange; an empty table gives an empty result; other columns have any name.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrun.operators import ranking
from millrun.session import Scratch

_LANES = 0x0000000100000001


def _words(text: Column) -> Column:
    return F.split(F.translate(text, "\t\n\r\x0b\x0c", "     "), " ")


def fingerprints(df: DataFrame, keys: list[str], text_col: str, words: int = 2) -> DataFrame:
    """``keys`` (which tell rows apart), ``f0 .. f{words-1}`` of 64 bits each, and ``copies``,
    the rows with these keys (whose texts are equal)."""
    term = F.col("term")
    weight = F.greatest(F.length(term) - 3, F.lit(0))
    hashed = df.select(*keys, F.posexplode_outer(_words(F.col(text_col))).alias(
        "word", "term")).select(
        *keys, F.when(F.coalesce("word", F.lit(0)) == 0, 1).otherwise(0).alias("first"),
        F.when(term != "", weight + 1).otherwise(0).cast("bigint").alias("w"),
        *[F.xxhash64(term, F.lit(k)).alias(f"h{k}") for k in range(words)])
    votes = hashed.groupBy(*keys).agg(
        F.sum("first").alias("copies"), F.coalesce(F.sum("w"), F.lit(0)).alias("n"),
        *[F.coalesce(F.sum(F.shiftright(f"h{k}", s).bitwiseAND(F.lit(_LANES)) * F.col("w")),
                     F.lit(0)).alias(f"v{k}_{s}") for k in range(words) for s in range(32)])

    def bits(w: int) -> Column:
        out = F.lit(0).cast("bigint")
        for s in range(32):
            low = F.col(f"v{w}_{s}").bitwiseAND(F.lit(0xFFFFFFFF))
            high = F.shiftrightunsigned(f"v{w}_{s}", 32)
            for place, count in ((s, low), (s + 32, high)):
                value = (1 << place) - (1 << 64 if place == 63 else 0)
                out = out.bitwiseOR(F.when(2 * count > F.col("n"), F.lit(value).cast("bigint"))
                                    .otherwise(F.lit(0).cast("bigint")))
        return out

    return votes.select(*keys, "copies", *[bits(w).alias(f"f{w}") for w in range(words)])


def distance(a: list[Column], b: list[Column]) -> Column:
    """Bits that differ between two fingerprints."""
    total = F.lit(0)
    for x, y in zip(a, b):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def as_text(parts: list[Column]) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(p), 16, "0") for p in parts]))


def block_keys(parts: list[Column], blocks: int, radius: int) -> Column:
    """One key for each permuted table: a choice of ``blocks - radius`` blocks and their bits."""
    bits = 64 * len(parts)
    edges = [bits * i // blocks for i in range(blocks + 1)]

    def block(i: int) -> list[Column]:
        out = []
        for w, part in enumerate(parts):
            lo, hi = max(edges[i], 64 * w) - 64 * w, min(edges[i + 1], 64 * (w + 1)) - 64 * w
            if lo < hi:
                mask = (1 << (hi - lo)) - 1
                cut = F.shiftrightunsigned(part, lo) if lo else part
                out.append(cut if hi - lo == 64 else cut.bitwiseAND(F.lit(mask)))
        return out

    return F.array(*[F.xxhash64(F.lit(t), *[c for i in chosen for c in block(i)])
                     for t, chosen in enumerate(combinations(range(blocks), blocks - radius))])


def near_prints(queries: DataFrame, table: DataFrame, parts: list[str], radius: int = 3,
                blocks: int = 5) -> DataFrame:
    """(q_*, t_*, distance): the distinct fingerprints of ``table`` near one of ``queries``.

    A query's own fingerprint is among them, at distance 0, where the table has it.
    """
    def keyed(df, prefix):
        return (df.select(*[F.col(p).alias(f"{prefix}_{p}") for p in parts]).distinct()
                .withColumn("key", F.explode(block_keys(
                    [F.col(f"{prefix}_{p}") for p in parts], blocks, radius))))

    q = [F.col(f"q_{p}") for p in parts]
    t = [F.col(f"t_{p}") for p in parts]
    return (keyed(queries, "q").join(keyed(table, "t"), "key")
            .withColumn("distance", distance(q, t)).where(F.col("distance") <= radius)
            .select(*q, *t, "distance").distinct())


def neighbour_counts(rows: DataFrame, asked: Column, parts: list[str], scratch: Scratch,
                     radius: int = 3, blocks: int = 5) -> DataFrame:
    """``parts`` and n_near: for the fingerprints of the rows ``asked`` for, how many other
    rows are within ``radius`` bits."""
    prints = scratch.write(rows.groupBy(*parts).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(asked).alias("asked")), "prints")
    near = near_prints(prints.where("asked"), prints, parts, radius, blocks)
    held = prints.select(*[F.col(p).alias(f"t_{p}") for p in parts], "n")
    return (near.join(held, [f"t_{p}" for p in parts])
            .groupBy(*[F.col(f"q_{p}").alias(p) for p in parts])
            .agg((F.sum("n") - 1).alias("n_near")))


def next_ids(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``ids`` (distinct ``id``, more columns) with ``next_id``: the next lower id, at last the first.

    Ids are dealt into ranges; only one row a range meets in one task.
    """
    n = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")),
            ids.count() // ranking.BUCKET_ROWS + 1)
    ranged = scratch.write(ids.repartitionByRange(n, F.col("id").desc())
                           .withColumn("range", F.spark_partition_id()), "ranges")
    heads = ranged.groupBy("range").agg(F.max("id").alias("head"))
    order = Window.orderBy("range")
    after = heads.select("range", F.coalesce(
        F.lead("head").over(order),
        F.max("head").over(Window.orderBy(F.lit(1)))).alias("after"))
    inside = Window.partitionBy("range").orderBy(F.col("id").desc())
    return (ranged.withColumn("in_range", F.lead("id").over(inside)).join(after, "range")
            .withColumn("next_id", F.coalesce("in_range", "after"))
            .drop("range", "in_range", "after"))


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = 2, asked: Column | None = None, radius: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last third of the characters replaced by as many from the
    start of the next document (descending id). Returns (id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, n_near); ``n_near`` is the number
    of other rows within ``radius`` bits, for the rows ``asked`` for by an expression over
    ``id`` (by default ids that 20 divides), else null.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    docs = df.select(F.col(id_col).cast("bigint").alias("id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = docs.where("id is not null")
    chain = scratch.write(next_ids(scratch.write(
        known.groupBy("id").agg(F.max(F.expr("length(text) div 3")).alias("take")), "ids"),
        scratch), "chain")
    givers = (known.join(chain.select(F.col("next_id").alias("id"), F.col("id").alias("to"),
                                      "take"), "id")
              .groupBy("id", "to", "take").agg(F.min("text").alias("text"))
              .select(F.col("to").alias("id"), F.expr(
                  "substring(text, 1, cast(take as int))").alias("given")))
    # rows without id are told apart by their place in the table, which no exchange precedes
    paired = known.join(givers, "id").withColumn("place", F.lit(0).cast("bigint")).unionByName(
        docs.where("id is null").select("*", F.lit(None).cast("string").alias("given"),
                                        F.monotonically_increasing_id().alias("place")))
    third = "length(text) div 3"
    edited = paired.select(
        "id", "place", F.length("text").cast("bigint").alias("n_chars"), "text",
        F.expr(f"concat(substring(text, 1, cast(length(text) - {third} as int)), "
               f"substring(given, 1, cast({third} as int)))").alias("edited"))
    # a row is told by its id and text: rows that repeat are counted, votes of both doubled
    own = ["id", "place", "n_chars", "edited_sha256", "text_a", "text_b"]
    both = edited.select(
        "id", "place", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.xxhash64("text", F.lit(1)).alias("text_a"), F.xxhash64("text", F.lit(2)).alias("text_b"),
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
                          F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body"))))
        .alias("x")).select(*own, "x.kind", "x.body")
    parts = [f"f{w}" for w in range(words)]
    found = fingerprints(both, [*own, "kind"], "body", words)
    rows = scratch.write(
        found.groupBy(*own).agg(
            F.max("copies").alias("copies"),
            *[F.max(F.when(F.col("kind") == 0, F.col(p))).alias(p) for p in parts],
            *[F.max(F.when(F.col("kind") == 1, F.col(p))).alias(f"e{p}") for p in parts])
        .withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
        .select("id", "n_chars", "edited_sha256", *parts, *[f"e{p}" for p in parts]),
        "fingerprints")
    following = (rows.where("id is not null").groupBy("id").agg(
        *[F.min(p).alias(f"n{p}") for p in parts])
        .join(chain.select(F.col("next_id").alias("id"), F.col("id").alias("to")), "id")
        .drop("id").withColumnRenamed("to", "id"))
    asked = F.coalesce(F.col("id") % 20 == 0 if asked is None else asked, F.lit(False))
    counts = scratch.write(neighbour_counts(rows, asked, parts, scratch, radius), "neighbours")

    def likeness(prefix: str) -> Column:
        return 1 - distance([F.col(p) for p in parts],
                            [F.col(prefix + p) for p in parts]) / (64.0 * words)

    no_next = F.col("id").isNull()
    return (rows.join(following, "id", "left").join(counts, parts, "left").select(
        F.col("id").alias(id_col), "n_chars",
        F.when(~no_next, F.col("edited_sha256")).alias("edited_sha256"),
        as_text([F.col(p) for p in parts]).alias("fingerprint"),
        F.when(~no_next, as_text([F.col(f"e{p}") for p in parts])).alias("edited_fingerprint"),
        F.when(~no_next, likeness("e")).alias("near_edited"), likeness("n").alias("near_next"),
        F.when(asked, F.col("n_near")).alias("n_near")))
