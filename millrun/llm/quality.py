"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's score is the sum of shared weights of its hashed features (its distinct
words, and bins of how many of its characters are capitals, digits, marks and so on).
Ordered thresholds cut the score into grades:

    P(grade >= k) = sigmoid(score - threshold[k])

Weights and thresholds are fitted together by maximum likelihood with a ridge penalty on
at most about ``max_labelled`` labelled documents, chosen by a hash of their id. Only
features in enough of them get a weight. Scores give the expected grade and the
probability of the top grades, by which documents are selected.

Ratings here: 0 for poor, 1 for good but toxic, 2 for good.

Defined cases: a null text is empty and scored by its (empty) features; of several
ratings of a document the lowest counts; unrated documents don't train; without any
rating, or with one grade only, everything is kept and scores are null; very long texts are
read whole, one at a time; repeated rows are scored each; ids may be null; an empty table
gives an empty result; other columns have any name.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrun.llm.arrow import byte_values, slices
from millrun.session import Scratch

DIMENSIONS = 1 << 18
_MARKS = b".,;:!?\"'()"
_CLASSES = [bytes(range(0x41, 0x5B)), b"0123456789", b"!", b"|", b"#*$%&<>", b"@:/=\"_", b"\n",
            b".,;?'()"]


def text_features(raw: bytes | None) -> np.ndarray:
    """Distinct hashed features of a text, ascending."""
    raw = raw or b""
    words = raw.lower().split()
    distinct = set(words)
    out = {zlib.crc32(w.strip(_MARKS)) for w in distinct}
    size = max(1, len(raw))
    for i, members in enumerate(_CLASSES):
        share = (len(raw) - len(raw.translate(None, members))) / size
        # bins by powers of two: 0, up to 1/512, ... up to 1
        level = 0 if not share else max(1, 10 + int(np.ceil(np.log2(share))))
        out.add(zlib.crc32(b"class", i * 64 + level + 1))
    fresh = len(distinct) / max(1, len(words))
    out.add(zlib.crc32(b"fresh", int(10 * fresh) + 1))
    out.add(zlib.crc32(b"words", min(16, len(words)).bit_length() + 1))
    return np.unique(np.fromiter((h % DIMENSIONS for h in out), dtype=np.int32, count=len(out)))


@dataclass
class OrdinalModel:
    """Weights of all hashed features and the ascending thresholds of the grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, features: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        score = float(self.weights[features].sum())
        return 1.0 / (1.0 + np.exp(self.thresholds - score))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, dimensions: int = DIMENSIONS,
                min_rows: int = 3, ridge: float = 1.0, steps: int = 300) -> OrdinalModel | None:
    """Maximum likelihood by gradient steps with adaptive rates; None with one grade only."""
    levels = int(grades.max(initial=0))
    if len(np.unique(grades)) < 2:
        return None
    flat = np.concatenate(rows)
    seen = np.bincount(flat, minlength=dimensions)
    index = np.full(dimensions, -1)
    used = np.flatnonzero((seen >= min_rows) & (seen < len(rows)))
    index[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = index[flat]
    owner, column = owner[column >= 0], column[column >= 0]
    n, k = len(rows), len(used)
    shares = np.array([np.clip((grades >= g).mean(), 1e-3, 1 - 1e-3)
                       for g in range(1, levels + 1)])
    cuts = -np.log(shares / (1 - shares))
    # thresholds = first, then first plus exp(gaps): always in order
    gaps = np.log(np.maximum(np.diff(cuts), 1e-2))
    params = np.concatenate([np.zeros(k), cuts[:1], gaps])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    below = grades - 1  # threshold that the grade is above, or -1
    for step in range(1, steps + 1):
        w, first, gap = params[:k], params[k], np.exp(params[k + 1:])
        cuts = first + np.concatenate([[0.0], np.cumsum(gap)])
        score = np.bincount(owner, weights=w[column], minlength=n)
        up = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -40, 40)))
        low = np.where(below >= 0, up[np.arange(n), np.maximum(below, 0)], 1.0)
        high = np.where(grades < levels, up[np.arange(n), np.minimum(grades, levels - 1)], 0.0)
        p = np.maximum(low - high, 1e-12)
        d_low = low * (1 - low) / p  # both are 0 where the grade has no such threshold
        d_high = high * (1 - high) / p
        d_score = -(d_low - d_high)
        d_cuts = np.zeros(levels)
        np.add.at(d_cuts, np.maximum(below, 0), np.where(below >= 0, d_low, 0.0))
        np.add.at(d_cuts, np.minimum(grades, levels - 1), np.where(grades < levels, -d_high, 0.0))
        after = np.cumsum(d_cuts[::-1])[::-1]
        grad = np.concatenate([
            np.bincount(column, weights=d_score[owner], minlength=k) + ridge * w,
            after[:1], after[1:] * gap]) / n
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        rate = 0.1 / (1 + 3 * step / steps)
        params -= rate * (mean / (1 - 0.9 ** step)) / (
            np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros(dimensions, dtype=np.float32)
    weights[used] = params[:k]
    cuts = params[k] + np.concatenate([[0.0], np.cumsum(np.exp(params[k + 1:]))])
    return OrdinalModel(weights, cuts)


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade) from quality and toxic flags: the lowest grade of a document's ratings."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(
        F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 2)
    return (labels.select(F.col(id_col).alias("id"), grade.alias("grade"))
            .where("id is not null and grade is not null")
            .groupBy("id").agg(F.min("grade").alias("grade")))


def fit(df: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_labelled: int = 20_000) -> OrdinalModel | None:
    """A model from the documents with ratings (id, grade from 0).

    About ``max_labelled`` of the rated documents at most train it; they are broadcast to
    the scan of the documents, and their features with enough rows reach the driver.
    """
    scratch = Scratch(df.sparkSession, "quality")
    n = ratings.count()
    if n > max_labelled:
        ratings = ratings.where(F.expr(
            f"pmod(xxhash64(id, 23), 1048576) < {max_labelled * 1048576 // n}"))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rated = texts.join(F.broadcast(ratings), "id").select("grade", "text")

    def run(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), pa.array(
                    [text_features(t) for t in byte_values(batch.column("text"))],
                    pa.list_(pa.int32()))], ["grade", "features"])

    rows = scratch.write(rated.mapInArrow(run, "grade int, features array<int>"), "rated")
    least = max(3, rows.count() * 3 // 1000)
    common = (rows.select(F.explode("features").alias("f")).groupBy("f").count()
              .where(F.col("count") >= least).select("f"))
    kept = [r["f"] for r in common.collect()]  # at most DIMENSIONS
    if not kept:
        return None
    known = np.zeros(DIMENSIONS, dtype=bool)
    known[kept] = True

    def only_common(batches):
        for batch in batches:
            lists = batch.column("features")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            keep = known[flat]
            ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(
                lists.value_lengths().to_numpy(zero_copy_only=False))])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(flat[keep], pa.int32()))],
                ["grade", "features"])

    held = rows.mapInArrow(only_common, "grade int, features array<int>").toArrow()
    features = [np.asarray(x.values) for x in held.column("features")]
    return fit_ordinal(features, held.column("grade").to_numpy().astype(np.int64),
                       min_rows=least)


def with_grades(df: DataFrame, model: OrdinalModel | None, text_col: str, out: str) -> DataFrame:
    """``df`` with a struct ``out``: expected grade and P(top grade) (null without a model)."""
    names = df.columns
    fields = [("expected", T.DoubleType()), ("top", T.DoubleType())]
    if model is None:
        return df.withColumn(out, F.struct(*[F.lit(None).cast("double").alias(n)
                                             for n, _ in fields]))
    src = df.select("*", F.col(text_col).cast("string").alias(out))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StructType(
        [T.StructField(n, t) for n, t in fields]))])

    def run(batches):
        for batch in slices(batches, out):
            p = np.array([model.at_least(text_features(t))
                          for t in byte_values(batch.column(out))])
            scores = pa.StructArray.from_arrays(
                [pa.array(p.sum(axis=1)), pa.array(p[:, -1])], names=[n for n, _ in fields])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*names, out])

    return src.mapInArrow(run, schema)


def classify(df: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             least_top: float = 0.5, max_labelled: int = 20_000) -> DataFrame:
    """(id, expected_grade, p_top, kept): kept where P(top grade) is at least ``least_top``."""
    model = fit(df, ratings, id_col, text_col, max_labelled)
    narrow = df.select(F.col(id_col), F.col(text_col).alias("text"))
    return with_grades(narrow, model, "text", "grades").select(
        id_col, F.col("grades.expected").alias("expected_grade"),
        F.col("grades.top").alias("p_top"),
        F.coalesce(F.col("grades.top") >= least_top, F.lit(True)).alias("kept"))


def keep_top(df: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             least_top: float = 0.5, max_labelled: int = 20_000) -> DataFrame:
    """The rows of ``df`` that are kept, all columns as they were."""
    out = "__grades"
    scored = with_grades(df, fit(df, ratings, id_col, text_col, max_labelled), text_col, out)
    return (scored.where(F.coalesce(F.col(out)["top"] >= least_top, F.lit(True)))
            .select(*[F.col(f"`{c}`") for c in df.columns]))
