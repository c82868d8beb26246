"""Quality rules: base counts, and distribution divergence from language references.

Each document gets two histograms: its bytes by character class, and its words by
common word (all others together). The distances are Jensen-Shannon distances (square root
of the divergence in bits, 0 to 1) from the reference of its language.

References are robust: the class histograms of a language's documents that pass the base
rules have a median (by class, in thousandths), and the reference is the mean over the
documents whose class distance from that median is within ``LIMITS["class"]``, so that a few
odd documents don't move it. A language, any value that occurs, has a reference if
``LIMITS["min_docs"]`` documents or more make it. Words are judged only in the languages of
``COMMON_WORDS``. A document is rejected when its characters alone are far off
(``LIMITS["class"]``), or its characters and its words both are off by less
(``LIMITS["both_class"]`` and ``LIMITS["both_word"]``).

Documents of other languages, or of none given, are held against what is common to all
references, in coarse classes that don't depend on the script: letters and blanks, digits,
punctuation, other marks, symbols. Documents shorter than the guards ``min_chars`` and
``min_words`` are judged by the base rules alone.

Shares are added up as integers (billionths), so references don't depend on how
rows are dealt to tasks. References are a written table with a row for each language
(upper and lower case and outer blanks don't matter), joined with the documents.

Defined cases: a null text has no words and fails the base rules; a null or blank language
is none; where no language has a reference the base rules alone judge; very long texts are
read whole, one at a time; repeated rows are judged each; ids may be null and repeat; an
empty table gives an empty result; other columns have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrun.llm.arrow import WHITESPACE, byte_values, slices
from millrun.session import Scratch

# Frequent words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at "
          "which but have an had they you were their one all we can her has there",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce "
          "il sont avec son ou mais nous elle leur cette aux",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es "
          "an werden aus er hat dass sie nach wird bei einer um am sind",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o pero sus "
          "le ha me si sin sobre este ya entre cuando todo esta",
}
SYMBOLS = b"#*$%&|<>"
LIMITS = {"class": 0.3, "both_class": 0.125, "both_word": 0.3, "min_chars": 250, "min_words": 50,
          "min_docs": 20}
SCALE = 1_000_000_000

_WORDS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
_BIN_OF_WORD = {w.encode(): i for i, w in enumerate(_WORDS)}
_N_WORD_BINS = len(_WORDS) + 1  # the last: all other words

_CLASS_OF_BYTE = np.full(256, 5, dtype=np.uint8)  # other marks and control characters
for _class, _bytes in enumerate([
        bytes(range(0x61, 0x7B)), bytes(range(0x41, 0x5B)), b"0123456789", WHITESPACE,
        b".,;:!?'\"()-"]):
    _CLASS_OF_BYTE[list(_bytes)] = _class
_CLASS_OF_BYTE[list(SYMBOLS)] = 6
_CLASS_OF_BYTE[0xC0:] = 7  # first byte of a character outside ASCII
_CLASS_OF_BYTE[0x80:0xC0] = 8  # its other bytes, not counted
_N_CLASSES = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]
                      + [T.StructField("n_chars", T.LongType()),
                         T.StructField("classes", T.ArrayType(T.LongType())),
                         T.StructField("common", T.ArrayType(T.LongType()))])


def _repeat_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words inside a 3-word window that occurs twice or more in the text."""
    if len(ids) < 4:
        return 0
    if n_distinct < 1 << 21:
        keys = (ids[:-2] * n_distinct + ids[1:-1]) * n_distinct + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * n_distinct + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * n_distinct + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        hit[order[1:][same] + shift] = True
        hit[order[:-1][same] + shift] = True
    return int(hit.sum())


def _shares(counts: np.ndarray) -> list[int]:
    total = int(counts.sum())
    return (counts * SCALE // total).tolist() if total else [0] * len(counts)


def text_stats(raw: bytes | None) -> tuple:
    """Base counts and histograms of one text, in the order of the stats struct."""
    raw = raw or b""
    words = raw.split()
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    classes = np.bincount(_CLASS_OF_BYTE[np.frombuffer(raw, dtype=np.uint8)],
                          minlength=_N_CLASSES + 1)[:_N_CLASSES]
    common = np.zeros(_N_WORD_BINS, dtype=np.int64)
    if words:
        counts = np.bincount(ids)
        bins = np.array([_BIN_OF_WORD.get(w.lower().strip(b".,;:!?"), _N_WORD_BINS - 1)
                         for w in index])
        common += np.bincount(bins, weights=counts, minlength=_N_WORD_BINS).astype(np.int64)
    return (len(words), len(b"".join(words).decode("utf-8", "replace")),
            len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            _repeat_words(ids, len(index)), int(classes.sum()), _shares(classes), _shares(common))


def with_stats(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with a struct ``out`` of its texts' base counts and histograms."""
    names = df.columns
    kept = df.select("*", F.col(text_col).cast("string").alias(out))
    schema = T.StructType([*df.schema.fields, T.StructField(out, _STATS)])

    def run(batches):
        fields = [pa.field(f.name, pa.list_(pa.int64()) if isinstance(f.dataType, T.ArrayType)
                           else pa.int64()) for f in _STATS]
        for batch in slices(batches, out):
            columns = zip(*map(text_stats, byte_values(batch.column(out))))
            stats = pa.StructArray.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], stats], [*names, out])

    return kept.mapInArrow(run, schema)


def base_failed(stats: str) -> Column:
    """Fewer than 50 words, or more than half of them in repeated 3-word windows."""
    s = F.col(stats)
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def _language(lang_col: str) -> Column:
    return F.lower(F.trim(F.col(lang_col).cast("string")))


def js_distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of a histogram in billionths from reference shares."""
    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def term(p, q):
        x = p / F.lit(float(SCALE))
        m = (x + q) / 2
        return part(x, m) + part(q, m)
    total = F.aggregate(F.zip_with(shares, reference, term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _normed(name: Column) -> Column:
    total = F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
    return F.transform(name, lambda x: x / F.greatest(total, F.lit(1.0)))


def _coarse(shares: Column) -> Column:
    """Letters of any script and blanks, digits, punctuation, other marks, symbols."""
    return F.array(shares[0] + shares[1] + shares[3] + shares[7], shares[2], shares[4],
                   shares[5], shares[6])


def references(stats_df: DataFrame, lang_col: str, stats: str, limits: dict,
               scratch: Scratch) -> DataFrame:
    """(__ref_lang, __ref_classes, __ref_common, __sums): a row for each language with support.

    Words are null for languages without common words; ``__sums`` are the class sums.
    """
    bins = {"classes": _N_CLASSES, "common": _N_WORD_BINS}
    passing = stats_df.where(~base_failed(stats)).select(
        _language(lang_col).alias("lang"), F.col(stats)).where("lang <> ''")
    # thousandths, so the exact percentile keeps at most 1001 counts a class
    medians = passing.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[
        F.percentile(F.expr(f"{stats}.classes[{i}] div 1000000"), F.lit(0.5)).alias(f"m{i}")
        for i in range(_N_CLASSES)]).where(F.col("n") >= limits["min_docs"])
    # written, so that the join knows how small it is and leaves the documents where they are
    medians = scratch.write(medians.select("lang", _normed(F.array(*[
        f"m{i}" for i in range(_N_CLASSES)])).alias("median")), "medians")
    core = passing.join(medians, "lang").where(
        js_distance(F.col(stats)["classes"], F.col("median")) <= limits["class"])
    sums = core.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.col(stats)[name][i]).alias(f"{name}{i}")
        for name, n in bins.items() for i in range(n)]).where(F.col("n") >= limits["min_docs"])
    sums = sums.select("lang", *[F.array(*[F.col(f"{name}{i}").cast("double") for i in range(n)])
                                 .alias(name) for name, n in bins.items()])
    has_words = F.col("lang").isin(*COMMON_WORDS)
    return sums.select(F.col("lang").alias("__ref_lang"),
                       _normed(F.col("classes")).alias("__ref_classes"),
                       F.when(has_words, _normed(F.col("common"))).alias("__ref_common"),
                       F.col("classes").alias("__sums"))


def with_references(stats_df: DataFrame, lang_col: str, stats: str, limits: dict,
                    scratch: Scratch, rows: DataFrame | None = None) -> DataFrame:
    """``rows`` (else ``stats_df``) with the columns of its language's reference in ``stats_df``,
    null where there is none, and ``__ref_any``, the coarse classes of all references (null
    without any). The result doesn't read ``stats_df`` when ``rows`` are given."""
    refs = scratch.write(references(stats_df, lang_col, stats, limits, scratch), "references")
    total = refs.agg(*[F.sum(F.col("__sums")[i]).alias(f"s{i}")
                       for i in range(_N_CLASSES)]).first()  # one row
    every = F.lit(None).cast("array<double>") if total["s0"] is None else _normed(_coarse(
        F.array(*[F.lit(x) for x in total])))
    rows = stats_df if rows is None else rows
    return rows.join(refs.drop("__sums"), _language(lang_col) == refs["__ref_lang"],
                     "left").withColumn("__ref_any", every)


def judge(stats: str, limits: dict) -> dict[str, Column]:
    """Columns class_distance, word_distance, base_failed and kept.

    Distances are null below a guard and without a reference; the class distance is in
    coarse classes where the language has none.
    """
    s = F.col(stats)
    own, common, every = (F.col(f"__ref_{name}") for name in ("classes", "common", "any"))
    classes = F.when(s["n_chars"] >= limits["min_chars"], F.when(
        own.isNotNull(), js_distance(s["classes"], own)).when(
        every.isNotNull(), js_distance(_coarse(s["classes"]), every)))
    words = F.when((s["n_words"] >= limits["min_words"]) & common.isNotNull(),
                   js_distance(s["common"], common))
    by_class, by_word = F.coalesce(classes, F.lit(0.0)), F.coalesce(words, F.lit(0.0))
    far = (by_class > limits["class"]) | \
        ((by_class > limits["both_class"]) & (by_word > limits["both_word"]))
    return {"class_distance": classes, "word_distance": words,
            "base_failed": base_failed(stats), "kept": ~base_failed(stats) & ~far}


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", limits: dict | None = None) -> DataFrame:
    """(id, counts, class_distance, word_distance, base_failed, kept) for every document."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
                       F.col(text_col).alias("text"))
    limits = LIMITS | (limits or {})
    scratch = Scratch(df.sparkSession, "rules")
    stats = scratch.write(with_stats(narrow, "text", "stats").drop("text"), "stats")
    verdict = judge("stats", limits)
    return with_references(stats, "lang", "stats", limits, scratch).select(
        F.col("id").alias(id_col), *[F.col("stats")[c].alias(c) for c in COUNTS],
        *[v.alias(k) for k, v in verdict.items()])


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang",
              limits: dict | None = None) -> DataFrame:
    """The rows of ``df`` that pass, all columns as they were.

    Texts are counted twice, for the references and for the verdicts, so no copy of them is
    written; only the references stay on disk.
    """
    out = "__rule_stats"
    limits = LIMITS | (limits or {})
    scratch = Scratch(df.sparkSession, "rules")
    stats = scratch.write(with_stats(df.select(lang_col, text_col), text_col, out).drop(text_col),
                          "stats")
    judged = with_references(stats, lang_col, out, limits, scratch, with_stats(df, text_col, out))
    scratch.drop("medians")
    scratch.drop("stats")
    return judged.where(judge(out, limits)["kept"]).select(*[F.col(f"`{c}`") for c in df.columns])
