"""URL filters: host and path rules, and boosted trees on lexical features for the rest.

A rule is an allowed or blocked host with a path; it fits that host and its subdomains
where the URL's path starts with the rule's. The longest fitting rule decides (of equals,
blocking). URLs that no rule fits are judged by gradient-boosted trees on lexical
features, trained from labelled URLs: length, path depth, digit ratio, entropy of the
characters, parameters, host labels, hyphens, and for the host's last label, its last two
labels and the path's first segment the smoothed share of blocked URLs among those
labelled (the mean where none is). Everything is DataFrame functions and Spark ML.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule and
the features of an empty text; ids may be null and repeat, every row is judged; very long
URLs are read whole; labels are 1 for block and
0 for allow, rows without one don't train; with labels of one class only, all URLs get it,
with none all are allowed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrun.session import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUPS = ("suffix", "domain", "section")
FEATURES = ["length", "depth", "digit_ratio", "entropy", "params", "labels", "hyphens",
            *[f"{g}_blocked" for g in GROUPS]]
SMOOTHING = 20.0  # labelled URLs at the mean that every group starts with


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: up to ``/ ? #`` in lower case, and from there up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, rule_host, rule_path) rows from a list."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("rule_host"),
                              F.lit(p).alias("rule_path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (row, id, url) with host, path, rule and rule_verdict (null: no rule fits).

    Every host suffix is looked up in the rules; a URL's rows meet again in a partial
    aggregate, so one row a URL is exchanged however common its suffixes are.
    """
    host, path = host_and_path(F.col("url"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    fits = (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path"))
    best = F.max(F.when(F.col("rule_host").isNotNull(), F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), "verdict",
        F.concat("rule_host", "rule_path").alias("rule"))))
    return (urls.withColumns({"host": host, "path": path})
            .withColumn("suffix", F.explode(suffixes)).join(rules, fits, "left")
            .groupBy("row", "id", "url", "host", "path").agg(best.alias("best"))
            .select("row", "id", "url", "host", "path", F.col("best.rule").alias("rule"),
                    F.col("best.verdict").alias("rule_verdict")))


def _count(text: Column, characters: str) -> Column:
    """How many of ``characters`` there are in ``text``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def entropy(text: Column) -> Column:
    """Bits a character of the text's own distribution of characters."""
    n = F.length(text)

    def bits(c):
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(F.transform(letters, bits), F.lit(0.0), lambda a, x: a + x)


def _group(name: str) -> Column:
    """What a URL shares with others: host suffixes, or the path's first segment."""
    return {"suffix": F.substring_index("host", ".", -1),
            "domain": F.substring_index("host", ".", -2),
            "section": F.regexp_extract("path", "^/([^/]*)/", 1)}[name]


def with_features(urls: DataFrame, scratch: Scratch) -> DataFrame:
    """``urls`` (url, host, path, label and more) with the columns of ``FEATURES``.

    The groups' shares are counted over all labelled rows.
    """
    text = F.coalesce("url", F.lit(""))
    n = F.length(text)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    out = urls.withColumns({
        "length": n.cast("double"),
        "depth": _count(F.col("path"), "/").cast("double"),
        "digit_ratio": F.when(n > 0, _count(text, "0123456789") / n).otherwise(0.0),
        "entropy": F.coalesce(entropy(text), F.lit(0.0)),
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
        "labels": F.size(F.split("host", "\\.")).cast("double"),
        "hyphens": _count(F.col("host"), "-").cast("double"),
    })
    counts = [F.count("label").alias("known"),
              F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")]
    total = urls.agg(*counts).first()
    mean = total["blocked"] / total["known"] if total["known"] else 0.0
    for name in GROUPS:
        table = scratch.write(urls.groupBy(_group(name).alias("_key")).agg(*counts).select(
            "_key", ((F.col("blocked") + SMOOTHING * mean) / (F.col("known") + SMOOTHING))
            .alias(f"{name}_blocked")), name)
        out = out.withColumn("_key", _group(name)).join(table, "_key").drop("_key")
    return out


def bounded_sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the rows at most, chosen by a hash of the URL."""
    n = labelled.count()
    if n <= rows:
        return labelled
    return labelled.where(F.expr(f"pmod(xxhash64(url, 17), 1048576) < {rows * 1048576 // n}"))


def train(labelled: DataFrame, scratch: Scratch, max_rows: int = 20_000, trees: int = 20,
          depth: int = 4) -> GBTClassificationModel | float:
    """Boosted trees from rows with ``FEATURES`` and ``label``, or the one label there is."""
    sample = bounded_sample(labelled.where("label is not null"), max_rows)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
        sample.select(*FEATURES, F.col("label").cast("double").alias("label")))
    rows = scratch.write(
        rows.select("features", "label").repartition(4, F.xxhash64(vector_to_array("features"))),
        "train")
    found = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(found) < 2:
        return found[0] if found else 0.0
    return GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.2, seed=7,
                         cacheNodeIds=False, checkpointInterval=-1).fit(rows)


def block_probability(urls: DataFrame, model: GBTClassificationModel | float,
                      out: str) -> DataFrame:
    """``urls`` (with ``FEATURES``) and the model's probability of label 1."""
    if isinstance(model, float):
        return urls.withColumn(out, F.lit(model))
    scored = model.transform(VectorAssembler(
        inputCols=FEATURES, outputCol="features").transform(urls))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


def judge_urls(df: DataFrame, rules: DataFrame, labelled: DataFrame | None = None,
               id_col: str = "page_id", url_col: str = "url",
               max_rows: int = 20_000) -> DataFrame:
    """(id, host, path, rule, verdict, block_probability) for every row of ``df``.

    ``labelled`` (url, label) trains the trees; without it, the URLs that a rule decides
    do, with the rule's verdict. The probability is null where a rule decided.
    """
    scratch = Scratch(df.sparkSession, "urls")
    urls = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                     F.col(url_col).cast("string").alias("url"))
    judged = scratch.write(match_rules(urls, rules), "judged")
    if labelled is None:
        rows = judged.withColumn("label", F.expr("if(rule_verdict = 'block', 1, 0)")).withColumn(
            "label", F.when(F.col("rule").isNotNull(), F.col("label")))
    else:
        host, path = host_and_path(F.col("url"))
        rows = judged.withColumn("label", F.lit(None).cast("int")).unionByName(
            labelled.select("url", F.col("label").cast("int").alias("label"))
            .withColumns({"host": host, "path": path}), allowMissingColumns=True)
    featured = scratch.write(with_features(rows, scratch), "features")
    model = train(featured, scratch, max_rows)
    scored = block_probability(featured.where("row is not null"), model, "p")
    by_model = F.when(F.col("p") >= 0.5, "block").otherwise("allow")
    return scored.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("rule_verdict", by_model).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("p")).alias("block_probability"))
