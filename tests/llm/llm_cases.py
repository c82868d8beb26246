"""Small documents with every awkward case, and helpers for the tests of this folder."""

from pyspark.sql import types as T

WORDS = ("the river runs past old mills and slow barges carry grain toward the "
         "harbour town where children wait on warm stones for evening bells").split()

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def prose(n, seed=0):
    return " ".join(WORDS[(i * 7 + i * i * (seed + 3) + seed) % len(WORDS)] + str((i + seed) % 13)
                    for i in range(n))


def awkward_rows():
    """Nulls, empty and long texts, ties, repeated rows, odd characters."""
    texts = [None, "", "   \n\t", "one", prose(80), prose(80), prose(400, 2),
             "é ü ñ 日本語 😀 " * 40, "x" * 70000, " " * 3000 + "end", "a\x00b\x0bc\x0cd\re",
             prose(30, 5) + "\n" + prose(30, 5), "<|endoftext|> it's 12ab34 !!!'s"]
    rows = [(i, t, ["en", None, "xx"][i % 3], "s", None if t is None else len(t))
            for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, prose(60, 9), "en", None, None), (None, None, None, None, None)]
    return rows


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(2)


def clashing(df):
    """More columns, named like those that the operators make themselves."""
    names = ["id", "row", "n", "h", "key", "node", "component", "kept", "stats", "features",
             "label", "block", "body", "start", "length", "f0", "next_id", "range", "url", "host"]
    return df.selectExpr("*", *[f"'x' as `{n}`" for n in names if n not in df.columns])
