"""Small document tables with the cases every operator must stand."""

import random
import re

from pyspark.sql import types as T

SF = "/root/testdata/sf0.01"
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, extra=()):
    """rows: (doc_id, text, source); ``extra`` adds string columns of these names."""
    schema = T.StructType([*DOC.fields, *[T.StructField(c, T.StringType()) for c in extra]])
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, *["x"] * len(extra)) for i, t, s in rows], schema)


def words(n, seed=0, vocab=400):
    r = random.Random(seed)
    return " ".join("w%d" % r.randrange(vocab) for _ in range(n))


def edge_rows():
    long_text = words(60_000, seed=5, vocab=5000)
    return [(1, None, "a"), (2, "", "a"), (3, " \t\n ", "b"), (4, "one", "b"), (5, words(50), None), (6, words(50), None),
            (6, words(50), None), (None, words(30, 3), "c"), (None, None, None), (8, long_text, "c"), (9, "x" * 30_000, "c"),
            (10, "Mixed CASE and ünïcode ßtraße — ok", "d"), (11, "<|endoftext|> a <|endoftext|>b", "d"),
            (12, "a\x1c b \x85 c   d  \n\n e   ", "d")]


CLASH = ["tag", "size", "draw", "cuts", "need", "fp", "bucket", "group", "row", "doc", "block", "whole", "repeats"]
