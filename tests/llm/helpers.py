"""Rows that every operator must handle: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def odd_documents(spark, extra=()):
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Ünder", "naïve", "日本", "x1", "THE", "end."]
    long = " ".join(rng.choice(vocabulary) for _ in range(6000))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [
        (1, passage + " tail one", "en", "a", 1),
        (2, "head " + passage, "en", "a", 2),
        (3, passage + " tail one", "en", None, None),
        (4, None, "en", "b", 0),
        (5, "", None, "b", 0),
        (6, " \n\t ", "de", "b", 3),
        (7, long, "en", "c", 9),
        (8, long + " " + passage, "fr", "c", 9),
        (9, "one two three", "en", "c", 9),
        (9, "one two three", "en", "c", 9),
        (9, "another text with the same id " + passage, "en", "c", 9),
        (None, "a text without id " + passage, "en", "d", 1),
        (None, None, None, None, None),
        *extra,
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    """Extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    for name in ("id", "key", "uid", "fp", "u", "v", "t", "n", "part", "data", "bucket", "node", "root", "start", "spans", "added", "fold", "kind", "whole", "flags", "own_id", "own_key", "flag_id", "flag_key", "n_words", "clean", "_sl_key", "_sl_text", "_sl_keep", "keep", "keep_id", "keep_key", "curve", "ids"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def empty(spark):
    return spark.createDataFrame([], DOCS)
