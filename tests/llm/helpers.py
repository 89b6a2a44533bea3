"""Small tables and plain versions that the tests compare with."""

from __future__ import annotations

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Clashing names: columns that operators make themselves.
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("score", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("n", T.StringType()),
        T.StructField("turn", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def documents(spark, rows):
    """A documents table of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), "s", "s", "k", "b", "n", "t", "x") for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def prose(rng, words, vocabulary=300):
    """Words of letters only."""
    return " ".join("ba" + "".join("etnirsoule"[int(d)] for d in str(rng.randrange(vocabulary))) for _ in range(words))


def shingles(text, n=5):
    words = WORD.findall(text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))
