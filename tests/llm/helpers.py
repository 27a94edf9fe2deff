"""Brute-force forms of what the operators compute, and awkward rows."""

from __future__ import annotations

import re

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string"

#: null and empty texts, blanks, repeated rows, ties, null keys, letters of several kinds, a very long text
AWKWARD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two"), (5, "one two"), (6, "Größe ñandú 中文 😀 x"), (7, "a" * 5000), (8, "b c " * 30_000),
    (9, None), (None, "no key at all"), (None, None), (10, "ends with blank \n"), (11, "\x00 control\x1f"),
]


def clean_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    """Extra columns named like the operators' own columns."""
    from pyspark.sql import functions as F

    names = ("key", "doc", "marks", "score", "ids", "ends", "findings", "blob", "node", "component", "label", "features", "chunk", "bucket", "fingerprint", "a", "group", "n")
    return df.select("*", *(F.lit(7).alias(n) for n in names))
