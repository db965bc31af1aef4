"""Shared by the tests of the training-data operators."""

import re

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


def frame(spark, rows, schema):
    """Rows padded with nulls to the schema (for extra columns with names that operators use themselves)."""
    width = schema.count(",") + 1
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text):
    w = words_of(text)
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
