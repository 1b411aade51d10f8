from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of texts, or of rows (doc_id, text, lang, source)."""

    def build(items):
        rows = [(i, x, "en", f"s{i % 3}") if not isinstance(x, tuple) else x for i, x in enumerate(items)]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def awkward(make):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns whose names may clash."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(20_000))
    prose = "The quick brown fox jumps over the lazy dog while many other animals of the wood look on in silence. " * 3
    rows = [
        (None, None, None, None), (1, None, "en", "a"), (2, "", None, "b"), (3, "   \n\t", "de", None), (4, long, "en", "a"), (5, prose, "en", "a"),
        (5, prose, "en", "a"), (6, prose, "fr", "b"), (7, prose + "end", "en", None), (None, prose, "en", "a"), (8, "é中\U0001f600 ſ K İ", "en", "c"), (9, "a" * 500, "en", "c"),
    ]
    extra = ("size", "_size", "_at", "k", "fp", "group", "found", "packed", "hash", "_hash", "n", "_part", "target", "_q_kept", "score", "_source", "_id", "_n", "epochs", "core")
    return make(rows).withColumns({c: F.lit(f"own {c}") for c in extra})


@pytest.fixture(scope="session")
def empty(make):
    return make(["x"]).where("false")
