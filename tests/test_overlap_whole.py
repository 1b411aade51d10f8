"""The whole-text overlap query against brute force."""

from __future__ import annotations

import re

from compare import SF

from corvane.plans.catalogue import QUERIES


def test_overlap_of_whole_texts(spark):
    words = lambda t: set(re.split("[ \n\t\r]+", (t or "").lower())) - {""}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n, item = max((len(words(r.text) & w), -i) for i, w in items.items())
        if n:
            want[r.doc_id] = (-item, n)
    got = {r.doc_id: (r.item_id, r.overlap) for r in QUERIES["q32_overlap_match"](spark, SF).collect()}
    assert got == want
