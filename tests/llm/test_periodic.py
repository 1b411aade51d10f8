from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest

from corvane.llm import periodic
from brute import brute_runs


def words(rng, n, kinds, tail):
    out = [rng.randrange(kinds) for _ in range(n)]
    if n and tail:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(3, 11)
        out = out[:a] + [out[a + i % p] for i in range(n - a)] + [rng.randrange(kinds) for _ in range(rng.randrange(12))]
    return out


@pytest.mark.parametrize("grid", [(1 << 15, 1 << 18), (10, 37)])
def test_runs_equal_brute_force(monkeypatch, grid):
    monkeypatch.setattr(periodic, "GRID_WORDS", grid[0])
    monkeypatch.setattr(periodic, "GRID_POINTS", grid[1])
    periodic._shared_grid.cache_clear()
    rng = random.Random(grid[0])
    for _ in range(800):
        w = words(rng, rng.randrange(90), rng.choice((1, 2, 3, 20)), rng.random() < 0.6)
        assert periodic.runs_of(np.array(w, np.int32)) == brute_runs(w), w
    periodic._shared_grid.cache_clear()


def test_long_texts_in_time():
    began = time.time()
    assert periodic.runs_of(np.zeros(1_000_000, np.int32)) == [(0, 1_000_000, 1)]
    tail = np.concatenate((np.random.default_rng(1).integers(0, 5000, 60_000), np.tile(np.arange(700), 9))).astype(np.int32)
    assert [(m, q) for _, m, q in periodic.runs_of(tail)] == [(6300, 700)]
    assert time.time() - began < 30


def test_words_are_numbered_by_slice(monkeypatch):
    text = " ".join(random.Random(1).choice(("a", "bb", "é", "ccc")) for _ in range(500)) + "\n\tend"
    whole = periodic.numbered(text)
    monkeypatch.setattr(periodic, "SLICE", 7)
    again = periodic.numbered(text)
    assert whole[0].tolist() == again[0].tolist() and whole[1] == again[1] and [whole[1][i].decode() for i in whole[0]] == text.split()


def test_table_and_collapsed_texts(spark, make):
    text = "x y " * 4 + "end of it"
    docs = make([text, "", None, "a " * 6, "a b c d e"])
    rows = {r.doc_id: r for r in periodic.run_table(docs, plant=False).collect()}
    assert (rows[0].n_runs, rows[0].start, rows[0].length, rows[0].period, rows[0].exponent_milli) == (1, 0, 8, 2, 4000)
    assert rows[0].runs_sha256 == hashlib.sha256(b"0,8,2\n").hexdigest() and rows[0].collapsed_sha256 == hashlib.sha256(b"x y end of it").hexdigest()
    nothing = hashlib.sha256(b"").hexdigest()
    for i in (1, 2):
        assert tuple(rows[i])[1:] == (0, None, None, None, None, nothing, nothing)
    assert {r.doc_id: r.text for r in periodic.collapsed_documents(docs).collect()} == {0: "x y end of it", 1: "", 2: None, 3: "a", 4: "a b c d e"}
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(docs).collect()}[0] == [(0, 8, 2)]


def test_awkward_and_empty_tables(awkward, empty):
    rows = periodic.run_table(awkward).collect()
    assert len(rows) == awkward.count() and all(r.runs_sha256 and r.collapsed_sha256 for r in rows)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in awkward.select("doc_id").collect())
    twice = [tuple(r) for r in rows if r.doc_id == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert [tuple(r)[1:5] for r in rows if r.doc_id in (1, 2, 3)] == [(0, None, None, None)] * 3
    collapsed = periodic.collapsed_documents(awkward)
    assert collapsed.columns == awkward.columns and collapsed.count() == awkward.count()
    assert periodic.run_table(empty).collect() == [] and periodic.collapsed_documents(empty).collect() == []


def test_text_ids(spark):
    docs = spark.createDataFrame([("a", "w " * 9), (None, "w " * 9)], "doc_id string, text string")
    assert {r.doc_id: r.n_runs for r in periodic.run_table(docs).collect()} == {"a": 1, None: 1}
