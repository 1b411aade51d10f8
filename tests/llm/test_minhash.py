from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import minhash
from brute import components, shingles


def planted(seed: int, groups: int, size: int) -> list[str]:
    """Texts in groups of copies with a few words changed, so that similarities lie on both sides of 0.8."""
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 9))):
                text[rng.randrange(len(text))] = rng.choice((f"x{rng.randrange(30)}", f"w{rng.randrange(400)}"))
            out.append(" ".join(text))
    return out


def wanted(texts: list, words: int, percent: int) -> list[int]:
    sets = [shingles(t, words) for t in texts]
    links = {
        (a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    }
    return components(len(texts), links)


@pytest.mark.parametrize(("words", "groups", "size"), [(2, 25, 12), (5, 20, 8), (2, 1, 300)])
def test_components_equal_brute_force(make, words, groups, size):
    texts = [*planted(words + size, groups, size), "", None, "one", "one", "One", "one two", "  ", "two one"]
    rows = minhash.minhash_table(make(texts), words, 80).collect()
    assert [r.component_id for r in sorted(rows)] == wanted(texts, words, 80)
    assert all(r.n_shingles == len(shingles(texts[r.doc_id], words)) and r.kept == (r.doc_id == r.component_id) for r in rows)


def test_pairs_at_the_bound(make):
    # Four of five shingles in common is 80 of 100; three of four is not.
    texts = ["a b c d e", "a b c d e f", "k l m n", "k l m n o"]
    assert [r.component_id for r in sorted(minhash.minhash_table(make(texts)).collect())] == [0, 0, 2, 3]


def test_signature_is_unbiased_and_varies_less():
    rng = np.random.default_rng(3)
    found, least = [], []
    for _ in range(300):
        pool = rng.integers(0, 2**64, 130, dtype=np.uint64)
        a, b = (minhash.signature(np.unique(x)) for x in (pool[:100], pool[30:]))
        same = a == b
        found.append(same.mean())
        least.append(same[: minhash.PERMUTATIONS].mean())
    true = 70 / 130
    assert abs(np.mean(found) - true) < 0.01 and np.var(found) < 0.75 * np.var(least)


def test_estimate_lets_alike_pairs_pass():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(0, 2**64, 110, dtype=np.uint64)
        a, b = (np.array(minhash.bits(minhash.signature(np.unique(x)))) for x in (pool[:99], pool[11:]))
        agree = np.bitwise_count(~((a[:2] ^ b[:2]) | (a[2:] ^ b[2:])).view(np.uint64)).sum()
        assert agree >= minhash.least_agreeing(0.8)
    assert len(np.unique(minhash.PLACES)) == 2 * minhash.PERMUTATIONS
    assert all(len(set(row % minhash.PERMUTATIONS)) == 4 for row in minhash.PLACES)


def test_first_of_alike_keeps_one_of_a_group(make):
    texts = planted(9, 6, 6) + ["", None, "alone", "alone"]
    docs = make(texts).withColumn("size", F.lit("own"))
    kept = minhash.first_of_alike(docs, 2, 80)
    assert kept.columns == docs.columns
    roots = wanted(texts, 2, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))


def test_awkward_and_empty_tables(awkward, empty):
    rows = [tuple(r)[:4] for r in minhash.minhash_table(awkward).collect()]
    by_id = {i: (n, c, k) for i, n, c, k in rows if i is not None}
    assert len(rows) == awkward.count() and rows.count((5, *by_id[5])) == 2
    assert [by_id[i] for i in (1, 2, 3)] == [(0, 1, True), (0, 2, True), (0, 3, True)]
    assert by_id[6][1:] == (5, False) and by_id[7][1:] == (5, False) and by_id[5][1:] == (5, True)
    nameless = sorted((n, c, k) for i, n, c, k in rows if i is None)
    assert nameless[0] == (0, None, True) and nameless[1][1:] == (5, False)
    assert minhash.minhash_table(empty).collect() == [] and minhash.first_of_alike(empty).collect() == []
    kept = minhash.first_of_alike(awkward)
    assert kept.columns == awkward.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "1", "2", "3", "4", "5", "8", "9"])
