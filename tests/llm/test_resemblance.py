"""The pipeline's near-duplicate stage against brute-force Jaccard of five-word shingle sets."""

from __future__ import annotations

import random

from compare import SF

import corpus_pipeline
from corvane.llm import resemblance


def brute_set(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows: list[tuple]) -> set:
    """Ids that are the least of their component of pairs with Jaccard 0.8 or more."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or common and common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return set(least.values())


def test_stage_equals_brute_force(spark, make):
    """Dense groups, chains and pairs on both sides of 0.8, short, empty and null texts."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(rng.choice((3, 5, 30, 80, 200)))] for _ in range(30)]
    texts = [None, "", " \n", "one two", "One  two", "one two three four five"]
    for _ in range(400):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t + [rng.choice(words) for _ in range(rng.choice((0, 0, 5, 15)))]))
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, make(texts), SF).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_kept(list(enumerate(texts)))


def test_stage_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert got == brute_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_pairs_at_the_bound_share_a_band():
    """Set pairs of similarity 0.8 to 0.82: SimHash's four bits missed nearly all of them."""
    import numpy as np

    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(2000):
        n = int(rng.integers(20, 200))
        pool = rng.integers(0, 2**64, n + n // 4, dtype=np.uint64)
        cut = n // 8
        a, b = np.unique(pool[: len(pool) - cut]), np.unique(pool[cut:])
        missed += not set(resemblance.bands(a)) & set(resemblance.bands(b))
    assert missed == 0


def test_stage_keeps_one_of_identical_rows(awkward, empty):
    """Nulls, empty texts, identical rows and clashing columns: one whole row of each group stays, as it was."""
    rows = awkward.collect()
    kept = resemblance.first_of_resembling(awkward)
    assert kept.columns == awkward.columns
    got = kept.collect()
    assert all(r in rows for r in got)
    assert len(got) == len(brute_kept([(i, r.text) for i, r in enumerate(rows)]))
    assert len(got) == len(brute_kept([(i, r.text) for i, r in enumerate(got)]))
    assert resemblance.first_of_resembling(empty).count() == 0


def test_boilerplate_makes_no_group(spark, make):
    """Texts that share up to three quarters of their shingles stay, however many they are."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    texts = [" ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(25)]) for _ in range(300)]
    assert resemblance.first_of_resembling(make(texts)).count() == 300
