from __future__ import annotations

import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing, sharding

SIZE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0) -> dict:
    """Shares by weight; what is above a cap is shared again among the rest until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_and_taken_words(spark, make):
    texts = [(i, "w " * (1 + (i * 7919) % 97), "en", None if i % 17 == 0 else f"s{i % 7 if i % 3 else 0}") for i in range(400)]
    out = mixing.mix_table(make(texts)).collect()
    sizes: dict = {}
    for _, t, _, s in texts:
        sizes[s] = sizes.get(s, 0) + len(SIZE.findall(t))
    want = brute_targets(sizes)
    for s in sizes:
        rows = [r for r in out if r.source == s]
        assert rows[0].source_size == sizes[s] and rows[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in rows) - want[s]) <= 1
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix_table(make(texts).repartition(5)).collect()), key=str)


def test_order_is_that_of_the_keys(make):
    """Brute force: within a source the fractional part takes documents in the order of -ln(u) / w."""
    docs = make([(i, "word " * (5 + i % 40), "en", f"s{i % 3}") for i in range(300)])
    keys = {r.doc_id: r._at for r in mixing.keyed(docs).collect()}
    out = mixing.mix_table(docs).collect()
    for s in {r.source for r in out}:
        rows = sorted((r for r in out if r.source == s), key=lambda r: keys[r.doc_id])
        left = round(rows[0].target) - rows[0].epochs * rows[0].source_size
        for r in rows:
            assert r.part == max(0, min(r.size, left))
            left -= r.size


@pytest.mark.parametrize("low", [1e-6, 1e-3, 1.0, 1e3])
def test_order_at_any_weight(make, low):
    """Brute force with exact logarithms: weights from low to 1000 low, no two keys tie, and the cut is where they say."""
    docs = make([(i, "word " * (5 + i % 40), "en", f"s{i % 2}") for i in range(400)]).withColumn("w", F.lit(low) * F.pow(F.lit(1000.0), (F.col("doc_id") % 10) / 9))
    rows = mixing.keyed(docs, quality=F.col("w"))
    found = rows.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(42)), 12)).collect()
    key = {r.doc_id: -math.log((r.draw + 0.5) / 2**52) / r.w for r in found}
    assert len({r._at for r in found}) == len(found)
    out = mixing.take(rows.drop("text"), mixing.budgets(rows.select("source", "_size", "_at"))).collect()
    for s in ("s0", "s1"):
        mine = sorted((r for r in out if r.source == s), key=lambda r: key[r.doc_id])
        left = round(mine[0].target) - mine[0].epochs * mine[0].source_size
        for r in mine:
            assert r._part == max(0, min(r._size, left))
            left -= r._size


def test_heavier_documents_come_first_more_often(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), (F.col("id") % 2).alias("heavy"))
    rows = mixing.keyed(docs, quality=F.when(F.col("heavy") == 1, 2.0).otherwise(1.0))
    a = rows.crossJoin(F.broadcast(rows.agg(F.percentile("_at", F.lit(0.5)).alias("m")))).where("_at < m").agg(F.avg("heavy")).first()[0]
    # P(Exp(2) below the joint median): 1 - x^2 with x + x^2 = 1.
    x = (math.sqrt(5) - 1) / 2
    assert a == pytest.approx((1 - x * x) / ((1 - x * x) + (1 - x)), abs=0.03)


def test_whole_documents_of_a_mix(make):
    docs = make([(i, "word " * 50, "en", f"s{i % 4}") for i in range(80)])
    taken = {r.doc_id: r.taken // 50 for r in mixing.mix_table(docs).collect() if r.part in (0, 50)}
    copies: dict = {}
    for r in mixing.mixed_documents(docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert all(copies.get(k, 0) == n for k, n in taken.items())


def test_mixing_edges(awkward, empty):
    out = mixing.mix_table(awkward).collect()
    assert len(out) == awkward.count() and all(r.size is not None and 0 <= r.taken <= 2 * r.size for r in out)
    assert mixing.mixed_documents(awkward).columns == awkward.columns and mixing.mixed_documents(awkward).count() > 0
    assert mixing.mix_table(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def jump(key: int, n: int) -> int:
    """The published loop, in unsigned 64-bit arithmetic."""
    at, nxt = -1, 0
    while nxt < n:
        at = nxt
        key = (key * 2862933555777941757 + 1) % 2**64
        nxt = int((at + 1) * (2**31 / ((key >> 33) + 1)))
    return at


def test_jump_equals_the_published_loop(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345, *((i * 0x9E3779B97F4A7C15) % 2**63 for i in range(200))]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 50):
        assert [r[0] for r in frame.select(sharding.jump_shard(F.col("k"), n)).collect()] == [jump(k % 2**64, n) for k in keys]


def test_shards(make):
    docs = make([f"text {i}" * (i % 9) for i in range(900)])
    out = sharding.shard_documents(docs, 8, rows_per_slice=20).collect()
    assert len(out) == 900
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
        assert 900 / 8 * 0.6 < sum(r.shard == s for r in out) < 900 / 8 * 1.4
    assert all(r.grown_shard in (r.shard, 8) for r in out) and 40 < sum(r.grown_shard == 8 for r in out) < 170
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in out)


def test_sharding_edges(awkward, empty):
    out = sharding.shard_documents(awkward).collect()
    assert len(out) == awkward.count()
    assert {r.size for r in out if r.doc_id in (1, 2)} == {1}
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.shard_documents(empty).count() == 0
