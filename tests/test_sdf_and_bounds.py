"""SDF files with any line ends and split at any byte, and similarity bounds that are no round floats."""

from __future__ import annotations

import random
from math import ceil

import pytest
from pyspark.sql import functions as F

from corvane.operators import joins
from corvane.sources import text_formats


def record(name: str, note: str = "x") -> str:
    lines = [name, "  made", "", "  1  0  0  0  0  0  0  0  0  0999 V2000", "    0.0000    0.0000    1.0000 C   0  0", "M  END", "> <note>", note, "", "$$$$", ""]
    return "\n".join(lines)


def read(spark, folder):
    return sorted((r.path.rsplit("/", 1)[1], r.ord, r.name, r.meta.get("note"), r.error) for r in text_formats.read_sdf(spark, f"file://{folder}").collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [64, 700, 8192, 1 << 27])
def test_records_of_split_files(spark, tmp_path, end, split):
    rng = random.Random(split)
    want = []
    for f in range(2):
        names = [rng.choice(["", "mol"]) + str(k) if k % 7 else "" for k in range(60)]
        (tmp_path / f"{f}.sdf").write_bytes("".join(record(n) for n in names).replace("\n", end).encode())
        want += [(f"{f}.sdf", k, n, "x", None) for k, n in enumerate(names)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        assert read(spark, tmp_path) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_marks_inside_lines_and_missing_last_mark(spark, tmp_path):
    text = record("a", "price $$$$ 5") + record("b") + record("c").removesuffix("$$$$\n")
    (tmp_path / "x.sdf").write_text(text)
    assert read(spark, tmp_path) == [("x.sdf", 0, "a", "price $$$$ 5", None), ("x.sdf", 1, "b", "x", None), ("x.sdf", 2, "c", "x", None)]


@pytest.mark.parametrize(("n", "m", "least"), [(100, 55, 0.55), (25, 7, 0.28), (25, 14, 0.56), (10, 3, 0.3), (50, 35, 0.7)])
def test_jaccard_at_its_bound(spark, n, m, least):
    rows = [(0, list(range(n))), (1, list(range(m))), (2, list(range(1000, 1000 + n)))]
    reps = spark.createDataFrame(rows, "rep long, tokens array<long>")
    assert [(r.a, r.b, r.common) for r in joins.jaccard_pairs(reps, least).collect()] == [(0, 1, m)]
    assert joins.jaccard_pairs(reps, least + 1e-6).count() == 0


def test_jaccard_equals_all_pairs(spark):
    rng = random.Random(5)
    sets = [frozenset(rng.sample(range(30), rng.randrange(1, 26))) for _ in range(120)]
    sets = list(dict.fromkeys(sets))
    reps = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "rep long, tokens array<long>")
    for percent in (28, 55, 56, 80):
        found = {(r.a, r.b) for r in joins.jaccard_pairs(reps, percent / 100).collect()}
        want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert found == want and ceil(percent) == percent


def test_containing_makes_no_nested_loop(spark):
    texts = [(0, "one two three four five six seven eight"), (1, "xone twoy"), (2, None), (3, "aaaa")]
    passages = [(10, "e two"), (11, "ne two three four five six se"), (12, "a"), (13, ""), (14, None), (15, "zz"), (16, "a")]
    rows = spark.createDataFrame(texts, "id long, t string")
    found = joins.containing(rows, spark.createDataFrame(passages, "p long, s string"), "id", "t", "p", "s")
    want = {(i, p) for i, t in texts for p, s in passages if t and s and s in t}
    assert sorted((r.id, r.p) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    long = [p for p in passages if p[1] and len(p[1].split()) > 6]
    assert joins.containing(rows, spark.createDataFrame(long, "p long, s string"), "id", "t", "p", "s").where(F.lit(True)).count() == 1
