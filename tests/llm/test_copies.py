"""SimHash groups, repeated strings, chats, the pipeline."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from compare import SF, assert_same, tables
from test_resemblance import brute_kept

from corvane.llm import catalogue, chat, mixing, quality, repeats, secrets, simhash


def brute_print(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints: list[int], ids: list) -> list:
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least: dict = {}
    for i, k in enumerate(ids):
        least[root(i)] = min(least.get(root(i), k), k)
    return [least[root(i)] for i in range(len(ids))]


def test_groups_equal_brute_force(make):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randrange(0, 60))] for _ in range(25)]
    texts = []
    for _ in range(260):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    got = simhash.simhash_groups(make(texts)).orderBy("doc_id").collect()
    prints = [brute_print(t) for t in texts]
    assert [int(r.fingerprint, 16) for r in got] == prints
    assert [r.component_id for r in got] == brute_groups(prints, list(range(len(texts))))


def test_any_four_bits_leave_a_common_root():
    """Whichever four bits differ, some choice of blocks turns both prints to the same leading bits."""
    rng = random.Random(4)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        two = np.array([a, b], np.uint64)
        roots = [simhash._turned(two, c) >> np.uint64(64 - sum(simhash.WIDTHS[i] for i in c)) for c in simhash.CHOICES]
        assert any(r[0] == r[1] for r in roots)
        assert all((simhash._turned(two, c)[0] ^ simhash._turned(two, c)[1]).item().bit_count() == 4 for c in simhash.CHOICES)


def test_dense_and_chained_prints(spark):
    """Hundreds of prints round a few centres, and chains: joined by tries."""
    rng = random.Random(2)
    prints = {0, 2**64 - 1}
    for _ in range(5):
        centre = rng.getrandbits(64)
        for _ in range(60):
            k = centre
            for _ in range(rng.randrange(7)):
                k ^= 1 << rng.randrange(64)
            prints.add(k)
    k = rng.getrandbits(64)
    for step in range(12):  # a chain whose ends differ in many bits
        prints.add(k := k ^ (0b1111 << (5 * step)))
    prints = sorted(prints)
    rows = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(rows).collect()}
    assert [got[i] for i in range(len(prints))] == brute_groups(prints, list(range(len(prints))))


def test_simhash_edges(awkward, empty):
    out = simhash.simhash_groups(awkward).collect()
    assert len(out) == awkward.count() and {r.fingerprint for r in out if r.doc_id in (1, 2, 3)} == {"0" * 16}
    first = simhash.first_of_groups(awkward)
    assert first.columns == awkward.columns
    # Brute force: one row for each group of prints, the least id of it, nulls last.
    rows = awkward.collect()
    prints = [brute_print(r.text) for r in rows]
    group = brute_groups(prints, list(range(len(rows))))
    want = []
    for g in set(group):
        ids = [r.doc_id for r, k in zip(rows, group, strict=True) if k == g]
        want.append(min(ids, key=lambda k: (k is None, k or 0)))
    kept = first.collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted(want, key=str)
    assert all(r in rows for r in kept)
    assert simhash.simhash_groups(empty).count() == 0 and simhash.first_of_groups(empty).count() == 0


def brute_repeats(texts: list) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[p : p + 200] for d in data for p in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - 199):
            if counts[d[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(d, gone, strict=True) if not y)
        out.append((len(d), sum(gone), sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts() -> list:
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghij klmno\n") for _ in range(n))
    base = [noise(rng.randrange(100, 900)) for _ in range(8)]
    texts = ["", None, "a" * 199, "a" * 200, "b" * 201, "c" * 700, "ab" * 200, "xyz" * 300, noise(200) * 2, noise(199) * 2]
    for i in range(90):
        t = rng.choice(base)
        if i % 5 == 1:
            a = rng.randrange(len(t))
            t = t[:a] + "é" + t[a + 1 :]
        elif i % 5 == 2:
            t = noise(rng.randrange(200)) + t[rng.randrange(50) :] + noise(rng.randrange(200))
        elif i % 5 == 3:
            t = t + rng.choice(base)
        elif i % 5 == 4:
            t = "".join("#" if rng.random() < 1 / 190 else c for c in t)
        texts.append(t)
    return texts


def test_repeats_equal_brute_force(make):
    texts = repeated_texts()
    got = repeats.repeat_table(make(texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats(texts)


@pytest.mark.parametrize("classes", [1, 2, 5])
def test_induced_order_equals_counting(classes, monkeypatch):
    """in_order() against counts of every window, for dictionary rows of one class of tau after another."""
    width = -(-repeats.WINDOW // classes)
    monkeypatch.setattr(repeats, "WIDTH", width)
    strings = [t.encode() for t in repeated_texts() if t and len(t.encode()) >= 200]
    rows, windows = [], []
    for i, data in enumerate(strings):
        for s, e, t in zip(*(x.tolist() for x in repeats.parse(data)), strict=True):
            for c in range(classes):
                high, low = min(t - s, c * width + width - 1), max(t - e, c * width)
                if low <= high:
                    rows.append((i, 0, repeats.OPEN, c, t, high, data[t - high : t - low + 200]))
                    windows += [(i, p, t - p, data[p : p + 200]) for p in range(t - high, t - low + 1)]
    counts = Counter(x[3] for x in windows)
    want = sorted((i, p) for i, p, _, w in windows if counts[w] > 1)
    got = sorted((i, p) for i, _, a, b in repeats.spans_in(rows) for p in range(a, b + 1))
    assert got == want and 0 < len(got) < len(windows)


def test_parsing_by_blocks_equals_parsing_at_once(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 100, 5000, dtype=np.uint8)), b"a" * 3000, b"xyz" * 900, b"q" * 250 + bytes(rng.integers(97, 123, 900, dtype=np.uint8))]
    whole = [repeats.phrase_rows(t) for t in texts]
    monkeypatch.setattr(repeats, "BLOCK", 97)
    for a, b in zip(whole, map(repeats.phrase_rows, texts), strict=True):
        assert all((x == y).all() for x, y in zip(a, b, strict=True))
    assert all(len(x[0]) <= 3 for x in whole[1:3]), "runs of one byte and of a short period are a few rows"


def test_identical_rows_cost_no_more_than_other_rows(make, spark):
    """Repeated rows of one id and text are marked once: 3,000 of them take about as long as 3,000 ids."""
    import time

    rng = random.Random(13)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(700))
    repeats.repeat_table(make([text, text])).collect()
    took = []
    for rows in ([(i, text, "en", "a") for i in range(3000)], [(1, text, "en", "a")] * 3000):
        began = time.perf_counter()
        got = repeats.repeat_table(make(rows)).collect()
        took.append(time.perf_counter() - began)
        assert len(got) == 3000 and {(r.n_bytes, r.n_removed, r.n_spans) for r in got} == {(len(text), len(text), 1)}
    assert took[1] < 3 * took[0] + 5


def crowd_texts(n: int) -> list:
    """n texts that share a passage of 330 bytes, some with a byte changed in it or cut, between words of their own."""
    rng = random.Random(29)
    words = lambda k: " ".join(f"w{rng.randrange(10**7)}" for _ in range(k))
    passage = words(40)[:330]
    texts = []
    for i in range(n):
        shared = passage
        if i % 7 == 1:
            a = rng.randrange(330)
            shared = passage[:a] + "é" + passage[a + 1 :]
        elif i % 7 == 2:
            shared = passage[rng.randrange(140) :]
        elif i % 7 == 3:
            shared = passage[: 330 - rng.randrange(140)]
        texts.append(f"{words(rng.randrange(25))}{shared}{words(rng.randrange(25))}")
    return texts


@pytest.mark.parametrize(("crowd", "narrower"), [(2, 8), (2, 2), (20, 3), (10**9, 8)])
def test_crowded_cores_are_cut(crowd, narrower, make, monkeypatch):
    """However few rows of a core make a crowd, results are those of counting every window."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "NARROWER", narrower)
    texts = crowd_texts(120) + repeated_texts()
    got = repeats.repeat_table(make(texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats(texts)


def test_no_task_orders_a_crowd(make, monkeypatch):
    """A passage of 2,500 texts: no key that reaches the ordering has more than CROWD rows, and bytes removed are right."""
    most = []
    order = repeats.ordered

    def counted(rows, width):
        most.append(max((r["count"] for r in rows.groupBy("key").count().collect()), default=0))
        return order(rows, width)

    monkeypatch.setattr(repeats, "ordered", counted)
    texts = crowd_texts(2500)
    got = repeats.repeat_table(make(texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats(texts)
    assert len(most) > 1 and max(most) <= repeats.CROWD


def test_every_window_has_its_phrase():
    rng = np.random.default_rng(0)
    for n in (0, 199, 200, 201, 1000):
        data = bytes(rng.integers(97, 101, n, dtype=np.uint8))
        first, last, at = repeats.parse(data)
        covered = [p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)]
        assert covered == list(range(max(0, n - 199)))
        assert all(b <= t <= a + repeats.WINDOW - 1 for a, b, t in zip(first, last, at, strict=True))


def test_repeat_edges(awkward, empty):
    out = repeats.repeat_table(awkward)
    assert sorted(tuple(r)[1:] for r in out.collect()) == sorted(brute_repeats([r.text for r in awkward.collect()]))
    assert repeats.repeat_table(empty).count() == 0


CHATS = "conv_id long, turn long, role string, text string"


def test_snapshots_collapse(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "bye <|im_end|>")]
    rows = [(c, t, *turns[t]) for c, n in ((1, 3), (2, 1), (3, 2), (4, 3)) for t in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 0, "system", "hi"), (None, 0, None, None), (7, 0, None, None)]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, CHATS)).collect()}
    assert set(out) == {1, 5, 6, 7}
    assert out[1].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye < |im_end|><|im_end|>\n"
    assert out[7].rendered == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat.format_chats(spark.createDataFrame([], CHATS)).count() == 0


def test_nulls_are_no_text(spark):
    """A null role or text is told from every text, and from the other one's null."""
    parts = [(None, None), (None, ""), ("", None), ("", ""), (None, "\x00"), ("\x00", None), ("\x01", "x"), (None, "x"), ("x", None)]
    out = chat.format_chats(spark.createDataFrame([(i, 0, *p) for i, p in enumerate(parts)], CHATS)).collect()
    assert {r.conv_id for r in out} == set(range(len(parts)))


def test_maximal_equals_brute_force(spark):
    rng = random.Random(5)
    convs = {i: [(rng.choice("ua"), rng.choice("xy")) for _ in range(rng.randrange(1, 5))] for i in range(120)}
    rows = [(c, t, *x) for c, turns in convs.items() for t, x in enumerate(turns)]
    got = {r.conv_id for r in chat.maximal(spark.createDataFrame(rows, CHATS)).collect()}
    want = {c for c, a in convs.items() if not any(len(b) > len(a) and b[: len(a)] == a or (b == a and d < c) for d, b in convs.items())}
    assert got == want


def test_queries_match_duckdb(spark):
    con = tables()
    for name, sql in catalogue.ORACLES.items():
        assert_same(catalogue.QUERIES[name](spark, SF), con, sql)


def test_pipeline_equals_brute_force(spark):
    """run() against the stages worked out one after another from their rows' own rules."""
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from corvane.llm.bpe import Encoder

    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = {r.doc_id for r in quality.quality_table(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.kept}
    docs = [d for d in docs if d["doc_id"] in kept]
    # Near-duplicates as the stage defines them: components of Jaccard 0.8 or more of five-word shingle sets.
    alone = brute_kept([(d["doc_id"], d["text"]) for d in docs])
    docs = [d for d in docs if d["doc_id"] in alone]
    docs = [d | {"text": secrets.redact(d["text"])} for d in docs]
    table = spark.createDataFrame([(d["doc_id"], d["source"], d["text"]) for d in docs], "doc_id long, source string, text string")
    copies: Counter = Counter()
    spots = {r.doc_id: (r.source, r._at, r._size) for r in mixing.keyed(table).collect()}
    budget = {r.source: (r.target, r.epochs, r.source_size) for r in mixing.mix_table(table).collect()}
    for source, (target, epochs, size) in budget.items():
        left = round(target) - epochs * size
        for k, (_, _, n) in sorted(((k, v) for k, v in spots.items() if v[0] == source), key=lambda x: x[1][1]):
            copies[k] += epochs + (left > 0 and 2 * left >= n > 0)
            left -= n
    e = Encoder(public_tokenizers.path(corpus_pipeline.VOCABULARY), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(e.ranks), special_tokens={})
    want = sorted((d["doc_id"], tuple(library.encode_ordinary(d["text"]))) for d in docs for _ in range(copies[d["doc_id"]]))
    got = sorted((r.doc_id, tuple(r.tokens)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and got


def test_sweep_removes_written_tables(spark, make):
    from corvane.llm import common

    table = common.written(make(["x"]), "swept")
    assert table.count() == 1
    common.sweep(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        table.count()


def test_phrases_of_long_periodic_texts_take_little_memory():
    """Peak of a fresh process over 20 MB of one byte, beyond what its imports take."""
    import subprocess
    import sys
    import time

    code = (
        "import resource, time; from corvane.llm import repeats; peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024;"
        "before, began = peak(), time.time(); rows = repeats.phrase_rows(b'a' * 20_000_000); print(len(rows[0]), peak() - before, time.time() - began)"
    )
    n, mb, seconds = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(n) == 1 and int(mb) < 300 and float(seconds) < 15


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_runs_of_equal_phrases_are_those_of_their_hashes(monkeypatch, block):
    import numpy as np
    import xxhash

    monkeypatch.setattr(repeats, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(60):
        unit = bytes(rng.randrange(97, 100) for _ in range(rng.choice((1, 2, 3, 40, 130, 131, 250))))
        data = bytes(rng.randrange(97, 123) for _ in range(rng.randrange(300))) + unit * rng.randrange(1, 300) + bytes(rng.randrange(97, 99) for _ in range(rng.randrange(300)))
        first, last, at = repeats.parse(data)
        ext = [xxhash.xxh3_64_intdigest(data[a : b + repeats.SPAN], 1) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        shape = ((last - first + 1) << 8 | (at - first)).tolist()
        new = [i for i in range(len(ext)) if i == 0 or (ext[i], shape[i]) != (ext[i - 1], shape[i - 1])]
        got = repeats.phrase_rows(data)
        assert got[0].tolist() == first[new].tolist() and got[2].tolist() == np.diff([*new, len(ext)]).tolist()


def test_stages_on_awkward_and_empty_tables(spark, awkward, empty):
    """Rows, not names alone: what each stage by itself makes of awkward rows, and nothing of an empty table."""
    import corpus_pipeline

    before = awkward.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, SF).collect() == []
        found = stage(spark, awkward, SF)
        after = found.collect()
        assert i == 4 or found.columns == awkward.columns
        if name in ("quality_rules", "near_duplicates"):
            # Rows stay as they are, none twice as often as before; all prose here repeats itself, so the rules keep none.
            assert not Counter(map(str, after)) - Counter(map(str, before)) and bool(after) == (name == "near_duplicates")
        elif name == "secret_scan":
            assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in before)
        elif name == "mix_sources":
            assert any(r.text for r in after) and {str(r) for r in after} <= {str(r) for r in before}
        else:
            assert [r.n_tokens for r in after] == [len(r.tokens) for r in after]
            assert Counter((r.doc_id, r.lang, r.source) for r in after) == Counter((r.doc_id, r.lang, r.source) for r in before)
