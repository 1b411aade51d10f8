"""BPE, secrets, fingerprints, quality rules, classifier."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken

from corvane.llm import bpe, classifier, fingerprints, quality, secrets

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return bpe.Encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs(ours):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(ours.ranks), special_tokens={})


def test_bpe_equals_the_library(ours, theirs):
    rng = random.Random(1)
    texts = ["", " ", "hello world", "x" * 3000, "ab" * 500, "日本語のテキスト 12345", "🙂🙃 naïve\r\n\t  end  ", "<|endoftext|>"]
    texts += ["".join(rng.choice("abAB 1.\n\té ñ中ß!'s🙂") for _ in range(rng.randrange(80))) for _ in range(800)]
    for t in texts:
        ids = ours.encode(t)
        assert ids == theirs.encode_ordinary(t) and ours.decode(ids) == t.encode()
    ours.kept.clear()
    ours.learn({p for t in texts for p in ours.split(t)})
    assert all(ours.encode(t) == theirs.encode_ordinary(t) for t in texts)


def test_trees_together_equal_trees_alone(ours):
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"abcde \xc3\xa9") for _ in range(rng.randrange(2, 64))) for _ in range(400)]
    pieces = [p for p in pieces if p not in ours.ranks]
    assert ours.merge_many(pieces) == [ours.merge(p) for p in pieces]


def test_token_digests(awkward, empty, theirs):
    frame = bpe.token_digests(awkward, PATH, public_tokenizers.PATTERN)
    texts = [r.text or "" for r in awkward.collect()]
    for t, r in zip(texts, frame.collect(), strict=True):
        ids = theirs.encode_ordinary(t)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.token_digests(empty, PATH, public_tokenizers.PATTERN).count() == 0
    got = bpe.encode_documents(awkward, PATH, public_tokenizers.PATTERN).collect()
    assert [r.tokens for r in got] == [theirs.encode_ordinary(t) for t in texts]


def brute_secrets(text: str) -> list:
    """Plain searches over the whole text."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_secrets_equal_plain_searches():
    rng = random.Random(3)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abc", "abcdef12", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef", "İ", "ſecret=abcdefg", "K", "\n", "é", "-", "."]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert [s for s in secrets.scan(text) if s[2] in secrets.BASE_KINDS] == brute_secrets(text), text


def token_with_checksum(prefix: str, body: str) -> str:
    value, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        tail = secrets.BASE62[d] + tail
    return prefix + body + tail


def test_checksums_decide():
    good = token_with_checksum("ghp_", "aB3" * 10)
    assert [s[2] for s in secrets.scan(f"x {good} y")] == ["github"]
    assert not secrets.scan(f"x {good[:-1]}{'0' if good[-1] != '0' else '1'} y")
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    body = base64.urlsafe_b64encode(b'{"sub":"someone"}').decode().rstrip("=")
    assert [s[2] for s in secrets.scan(f"{head}.{body}.{'a' * 20}Z")] == ["jwt"]
    pem = "-----BEGIN PRIVATE KEY-----\nMIIB\n-----END PRIVATE KEY-----"
    assert secrets.redact(f"a {pem} b") == "a [pem] b"


def test_jwts_equal_the_plain_expression_and_take_linear_time():
    import time

    plain = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}")
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    rng = random.Random(8)
    parts = ["eyJ", "EYJ", ".", "..", head, "abcdefgh", "abcdefghijklmnopqr", "-", "_", " ", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 16)))
        want = [(m.start(), m.end(), "jwt") for m in plain.finditer(text) if secrets._jwt_holds(m[0])]
        assert [s for s in secrets.scan(text) if s[2] == "jwt"] == want, text
    began = time.perf_counter()
    for unit in ("eyJ", "eyJ.", "eyJabcdefgh.", "token=", "AKIA", "-----BEGIN PRIVATE KEY-----", "password "):
        secrets.scan(unit * (5_000_000 // len(unit)))
    assert time.perf_counter() - began < 60


def test_secret_tables(awkward, empty, make):
    assert secrets.scan_documents(awkward).count() == awkward.count()
    r = secrets.scan_documents(make(["my token = abcdef123 and 0123456789abcdef01234567"])).first()
    assert (r.n_assign, r.n_access, r.n_hex, r.spans) == (1, 0, 1, "assign:3:20,hex:25:49")
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    out = secrets.redact_documents(awkward)
    assert out.columns == awkward.columns
    assert [r for r in out.collect() if r.doc_id != 9] == [r for r in awkward.collect() if r.doc_id != 9]
    assert [(r.text, r.n_chars) for r in out.collect() if r.doc_id == 9] == [("[hex]", 5)]
    changed = secrets.redact_documents(make(["my token = abcdef123"])).first()
    assert (changed.text, changed.n_chars) == ("my [assign]", 11)
    assert secrets.scan_documents(empty).count() == 0 and secrets.redact_documents(empty).count() == 0


def test_fingerprints_fold_and_tell_apart(make):
    a = fingerprints.fingerprint_groups(make(["Ünïcode  TEXT", "ünïcode text\n", "ünïcode text!", None, ""])).orderBy("doc_id").collect()
    assert a[0].fingerprint == a[1].fingerprint != a[2].fingerprint and a[3].fingerprint == a[4].fingerprint
    assert [r["first"] for r in a] == [0, 0, 2, 3, 3]


def test_equal_hashes_of_unequal_texts_get_numbers(make, monkeypatch, spark):
    monkeypatch.setattr(fingerprints, "digest", lambda data: "same")
    monkeypatch.setattr(fingerprints, "map_batches", local_map(spark))
    got = fingerprints.fingerprint_groups(make(["one", "two", "one"])).orderBy("doc_id").collect()
    assert got[0].fingerprint == got[2].fingerprint != got[1].fingerprint and [r["first"] for r in got] == [0, 1, 0]


def local_map(spark):
    """map_batches() on the driver, where a test has replaced parts of the module."""

    def run(df, fn, schema, cut=0):
        rows = df.collect()
        out = fn(*([r[i] for r in rows] for i in range(len(df.columns)))) if rows else []
        return spark.createDataFrame(list(zip(*out, strict=True)), schema)

    return run


def test_edits_equal_brute_force(awkward, empty, make):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc é\n") for _ in range(rng.randrange(0, 40))) for _ in range(300)] + ["", "x"]
    got = {r.doc_id: r for r in fingerprints.edit_table(make(texts)).collect()}
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        a, b, c = map(fingerprints.canonical, (t, new, nxt))
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (got[i].near_edited, got[i].near_next) == (float(a == b), float(a == c))
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (a == b)
    assert fingerprints.edit_table(awkward).count() == awkward.count()
    assert fingerprints.edit_table(empty).count() == 0
    assert fingerprints.edit_table(make(["alone"])).first().near_next == 1.0


def brute_measure(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen: dict = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_measures_equal_brute_force():
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "b", "cé", " ", " ", "\n", "#", "\x0b", " ", "\x85"]) for _ in range(rng.randrange(60)))
        assert quality.measure(text)[:5] == brute_measure(text), repr(text)


def test_buckets_keep_order_and_edges(spark):
    from pyspark.sql import functions as F

    values = [0, 1, 63, 64, 65, 127, 128, 255, 256, 1000, 5000, 2**31 - 1, 2**31]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("low")).collect()
    assert all(r.low <= r.v < r.low * (1 + 1 / 64) + 1 for r in got) and [r.low for r in got] == sorted(r.low for r in got)
    assert all(r.low == r.v for r in got if r.v < 128)


def brute_fences(rows: list[tuple], prior: int = quality.PRIOR) -> dict:
    """{(lang, source): (q1, q3)} of (lang, source, value) rows, by weighted lists of the values themselves."""
    from fractions import Fraction

    def spread(items: list, parent: dict) -> dict:
        out = {v: Fraction(prior) * w for v, w in parent.items()}
        for v in items:
            out[v] = out.get(v, 0) + 1
        total = sum(out.values())
        return {v: w / total for v, w in out.items()}

    def quartile(share: dict, p: Fraction):
        upto = Fraction(0)
        for v in sorted(share):
            upto += share[v]
            if upto >= p:
                return v

    values = [v for *_, v in rows]
    top = {v: Fraction(values.count(v), len(values)) for v in set(values)}
    out = {}
    for lang in {r[0] for r in rows}:
        mid = spread([v for a, _, v in rows if a == lang], top)
        for source in {r[1] for r in rows if r[0] == lang}:
            own = spread([v for a, b, v in rows if (a, b) == (lang, source)], mid)
            out[lang, source] = quartile(own, Fraction(1, 4)), quartile(own, Fraction(3, 4))
    return out


def test_fences_equal_brute_force(make):
    """Small and large groups, a null language and source: every fence comes from the blended sketches, by exact fractions."""
    rng = random.Random(11)
    docs = []
    for g, (lang, source, n, length) in enumerate((("en", "a", 300, 5), ("en", "b", 3, 9), ("de", "a", 40, 7), (None, "a", 20, 3), ("de", None, 1, 12))):
        docs += [(1000 * g + i, " ".join("".join(rng.choices("abcdefghijklm", k=max(1, length + rng.randrange(-2, 3)))) for _ in range(60)), lang, source) for i in range(n)]
    table = make(docs)
    got = {(r._lang, r._source): r for r in quality.thresholds(quality.measured(table)).collect()}
    rows = []
    for r in quality.measured(table).collect():
        v = 100 * r._q_word_chars // r._q_n_words
        shift = max(v.bit_length() - 7, 0)
        rows.append((r.lang, r.source, v >> shift << shift))
    want = brute_fences(rows)
    assert {k: (r.low_word_hundredths, r.high_word_hundredths) for k, r in got.items()} == {k: (a - 4 * (b - a), b + 4 * (b - a)) for k, (a, b) in want.items()}
    assert len({(r.low_word_hundredths, r.high_word_hundredths) for r in got.values()}) >= 4
    assert {r.high_mark_pm for r in got.values()} == {None}, "no text shows a mark, so nothing is judged by marks"


def test_sketches_decide_on_the_given_table(spark):
    """No constant stands in for the sketches: fences of the groups differ from one another, and move with a group's texts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = quality.measured(docs.select("lang", "source", "text")).drop("text")
    fences = quality.thresholds(rows).collect()
    for name in ("high_mark_pm", "high_repeat_pm", "high_dup_line_pm", "high_word_hundredths", "low_word_hundredths"):
        values = [r[name] for r in fences]
        most = max(values.count(v) for v in values)
        assert most <= len(values) / 2, name


def test_each_measure_rejects_and_clean_documents_stay(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = quality.measured(docs.select("doc_id", "lang", "source", "text")).drop("text")
    rows = quality.judged(rows, quality.thresholds(rows)).where("not _q_failed")
    value = quality.measures()
    beyond = [F.count_if(value[k] > F.col(f"high_{k}")).alias(k) for k, *_ in quality.RULES]
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = rows.join(labels, "doc_id", "left")
    found = rows.agg(*beyond, F.avg(F.when(F.col("quality") == 1, (~F.col("_q_kept")).cast("int"))).alias("clean"), F.avg(F.when(F.col("quality") == 0, (~F.col("_q_kept")).cast("int"))).alias("junk")).first()
    assert all(found[k] > 0 for k, *_ in quality.RULES) and found.clean <= 0.005 and found.junk == 1


def test_many_sources_make_no_more_rows_than_their_sketches(spark):
    """A group's fences need the rows of its own sketch alone; its language's go to each task of GROUPS groups."""
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select(
        F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 20_000).alias("source"), *(F.lit(100).cast("long").alias(f"_q_{k}") for k in ("n_words", "n_symbols", "n_lines")),
        (F.col("id") % 40).alias("_q_n_marks"), (500 + F.col("id") % 7).alias("_q_word_chars"), *(F.lit(0).cast("long").alias(f"_q_{k}") for k in ("n_dup_lines", "n_repeat_words")),
    )
    fences = quality.thresholds(rows)
    assert fences.count() == 20_000 and fences.agg(F.count_distinct("high_mark_pm")).first()[0] > 1


def test_rules_adapt_and_keep_clean_documents(make):
    rng = random.Random(7)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(80))
    clean = [(i, prose(), "en", "prose") for i in range(600)]
    code = [(1000 + i, prose().replace(" ", " <b> "), "en", "code") for i in range(600)]
    junk = [(5000 + i, " ".join(w + "$$$" for w in prose().split()), "en", "prose") for i in range(10)]
    short = [(6000, "too short", "en", "prose")]
    got = {r.doc_id: r for r in quality.quality_table(make(clean + code + junk + short)).collect()}
    assert all(got[i].kept for i, *_ in clean)
    assert all(got[i].kept for i, *_ in code), "a source of mark-up has a threshold of its own"
    assert not any(got[i].kept for i, *_ in junk) and got[6000].base_failed and not got[6000].kept


def test_quality_edges(awkward, empty):
    out = quality.quality_table(awkward)
    assert out.count() == awkward.count() and out.where("kept and base_failed").count() == 0
    assert quality.kept_documents(awkward).columns == awkward.columns
    assert quality.quality_table(empty).count() == 0 and quality.kept_documents(empty).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in classifier.quality_scores(docs, labels).collect()}
    truth = [(got[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    good, bad = [g.score for g, q in truth if q == 1], [g.score for g, q in truth if q == 0]
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(g.predicted == q for g, q in truth) / len(truth) > 0.9
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for k, r in got.items())


def test_training_never_sees_held_out_rows(labelled):
    docs, labels = labelled
    spark = docs.sparkSession
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    a = classifier.quality_scores(docs, labels).collect()
    b = classifier.quality_scores(docs.repartition(3), flipped).collect()
    assert {r.doc_id: r.score for r in a} == pytest.approx({r.doc_id: r.score for r in b}) and spark is not None


def test_classifier_edges(awkward, empty, labelled, spark):
    _, labels = labelled
    none = labels.where("false")
    assert {r.score for r in classifier.quality_scores(awkward, none).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1, 0), (5, 1, 0), (5, 0, 0), (6, None, 1), (7, 3, 0), (4, 0, 0), (99, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    out = classifier.quality_scores(awkward, odd).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert classifier.quality_scores(empty, labels).count() == 0


def test_long_texts_score_as_in_one_piece(monkeypatch):
    """Runs of passages with a running softmax give what all passages at once give; packing loses nothing."""
    import numpy as np

    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abc!#") for _ in range(rng.randrange(1, 9))) for _ in range(n)) for n in (0, 1, 64, 65, 900, 3000)]
    model = classifier.Model(3)
    whole = [float(model.forward(x.astype(np.float64), np.zeros(len(x), np.int64), 1)[0][0]) for x in map(classifier.passages, texts)]
    assert all((classifier.unpacked(classifier.packed(t)) == classifier.passages(t)).all() for t in texts)
    assert model.score(texts) == pytest.approx(whole, abs=1e-12)
    monkeypatch.setattr(classifier, "RUN", 3)
    assert model.score(texts) == pytest.approx(whole, abs=1e-12)


def test_gradient_equals_differences():
    import numpy as np

    rng = np.random.default_rng(0)
    model = classifier.Model()
    x, bag, y = rng.normal(size=(7, classifier.WIDTH)), np.array([0, 0, 0, 1, 1, 2, 2]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(p := model.forward(x, bag, 3)[0]) + (1 - y) * np.log(1 - p))
    score, kept = model.forward(x, bag, 3)
    g = model.gradient(y, bag, score, kept)
    for name, at in (("E", (3, 5)), ("e", (2,)), ("V", (1, 4)), ("U", (6, 2)), ("w", (5,)), ("c", (7,)), ("b", (0,))):
        old = model.p[name][at]
        model.p[name][at] = old + 1e-6
        up = loss()
        model.p[name][at] = old - 1e-6
        assert (up - loss()) / 2e-6 == pytest.approx(g[name][at], rel=1e-4, abs=1e-8)
        model.p[name][at] = old


def test_text_ids_are_scored(spark):
    from corvane.llm import classifier

    docs = spark.createDataFrame([(f"d{i}", ("fine prose here " if i % 2 else "$$$ ### %%% ") * 20) for i in range(40)] + [(None, None)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)], "doc_id string, quality int")
    rows = classifier.quality_scores(docs, labels).collect()
    assert len(rows) == 41 and all(0 <= r.score <= 1 for r in rows) and {r.doc_id for r in rows} == {f"d{i}" for i in range(40)} | {None}
