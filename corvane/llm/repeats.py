"""Removal of repeated byte strings by prefix-free parsing and suffix order.

A byte is removed if a string of SPAN (200) bytes that covers it also starts anywhere else, in the same document or
another. A window is such a string; the work is to tell which windows occur twice, without a row for each byte.

Parsing. A hash of each 8-byte gram slides over the text; the least of the WINDOW grams at a window's start is its
trigger. A trigger depends on the window's bytes alone, so equal windows have their triggers in the same place, and
every window has one. The windows of one trigger form a phrase: its own bytes are the starts of these windows, its
extension reaches to the end of the last one. All windows of a phrase hold the trigger's core, the 71 bytes from it on.
Phrases that repeat one after another, as in runs of a byte or a short period, are one row.

Counting. A core that occurs once has no repeated window. An extension that occurs twice makes all its windows
repeated. Only extensions that occur once but share their core with others are open; with one copy of each repeated
extension of these cores they are the dictionary.

Order. The dictionary's suffixes of at least 200 bytes are put in the corpus's order as prefix-free parsing does it. A
suffix is what stands before the trigger, a suffix of the dictionary's phrase, followed by what the parse goes on with
from the trigger. The parse is sorted once, with the common prefix of neighbours. The suffixes before the trigger are
induced from it: the order by tau + 1 bytes before the trigger is the order by tau bytes, dealt out by one byte more.
Equal suffixes of phrases are tied by the order of the parse, so equal windows are neighbours at each tau, and bytes,
not hashes, tell them.

Phrases meet by CLASSES classes of tau, each with the longer core that its windows share (136 bytes for two classes); a
class whose core occurs once has no repeated window and goes no further. Texts are named by two 64-bit hashes, and equal
texts are one: a text's phrases are marked once, however many rows have it.

Crowds. Rows of one core beyond CROWD, from a passage that very many texts share, are not one task's work: their class is
cut into NARROWER ones, whose windows share still longer cores, and counting and ordering start again there. Where such
a passage begins or ends, all but one of the narrower classes lie within it, and counting decides them, or outside,
where cores are unique. A class of one tau has nothing but equal strings, so this ends after three cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from corvane.llm.common import frequent, map_batches, shipped, small, written

SPAN, WINDOW, GRAM = 200, 130, 8
CORE = SPAN - WINDOW + 1
#: Classes of tau, the bytes of a window before its trigger, and how many tau each has.
CLASSES = 2
WIDTH = -(-WINDOW // CLASSES)
#: Window starts parsed at once, and dictionary rows put in order at once, at least.
BLOCK, SORTED = 1 << 20, 8000
#: Dictionary rows of one core that are put in order in one task at most, and the parts that a class with more is cut into.
CROWD, NARROWER = 1000, 8


Phrases = tuple[np.ndarray, np.ndarray, np.ndarray]


def parsed(data: bytes) -> Iterator[Phrases]:
    """First and last window start and trigger of each phrase, in order, a block of windows at a time; none for fewer than SPAN bytes."""
    n = len(data) - SPAN + 1
    held = None  # the block's last phrase: it may go on in the next one
    for a in range(0, n, BLOCK):
        at = a + _triggers(data[a : a + BLOCK + SPAN - 1])
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        first, trigger = a + new, at[new]
        if held is not None and trigger[0] == held[1]:
            first[0] = held[0]
        elif held is not None:
            first, trigger = np.concatenate(([held[0]], first)), np.concatenate(([held[1]], trigger))
        yield first[:-1], first[1:] - 1, trigger[:-1]
        held = first[-1], trigger[-1]
    if held is not None:
        yield np.array([held[0]]), np.array([n - 1]), np.array([held[1]])


def parse(data: bytes) -> Phrases:
    """All of parsed() at once."""
    none = np.zeros(0, np.int64)
    first, last, trigger = (np.concatenate(x) for x in zip((none, none, none), *parsed(data), strict=True))
    return first, last, trigger


def _triggers(data: bytes) -> np.ndarray:
    """The trigger of each window of data."""
    grams = np.ndarray((len(data) - GRAM + 1,), "<u8", buffer=data, strides=(1,))
    mixed = grams * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    # Upper half: hash; lower half: place, so that the first of equal hashes is the least.
    least = (mixed >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    wide = 1
    while 2 * wide <= WINDOW:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if WINDOW > wide:
        least = np.minimum(least[: wide - WINDOW], least[WINDOW - wide :])
    return (least[: len(data) - SPAN + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _again(data: bytes, first: np.ndarray, last: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Which phrases, in order, have the shape and the extension of the one before them: that extension begins as many bytes earlier as the phrase has windows."""
    out = np.zeros(len(first), bool)
    some = 1 + np.flatnonzero(shape[1:] == shape[:-1])
    for step in np.unique(last[some] - first[some]) + 1:
        those = some[last[some] - first[some] + 1 == step]
        a, b = first[those] - step, last[those] - step + SPAN
        if len(those) < 64:
            out[those] = [data[x:y] == data[x + step : y + step] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        else:
            low = int(a[0])
            view = np.frombuffer(data[low : int(b[-1] + step)], np.uint8)
            unlike = np.concatenate(([0], np.cumsum(view[:-step] != view[step:], dtype=np.int32)))
            out[those] = unlike[b - low] == unlike[a - low]
    return out


def phrase_rows(data: bytes) -> list[np.ndarray]:
    """Columns s, shape (windows x 256 + bytes from the first window to its trigger), run, core, ext of a text's phrases.

    run phrases with equal extensions that follow one another are one row. Such phrases are told by comparing bytes, a
    block at a time, and only the first of a run is hashed: a long text of one byte or a short period takes a block's memory.
    """
    parts: list[list[np.ndarray]] = []
    for first, last, at in parsed(data):
        if not len(first):
            continue
        shape = ((last - first + 1) << 8 | (at - first)).astype(np.int32)
        new = np.flatnonzero(~_again(data, first, last, shape))
        run = np.diff(np.concatenate((new, [len(first)]))).astype(np.int32)
        core = _signed([xxhash.xxh3_64_intdigest(data[a : a + CORE]) for a in at[new].tolist()])
        ext = _signed([xxhash.xxh3_64_intdigest(data[a : b + SPAN], 1) for a, b in zip(first[new].tolist(), last[new].tolist(), strict=True)])
        rows = [first[new].astype(np.int32), shape[new], run, core, ext]
        if parts and parts[-1][1][-1] == rows[1][0] and parts[-1][4][-1] == rows[4][0]:
            # The run of the block before goes on.
            parts[-1][2][-1] += rows[2][0]
            rows = [c[1:] for c in rows]
        if len(rows[0]):
            parts.append(rows)
    if not parts:
        return [np.zeros(0, t) for t in (np.int32, np.int32, np.int32, np.int64, np.int64)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id), F.xxhash64(whole).alias("k"), F.xxhash64(F.lit(1), whole).alias("k2"), whole.alias("text"))


PHRASE = StructType(
    [StructField(n, t) for n, t in (("k", LongType()), ("k2", LongType()), ("s", IntegerType()), ("shape", IntegerType()), ("run", IntegerType()), ("core", LongType()), ("ext", LongType()))]
)


def phrases(docs: DataFrame) -> DataFrame:
    """(k, k2, s, shape, run, core, ext) of every phrase of (k, k2, text)."""
    arrow = to_arrow_schema(PHRASE)
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, arrow.types, strict=True)], schema=arrow)

    return docs.select("k", "k2", "text").mapInArrow(run, PHRASE)


def _gathered(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[list[np.ndarray]]:
    """The columns of PHRASE of texts (k, k2, text), some tens of thousands of rows at a time."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        for k, k2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = phrase_rows(text.encode())
            if n := len(found[0]):
                held.append([np.full(n, k), np.full(n, k2), *found])
                size += n
            if size > least:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def cores_twice(docs: DataFrame) -> DataFrame:
    """(core, n_core) of the cores that occur twice; counts of a batch become one row for each core before the shuffle."""
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches):
            core, at = np.unique(held[5], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(np.bincount(at, held[4]).astype(np.int64))], names=["h", "n"])

    return frequent(docs.select("k", "k2", "text").mapInArrow(run, "h long, n long")).select(F.col("h").alias("core"), F.col("n").alias("n_core"))


REPEATED, WITNESS, OPEN = 0, 1, 2


def marks(docs: DataFrame) -> DataFrame:
    """(k, k2, s, shape, run, kind) of phrases whose core occurs twice: repeated as a whole, the same and a witness, or open."""
    # Both sides of the joins are plain tables, so that a hot core's phrases can be split at run time.
    found = written(phrases(docs).join(written(cores_twice(docs), "twice"), "core"), "candidates")
    exts = found.groupBy("core", "ext").agg(F.sum("run").alias("n_ext"), F.min(F.struct("k", "k2", "s")).alias("one"))
    exts = written(exts.where("n_ext > 1").withColumnsRenamed({"core": "_core", "ext": "_ext"}), "extensions")
    found = found.join(exts, (F.col("core") == F.col("_core")) & (F.col("ext") == F.col("_ext")), "left")
    witness = (F.col("n_ext") < F.col("n_core")) & (F.struct("k", "k2", "s") == F.col("one"))
    kind = F.when(F.col("n_ext").isNull(), OPEN).when(witness, WITNESS).otherwise(REPEATED)
    return written(found.select("k", "k2", "s", "shape", "run", kind.alias("kind")).distinct(), "marks")


def _by_text(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("k", "k2").agg(F.collect_list(F.struct(*columns)).alias("found"))


def _packed(docs: DataFrame) -> DataFrame:
    """docs with text compressed, for the shuffle."""

    def run(*columns: list) -> list:
        z = zstandard.ZstdCompressor(level=1).compress
        return [*columns[:-1], [z(t.encode()) for t in columns[-1]]]

    names = [c for c in docs.columns if c != "text"]
    return map_batches(docs.select(*names, "text"), run, StructType([*(docs.schema[c] for c in names), StructField("packed", BinaryType())]), cut=500)


DICTIONARY = StructType(
    [
        StructField(n, t)
        for n, t in (("key", LongType()), ("k", LongType()), ("k2", LongType()), ("kind", IntegerType()), ("class", IntegerType()), ("t", IntegerType()), ("before", IntegerType()), ("string", BinaryType()))
    ]
)


def classes(data: bytes, at: int, low: int, high: int, width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Of windows that begin low to high bytes before the trigger at data[at], by classes of width tau: key, class, greatest tau and string.

    key: a hash of the class's core, the bytes that all its windows share.
    """
    for c in range(low // width, high // width + 1):
        top, least = min(high, c * width + width - 1), max(low, c * width)
        key = xxhash.xxh3_64_intdigest(data[at - c * width : at - c * width + SPAN - width + 1], c << 8 | width) - 2**63
        yield key, c, top, data[at - top : at - least + SPAN]


def dictionary(docs: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each class of tau of each open phrase and witness, by the hash of the class's core.

    t: the trigger's place in its text; before: bytes of string before the trigger, the class's greatest tau for the
    phrase; string reaches to the end of its last window.
    """
    wanted = _by_text(found.where(F.col("kind") != REPEATED), "s", "shape", "kind")
    # One copy of a text is enough.
    texts = _packed(docs.select("k", "k2", "text")).groupBy("k", "k2").agg(F.first("packed").alias("packed"))
    rows = texts.join(wanted, ["k", "k2"]).select("k", "k2", "packed", "found")

    def run(ks: list, k2s: list, packs: list, lists: list) -> list:
        open_ = zstandard.ZstdDecompressor().decompress
        out: list[tuple] = []
        for k, k2, data, wants in zip(ks, k2s, packs, lists, strict=True):
            data = open_(data)
            for w in wants:
                n, most = w["shape"] >> 8, w["shape"] & 255
                t = w["s"] + most
                out += [(key, k, k2, w["kind"], c, t, top, string) for key, c, top, string in classes(data, t, most - n + 1, most, WIDTH)]
        return [list(c) for c in zip(*out, strict=True)] or [[]] * len(DICTIONARY)

    return map_batches(rows, run, DICTIONARY, cut=200)


def narrowed(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows of a dictionary cut into classes of width tau, and the spans (k, k2, a, b) that counting their strings decides.

    A string that occurs twice makes all its windows repeated; one of its rows stays, as a witness. Strings are compared
    by 128-bit hashes within equal cores.
    """
    named = StructType([*DICTIONARY, StructField("low", IntegerType()), StructField("name", BinaryType())])

    def run(keys: list, ks: list, k2s: list, kinds: list, old: list, ts: list, befores: list, strings: list) -> list:
        out: list[tuple] = []
        for k, k2, kind, t, high, data in zip(ks, k2s, kinds, ts, befores, strings, strict=True):
            for key, c, top, string in classes(data, high, high - len(data) + SPAN, high, width):
                out.append((key, k, k2, kind, c, t, top, string, top - len(string) + SPAN, xxhash.xxh3_128_digest(string, top)))
        return [list(c) for c in zip(*out, strict=True)] or [[]] * len(named)

    cut = written(map_batches(rows.select(DICTIONARY.names), run, named, cut=200), "cut")
    twice = cut.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "k2", "t")).alias("one")).where("n > 1")
    twice = small(written(twice.select(F.col("key").alias("_key"), F.col("name").alias("_name"), "one"), "strings-twice"))
    both = cut.join(twice, (F.col("key") == F.col("_key")) & (F.col("name") == F.col("_name")), "left")
    spans = both.where((F.col("kind") == OPEN) & F.col("one").isNotNull()).select("k", "k2", (F.col("t") - F.col("before")).alias("a"), (F.col("t") - F.col("low")).alias("b"))
    left = both.where(F.col("one").isNull() | (F.struct("k", "k2", "t") == F.col("one")))
    left = left.withColumn("kind", F.when(F.col("one").isNull(), F.col("kind")).otherwise(WITNESS))
    return written(left.select(DICTIONARY.names), "narrowed"), spans


def in_order(data: np.ndarray, trigger: np.ndarray, low: np.ndarray, high: np.ndarray, base: int) -> np.ndarray:
    """For dictionary rows: which windows, by tau - base, occur in another row or at another tau.

    data: the rows' strings, with SPAN bytes to spare at either end; trigger: where each row's trigger stands in it.
    low, high: the tau of each row's windows, all from base to base + WIDTH - 1. Rows need not share a core.
    """
    n = len(trigger)
    out = np.zeros((n, WIDTH), bool)
    # The parse's order: what follows the trigger, within equal base bytes before it (all windows of the class have these).
    whole = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, base + SPAN)[trigger - base])
    order = np.argsort(whole.view(np.dtype((np.void, base + SPAN))).ravel(), kind="stable")
    same = whole[order[1:]] == whole[order[:-1]]
    common = np.where(same.all(1), base + SPAN, same.argmin(1)) if n > 1 else np.zeros(0, np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # A row's suffix of the dictionary by name: rows with equal names agree in the tau bytes before the trigger.
    name = np.zeros(n, np.int64)
    name[order] = np.concatenate(([0], np.cumsum(common < base)))
    for tau in range(base, base + WIDTH):
        if tau > base:
            order = order[high[order] >= tau]
            if len(order) < 2:
                break
            byte = data[trigger[order] - tau]
            turn = np.argsort(byte, kind="stable")
            order, byte = order[turn], byte[turn]
            old = name[order]
            name[order] = np.concatenate(([0], np.cumsum((byte[1:] != byte[:-1]) | (old[1:] != old[:-1]))))
        here = order[low[order] <= tau]
        if len(here) < 2:
            continue
        # Equal names are tied by the parse: do the parts from the trigger on agree in the SPAN - tau bytes that are left?
        depth = np.concatenate(([0], np.cumsum(common < base + SPAN - tau)))[place[here]]
        alike = (name[here[1:]] == name[here[:-1]]) & (depth[1:] == depth[:-1])
        out[here[1:], tau - base] |= alike
        out[here[:-1], tau - base] |= alike
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


SPANS = StructType([StructField("k", LongType()), StructField("k2", LongType()), StructField("a", IntegerType()), StructField("b", IntegerType())])


def spans_in(rows: list[tuple], width: int | None = None) -> list[tuple[int, int, int, int]]:
    """(k, k2, a, b) of the runs of repeated window starts in the open ones of rows (k, k2, kind, class, t, before, string).

    width: how many tau a class has, WIDTH at most, which None stands for.
    """
    out = []
    for c in sorted({r[3] for r in rows}):
        own, base = [r for r in rows if r[3] == c], c * (width or WIDTH)
        lengths = np.array([len(r[6]) for r in own])
        before = np.array([r[5] for r in own])
        starts = SPAN + np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join([bytes(SPAN), *(r[6] for r in own), bytes(SPAN)]), np.uint8)
        low = before - (lengths - SPAN)
        flags = in_order(data, starts + before, low, before, base)
        for i in np.flatnonzero(flags.any(1)).tolist():
            k, k2, kind, _, t, *_ = own[i]
            if kind == OPEN:
                out += [(k, k2, t - base - b, t - base - a) for a, b in _runs(flags[i])]
    return out


def resolved(rows: DataFrame) -> DataFrame:
    """(k, k2, a, b): runs of repeated window starts in the open phrases of a written dictionary()."""
    found, width = [], WIDTH
    while True:
        counts = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
        crowded = counts.where(F.col("n") > CROWD).select("key")
        if crowded.isEmpty():
            return reduce(DataFrame.union, found, ordered(rows.join(counts, "key", "left_semi"), width))
        crowded = small(crowded)
        others = rows.join(crowded, "key", "left_anti")
        found.append(ordered(others.join(counts, "key", "left_semi"), width))
        width = -(-width // NARROWER)
        rows, spans = narrowed(rows.join(crowded, "key", "left_semi"), width)
        found.append(spans)


def ordered(rows: DataFrame, width: int) -> DataFrame:
    """(k, k2, a, b) of the open ones of dictionary rows, in classes of width tau; the rows of a key are put in order in one task."""
    near = rows.repartition("key").sortWithinPartitions("key")
    arrow = to_arrow_schema(SPANS)
    shipped(rows.sparkSession)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        before = None
        for part in batches:
            for key, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if key != before and len(held) >= SORTED:
                    yield batch(spans_in(held, width))
                    held = []
                before = key
                held.append(tuple(row))
        if held:
            yield batch(spans_in(held, width))

    return near.mapInArrow(run, SPANS)


def repeat_spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (id, k, k2, text) of docs, and spans (k, k2, a, b): runs of window starts that repeat."""
    rows = _keyed(docs, id, text)
    found = marks(rows)
    more = written(resolved(written(dictionary(rows, found), "dictionary")), "resolved")
    last = F.col("s") + F.col("run") * F.shiftright("shape", 8) - 1
    return rows, found.where(F.col("kind") != OPEN).select("k", "k2", F.col("s").alias("a"), last.cast("int").alias("b")).unionByName(more)


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row of docs.

    Null and empty texts have no bytes. Repeated rows repeat each other, so both lose every byte that a window covers.
    Texts under 200 bytes lose nothing. Remaining bytes need not be valid UTF-8.
    """
    rows, spans = repeat_spans(docs, id, text)
    spans = written(_by_text(spans, "a", "b").withColumnsRenamed({"k": "_k", "k2": "_k2"}), "spans")
    joined = _packed(rows).join(spans, (F.col("k") == F.col("_k")) & (F.col("k2") == F.col("_k2")), "left").select(id, "packed", "found")

    def run(ids: list, packs: list, lists: list) -> list:
        open_ = zstandard.ZstdDecompressor().decompress
        out = []
        for data, spans in zip(packs, lists, strict=True):
            data = open_(data)
            turn = np.zeros(len(data) + 1, np.int32)
            for x in spans or ():
                turn[x["a"]] += 1
                turn[x["b"] + SPAN] -= 1
            gone = np.cumsum(turn[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((len(data), int(gone.sum()), len(_runs(gone)), kept))
        return [ids, *([x[k] for x in out] for k in range(4))]

    longs = [StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    return map_batches(joined, run, StructType([docs.schema[id], *longs, StructField("kept", BinaryType())]), cut=500)


def repeat_table(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """without_repeats() with kept_sha256 in place of the bytes."""
    out = without_repeats(docs, id, text)
    return out.select(id, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB: repeat_table() over documents, by counting every window of 200 bytes.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(coalesce(text, '')) AS h FROM documents),
w AS (
  SELECT rid, p, md5(substr(h, 2 * p + 1, {2 * SPAN})) AS m FROM (SELECT rid, h, unnest(range(length(h) // 2 - {SPAN - 1})) AS p FROM d WHERE length(h) >= {2 * SPAN})
), c AS (
  SELECT m FROM w GROUP BY 1 HAVING count(*) > 1
), r AS (
  SELECT rid, p FROM w SEMI JOIN c USING (m)
), i AS (
  SELECT rid, p, coalesce((p > lag(p) OVER (PARTITION BY rid ORDER BY p) + {SPAN})::INT, 1) AS new FROM r
), s AS (
  SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS run FROM i
), a AS (
  SELECT rid, min(p) AS a, max(p) + {SPAN} AS b FROM s GROUP BY rid, run
), g AS (
  SELECT *, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS before FROM a
), k AS (
  SELECT rid, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last
  FROM g JOIN d USING (rid) GROUP BY rid
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN k.rid IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
