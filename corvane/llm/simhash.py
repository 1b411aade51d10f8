"""SimHash near-duplicates by a self-join of binary tries.

Of 64 bits in seven blocks, fingerprints that differ in at most 4 bits agree in at least three blocks. For each of the
35 choices of three blocks the fingerprint is turned so that these lead: their 27 or 28 bits are the root of a trie of
its own, and each root is a task key. Inside a root, pairs of nodes walk down together; a pair carries the bits in
which it differs so far and is dropped when they exceed the budget. A root of 27 bits holds 75 of ten billion evenly
spread fingerprints, so only fingerprints that really are close meet.

Equal fingerprints collapse before the join, so exact copies cost nothing there. Each task returns stars (a fingerprint
and the least one of its cluster) instead of pairs, and pairs of nodes whose leaves are already one cluster are
dropped: a dense group of near copies costs about its size, not its square. Clusters of tasks meet in a distributed
connected-components loop over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corvane.llm.common import aside, map_batches, shipped, small, written

#: Widths and places of the blocks, from the top bit; the blocks that lead, for each choice of EQUAL ones.
WIDTHS, EQUAL = (10, 9, 9, 9, 9, 9, 9), 3
PLACES = (0, *accumulate(WIDTHS))[:-1]
CHOICES = tuple(combinations(range(len(WIDTHS)), EQUAL))
#: A task key is a choice's number, then its root in so many bits.
ROOT = 32
#: Fingerprints of whole tasks that a worker joins at once, at least.
HELD = 50_000
#: Node pairs that walk down at once.
FRONT = 1 << 18


def shingle_hashes(text: str | None, words: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of each run of so many words of the text, A-Z lower-cased; of all words if there are fewer."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)], np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def print_of(hashes: np.ndarray) -> int:
    """64 bits, one set where over half of the hashes have it set; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """The print of the text's shingles; 0 without words."""
    return print_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 4, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of keep and fp (long, the fingerprint's 64 bits) of every row; null and empty texts have 0."""

    def run(*columns: list) -> list:
        return [*columns[:-1], np.array([fingerprint(t, words) for t in columns[-1]], np.uint64).view(np.int64)]

    return map_batches(docs.select(*keep, text), run, StructType([*(docs.schema[k] for k in keep), StructField("fp", LongType())]))


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (each cluster's least member) after joining the clusters of a[i] and b[i]."""
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return label
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label = label[label]


def trie_join(keys: np.ndarray, pairs: list[np.ndarray], budget: int) -> np.ndarray:
    """Clusters of sorted 64-bit keys that differ in at most budget bits: each key's least place in its cluster.

    pairs: node pairs to begin with, as (lo, hi, lo, hi, depth, differing bits); a node is a range of places whose keys
    agree in their first depth bits.
    """
    label = np.arange(len(keys))
    stack = [np.stack(pairs).astype(np.int64).reshape(6, -1)] if pairs else []
    zeros: dict[int, np.ndarray] = {}
    while stack:
        front = stack.pop()
        if front.shape[1] > FRONT:
            half = front.shape[1] // 2
            stack += [front[:, half:], front[:, :half]]
            continue
        # Pairs of nodes whose leaves are all in one cluster have nothing to add.
        turns = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        one = (turns[front[1] - 1] == turns[front[0]]) & (turns[front[3] - 1] == turns[front[2]]) & (label[front[0]] == label[front[2]])
        front = front[:, ~one]
        leaf = (front[1] - front[0] == 1) & (front[3] - front[2] == 1)
        if leaf.any():
            a, b = front[0][leaf], front[2][leaf]
            near = np.bitwise_count(keys[a] ^ keys[b]) <= budget
            label = _roots(label, a[near], b[near])
            front = front[:, ~leaf]
        if not front.shape[1]:
            continue
        out = []
        for depth in np.unique(front[4]).tolist():
            if depth not in zeros:
                zeros[depth] = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1) == 0)))
            z = zeros[depth]
            al, ah, bl, bh, _, diff = front[:, front[4] == depth]
            am, bm = al + z[ah] - z[al], bl + z[bh] - z[bl]
            own = al == bl
            for lo, hi, lo2, hi2, more, where in (
                (al, am, bl, bm, 0, None),
                (am, ah, bm, bh, 0, None),
                (al, am, bm, bh, 1, None),
                (am, ah, bl, bm, 1, ~own),
            ):
                ok = (hi > lo) & (hi2 > lo2) & (diff + more <= budget) & ~(own & (more == 0) & (hi - lo == 1))
                if where is not None:
                    ok &= where
                if ok.any():
                    out.append(np.stack([lo[ok], hi[ok], lo2[ok], hi2[ok], np.full(ok.sum(), depth + 1), diff[ok] + more]))
        # The nearest pairs come last and so off the stack first: clusters grow early and spare the rest.
        out.sort(key=lambda x: -x[5].min())
        stack += [np.concatenate(out, axis=1)] if sum(x.shape[1] for x in out) <= FRONT and out else out
    return label


def _turned(prints: np.ndarray, choice: tuple[int, ...]) -> np.ndarray:
    """Prints with the blocks of a choice first, in their order, then the others."""
    out = np.zeros_like(prints)
    for i in (*choice, *(i for i in range(len(WIDTHS)) if i not in choice)):
        out = (out << np.uint64(WIDTHS[i])) | ((prints >> np.uint64(64 - PLACES[i] - WIDTHS[i])) & np.uint64(2 ** WIDTHS[i] - 1))
    return out


def _stars(task: np.ndarray, prints: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, least of its cluster) of whole tasks, sorted by task."""
    starts = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(task)])))
    several = np.repeat(sizes > 1, sizes)
    task, prints, sizes = task[several], prints[several], sizes[sizes > 1]
    if not len(task):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    choice = task >> ROOT
    keys = np.empty_like(prints)
    for i in np.unique(choice).tolist():
        keys[choice == i] = _turned(prints[choice == i], CHOICES[i])
    order = np.lexsort((keys, task))
    keys, prints = keys[order], prints[order]
    starts = np.cumsum(sizes) - sizes
    width = np.array([sum(WIDTHS[i] for i in c) for c in CHOICES])[choice[starts]]
    pairs = np.stack([starts, starts + sizes, starts, starts + sizes, width, np.zeros(len(starts), np.int64)])
    label = trie_join(keys, [pairs], budget)
    at = np.flatnonzero(label != np.arange(len(keys)))
    return prints[at], prints[label[at]]


def near_stars(nodes: DataFrame, budget: int = 4) -> DataFrame:
    """Edges (src, dst) of stars that join all of the distinct longs fp that differ in at most budget (up to 4) bits."""
    if budget > len(WIDTHS) - EQUAL:
        raise ValueError(f"the budget is at most {len(WIDTHS) - EQUAL}")
    block = [F.shiftrightunsigned("fp", 64 - at - width).bitwiseAND(F.lit(2**width - 1)) for at, width in zip(PLACES, WIDTHS, strict=True)]
    tasks = []
    for n, choice in enumerate(CHOICES):
        root = F.lit(n).cast("long")
        for i in choice:
            root = F.shiftleft(root, WIDTHS[i]).bitwiseOR(block[i])
        # The choice's number stands above the root's bits, whether these are 27 or 28.
        tasks.append(root + F.lit((n << ROOT) - (n << sum(WIDTHS[i] for i in choice))))
    rows = nodes.select(F.explode(F.array(*tasks)).alias("task"), "fp")
    rows = rows.repartition("task").sortWithinPartitions("task")
    schema = StructType([StructField("src", LongType()), StructField("dst", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            n += batch.num_rows
            if n >= HELD and held[0][0][0] != held[-1][0][-1]:
                task, prints = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(task, task[-1]))
                yield _edges(*_stars(task[:cut], prints[:cut], budget))
                held, n = [(task[cut:], prints[cut:])], n - cut
        if n:
            yield _edges(*_stars(*(np.concatenate(x) for x in zip(*held, strict=True)), budget))

    shipped(nodes.sparkSession)
    return rows.mapInArrow(run, schema)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])


def _settled(found: DataFrame) -> bool:
    """Is each node of the edges src > dst either a centre or has one edge, to a centre?"""
    twice = found.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("src")
    chained = found.join(found.select(F.col("dst").alias("at")).distinct(), F.col("src") == F.col("at"), "left_semi").select("src")
    return twice.union(chained).isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each component of the edges (src, dst), for nodes that aren't it themselves.

    Large-star and small-star rounds (Kiveris et al., 2014): minima combine before the shuffle, each round is a written
    table, nothing is collected but a count and whether a row is left.
    """
    clean = lambda e: e.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    found = written(clean(edges), "edges")
    for turn in range(most_rounds):
        if _settled(found):
            return found.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        # Large star: each node hands its larger neighbours to the least of itself and its neighbours.
        both = found.union(found.select("dst", "src"))
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("at"), F.least("low", "src").alias("low"))
        large = clean(both.where("dst > src").join(least, F.col("src") == F.col("at")).select(F.col("dst").alias("src"), F.col("low").alias("dst")))
        # Small star: each node hands its smaller neighbours, and itself, to the least of them.
        least = large.groupBy("src").agg(F.min("dst").alias("low")).withColumnRenamed("src", "at")
        joined = large.join(least, F.col("src") == F.col("at"))
        small = joined.select(F.explode(F.array(F.struct("src", F.col("low").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")))).alias("e")).select("e.*")
        # Neither star makes more edges than there were.
        found = written(clean(small), f"stars-{turn}", rows=found.count())
    raise RuntimeError("the components did not settle")


def near_groups(prints: DataFrame, budget: int = 4, id: str = "doc_id") -> DataFrame:
    """Every row of prints (doc_id, fp, any other columns) with group and component_id, the least doc_id of its group."""
    prints = written(prints, "prints")
    nodes = written(prints.groupBy("fp").agg(F.min(id).alias("_low")), "nodes")
    roots = components(near_stars(nodes.select("fp"), budget))
    named = written(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "_low", F.coalesce("root", "fp").alias("group")), "grouped")
    low = named.groupBy("group").agg(F.min("_low").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    low = small(written(low.select(F.col("group").alias("_group"), "component_id"), "lows"))
    # Sides of both joins are plain tables, so that a hot group's or fingerprint's rows can be split at run time.
    named = named.join(low, F.col("group") == F.col("_group"), "left")
    named = written(named.select(F.col("fp").alias("_fp"), "group", F.coalesce("component_id", "_low").alias("component_id")), "named")
    return prints.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def simhash_groups(docs: DataFrame, words: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows are nodes that coincide; a null
    doc_id is named only where its whole component has none; an empty table gives an empty result.
    """
    out = near_groups(fingerprints(docs, words), budget)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The row of docs of each group of groups (doc_id, _hash of the text, group) with the least doc_id, nulls last, then by hash.

    Decided on ids and hashes alone. Texts meet the list of what goes in an anti-join; only identical rows (one id, one
    text) of which one stays are numbered with their texts.
    """
    rows = groups.groupBy("doc_id", "_hash", "group").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash")).alias("k")).withColumnRenamed("group", "_group")
    here = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & F.col("_hash").eqNullSafe(F.col("k._hash"))
    fate = rows.join(first, F.col("group") == F.col("_group")).select(F.col("doc_id").alias("_id"), "_hash", "n", here.alias("stays"))
    fate = written(fate.where("n > 1 or not stays"), "fate")
    named = docs.withColumn("_text_hash", F.xxhash64("text"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    alone = named.join(small(fate), on, "left_anti")
    again = Window.partitionBy("_id", "_hash").orderBy("source", "lang")
    many = named.join(small(fate.where("stays")), on).withColumn("_n", F.row_number().over(again)).where("_n = 1")
    return alone.select(docs.columns).union(many.select(docs.columns))


def first_of_groups(docs: DataFrame, words: int = 4, budget: int = 4) -> DataFrame:
    """One row of docs for each group, the one with the least doc_id (nulls last, then by a hash of the text).

    Null and empty texts have fingerprint 0 and are one group, with any text whose fingerprint is near 0; of identical
    rows one stays; columns beyond those of documents are carried along under any name; an empty table gives an empty result.
    """
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    groups = written(near_groups(fingerprints(named, words, keep=("doc_id", "_hash")), budget).select("doc_id", "_hash", "group"), "groups")
    return aside(docs, lambda docs: keep_first(docs, groups))
