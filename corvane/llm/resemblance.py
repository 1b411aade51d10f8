"""Near-duplicates by the Jaccard similarity of word-shingle sets: what SimHash groups leave open at 0.8.

64-bit SimHash can't decide 0.8 alone: such pairs differ in about 10 bits, some in 20, where unrelated texts begin to
agree. So its trie join gives the first links (4 bits), and the rest are found in three narrowing steps:

    bands   MinHash bands tell which sets can have a partner at all. A pair of similarity s shares a band with
            probability 1 - (1 - s^ROWS)^BANDS: all but 5e-8 of pairs at 0.8. Bands only choose sets, they make no pairs.
    prefix  A set's shingles are put in one order for all, rarest first. Two sets of similarity 0.8 share one of the
            first fifth of each. Shingles that no other set has are never emitted, so boilerplate that many texts
            share, the last in order, makes no candidates unless it is four fifths of a text.
    rounds  The rows of a shingle meet a few leaders first, chosen by hash and others for each shingle; links join
            components. Only rows that are in different components after that meet each other.

Equal sets collapse before all this. Every link, SimHash's too, is counted from both whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from corvane.llm.common import aside, frequent, map_batches, shipped, small, written
from corvane.llm.simhash import components, keep_first, near_stars, print_of, shingle_hashes

BANDS, ROWS = 32, 4
#: Leaders that the rows of a shingle meet, round by round.
LEADERS = (4, 32)
#: Odd factors and masks of the MinHash orders.
FACTORS, MASKS = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64) | np.array([1, 0], np.uint64)[:, None, None]
#: Shingles hashed at once.
SLICE = 1 << 12


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(shingle_hashes(text, words))


def bands(found: np.ndarray) -> list[int] | None:
    """A long for each band of a shingle set, null without shingles; equal only at the same band."""
    if not len(found):
        return None
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), SLICE):
        least = np.minimum(least, ((found[at : at + SLICE] ^ MASKS) * FACTORS).min(1))
    return [xxhash.xxh64_intdigest(part.tobytes(), i) - 2**63 for i, part in enumerate(least.reshape(BANDS, ROWS))]


def _named(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, _hash (of the text), key (of the shingle set), size (of the set), fp (SimHash) and bands of every row."""

    def run(ids: list, hashes: list, texts: list) -> list:
        keys, sizes, prints, found = [], [], [], []
        for t in texts:
            every = shingle_hashes(t, words)
            distinct = np.unique(every)
            keys.append(xxhash.xxh64_intdigest(distinct.tobytes(), 42) - 2**63)
            sizes.append(len(distinct))
            prints.append(print_of(every) - 2**63)
            found.append(bands(distinct))
        return [ids, hashes, keys, sizes, prints, found]

    longs = [StructField(c, LongType()) for c in ("_hash", "key")]
    fields = [docs.schema["doc_id"], *longs, StructField("size", IntegerType()), StructField("fp", LongType()), StructField("bands", ArrayType(LongType()))]
    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("_hash"), "text"), run, StructType(fields))


def _whole(docs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(key, size, set) of rows (key, size, _id, _text_hash), each naming a row of docs with that set."""

    def run(keys: list, sizes: list, texts: list) -> list:
        return [keys, sizes, [shingle_set(t, words).view(np.int64) for t in texts]]

    named = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    texts = named.join(small(rows), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text_hash"))).select("key", "size", "text")
    fields = [StructField("key", LongType()), StructField("size", IntegerType()), StructField("set", ArrayType(LongType()))]
    return map_batches(texts, run, StructType(fields), cut=500)


def _ordered(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")


def _prints_alike(nodes: DataFrame) -> DataFrame:
    """Pairs (src, dst) of keys that SimHash's trie join puts together: stars over prints, and keys with equal prints."""
    prints = written(nodes.groupBy("fp").agg(F.min("key").alias("low")), "prints")
    stars = near_stars(prints.select("fp"))
    low = lambda name, at: prints.select(F.col("fp").alias(at), F.col("low").alias(name))
    near = stars.join(low("_a", "src"), "src").join(low("_b", "dst"), "dst").select(*_ordered("_a", "_b"))
    same = nodes.select("fp", "key").join(prints, "fp").where("key <> low").select(*_ordered("key", "low"))
    return near.union(same).distinct()


def _often(sets: DataFrame) -> DataFrame:
    """(h, n) of the shingles that occur in n > 1 sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["h", "n"])

    shipped(sets.sparkSession)
    return frequent(sets.select("set").mapInArrow(run, "h long, n long"))


def _shared(sets: DataFrame, least: float) -> DataFrame:
    """(key, size, shared) of the sets that can have a partner: shared holds their shingles (n, h) that occur in n > 1 sets, rarest first."""
    each = sets.select("key", "size", F.explode("set").alias("h"))
    own = each.join(written(_often(sets), "often"), "h").groupBy("key", "size").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("shared"))
    return own.where(F.size("shared") >= F.ceil(least * F.col("size") - 1e-9))


def _prefixes(shared: DataFrame, least: float) -> DataFrame:
    """(h, key, size, rest): each set's first shingles in the order; rest counts its shingles from this one on."""
    length = F.greatest(F.size("shared") - F.ceil(least * F.col("size") - 1e-9) + 1, F.lit(0)).cast("int")
    rows = shared.select("key", "size", F.size("shared").alias("m"), F.posexplode(F.slice("shared", F.lit(1), length)).alias("at", "s"))
    return rows.select(F.col("s.h").alias("h"), "key", "size", (F.col("m") - F.col("at")).alias("rest"))


def _may_link(least: float) -> Column:
    """Of a row and another (_key, _size, _rest, _root) with a common shingle: do sizes and what is left allow a link?"""
    near = (F.col("size") >= least * F.col("_size") - 1e-9) & (F.col("_size") >= least * F.col("size") - 1e-9)
    common = F.least("rest", "_rest") >= F.ceil(least / (1 + least) * (F.col("size") + F.col("_size")) - 1e-6)
    return near & common & (F.col("root") != F.col("_root"))


def _alike(pairs: DataFrame, shared: DataFrame, least: float) -> DataFrame:
    """Pairs (src, dst) whose whole sets have a Jaccard similarity of least or more."""
    side = lambda name, at: shared.select(F.col("key").alias(at), F.col("size").alias(f"{name}_n"), F.col("shared.h").alias(name))
    both = pairs.join(side("_a", "src"), "src").join(side("_b", "dst"), "dst")
    both = both.select("src", "dst", (F.col("_a_n") + F.col("_b_n")).alias("_sum"), F.size(F.array_intersect("_a", "_b")).alias("_common"))
    return both.where(F.col("_common") / (F.col("_sum") - F.col("_common")) >= least).select("src", "dst")


def _linked(prefixes: DataFrame, shared: DataFrame, first: DataFrame, least: float) -> DataFrame:
    """(node, root) of the components of all links, from the pairs of first and those that share a prefix shingle."""
    side = lambda rows: rows.withColumnsRenamed({c: f"_{c}" for c in ("key", "size", "rest", "root")})
    ends = [F.col("node").alias("src"), F.col("root").alias("dst")]

    def joined(roots: DataFrame | None, pairs: DataFrame) -> DataFrame:
        links = _alike(pairs, shared, least)
        return components(links if roots is None else links.union(roots.select(*ends)))

    def open_(roots: DataFrame | None) -> DataFrame:
        """The rows, with their roots, of shingles whose rows are in more than one component."""
        if roots is None:
            return prefixes.withColumn("root", F.col("key"))
        rows = prefixes.join(roots, F.col("key") == F.col("node"), "left").select("h", "key", "size", "rest", F.coalesce("root", "key").alias("root"))
        several = rows.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("h")
        return written(rows.join(several, "h", "left_semi"), "open")

    roots = None
    for turn, most in enumerate(LEADERS):
        rows = open_(roots)
        mix = F.xxhash64("h", "key", F.lit(turn))
        slots = rows.groupBy("h", F.pmod(mix, F.lit(most)).alias("slot")).agg(F.min(F.struct(mix.alias("mix"), "key", "size", "rest", "root")).alias("l"))
        leaders = side(slots.select("h", "l.key", "l.size", "l.rest", "l.root"))
        pairs = rows.join(leaders, "h").where(_may_link(least)).select(*_ordered("key", "_key"))
        roots = joined(roots, (pairs if turn else pairs.union(first)).distinct())
    rows = open_(roots)
    # Of a pair in two components at least one is outside the shingle's largest: only such rows look for others.
    largest = rows.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.max(F.struct("n", "root")).alias("most"))
    few = written(rows.join(largest, "h").where("root <> most.root").select("h", "key", "size", "rest", "root"), "few")
    pairs = few.join(side(rows), "h").where(_may_link(least)).select(*_ordered("key", "_key")).distinct()
    return joined(roots, pairs)


def resembling_groups(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, _hash (of the text) and group of every row: rows linked by a similarity of least or more share a group.

    Texts without words are one group; texts of fewer words than a shingle are alike where all their words are.
    """
    named = written(_named(docs, words), "resemblance")
    nodes = named.groupBy("key").agg(
        F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_hash")).alias("k")
    )
    nodes = written(nodes.select("key", "size", "fp", "bands", F.col("k.doc_id").alias("_id"), F.col("k._hash").alias("_text_hash")), "sets-named")
    first = written(_prints_alike(nodes), "prints-alike")
    rows = nodes.select("key", F.explode("bands").alias("band"))
    twice = written(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band"), "bands")
    some = [rows.join(twice, "band").select("key"), first.select("src"), first.select("dst")]
    some = nodes.join(reduce(DataFrame.union, some).distinct(), "key", "left_semi").select("key", "size", "_id", "_text_hash")
    sets = written(_whole(docs, written(some, "suspects"), words), "sets")
    # Identical rows give their set as often as they occur.
    shared = written(_shared(sets.dropDuplicates(["key"]), least), "shared")
    roots = _linked(written(_prefixes(shared, least), "prefixes"), shared, first, least)
    return named.join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "_hash", F.coalesce("root", "key").alias("group"))


def first_of_resembling(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One row of docs for each group, the one with the least doc_id (nulls last, then by a hash of the text)."""
    groups = written(resembling_groups(docs, words, least), "groups")
    return aside(docs, lambda docs: keep_first(docs, groups))
