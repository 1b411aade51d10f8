"""MinHash near-duplicates by min-max hashing (Ji et al., 2013).

Each of 64 permutations of a shingle set gives two values of its signature, the least and the greatest, so 128 values
cost 64 evaluations for each shingle. Each agrees between two sets with their Jaccard similarity as probability, and
the two of one permutation lean against each other, so that their mean varies less than that of two permutations. The
signature is used twice:

    bands     32 bands of two minima and two maxima of four different permutations. Sets of similarity s share a band
              with probability 1 - (1 - s^4)^32: all but 5e-8 at 0.8.
    estimate  two bits of each value, four longs a set. Of a pair with a common band, the values that seem to agree are
              counted by bits in the JVM; a pair five deviations below what 0.8 gives is let go (3e-7 at 0.8).

What is left is confirmed from both whole sets. Equal sets are one node from the start. A small bucket compares all its
rows. In a larger one rows meet a leader first, chosen by hash, another in each band, and links join components. The
rows of buckets that are in different components after that meet by an exact filter of resemblance.py: they need most of
their shingles in common with others, and share one of the rarest. So a dense group costs about its size, and no pair of
a common band is left out.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from corvane.llm.common import aside, map_batches, small, written
from corvane.llm.resemblance import _may_link, _prefixes, _shared
from corvane.llm.simhash import components, keep_first, shingle_hashes

#: Permutations; bands, each of two minima and two maxima.
PERMUTATIONS, BANDS = 64, 32
#: Places of a band's values among the minima and then the maxima; no permutation gives two values to one band.
PLACES = np.array([(i, i + 32, 64 + (i + 8) % 64, 64 + (i + 40) % 64) for i in range(BANDS)])
FACTORS, MASKS = np.random.default_rng(12).integers(0, 2**64, (2, PERMUTATIONS, 1), dtype=np.uint64) | np.array([1, 0], np.uint64)[:, None, None]
#: Spreads the values' bits before two are taken.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Shingles hashed at once.
SLICE = 1 << 12
#: Buckets of up to so many rows compare all of them; in larger ones rows meet one of them first.
SMALL = 8
#: Deviations below the expected count of agreeing values at which a pair is let go.
DEVIATIONS = 5
BITS = ("s0", "s1", "s2", "s3")


def signature(found: np.ndarray) -> np.ndarray:
    """128 values of a set of 64-bit hashes: the least of each permutation, then the greatest."""
    least, most = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(found), SLICE):
        turned = (found[at : at + SLICE] ^ MASKS) * FACTORS
        least, most = np.minimum(least, turned.min(1)), np.maximum(most, turned.max(1))
    return np.concatenate((least, most))


def bands(values: np.ndarray) -> list[int]:
    """A long for each band of a signature; equal only at the same band."""
    return [xxhash.xxh64_intdigest(part.tobytes(), i) - 2**63 for i, part in enumerate(values[PLACES])]


def bits(values: np.ndarray) -> list[int]:
    """The upper of the two bits of each value as two longs, then the lower as two more."""
    two = ((values * SPREAD) >> np.uint64(62)).astype(np.uint8)
    return np.packbits(np.concatenate((two >> 1, two & 1))).view(np.int64).tolist()


def least_agreeing(least: float) -> int:
    """Values that must seem to agree: DEVIATIONS below what a similarity of least gives; unlike values agree in a quarter."""
    n, p = 2 * PERMUTATIONS, least + (1 - least) / 4
    return max(0, math.floor(n * p - DEVIATIONS * math.sqrt(n * p * (1 - p))))


def _named(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, _hash (of the text), key (of the shingle set, null if it is empty), size, bands and bits of every row."""

    def named(text: str | None) -> tuple:
        found = np.unique(shingle_hashes(text, words))
        if not len(found):
            return None, 0, None, None, None, None, None
        values = signature(found)
        return xxhash.xxh64_intdigest(found.tobytes(), 42) - 2**63, len(found), bands(values), *bits(values)

    def run(ids: list, hashes: list, texts: list) -> list:
        once = {t: named(t) for t in set(texts)}
        return [ids, hashes, *map(list, zip(*(once[t] for t in texts), strict=True))] if ids else [[]] * 9

    longs = [StructField(c, LongType()) for c in BITS]
    head = [docs.schema["doc_id"], StructField("_hash", LongType()), StructField("key", LongType()), StructField("size", IntegerType())]
    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("_hash"), "text"), run, StructType([*head, StructField("bands", ArrayType(LongType())), *longs]))


def _sets(docs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(key, set) of rows (key, _id, _text_hash), each naming a row of docs with that set; once for each key."""

    def run(keys: list, texts: list) -> list:
        return [keys, [np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts]]

    named = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text_hash"))
    found = map_batches(named.join(small(rows), on).select("key", "text"), run, StructType([StructField("key", LongType()), StructField("set", ArrayType(LongType()))]), cut=500)
    return found.dropDuplicates(["key"])  # identical rows give their set as often as they occur


def _pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(src, dst) of rows of a and b in one bucket that sizes and estimates let pass, once a bucket."""
    b = b.withColumnsRenamed({c: f"_{c}" for c in b.columns if c != "band"})
    apart = [F.bitwise_not(F.col(s).bitwiseXOR(F.col(f"_{s}"))) for s in BITS]
    # A value seems to agree where both of its bits do: longs 0 and 2 hold one half of the values, 1 and 3 the other.
    agree = F.bit_count(apart[0].bitwiseAND(apart[2])) + F.bit_count(apart[1].bitwiseAND(apart[3]))
    sizes = (F.col("size") >= least * F.col("_size") - 1e-9) & (F.col("_size") >= least * F.col("size") - 1e-9)
    may = (F.col("key") != F.col("_key")) & sizes & (agree >= least_agreeing(least))
    return a.join(b, "band").where(may).select(F.least("key", "_key").alias("src"), F.greatest("key", "_key").alias("dst"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets have 100 * common >= percent * union."""
    side = lambda name, at: sets.select(F.col("key").alias(at), F.col("set").alias(name))
    both = pairs.join(side("_a", "src"), "src").join(side("_b", "dst"), "dst")
    common = F.size(F.array_intersect("_a", "_b")).cast("long")
    both = both.select("src", "dst", (F.size("_a") + F.size("_b")).alias("_sum"), common.alias("_common"))
    return both.where(100 * F.col("_common") >= percent * (F.col("_sum") - F.col("_common"))).select("src", "dst")


class _Links:
    """Confirmed links so far, as (node, root) of their components; sets are read from docs when a pair first needs them."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, words: int, percent: int):
        self.docs, self.nodes, self.words, self.percent = docs, nodes, words, percent
        self.sets: DataFrame | None = None
        self.roots: DataFrame | None = None

    def load(self, keys: DataFrame) -> None:
        """Reads the sets of the distinct keys that aren't there yet."""
        if self.sets is not None:
            keys = keys.join(self.sets.select("key"), "key", "left_anti")
        rows = written(self.nodes.join(keys, "key", "left_semi").select("key", "_id", "_text_hash"), "suspects")
        new = written(_sets(self.docs, rows, self.words), "sets")
        self.sets = new if self.sets is None else self.sets.union(new)

    def add(self, pairs: DataFrame) -> None:
        """Takes in the pairs that their whole sets confirm."""
        pairs = written(pairs, "candidates")
        self.load(pairs.select(F.col("src").alias("key")).union(pairs.select("dst")).distinct())
        links = _confirmed(pairs, self.sets, self.percent)
        if self.roots is not None:
            links = links.union(self.roots.select(F.col("node").alias("src"), F.col("root").alias("dst")))
        self.roots = components(links)

    def open(self, rows: DataFrame, by: str) -> DataFrame:
        """rows with the root of their key, of the groups by whose rows are in more than one component."""
        found = self.roots.select(F.col("node").alias("key"), "root")
        rows = rows.join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))
        several = rows.groupBy(by).agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select(by)
        return written(rows.join(several, by, "left_semi"), "open")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(band, n, key, size, bits) of the nodes in buckets of n > 1."""
    rows = nodes.select(F.explode("bands").alias("band"), "key").repartition("band")
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return written(rows.join(sizes, "band").join(nodes.select("key", "size", *BITS), "key"), "buckets")


def _linked(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) of the components of all links."""
    least = percent / 100
    rows = _buckets(nodes)
    links = _Links(docs, nodes, words, percent)
    few, many = (rows.where(cond).drop("n") for cond in (f"n <= {SMALL}", f"n > {SMALL}"))
    leader = F.min_by(F.struct("key", "size", *BITS), F.xxhash64("band", "key")).alias("l")
    links.add(_pairs(few, few, least).union(_pairs(many, many.groupBy("band").agg(leader).select("band", "l.*"), least)).distinct())
    # What large buckets leave open is settled by an exact filter: two sets of that similarity share most shingles, and
    # one of the rarest of each. A set with too many shingles of its own goes without a pair.
    left = written(links.open(many.select("band", "key"), "band").select("key").distinct(), "left")
    links.load(left)
    sets = links.sets.join(left, "key", "left_semi").select("key", F.size("set").alias("size"), "set")
    prefixes = written(_prefixes(written(_shared(sets, least), "shared"), least), "prefixes")
    rows = links.open(prefixes, "h")
    # Of a pair in two components at least one is outside the shingle's largest: only such rows look for others.
    largest = rows.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.max(F.struct("n", "root")).alias("most"))
    outside = written(rows.join(largest, "h").where("root <> most.root").select(rows.columns), "outside")
    others = rows.withColumnsRenamed({c: f"_{c}" for c in rows.columns if c != "h"})
    met = outside.join(others, "h").where(_may_link(least))
    links.add(met.select(F.least("key", "_key").alias("src"), F.greatest("key", "_key").alias("dst")).distinct())
    return links.roots


def _nodes(named: DataFrame) -> DataFrame:
    """One row for each set that isn't empty, named by its row with the least doc_id."""
    first = [F.first(c).alias(c) for c in ("size", "bands", *BITS)]
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_hash")).alias("k")
    nodes = named.where("key is not null").groupBy("key").agg(*first, least, F.count(F.lit(1)).alias("n"))
    return written(nodes.select("key", "size", "bands", *BITS, "n", F.col("k.doc_id").alias("_id"), F.col("k._hash").alias("_text_hash")), "nodes")


def alike_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, _hash (of the text), n_shingles, group and component_id of every row.

    group: a long that rows linked by 100 * common >= percent * union share; null for a text without words, which is
    linked with nothing. component_id: the least doc_id of the group, null where all of its ids are; a row's own without
    a group. Repeated rows are in one group; an empty table gives an empty result.
    """
    named = written(_named(docs, words), "signed")
    nodes = _nodes(named)
    roots = _linked(docs, nodes, words, percent).select(F.col("node").alias("key"), "root")
    nodes = written(nodes.select("key", "n", "_id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "grouped")
    groups = nodes.groupBy("root").agg(F.min("_id").alias("component_id"), F.sum("n").alias("n")).where("n > 1").select("root", "component_id")
    # Rows alone in their group name themselves; of the others the table is plain, so that a hot set's rows can be split at run time.
    known = small(written(nodes.join(groups, "root").select(F.col("key").alias("_key"), "root", "component_id"), "known"))
    out = named.join(known, F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "_hash", F.col("size").cast("long").alias("n_shingles"), F.coalesce("root", "key").alias("group"), component.alias("component_id"))


def minhash_table(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (is it the least of its component?) of every row.

    Nulls, empty and repeated rows are as in alike_groups(). A row without a doc_id is kept only where no row of its
    component has one.
    """
    found = alike_groups(docs, words, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_of_alike(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each group, the one with the least doc_id (nulls last, then by a hash of the text); all rows without words stay."""
    groups = written(alike_groups(docs, words, percent).select("doc_id", "_hash", "group"), "groups")
    named = groups.where("group is not null")

    def work(rows: DataFrame) -> DataFrame:
        wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        return keep_first(rows.where(~wordless), named).union(rows.where(wordless))

    return aside(docs, work)


#: DuckDB: minhash_table() over documents, every pair of distinct sets with a common shingle counted.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT rid, doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) END AS xs FROM d
), u AS (
  SELECT xs, min(doc_id) AS k, len(xs) AS n FROM s WHERE len(xs) > 0 GROUP BY xs
), e AS (SELECT k, n, unnest(xs) AS x FROM u), p AS (
  SELECT a.k AS a, b.k AS b, a.n + b.n AS total, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.k < b.k AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL
), l AS (
  SELECT a, b FROM p WHERE 100 * common >= 80 * (total - common)
), m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (
  SELECT DISTINCT a AS k, a AS low FROM m UNION SELECT m.b, r.low FROM r JOIN m ON m.a = r.k
), c AS (SELECT k, min(low) AS low FROM r GROUP BY 1)
SELECT doc_id, coalesce(len(xs), 0) AS n_shingles, coalesce(low, k, doc_id) AS component_id, doc_id = coalesce(low, k, doc_id) AS kept
FROM s LEFT JOIN u USING (xs) LEFT JOIN c USING (k)
"""
