"""Source divergence audit: how far the word use of each (lang, source) group lies from the others' and from its language's.

Each language keeps the V terms in at least LEAST_DOCS of its documents. A group with N occurrences of them gives a term
that occurs c times the share p = 1 + floor(10^9 (c + 2) / (N + 2 V)); p0 is that of an absent term. Two shares differ by
f(p, q) = floor((p - q)^2 / (p + q)), and two groups by the sum of f over all V terms, exact in whole numbers. As if all
terms were absent from both groups, that is V f(p0, q0). The rest is a sum of what terms differ from that, split by how
many groups of the language have a term:

    heavy  (at least a third of the groups, or more than MOST_LIGHT): f(p, q) - f(p0, q0) over dense tiles of shares, at
           most 64 x 64 groups by a slice of terms, in NumPy. A term that no group of a tile has adds nothing there.
    light  each group's own counts against the other's p0, f(p, q0) - f(p0, q0), from a histogram of its counts; and for
           the terms that both have, from each term's posting pairs, f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

Both partial sums are sums of longs, in any order. Words are counted inside each task before anything is shuffled, and
what is shuffled afterwards is a row for each term of a group.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import shipped, small, written

#: A language's term occurs in at least so many of its documents.
LEAST_DOCS = 10
#: Shares are of so many.
WHOLE = 1_000_000_000
#: A term is heavy in at least one of so many groups of its language.
HEAVY_SHARE = 3
#: Or in more than so many, so that the posting pairs of a light term stay few.
MOST_LIGHT = 512
#: Groups on a side of a dense tile, and its terms on average.
TILE, TERMS = 64, 256
#: Terms of a task's counters that are handed on at once.
HELD = 300_000
#: Posting pairs, or cells of a tile, worked out at once.
CELLS = 1 << 20
#: Ranks of a group's terms.
TOP = 10
#: Bytes of a text to those of its terms: A-Z lower-cased, other ASCII but a-z cut.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of letters A-Z, lower-cased, a-z and characters beyond ASCII."""
    return (text or "").encode().translate(FOLD).split()


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of the terms of a group, summed by task so far."""

    def flushed(n: dict, df: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in n.items():
            many = df[lang, source]
            # Terms are cut out of valid UTF-8 at ASCII bytes, so they are valid too.
            terms = pa.array(list(found), pa.binary()).cast(pa.string())
            counts = [np.fromiter(found.values(), np.int64, len(found)), np.fromiter((many[t] for t in found), np.int64, len(found))]
            names = [pa.repeat(pa.scalar(x, pa.string()), len(found)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, terms, *map(pa.array, counts)], names=["lang", "source", "term", "n", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = defaultdict(Counter), defaultdict(Counter)
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = terms_of(text)
                n[lang, source].update(words)
                df[lang, source].update(set(words))
            if sum(map(len, n.values())) > HELD:
                yield from flushed(n, df)
                n, df = defaultdict(Counter), defaultdict(Counter)
        yield from flushed(n, df)

    shipped(docs.sparkSession)
    rows = docs.select(_filled("lang").alias("lang"), _filled("source").alias("source"), "text")
    return rows.mapInArrow(run, "lang string, source string, term string, n long, df long")


def _f(p: str, q: str) -> str:
    """SQL of f of two shares, longs; the square is under 2^60."""
    return f"((({p} - {q}) * ({p} - {q})) div ({p} + {q}))"


def _share(count: str, total: str) -> Column:
    """p of a count, where total is N + 2 V; in decimals, as 10^9 times a count may be beyond a long. Null where total is 0."""
    return F.expr(f"1L + (cast({WHOLE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast(nullif({total}, 0) as decimal(20,0))")


def differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f of arrays of shares."""
    return (p - q) ** 2 // (p + q)


#: Sums v of pairs of group numbers a < b of a language.
PAIRS = "lang string, a long, b long, v long"


def _added(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of numbers once, its v added up."""
    if not len(a):
        return a, b, v
    order = np.lexsort((b, a))
    a, b, v = a[order], b[order], v[order]
    starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[starts], b[starts], np.add.reduceat(v, starts)


def _batch(lang: str, a: np.ndarray, b: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(a)), *map(pa.array, (a, b, v))], names=["lang", "a", "b", "v"])


def posting_sums(starts: np.ndarray, g: np.ndarray, p: np.ndarray, absent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs a < b of groups and the sum of what their common terms correct.

    g, p, absent: group, share and p0 of each posting, by term and group; starts: each term's first posting. Terms with
    equally many postings are worked out together.
    """
    sums = (np.zeros(0, np.int64),) * 3
    sizes = np.diff(np.concatenate((starts, [len(g)])))
    for k in np.unique(sizes[sizes > 1]).tolist():
        first, second = np.triu_indices(k, 1)
        here = starts[sizes == k]
        step = max(1, CELLS // len(first))
        for at in range(0, len(here), step):
            x, y = ((here[at : at + step, None] + side).ravel() for side in (first, second))
            v = differ(p[x], p[y]) - differ(p[x], absent[y]) - differ(absent[x], p[y]) + differ(absent[x], absent[y])
            sums = _added(*(np.concatenate(both) for both in zip(sums, (g[x], g[y], v), strict=True)))
    return sums


def _light(rows: DataFrame) -> DataFrame:
    """PAIRS of the rows (lang, term, g, p, p0) of light terms; a task adds up all terms that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple] = {}
        rest: pa.Table | None = None

        def take(held: pa.Table) -> None:
            lang, term = (held.column(c).combine_chunks() for c in ("lang", "term"))
            g, p, absent = (held.column(c).to_numpy() for c in ("g", "p", "p0"))
            new = np.ones(len(held), bool)
            new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            names = lang.take(pa.array(starts)).to_numpy(zero_copy_only=False)
            for name in dict.fromkeys(names):
                # Rows are sorted by language: one stretch of terms each.
                mine = np.flatnonzero(names == name)
                low, high = starts[mine[0]], starts[mine[-1] + 1] if mine[-1] + 1 < len(starts) else len(held)
                found = posting_sums(starts[mine] - low, g[low:high], p[low:high], absent[low:high])
                sums[name] = _added(*(np.concatenate(both) for both in zip(sums[name], found, strict=True))) if name in sums else found

        for batch in batches:
            held = pa.Table.from_batches([batch])
            held = held if rest is None else pa.concat_tables([rest, held])
            lang, term = held.column("lang"), held.column("term")
            # The last term may go on in the next batch.
            last = pc.and_(pc.equal(lang, lang[-1]), pc.equal(term, term[-1])).to_numpy()
            cut = int(last.argmax())
            if cut:
                take(held.slice(0, cut))
            rest = held.slice(cut)
        if rest is not None and len(rest):
            take(rest)
        for name, found in sums.items():
            yield _batch(name, *found)

    shipped(rows.sparkSession)
    return rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "g").mapInArrow(run, PAIRS)


def tile_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of f over the terms (columns) of each row of shares of x with each of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    step = max(1, CELLS // out.size)
    for at in range(0, x.shape[1], step):
        out += differ(x[:, None, at : at + step], y[None, :, at : at + step]).sum(2)
    return out


def _heavy(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """PAIRS of what the rows (lang, term, g, p) of heavy terms differ from absent ones: a task for each pair of up to TILE groups and slice of a language's terms.

    Each tile also gets the p0 of its groups, as rows without a term, for those that have none of its terms.
    """

    def run(table: pa.Table) -> pa.Table:
        side, other = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        g, p, terms = table.column("g").to_numpy(), table.column("p").to_numpy(), table.column("term").combine_chunks().dictionary_encode()
        group = terms.indices.is_null().to_numpy(zero_copy_only=False)
        at = terms.indices.fill_null(0).to_numpy()
        order = np.argsort(g[group])
        numbers, absent = g[group][order], p[group][order]
        shares = np.repeat(absent[:, None], len(terms.dictionary), axis=1)
        shares[np.searchsorted(numbers, g[~group]), at[~group]] = p[~group]
        mine, theirs = numbers // TILE == side, numbers // TILE == other
        sums = tile_sums(shares[mine], shares[theirs]) - shares.shape[1] * differ(absent[mine][:, None], absent[theirs])
        a, b = np.meshgrid(numbers[mine], numbers[theirs], indexing="ij")
        return pa.Table.from_batches([_batch(table.column("lang")[0].as_py(), a[a < b], b[a < b], sums[a < b])])

    shipped(rows.sparkSession)
    at = groups.select("lang", "g", "p0", "tiles", "slices").where("slices > 0")
    plain = at.select("lang", F.lit(None).cast("string").alias("term"), "g", F.col("p0").alias("p"), "tiles", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    each = rows.select("lang", "term", "g", "p", "tiles", F.pmod(F.xxhash64("term"), "slices").cast("int").alias("slice"))
    own, u = F.floor(F.col("g") / TILE), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    cells = each.union(plain).select("lang", "term", "g", "p", "slice", own.alias("t"), u.alias("u"))
    cells = cells.select("lang", "slice", F.least("t", "u").cast("long").alias("x"), F.greatest("t", "u").cast("long").alias("y"), "term", "g", "p")
    return cells.groupBy("lang", "slice", "x", "y").applyInArrow(run, PAIRS)


def _audited(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept terms of each group, and all groups.

    terms: lang, source, term, n, all (n in the language), heavy, first (is it the language's first row of the term?).
    groups: lang, source, g (number), total (N + 2 V), p0, all_total (the language's), v, tiles, slices.
    """
    here = Window.partitionBy("lang", "term")
    # One shuffle by term serves the sums of a group and those of its language.
    counts = _counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    over = {"docs": F.sum("df").over(here), "all": F.sum("n").over(here), "k": F.count(F.lit(1)).over(here), "first": F.min("source").over(here) == F.col("source")}
    kept = counts.withColumns(over).where(F.col("docs") >= LEAST_DOCS)
    kept = written(kept.select("lang", "source", "term", "n", "all", "k", "first"), "terms")
    names = written(docs.select(_filled("lang").alias("lang"), _filled("source").alias("source")).distinct(), "names")
    size = names.groupBy("lang").agg(F.count(F.lit(1)).alias("s"))
    size = small(written(size, "languages"))
    kept = kept.join(size, "lang").withColumn("heavy", (HEAVY_SHARE * F.col("k") >= F.col("s")) | (F.col("k") > MOST_LIGHT)).drop("k", "s")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("all_n"), F.count_if("first").alias("v"), F.count_if(F.col("first") & F.col("heavy")).alias("n_heavy"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = names.join(own, ["lang", "source"], "left").join(size, "lang").join(langs, "lang", "left").na.fill(0, ["own_n", "all_n", "v", "n_heavy"])
    groups = groups.withColumns({
        "g": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1,
        "total": F.expr("own_n + 2 * v"),
        "all_total": F.expr("all_n + 2 * v"),
        "tiles": F.ceil(F.col("s") / TILE),
        "slices": F.ceil(F.col("n_heavy") / TERMS),
    }).withColumn("p0", _share("0L", "total"))
    return kept, written(groups.select("lang", "source", "g", "total", "all_total", "v", "tiles", "slices", "p0"), "groups")


def _pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, v): the sum of f over all kept terms of each pair of groups a < b of a language."""
    side = lambda name: groups.select("lang", F.col("g").alias(name), F.col("p0").alias(f"{name}0"), "v")
    every = side("a").join(small(side("b").drop("v")), "lang").where("a < b")
    absent = every.select("lang", "a", "b", F.expr(f"coalesce(v * {_f('a0', 'b0')}, 0L)").alias("v"))
    light = shares.where("not heavy").select("lang", "term", "g", "p", "p0")
    counts = light.groupBy("lang", "g", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    met = counts.join(small(side("b").drop("v")), "lang").where("g <> b")
    own = met.select("lang", F.least("g", "b").alias("a"), F.greatest("g", "b").alias("b"), F.expr(f"m * ({_f('p', 'b0')} - {_f('p0', 'b0')})").alias("v"))
    dense = _heavy(shares.where("heavy"), groups)
    return absent.union(own).union(_light(light)).union(dense).groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))


def divergence_table(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: the audit of every (lang, source) group.

    part "pair": each other source of the language, by falling divergence. part "term": the group's terms above their
    share in the language, the first TOP. Null texts, languages and sources count as ''; empty texts and repeated rows
    count as documents; a language without kept terms has pairs of 0; equal values rank by the item's bytes; an empty
    table gives an empty result.
    """
    kept, groups = _audited(docs)
    named = small(groups)
    shares = kept.join(named.select("lang", "source", "g", "total", "all_total", "tiles", "slices", "p0"), ["lang", "source"])
    shares = shares.withColumns({"p": _share("n", "total"), "q": _share("all", "all_total")})
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    above = shares.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    pairs = written(_pair_values(shares, groups), "divergences")
    both = pairs.union(pairs.select("lang", "b", "a", "v"))
    name = lambda c, g: named.select("lang", F.col("source").alias(c), F.col("g").alias(g))
    both = both.join(name("source", "a"), ["lang", "a"]).join(name("item", "b"), ["lang", "b"])
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("v").alias("value"))
    return ranked(both).union(ranked(above).where(F.col("rank") <= TOP))


#: DuckDB: divergence_table() over documents, f summed over every kept term of every pair.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), o AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
w AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(w.n, 0) + 2 * v.v))::BIGINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 2) // (v.n + 2 * v.v))::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN w ON w.lang = g.lang AND w.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), x AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS v FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), e AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM s WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM e QUALIFY rank <= 10 OR part = 'pair'
"""
