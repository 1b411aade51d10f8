"""Quality rules whose thresholds come from the corpus: mergeable quantile sketches per language and source.

Each document has a few measures. A sketch counts a measure's values in log-linear buckets (exact below 128, within
1/64 above), so it is bounded, sketches merge by adding counts, and the order of merging changes nothing. All documents
that pass the base rules are in it: those that the fences judge.

Sketches per (language, source) are blended with their language's, and that with the whole corpus's, as if PRIOR
documents of the parent's spread had been seen too: a small group leans on its parent, a large one on itself, without a
size at which one takes over from the other. A document goes if a measure lies beyond its group's fence,

    upper quantile + spread x (upper - lower quantile),

or below the mirrored fence where the measure has one. What every text shows, punctuation and word length, is fenced by
its quartiles among the texts that show any; repeated lines and words, which most texts don't show at all, by the median
and the 99th percentile of all, so that one in a hundred of a group's texts goes at most. The quantiles alone decide: no
fence has a fixed value.
"""

from __future__ import annotations

import string
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corvane.llm.common import aside, map_batches, shipped, small, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_marks")
MARKS = string.punctuation.encode()
#: Documents of the parent's spread that are added to each sketch.
PRIOR = 50
#: Groups of a language whose fences one task works out, on average.
GROUPS = 1000
#: Measures: the lower and the upper quantile in hundredths, the spread, and whether there is a lower fence. Values are per
#: mille but for word_hundredths, a hundredth of a character. A value of 0 counts in the sketches of RARE alone.
RULES = (("mark_pm", 25, 75, 4, False), ("dup_line_pm", 50, 99, 1, False), ("repeat_pm", 50, 99, 1, False), ("word_hundredths", 25, 75, 4, True))
RARE = ("dup_line_pm", "repeat_pm")


def measure(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text, its lines with a word, its ASCII punctuation; null: zeros."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    marks = len(data) - len(data.translate(None, MARKS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if len(words) > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        base = len(number)
        if base < 2_000_000:
            windows = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
        else:
            _, pairs = np.unique(ids[:-2] * base + ids[1:-1], return_inverse=True)
            windows = pairs * base + ids[2:]
        _, at, n = np.unique(windows, return_inverse=True, return_counts=True)
        twice = n[at] > 1
        cover = np.zeros(len(words), bool)
        for k in range(3):
            cover[k : k + len(twice)] |= twice
        repeated = int(cover.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), marks


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures of measure() as columns _q_<name>; a map stage that shuffles nothing."""
    names = [f"_q_{k}" for k in (*BASE, *MORE)]
    at = docs.columns.index(text)

    def run(*columns: list) -> list:
        found = [measure(t) for t in columns[at]]
        return [*columns, *([x[k] for x in found] for k in range(len(names)))]

    return map_batches(docs, run, StructType([*docs.schema, *(StructField(n, LongType()) for n in names)]))


def _ratio(a: Column, b: Column, by: int) -> Column:
    return F.floor(by * a / F.greatest(b, F.lit(1))).cast("long")


def measures() -> dict[str, Column]:
    c = {k: F.col(f"_q_{k}") for k in (*BASE, *MORE)}
    return {
        "mark_pm": _ratio(c["n_marks"], c["word_chars"], 1000),
        "dup_line_pm": _ratio(c["n_dup_lines"], c["n_lines"], 1000),
        "repeat_pm": _ratio(c["n_repeat_words"], c["n_words"], 1000),
        "word_hundredths": _ratio(c["word_chars"], c["n_words"], 100),
    }


def bucket(v: Column) -> Column:
    """The least value of the sketch's bucket of a value of 0 or more: its first seven binary digits."""
    shift = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def base_failed() -> Column:
    words, repeat = F.col("_q_n_words"), F.col("_q_n_repeat_words")
    return (words < 50) | (100 * repeat > 50 * words)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the rows of measured() that pass the base rules."""
    pairs = F.array(*(F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in measures().items()))
    shown = F.filter(pairs, lambda m: (m["bucket"] > 0) | m["measure"].isin(*RARE))
    found = rows.where(~base_failed()).select("lang", "source", F.explode(shown).alias("m")).groupBy("lang", "source", "m.measure", "m.bucket")
    return written(found.agg(F.count(F.lit(1)).alias("n")), "sketches")


def _same(a: DataFrame, b: DataFrame, null_safe: tuple[str, ...]) -> DataFrame:
    """a left-joined with b on columns of equal names, also where both are null."""
    b = b.withColumnsRenamed({c: f"_b_{c}" for c in null_safe})
    return a.join(b, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in null_safe], "left").drop(*(f"_b_{c}" for c in null_safe))


class Sketch:
    """Sorted buckets and their running counts, as Python numbers: blended counts are beyond 64 bits."""

    def __init__(self, buckets: list[int], counts: list[int]):
        pairs = sorted(zip(buckets, counts, strict=True))
        self.buckets, self.upto = [b for b, _ in pairs], [0, *accumulate(n for _, n in pairs)]
        self.total = self.upto[-1]

    def below(self, b: int) -> int:
        """Documents in buckets up to b."""
        return self.upto[bisect_right(self.buckets, b)]


def quantile(own: Sketch, lang: Sketch, whole: Sketch, hundredths: int, prior: int) -> int:
    """The least bucket with so many hundredths of the blended counts up to it: own, then prior documents of the language's
    blend, which has prior documents of the whole corpus's; all scaled to whole numbers. whole has every bucket."""
    parents = whole.total * (lang.total + prior)
    wanted = hundredths * parents * (own.total + prior)
    upto = lambda b: 100 * (own.below(b) * parents + prior * (lang.below(b) * whole.total + prior * whole.below(b)))
    return whole.buckets[bisect_left(whole.buckets, wanted, key=upto)]


def thresholds(rows: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row per (lang, source) with a document past the base rules: the fences high_<measure> and low_<measure>, null where no text shows the measure.

    A group has only the rows of its own sketch. It meets its language's sketch in tasks of GROUPS groups, to each of
    which that sketch goes; the corpus's, which has no more rows than buckets, goes with the code.
    """
    fine = sketches(rows)
    corpus: dict[str, tuple[list[int], list[int]]] = {}
    for measure, low, n in fine.groupBy("measure", "bucket").agg(F.sum("n")).collect():  # as many as a sketch has buckets
        for held, v in zip(corpus.setdefault(measure, ([], [])), (low, n), strict=True):
            held.append(v)
    parts = fine.select("lang", "source").distinct().groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / GROUPS).alias("parts"))
    part = F.pmod(F.xxhash64("source"), "parts")
    own = _same(fine, parts, ("lang",)).select("lang", part.alias("part"), "source", F.lit(True).alias("own"), "measure", "bucket", "n")
    langs = fine.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    langs = _same(langs, parts, ("lang",)).select("lang", every.alias("part"), F.lit(None).cast("string").alias("source"), F.lit(False).alias("own"), "measure", "bucket", "n")
    names = [(f"high_{k}", k) for k, *_ in RULES] + [(f"low_{k}", k) for k, *_, lower in RULES if lower]

    def run(table: pa.Table) -> pa.Table:
        found: dict[tuple, tuple[list, list]] = {}
        for source, mine, measure, low, n in zip(*(table.column(c).to_pylist() for c in ("source", "own", "measure", "bucket", "n")), strict=True):
            for held, v in zip(found.setdefault((source, mine, measure), ([], [])), (low, n), strict=True):
                held.append(v)
        sources = list(dict.fromkeys(source for source, mine, _ in found if mine))
        out = {name: [] for name, _ in names}
        for measure, a, b, spread, lower in RULES:
            whole, lang = (Sketch(*x) for x in (corpus.get(measure, ((), ())), found.get((None, False, measure), ((), ()))))
            for source in sources:
                mine = Sketch(*found.get((source, True, measure), ((), ())))
                low, high = (quantile(mine, lang, whole, q, prior) if whole.total else None for q in (a, b))
                out[f"high_{measure}"].append(None if high is None else high + spread * (high - low))
                if lower:
                    out[f"low_{measure}"].append(None if high is None else low - spread * (high - low))
        lang = pa.array([table.column("lang")[0].as_py()] * len(sources), pa.string())
        return pa.table([lang, pa.array(sources, pa.string()), *(pa.array(out[name], pa.int64()) for name, _ in names)], names=["_lang", "_source", *out])

    shipped(rows.sparkSession)
    found = own.union(langs).groupBy("lang", "part").applyInArrow(run, "_lang string, _source string, " + ", ".join(f"{name} long" for name, _ in names))
    return written(found, "thresholds")


def judged(rows: DataFrame, fences: DataFrame) -> DataFrame:
    """rows of measured() with base_failed and kept: the fixed base rules, then the fences of its group, joined."""
    out = rows.join(small(fences), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    value, beyond = measures(), F.lit(False)
    for name, *_, lower in RULES:
        beyond = beyond | F.coalesce(value[name] > F.col(f"high_{name}"), F.lit(False))
        if lower:
            beyond = beyond | F.coalesce(value[name] < F.col(f"low_{name}"), F.lit(False))
    return out.withColumns({"_q_failed": base_failed(), "_q_kept": ~base_failed() & ~beyond})


def quality_table(docs: DataFrame, **how) -> DataFrame:
    """doc_id, the base measures, base_failed and kept of every row.

    Null and empty texts have zeros and fail the base; null languages and sources are groups like any other; repeated
    rows are judged alike; an empty table gives an empty result.
    """
    rows = written(measured(docs.select("doc_id", "lang", "source", "text")).drop("text"), "measured")
    out = judged(rows, thresholds(rows, **how))
    return out.select("doc_id", *(F.col(f"_q_{k}").alias(k) for k in BASE), F.col("_q_failed").alias("base_failed"), F.col("_q_kept").alias("kept"))


def kept_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns; texts are measured again in the scan instead of shuffled.

    Nulls, repeated rows and empty tables are as in quality_table(): null and empty texts go.
    """
    rows = written(measured(docs.select("lang", "source", "text")).drop("text"), "measured")
    fences = thresholds(rows, **how)
    return aside(docs, lambda d: judged(measured(d), fences).where("_q_kept"))


_WORD = r"[^\x20\x09-\x0D]"
#: DuckDB: quality_table() over documents; sketches and fences as here, from plain counts.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT *, regexp_extract_all(text, '{_WORD}+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d
), x AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM t WHERE len(words) > 2)
), r AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i FROM x QUALIFY count(*) OVER (PARTITION BY rid, win) > 1), range(3) s(k) GROUP BY 1
), b AS (
  SELECT t.rid, doc_id, lang, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^!-/:-@\\[-`{{-~]', '', 'g')) AS n_marks, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words FROM t LEFT JOIN r USING (rid)
), g AS (SELECT * FROM b WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)), m AS (
  SELECT rid, lang, source, 'mark_pm' AS measure, 1000 * n_marks // greatest(word_chars, 1) AS v FROM g
  UNION ALL SELECT rid, lang, source, 'dup_line_pm', 1000 * n_dup_lines // greatest(n_lines, 1) FROM g
  UNION ALL SELECT rid, lang, source, 'repeat_pm', 1000 * n_repeat_words // greatest(n_words, 1) FROM g
  UNION ALL SELECT rid, lang, source, 'word_hundredths', 100 * word_chars // greatest(n_words, 1) FROM g
), rule AS (FROM (VALUES {", ".join(f"('{k}', {a}, {b}, {spread}, {lower})" for k, a, b, spread, lower in RULES)}) r(measure, qa, qb, spread, lower)),
e AS (
  SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS low FROM m WHERE v > 0 OR measure IN {RARE}
), s AS (SELECT lang, source, measure, low, count(*)::HUGEINT AS n FROM e GROUP BY ALL),
top AS (SELECT measure, low, sum(n)::HUGEINT AS p, sum(sum(n)) OVER (PARTITION BY measure)::HUGEINT AS ps FROM s GROUP BY 1, 2),
l AS (SELECT lang, measure, low, sum(n)::HUGEINT AS n FROM s GROUP BY 1, 2, 3),
mid AS (
  SELECT x.lang, top.measure, top.low, coalesce(n, 0) * ps + {PRIOR} * p AS p, ps * (sum(coalesce(n, 0)) OVER (PARTITION BY x.lang, top.measure)::HUGEINT + {PRIOR}) AS ps
  FROM (SELECT DISTINCT lang FROM g) x CROSS JOIN top
  LEFT JOIN l ON l.measure = top.measure AND l.low = top.low AND l.lang IS NOT DISTINCT FROM x.lang
), w AS (
  SELECT x.lang, x.source, mid.measure, mid.low, coalesce(n, 0) * ps + {PRIOR} * p AS w,
    ps * (sum(coalesce(n, 0)) OVER (PARTITION BY x.lang, x.source, mid.measure)::HUGEINT + {PRIOR}) AS total
  FROM (SELECT DISTINCT lang, source FROM g) x JOIN mid ON mid.lang IS NOT DISTINCT FROM x.lang
  LEFT JOIN s ON s.measure = mid.measure AND s.low = mid.low AND s.lang IS NOT DISTINCT FROM x.lang AND s.source IS NOT DISTINCT FROM x.source
), u AS (
  SELECT *, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY low) AS upto FROM w JOIN rule USING (measure)
), q AS (
  SELECT lang, source, measure, any_value(spread) AS spread, any_value(lower) AS lower, min(low) FILTER (100 * upto >= qa * total) AS qa, min(low) FILTER (100 * upto >= qb * total) AS qb FROM u GROUP BY 1, 2, 3
), o AS (
  SELECT rid, bool_or(v > qb + spread * (qb - qa) OR lower AND v < qa - spread * (qb - qa)) AS beyond
  FROM (SELECT m.*, qa, qb, spread, lower FROM m JOIN q ON m.measure = q.measure AND m.lang IS NOT DISTINCT FROM q.lang AND m.source IS NOT DISTINCT FROM q.source) GROUP BY 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(beyond, false) AS kept FROM b LEFT JOIN o USING (rid)
"""
