"""Periodic runs of words by harmonic grid probing.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that can't be extended.
It holds at least four neighbouring multiples of q, and from the first of them on the next 2 q + 1 words equal those q
further on. So for each period p only the grid points jp are probed, n/p of them, n log n in all:

    probe    words jp, (j+1)p, (j+2)p and (j+3)p are equal, and so are the two words after jp and after (j+1)p;
    confirm  the 2 p + 1 words from jp on are compared with those p further on, in chunks that double;
    extend   the stretch grows to both sides, again in chunks.

Grid points within a stretch that was compared are skipped, and those within a found run whose period divides p. By the
theorem of Fine and Wilf a stretch of four periods p whose smallest period is less has one that divides p, and the same
ends: periods go upwards, so the skipping leaves each run at its smallest period.

All of a text's work is inside one row; nothing is shuffled. Memory is a few numbers for each word of the text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corvane.llm.common import map_batches

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Texts of up to so many words share one grid; longer ones make theirs, so many points at once.
GRID_WORDS, GRID_POINTS = 1 << 15, 1 << 18
#: Words compared at first when a survivor is confirmed or extended.
CHUNK = 64
#: Characters of a text that are cut into words at once, at least.
SLICE = 1 << 20


def numbered(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word, and the words by number; cut a slice at a time, so that few word objects live at once."""
    if not text:
        return np.zeros(0, np.int32), []
    data = text.encode()
    number: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = data[at:end].split()
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        at = end
    return np.concatenate(parts), list(number)


@cache
def _shared_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Period, jp and (j+3)p of all grid points with (j+3)p < GRID_WORDS, by the last: a text's points come first."""
    p, x = _points(GRID_WORDS, 1, GRID_WORDS)
    order = np.argsort(x + 3 * p, kind="stable")
    p, x = p[order].astype(np.int32), x[order].astype(np.int32)
    return p, x, x + 3 * p


def _points(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Period and jp of the grid points with (j+3)p < n of the periods from low to high - 1."""
    periods = np.arange(low, high)
    many = np.maximum((n - 1) // periods - 2, 0)
    p = np.repeat(periods, many)
    j = np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)
    return p, j * p


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grid points of a text of n words, blocks of ascending periods."""
    if n <= GRID_WORDS:
        p, x, last = _shared_grid()
        upto = int(np.searchsorted(last, n))
        yield p[:upto], x[:upto]
        return
    low = 1
    while LEAST_PERIODS * low <= n:
        high = low + max(1, GRID_POINTS * low // n)
        yield _points(n, low, high)
        low = high


def _survivors(w: np.ndarray, p: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid points whose probes agree, by period and place."""
    for a, b in ((0, 1), (0, 2), (0, 3)):
        hit = w[x + a * p] == w[x + b * p]
        p, x = p[hit], x[hit]
    for k in (1, 2):
        hit = w[x + k] == w[x + p + k]
        p, x = p[hit], x[hit]
    order = np.lexsort((x, p))
    return p[order].astype(np.int64), x[order].astype(np.int64)


def _agreeing(w: np.ndarray, a: int, b: int, most: int, back: bool = False) -> int:
    """How many words from a on equal those from b on (a < b), most at most; back: the words before a and b."""
    done, chunk = 0, CHUNK
    while done < most:
        chunk = min(chunk, most - done)
        if back:
            same = w[a - done - chunk : a - done][::-1] == w[b - done - chunk : b - done][::-1]
        else:
            same = w[a + done : a + done + chunk] == w[b + done : b + done + chunk]
        if not same.all():
            return done + int(same.argmin())
        done += chunk
        chunk *= 2
    return done


def _stretches(w: np.ndarray, p: int, places: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of period p around grid points that survived, each once."""
    n, found, k = len(w), [], 0
    while k < len(places):
        x = int(places[k])
        same = _agreeing(w, x, x + p, min(2 * p + 1, n - p - x))
        if same == 2 * p + 1:
            same += _agreeing(w, x + same, x + p + same, n - p - x - same)
            before = _agreeing(w, x, x + p, x, back=True)
            length = before + same + p
            if length >= max(LEAST_WORDS, LEAST_PERIODS * p):
                found.append((x - before, length, p))
        # The word x + same differs from the one p further on, so no run of this period has both.
        k = int(np.searchsorted(places, x + same, "right"))
    return found


def _outside(p: np.ndarray, x: np.ndarray, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Mask of the grid points that no run of found (one period q, by start) covers at a multiple of q."""
    starts, lengths, periods = np.array(found).T
    ends = np.maximum.accumulate(starts + lengths)
    at = np.searchsorted(starts, x, "right") - 1
    return (p % periods[0] != 0) | (at < 0) | (x + p >= ends[at])


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array of word numbers, by start, then period."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    if len(w) < LEAST_WORDS:
        return []
    for p, x in _grid(len(w)):
        p, x = _survivors(w, p, x)
        for known in found.values():
            if not len(p):
                break
            keep = _outside(p, x, known)
            p, x = p[keep], x[keep]
        while len(p):
            upto = int(np.searchsorted(p, p[0], "right"))
            new = _stretches(w, int(p[0]), x[:upto])
            if new:
                found[int(p[0])] = new
            p, x = p[upto:], x[upto:]
            if new:
                keep = _outside(p, x, new)
                p, x = p[keep], x[keep]
    return sorted(r for new in found.values() for r in new)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Mask of n words without those that a run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def planted(w: np.ndarray, doc_id: object) -> np.ndarray:
    """The words with a made-up periodic tail where crc32 of the id is divisible by 10; as they are for a null id."""
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((w[:a], w[a : a + p][np.arange(n - a) % p]))


def _digest(words: list[bytes], numbers: np.ndarray) -> str:
    """SHA-256 of the words of the numbers, joined by spaces; joined a slice at a time."""
    found, at = hashlib.sha256(), 0
    for at in range(0, len(numbers), SLICE):
        found.update(b" " * (at > 0) + b" ".join([words[i] for i in numbers[at : at + SLICE].tolist()]))
    return found.hexdigest()


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id and runs (array of start, length, period, by start, then period) of every row.

    Null and empty texts, and those of under six words, have none; a null doc_id stays; repeated rows have the same runs;
    an empty table gives an empty result. plant: see planted().
    """

    def run(ids: list, texts: list) -> list:
        out = []
        for i, t in zip(ids, texts, strict=True):
            w = numbered(t)[0]
            out.append([{"start": s, "length": m, "period": q} for s, m, q in runs_of(planted(w, i) if plant else w)])
        return [ids, out]

    one = "array<struct<start:bigint,length:bigint,period:bigint>>"
    fields = StructType([docs.schema["doc_id"], StructField("runs", docs.sparkSession.range(0).select(F.lit(None).cast(one).alias("r")).schema["r"].dataType)])
    return map_batches(docs.select("doc_id", "text"), run, fields)


def collapsed_documents(docs: DataFrame) -> DataFrame:
    """docs with text rebuilt without the words that a run contains after its first period, joined by one space.

    Texts without a run stay as they are, nulls too; other columns are untouched.
    """
    at = docs.columns.index("text")

    def collapsed(t: str | None) -> str | None:
        w, words = numbered(t)
        runs = runs_of(w)
        return b" ".join([words[i] for i in w[kept_words(len(w), runs)].tolist()]).decode() if runs else t

    return map_batches(docs, lambda *c: [*c[:at], list(map(collapsed, c[at])), *c[at + 1 :]], docs.schema)


def run_table(docs: DataFrame, plant: bool = True) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the kept words, for every row.

    Null and empty texts have no run, four nulls and the digests of nothing; a null doc_id stays and plants nothing;
    repeated rows give equal rows; an empty table gives an empty result.
    """

    def run(ids: list, texts: list) -> list:
        out: list[list] = [[] for _ in range(7)]
        for i, t in zip(ids, texts, strict=True):
            w, words = numbered(t)
            w = planted(w, i) if plant else w
            runs = runs_of(w)
            start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
            lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
            row = (len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(lines.encode()).hexdigest())
            for held, v in zip(out, (*row, _digest(words, w[kept_words(len(w), runs)])), strict=True):
                held.append(v)
        return [ids, *out]

    longs = [StructField(c, LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    return map_batches(docs.select("doc_id", "text"), run, StructType([docs.schema["doc_id"], *longs, *(StructField(c, StringType()) for c in ("runs_sha256", "collapsed_sha256"))]))


#: DuckDB: run_table() over documents. Equal three-word windows meet by equality; stretches of them at one distance are
#: runs, and of the runs with the same ends the least distance is the smallest period.
ORACLE = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS t
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), c AS (
  SELECT rid, doc_id, ws, len(ws) AS n,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x))), lambda a, x: xor(a >> 8, t[xor(a % 256, x) + 1])), 4294967295) AS h FROM d, tab
), g AS (
  SELECT rid, doc_id, ws, n, h % 10 = 0 AND n > 0 AS hit, CASE WHEN n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS k FROM c
), o AS (
  SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM g
), w AS (
  SELECT o.rid, o.i, n, coalesce(s.word, o.word) AS word FROM o JOIN g USING (rid)
  LEFT JOIN o s ON s.rid = o.rid AND hit AND o.i >= a AND s.i = a + (o.i - a) % (1 + (n - a) // k)
), x AS (
  SELECT rid, n, i, word || ' ' || lead(word) OVER r || ' ' || lead(word, 2) OVER r AS win FROM w WINDOW r AS (PARTITION BY rid ORDER BY i)
), m AS (
  SELECT a.rid, a.i, b.i - a.i AS p FROM x a JOIN x b ON a.rid = b.rid AND a.win = b.win AND a.i < b.i AND 4 * (b.i - a.i) <= a.n
), s AS (
  SELECT rid, p, min(i) AS start, count(*) + 2 + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS island FROM m) GROUP BY rid, p, island
), runs AS (
  SELECT rid, start, length, min(p) AS period FROM s WHERE length >= 6 AND length >= 4 * p GROUP BY 1, 2, 3
), q AS (
  SELECT rid, count(*) AS n_runs, min(struct_pack(l := -length, s := start, p := period)) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY 1
), gone AS (
  SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (rid, i) GROUP BY 1
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, -b.l AS length, b.p AS period, 1000 * -b.l // b.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM g LEFT JOIN q USING (rid) LEFT JOIN kept USING (rid)
"""
