"""Document fingerprints: a canonical text's 128-bit xxhash, with bytes compared wherever two of them agree.

Canonical is NFKC, full case folding, NFKC again, white space folded to single spaces. Documents are grouped by the
hash and their canonical bytes together, which is the comparison of bytes inside equal buckets: Spark's aggregation
finds its key by hash and compares it by bytes, and copies combine before the shuffle, so a large group of copies costs
a row for each task. Should two different texts ever share a hash, they get numbered fingerprints.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from corvane.llm.common import map_batches, shipped, written


def canonical(text: str | None) -> bytes:
    """The bytes that a fingerprint is made of; null counts as empty."""
    if not text:
        return b""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def collisions(docs: DataFrame, text: str = "text") -> DataFrame:
    """(hash, check, number): the second and later distinct canonical texts of a hash, in the order of their SHA-256.

    Empty but for collisions of 128 bits. Canonical texts travel compressed; equal texts compress to equal bytes.
    """

    def run(texts: list) -> list:
        pack = zstandard.ZstdCompressor(level=1).compress
        found = [canonical(t) for t in texts]
        return [[digest(c) for c in found], [pack(c) for c in found]]

    rows = map_batches(docs.select(text), run, StructType([StructField("hash", StringType()), StructField("packed", BinaryType())]), cut=500)
    distinct = rows.groupBy("hash", "packed").agg(F.count(F.lit(1)).alias("n")).select("hash", F.sha2("packed", 256).alias("check"))
    many = distinct.groupBy("hash").agg(F.collect_set("check").alias("all")).where("size(all) > 1")
    return written(many.select("hash", F.posexplode(F.array_sort("all")).alias("number", "check")).where("number > 0"), "collisions")


def _check(data: bytes) -> str:
    """What collisions() knows a canonical text by."""
    return hashlib.sha256(zstandard.ZstdCompressor(level=1).compress(data)).hexdigest()


def fingerprint_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fingerprint and first, the least id with the same canonical text, of every row of docs.

    Null and empty texts are equal; repeated rows are copies; a group whose ids are all null has a null first.
    """

    def run(ids: list, texts: list) -> list:
        found = [canonical(t) for t in texts]
        return [ids, [digest(c) for c in found], [_check(c) for c in found]]

    schema = StructType([docs.schema[id], StructField("hash", StringType()), StructField("check", StringType())])
    rows = numbered(written(map_batches(docs.select(id, text), run, schema, cut=500), "hashed"), collisions(docs, text), "hash", "check", "fingerprint")
    first = rows.groupBy("fingerprint").agg(F.min(id).alias("first")).withColumnRenamed("fingerprint", "_fp")
    return rows.join(first, F.col("fingerprint") == F.col("_fp")).select(id, "fingerprint", "first")


def numbered(rows: DataFrame, clashes: DataFrame, hash: str, check: str, name: str) -> DataFrame:
    """rows with name: the hash, and its number where its text isn't the first of that hash."""
    other = clashes.select(F.col("hash").alias("_hash"), F.col("check").alias("_check"), F.col("number").alias("_number"))
    out = rows.join(other, (F.col(hash) == F.col("_hash")) & (F.col(check) == F.col("_check")), "left")
    tail = F.coalesce(F.concat(F.lit("-"), F.col("_number").cast("string")), F.lit(""))
    return out.withColumn(name, F.concat(F.col(hash), tail)).drop("_hash", "_check", "_number", check, *([hash] if hash != name else []))


def edited(text: str, after: str) -> str:
    """text with its last half (rounded down) replaced by as many code points from the beginning of after, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


DONE, LAST, HEAD = 0, 1, 2
OUT = ("n_chars", "edited_sha256", "hash", "check", "edited_hash", "edited_check", "near_edited", "near_next")


def _compared(text: str, after: str) -> tuple:
    new = edited(text, after)
    a, b, c = canonical(text), canonical(new), canonical(after)
    # Bytes, not hashes, decide the likeness of exact fingerprints: 1 or 0.
    return len(text), hashlib.sha256(new.encode()).hexdigest(), digest(a), _check(a), digest(b), _check(b), float(a == b), float(a == c)


def edit_table(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    The next document is that of the next id, ties in the order of a hash of the text, nulls first, and after the last
    comes the first; a table of one row is its own next. Null counts as empty. Texts are shuffled twice, compressed:
    canonical ones by hash, for the comparison inside equal buckets, and whole ones by ranges of the id. A range streams in order, each row meeting the next one. Only the first and last rows of the
    ranges meet once more, by an equality join of range and next range.
    """
    fields = [StructField(n, t) for n, t in zip(OUT, (LongType(), *[StringType()] * 5, DoubleType(), DoubleType()), strict=True)]
    clashes = collisions(docs, text)

    def pack(ids: list, texts: list, orders: list) -> list:
        z = zstandard.ZstdCompressor(level=1).compress
        return [ids, orders, [z((t or "").encode()) for t in texts]]

    kind = StructType([docs.schema[id], StructField("_order", LongType()), StructField("_packed", BinaryType())])
    rows = map_batches(docs.select(id, text, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_order")), pack, kind, cut=500)
    rows = rows.repartitionByRange(id, "_order").sortWithinPartitions(id, "_order")
    schema = StructType([docs.schema[id], *fields, StructField("_kind", IntegerType()), StructField("_part", IntegerType()), StructField("_text", BinaryType())])
    arrow = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_ = zstandard.ZstdDecompressor().decompress
        held = None
        blank = (None,) * len(OUT)

        def packed(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(arrow.names, x, strict=True)) for x in found], schema=arrow)

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, out = whole.slice(at, 500), []
                for key, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    t = open_(data).decode()
                    if held is None:
                        out.append((key, *blank, HEAD, part, data))
                    else:
                        out.append((held[0], *_compared(held[1], t), DONE, part, None))
                    held = (key, t, data)
                yield packed(out)
        if held is not None:
            yield packed([(held[0], *blank, LAST, part, held[2])])

    shipped(docs.sparkSession)
    found = written(rows.mapInArrow(walk, schema), "walked")
    parts = found.where(F.col("_kind") == HEAD).select("_part")
    order = Window.orderBy("_part")
    onward = parts.select("_part", F.coalesce(F.lead("_part").over(order), F.min("_part").over(Window.partitionBy())).alias("_next"))
    heads = found.where(F.col("_kind") == HEAD).select(F.col("_part").alias("_next"), F.col("_text").alias("_after"))
    last = found.where(F.col("_kind") == LAST).select(id, "_part", "_text").join(onward, "_part").join(heads, "_next").select(id, "_text", "_after")

    def finish(ids: list, texts: list, afters: list) -> list:
        open_ = zstandard.ZstdDecompressor().decompress
        got = [_compared(open_(a).decode(), open_(b).decode()) for a, b in zip(texts, afters, strict=True)]
        return [ids, *([x[k] for x in got] for k in range(len(OUT)))]

    last = map_batches(last, finish, StructType([docs.schema[id], *fields]))
    every = found.where(F.col("_kind") == DONE).select(id, *OUT).unionByName(last)
    every = numbered(every, clashes, "hash", "check", "fingerprint")
    every = numbered(every, clashes, "edited_hash", "edited_check", "edited_fingerprint")
    return every.select(id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
