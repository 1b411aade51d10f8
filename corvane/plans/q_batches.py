"""Queries: buckets, batches, offsets, padding, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import ragged
from corvane.operators import batching, joins
from corvane.plans.registry import query, r
from corvane.session import table

LIMITS = [500, 1000, 2000, 4000, 8000, 16000, 1 << 20]
BUDGET = 64_000.0
BUCKET_SQL = "CASE " + " ".join(f"WHEN n <= {x} THEN {i}" for i, x in enumerate(LIMITS)) + " END"
SIZE_SQL = "[" + ", ".join(str(batching.batch_size(BUDGET, batching.bucket_cost("linear", x))) for x in LIMITS) + "]"


@query(f"""
WITH b AS (SELECT doc_id, n_chars AS n, {BUCKET_SQL} AS bucket FROM documents)
SELECT doc_id, bucket, ((row_number() OVER (PARTITION BY bucket ORDER BY n, doc_id) - 1) // ({SIZE_SQL})[bucket + 1])::BIGINT AS batch FROM b
""")
def q37_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in buckets of length, batches of one bucket by cost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return batching.batches(docs, "n_chars", LIMITS, BUDGET, order=[F.col("n_chars"), F.col("doc_id")]).select("doc_id", "bucket", "batch")


@query(f"""
WITH u AS (SELECT 'documents' AS dataset, 0 AS turn, doc_id AS key, n_chars AS n FROM documents UNION ALL SELECT 'pages', 1, page_id, length(html) FROM pages),
b AS (SELECT *, row_number() OVER (ORDER BY turn, key) - 1 AS global_id, {BUCKET_SQL} AS bucket FROM u)
SELECT dataset, key, global_id, bucket, ((row_number() OVER (PARTITION BY dataset, bucket ORDER BY key) - 1) // ({SIZE_SQL})[bucket + 1])::BIGINT AS batch FROM b
""")
def q38_multi_dataset_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages under one global numbering; batches hold one data set and bucket."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("n"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.length("html").cast("long").alias("n"))
    rows = batching.concatenated([("documents", docs), ("pages", pages)], "key")
    out = batching.batches(rows, "n", LIMITS, BUDGET, order=[F.col("key")], by=["dataset"])
    return out.select("dataset", "key", "global_id", "bucket", "batch")


@query("""
WITH o AS (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS start, n_chars FROM documents),
q AS (SELECT event_id, (event_id * 9973) % (SELECT sum(n_chars) FROM documents) AS place FROM events)
SELECT event_id, place::BIGINT AS place, doc_id, (place - start)::BIGINT AS local FROM q JOIN o ON place >= start AND place < start + n_chars
""")
def q39_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid end to end; each event's global place found again as a document and a place in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    spans = batching.running(docs, ["doc_id"], F.col("n_chars"), "start").withColumn("stop", F.col("start") + F.col("n_chars")).drop("n_chars")
    total = docs.agg(F.sum("n_chars").alias("_total"))
    asked = table(spark, sf_dir, "events").select("event_id").crossJoin(F.broadcast(total))  # one row
    asked = asked.select("event_id", ((F.col("event_id") * 9973) % F.col("_total")).alias("place"))
    return joins.locate(asked, spans, "place", 2000).select("event_id", "place", "doc_id", "local")


@query("""
WITH s AS (SELECT conv_id, list(length(text) ORDER BY turn) AS sizes FROM conversations GROUP BY 1), m AS (SELECT *, max(len(sizes)) OVER (PARTITION BY conv_id // 16) AS width FROM s)
SELECT conv_id, width::INT AS width, array_to_string(list_concat(sizes, list_transform(range(width - len(sizes)), lambda x: 0)), ',') AS padded, len(sizes)::INT AS real FROM m
""")
def q40_pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn lengths padded to the longest conversation of the batch, sixteen ids a batch, and the mask's sum."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda t: t["n"]).alias("sizes"))
    width = F.max(F.size("sizes")).over(Window.partitionBy(F.floor(F.col("conv_id") / 16)))
    rows = turns.withColumn("width", width)
    padded = ragged.pad(F.col("sizes"), F.col("width"), F.lit(0))
    real = F.aggregate(ragged.mask(F.col("sizes"), F.col("width")), F.lit(0), lambda a, v: a + v)
    return rows.select("conv_id", "width", F.array_join(F.transform(padded, lambda v: v.cast("string")), ",").alias("padded"), real.alias("real"))


@query("""
WITH d AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS id, count(*) OVER () AS size FROM (SELECT DISTINCT p_type FROM part))
SELECT p_type, id::INT AS id, array_to_string(list_transform(range(size), lambda k: (k = id)::INT), '') AS one_hot, count(*) AS n, any_value(id)::INT AS decoded FROM part JOIN d USING (p_type) GROUP BY p_type, id, size
""")
def q41_one_hot_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary of part types: ids, one-hot rows, and the ids decoded from these again."""
    counts = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    ids = counts.withColumns({"id": F.row_number().over(Window.orderBy("p_type")) - 1, "_size": F.count(F.lit(1)).over(Window.partitionBy())})
    hot = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1), lambda k: (k == F.col("id")).cast("int"))
    rows = ids.withColumn("hot", hot)
    return rows.select("p_type", "id", F.array_join(F.transform("hot", lambda v: v.cast("string")), "").alias("one_hot"), "n", ragged.argmax(F.col("hot")).alias("decoded"))


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_size > 2 THEN p_retailprice END AS v FROM part), s AS (SELECT avg(v) AS m, stddev_pop(v) AS d, min(v) AS lo, max(v) AS hi FROM p)
SELECT p_partkey, round(coalesce((v - m) / d, -10.0), 6) AS z, round(coalesce((v - lo) / (hi - lo), -1.0), 6) AS unit FROM p, s
""")
def q42_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices standardised and scaled to the unit interval; a missing one takes each feature's error value."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 2, F.col("p_retailprice")).alias("v"))
    stats = rows.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    both = rows.crossJoin(F.broadcast(stats))  # one row
    z = F.coalesce((F.col("v") - F.col("m")) / F.col("d"), F.lit(-10.0))
    unit = F.coalesce((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(-1.0))
    return both.select("p_partkey", r(z).alias("z"), r(unit).alias("unit"))
