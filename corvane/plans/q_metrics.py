"""Queries: evaluation metrics, interactions, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import vocab
from corvane.functions.flow import hash_uniform, total_variation
from corvane.functions.geom import rmsd
from corvane.operators import interactions, joins, metrics
from corvane.plans.registry import conformers, distributions, query, r
from corvane.session import table
from corvane.streaming import metrics as windows

# The five event types stand for interaction types.
KINDS = {"view": "HBDonor", "click": "HBAcceptor", "signup": "Cationic", "purchase": "Anionic", "error": "Hydrophobic"}
KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"


def _interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as interactions: user the complex, day and hour the atoms."""
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return table(spark, sf_dir, "events").select(
        "user_id", F.element_at(kind, F.col("event_type")).alias("type"), F.array(F.dayofmonth("ts")).alias("p_atoms"), F.array(F.hour("ts")).alias("l_atoms")
    )


@query("""
SELECT lang, round(count(*) FILTER (quality = 1)::DOUBLE / count(*), 6) AS validity, count(*) AS n, round(coalesce(avg(n_chars) FILTER (quality = 1), 0), 6) AS mean_size
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1
""")
def q24_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents labelled good; unlabelled ones count as bad."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = F.col("quality") == 1
    return metrics.evaluate(rows, {
        "validity": r(metrics.validity(good)), "n": F.count(F.lit(1)), "mean_size": r(metrics.mean_of_valid(F.when(good, F.col("n_chars")), 0.0)),
    }, ["lang"])


@query("SELECT lang, round(count(DISTINCT text)::DOUBLE / count(text), 6) AS uniqueness FROM documents GROUP BY 1")
def q25_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.md5("text").alias("key"))
    return metrics.evaluate(rows, {"uniqueness": r(metrics.uniqueness(F.col("key")))}, ["lang"])


@query("""
WITH c AS (SELECT DISTINCT doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT lang, round(count(*) FILTER (text NOT IN (SELECT text FROM benchmark))::DOUBLE / count(*), 6) AS novel_exact,
  round(count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM c))::DOUBLE / count(*), 6) AS novel_contained, count(*) FILTER (doc_id IN (SELECT doc_id FROM c)) AS n_containing
FROM documents GROUP BY 1
""")
def q26_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that equal no benchmark text, and that contain none."""
    docs, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    same = docs.join(known.select("text").distinct(), "text", "left_semi").select("doc_id", F.lit(True).alias("same"))
    held = joins.containing(docs, known.withColumnRenamed("text", "passage"), "doc_id", "text", "item_id", "passage")
    held = held.select("doc_id").distinct().withColumn("held", F.lit(True))
    rows = docs.select("doc_id", "lang").join(same, "doc_id", "left").join(held, "doc_id", "left")
    key = F.col("doc_id")
    return metrics.evaluate(rows, {
        "novel_exact": r(metrics.novelty(F.col("same"), key)), "novel_contained": r(metrics.novelty(F.col("held"), key)), "n_containing": F.count_if("held"),
    }, ["lang"])


@query("""
SELECT a.source, round(avg((a.text = b.text)::int), 6) AS same_text, round(avg((a.lang = b.lang)::int), 6) AS same_lang, count(*) AS n
FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1 GROUP BY 1
""")
def q27_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the one of the next id; the last has none and counts in no mean."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.md5("text").alias("key"))
    ref = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("ref_lang"), F.col("key").alias("ref_key"))
    rows = docs.join(ref, "doc_id", "left")
    return metrics.evaluate(rows, {
        "same_text": r(metrics.reconstruction(F.col("key"), F.col("ref_key"))), "same_lang": r(metrics.reconstruction(F.col("lang"), F.col("ref_lang"))), "n": F.count(F.lit(1)),
    }, ["source"])


@query(f"""
WITH e AS (SELECT user_id, {KIND_SQL} AS t FROM events), g AS (
  SELECT user_id, CASE WHEN t IN ('HBDonor', 'HBAcceptor') THEN 'hydrogen-bond' WHEN t IN ('Cationic', 'Anionic') THEN 'ionic-interaction' ELSE t END AS type FROM e
)
SELECT user_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(type))), ',') AS types FROM g GROUP BY 1
""")
def q29_interaction_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interactions.grouped(interactions.of_types(_interactions(spark, sf_dir), list(KINDS.values())), "hbond", "ionic")
    counts = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(interactions.types_present(rows, "user_id"), "user_id").select("user_id", "n", F.array_join("types", ",").alias("types"))


@query(f"""
WITH c AS (SELECT DISTINCT user_id, dayofmonth(ts) AS p, hour(ts) AS l, {KIND_SQL} AS type FROM events)
SELECT user_id, count(*) AS n_cells, count(DISTINCT p) AS n_p, count(DISTINCT l) AS n_l, sum(p * l)::BIGINT AS checksum FROM c GROUP BY 1
""")
def q30_dense_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = interactions.dense(_interactions(spark, sf_dir), "user_id")
    return cells.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_distinct("p").alias("n_p"), F.count_distinct("l").alias("n_l"), F.sum((F.col("p") * F.col("l")).cast("long")).alias("checksum")
    )


@query("""
WITH m AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS new FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error')),
j AS (SELECT user_id || ':' || dayofmonth(ts) AS id, new FROM events LEFT JOIN m USING (event_type))
SELECT id, count(*) AS n, sum(new)::BIGINT AS total FROM j GROUP BY 1 HAVING count(*) = count(new)
""")
def q31_remap_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of a user's day, kept where every member is in the mapping, members renumbered."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", F.dayofmonth("ts")).alias("id"), "event_type")
    kept = sorted(set(KINDS) - {"error"})
    mapping = spark.createDataFrame([(t, i) for i, t in enumerate(kept)], "event_type string, new int")
    out = joins.remap_all(rows, mapping, "id", "event_type", "new")
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("total"))


POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


@query("""
WITH s AS (SELECT doc_id, n_chars FROM documents), u AS (
  SELECT n_chars, b, ('0x' || substring(md5(doc_id || ':' || b || ':5'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s, range(50) t(b)
), w AS (
  SELECT b, n_chars, (u >= 0.36787944117144233)::int + (u >= 0.7357588823428847)::int + (u >= 0.9196986029286058)::int + (u >= 0.9810118431238462)::int
    + (u >= 0.9963401531726563)::int + (u >= 0.9994058151824183)::int + (u >= 0.9999167588507119)::int AS k FROM u
), m AS (SELECT b, sum(n_chars * k)::DOUBLE / sum(k) AS mean FROM w GROUP BY 1),
c AS (SELECT round(quantile_cont(mean, 0.025), 5) AS low, round(quantile_cont(mean, 0.975), 5) AS high FROM m)
SELECT round(avg(n_chars), 6) AS mean, quantile_cont(n_chars::DOUBLE, 0.5) AS median, round(stddev_pop(n_chars), 6) AS std, min(n_chars) AS least, max(n_chars) AS most,
  round(avg((n_chars >= 4000)::int), 6) AS share_large, any_value(low) AS low, any_value(high) AS high FROM s, c
""")
def q43_size_stats_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size statistics with a bootstrap interval of the mean: each row enters each of 50 resamples a Poisson number of times."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    draws = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(49)))).withColumn("u", hash_uniform(F.col("doc_id"), F.col("b"), seed=5))
    times = sum(((F.col("u") >= p).cast("int") for p in POISSON), F.lit(0))
    means = draws.withColumn("k", times).groupBy("b").agg((F.sum(F.col("n_chars") * F.col("k")) / F.sum("k")).alias("mean"))
    interval = means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    stats = rows.agg(*metrics.size_report(F.col("n_chars"), 4000))
    both = stats.crossJoin(F.broadcast(interval))  # one row each
    return both.select("median", "least", "most", *(r(F.col(c)).alias(c) for c in ("mean", "std", "share_large")), *(F.round(c, 5).alias(c) for c in ("low", "high")))


@query("""
WITH c AS (SELECT o_custkey, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS f, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1)
SELECT count(*) AS n_customers, count(f - o) AS n_pairs, round(avg(f - o), 3) AS mean_delta, round(quantile_cont(f - o, 0.5), 3) AS median_delta, round(max(f - o), 3) AS max_delta FROM c
""")
def q44_paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of customers' finished and open totals, over customers that have both."""
    total = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((total("F") - total("O")).alias("d"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_customers"), F.count("d").alias("n_pairs"), F.round(F.avg("d"), 3).alias("mean_delta"),
        F.round(F.percentile("d", F.lit(0.5)), 3).alias("median_delta"), F.round(F.max("d"), 3).alias("max_delta"),
    )


@query("""
WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (
  SELECT x.vec_id, sqrt(list_sum(list_transform(list_zip(x.v[1:63], y.v[1:63]), lambda z: (z[1] - z[2]) ** 2)) / 21) AS rmsd,
    list_transform(x.v, lambda e: exp(e)) AS ex, list_transform(y.v, lambda e: exp(e)) AS ey FROM a x JOIN a y ON y.vec_id = x.vec_id + 1
), q AS (
  SELECT vec_id, rmsd, list_transform(ex, lambda e: e / list_sum(ex)) AS p, list_transform(ey, lambda e: e / list_sum(ey)) AS q FROM p
)
SELECT vec_id, round(rmsd, 6) AS rmsd, round(0.5 * list_sum(list_transform(list_zip(p, q), lambda z: abs(z[1] - z[2]))), 6) AS tv FROM q
""")
def q49_rmsd_tv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conformer against the next one: RMSD without alignment, total variation of the softmax of its numbers."""
    rows = conformers(spark, sf_dir).select("vec_id", "xyz").join(distributions(spark, sf_dir), "vec_id")
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("xyz").alias("xyz2"), F.col("p").alias("p2"))
    return rows.join(nxt, "vec_id").select("vec_id", r(rmsd(F.col("xyz"), F.col("xyz2"))).alias("rmsd"), r(total_variation(F.col("p"), F.col("p2"))).alias("tv"))


@query("""
SELECT doc_id, round(avg(n_chars), 6) AS mean_chars, count(n_chars) AS n, grouping(doc_id)::TINYINT AS is_total FROM documents GROUP BY GROUPING SETS ((doc_id), ())
""")
def q54_per_row_and_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.per_row_and_total(table(spark, sf_dir, "documents"), "doc_id", F.col("n_chars"), "mean_chars")
    return out.withColumn("mean_chars", r(F.col("mean_chars")))


@query("""
WITH g AS (SELECT label, avg(embedding[64]::DOUBLE) AS m, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) >= 2)
SELECT count(*) AS n, round(avg(m), 6) + 0.0 AS macro FROM g
""")
def q59_macro_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over molecules of their conformers' mean energy, molecules of one conformer left out."""
    out = metrics.macro_mean(conformers(spark, sf_dir), "mol", "energy", 2)
    return out.select("n", r(F.col("macro")).alias("macro"))


@query("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, round(avg((value > 50)::int), 6) AS high, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2
""")
def q60_windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of events by day, by the aggregates that a stream would use."""
    v = F.col("value")
    out = windows.windowed(table(spark, sf_dir, "events"), "ts", "1 day", {"high": F.avg((v > 50).cast("int")), "n": F.count(F.lit(1)), "mean": F.avg(v)}, by=["event_type"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", r(F.col("high")).alias("high"), "n", r(F.col("mean")).alias("mean"))


@query("""
WITH t AS (FROM (VALUES (0, '0_F', 0, false, NULL), (1, '1_F', 1, false, NULL), (2, '2_F', 2, false, NULL), (3, '3_F', 3, false, NULL), (4, '1_T', 1, true, NULL),
  (5, '2_T', 2, true, NULL), (6, '3_T', 3, true, NULL), (7, '2_F_E', 2, false, 'E'), (8, '2_F_Z', 2, false, 'Z'), (9, '-1_F', -1, false, NULL)) t(bond_id, token, bond_order, aromatic, stereo)),
l AS (SELECT CASE WHEN l_quantity >= 48 THEN -1 ELSE l_linenumber % 4 END AS bond_order, l_returnflag = 'A' AND l_linenumber % 4 > 0 AND l_quantity < 48 AS aromatic, l_linestatus FROM lineitem),
b AS (SELECT bond_order, aromatic, CASE WHEN bond_order = 2 AND NOT aromatic THEN CASE l_linestatus WHEN 'O' THEN 'E' WHEN 'F' THEN 'Z' END END AS stereo FROM l)
SELECT bond_id, token, t.bond_order, t.aromatic, t.stereo, count(*) AS n FROM b JOIN t ON t.bond_order = b.bond_order AND t.aromatic = b.aromatic AND t.stereo IS NOT DISTINCT FROM b.stereo GROUP BY ALL
""")
def q61_bond_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line is a bond: its token built from order, aromaticity and stereo, encoded, counted, and named by the bond dimension table."""
    line = table(spark, sf_dir, "lineitem")
    special = F.col("l_quantity") >= 48
    order = F.when(special, -1).otherwise(F.col("l_linenumber") % 4).cast("int")
    aromatic = (F.col("l_returnflag") == "A") & (F.col("l_linenumber") % 4 > 0) & ~special
    line = line.select(order.alias("o"), aromatic.alias("a"), "l_linestatus")
    stereo = F.when((F.col("o") == 2) & ~F.col("a"), F.when(F.col("l_linestatus") == "O", "e").when(F.col("l_linestatus") == "F", "z"))
    counts = line.select(vocab.encode(vocab.bond_token(F.col("o"), F.col("a"), stereo), vocab.BOND_TOKENS).alias("bond_id")).groupBy("bond_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(vocab.bond_vocabulary(spark)), "bond_id").select("bond_id", "token", "bond_order", "aromatic", "stereo", "n")
