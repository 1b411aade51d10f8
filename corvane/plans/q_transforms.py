"""Queries: composed transforms, filters, padded batches, draws, integration steps, ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import flow, geom, vocab
from corvane.operators import batching, ensemble, features, filters, graph, interactions, kernels
from corvane.plans.q_geometry import MOVE, TURN
from corvane.plans.registry import PROBS, PTS, conformers, distributions, query, r
from corvane.session import table

_U = "('0x' || substring(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_NORMAL = f"""sqrt(-2 * ln(1 - {_U.format("event_id || ':5:0'")})) * cos(2 * pi() * {_U.format("event_id || ':5:1'")})"""


@query(f"""SELECT event_id, round({_NORMAL}, 6) + 0.0 AS z, round(least(10 + 2 * ({_NORMAL}), 11), 6) AS clipped, round(3 + 4 * {_U.format("event_id || ':5'")}, 6) AS even FROM events""")
def q77_random_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal draws, with and without an upper clip, and uniform ones."""
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", r(flow.hash_normal(key, seed=5)).alias("z"), r(flow.gaussian_feature(key, mean=10, std=2, most=11, seed=5)).alias("clipped"),
        r(flow.uniform_feature(key, low=3, high=7, seed=5)).alias("even"),
    )


@query("""
WITH c AS (SELECT p_partkey, p_size, p_retailprice, p_type LIKE '%STEEL%' AS h, CASE WHEN p_size % 4 <> 0 THEN 1 END AS profile FROM part),
f AS (SELECT CASE WHEN NOT h THEN 'no_hydrogens' WHEN NOT p_size <= 35 THEN 'too_large' WHEN profile IS NULL THEN 'no_profile' WHEN NOT p_retailprice / 1000 >= 0.92 THEN 'low_qed' END AS reason FROM c)
SELECT reason, count(*) AS n FROM f GROUP BY 1
""")
def q78_dataset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as complexes: how many each condition drops, and how many stay (reason null)."""
    rows = table(spark, sf_dir, "part").select("p_size", "p_retailprice", "p_type")
    conditions = filters.pocket_conditions(F.col("p_size"), F.contains("p_type", F.lit("STEEL")), F.when(F.col("p_size") % 4 != 0, F.lit(1)), F.col("p_retailprice") / 1000, 35, 0.92)
    counts = filters.drop_counts(rows, conditions)
    stay = filters.kept(rows, conditions).agg(F.count(F.lit(1)).alias("_n"))
    # The filter itself must keep what the counts say that it keeps.
    checked = counts.crossJoin(F.broadcast(stay))  # one row
    return checked.select("reason", F.when(F.col("reason").isNull() & (F.col("n") != F.col("_n")), F.raise_error(F.lit("counts and filter differ"))).otherwise(F.col("n")).alias("n"))


@query("""
SELECT p_brand, count(*) AS n FROM part WHERE p_size <= 20 AND p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 30) GROUP BY 1
""")
def q79_training_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of at most 20 atoms with 30 conformers or more, lineitems being conformers."""
    confs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n_confs"))
    rows = table(spark, sf_dir, "part").join(confs, "p_partkey")
    return filters.kept(rows, filters.training_conditions(F.col("p_size"), F.col("n_confs"), 20, 30)).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT conv_id, conv_id // 8 AS batch, list(length(text) ORDER BY turn) AS sizes, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1),
m AS (SELECT *, max(len(sizes)) OVER (PARTITION BY batch) AS width FROM s)
SELECT conv_id, batch, width::INT AS width, array_to_string(list_concat(sizes, list_transform(range(width - len(sizes)), lambda x: 0)), ',') AS sizes,
  array_to_string(list_concat(roles, list_transform(range(width - len(roles)), lambda x: '-')), ',') AS roles, array_to_string(list_transform(range(width), lambda i: (i < len(sizes))::INT), '') AS mask FROM m
""")
def q80_padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as molecules, turns as atoms: arrays padded to the longest of a batch of eight ids, with the mask."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("size"), "role")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    rows = rows.select("conv_id", F.floor(F.col("conv_id") / 8).alias("batch"), F.col("t.size").alias("sizes"), F.col("t.role").alias("roles"), F.size("t").alias("n"))
    out = batching.collated(rows, ["batch"], {"sizes": F.lit(0), "roles": F.lit("-")}, "n")
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), "" if c == "mask" else ",").alias(c)
    return out.select("conv_id", "batch", "width", *map(text, ("sizes", "roles", "mask")))


@query(f"""
WITH {PROBS}, c AS (SELECT vec_id, i, p, vec_id % 64 AS cur, max(CASE WHEN i = vec_id % 64 THEN p END) OVER (PARTITION BY vec_id) AS here FROM probs),
o AS (SELECT *, CASE WHEN i = cur THEN 0 ELSE least(1, 0.05 * (1 + 0.1 + 0.1 * 63 * 0.5) / 0.5 * p + 0.05 * 0.1 * here) END AS off FROM c),
q AS (SELECT vec_id, i, cur, CASE WHEN i = cur THEN greatest(0, 1 - sum(off) OVER (PARTITION BY vec_id)) ELSE off END AS q FROM o),
s AS (SELECT *, sum(q) OVER (PARTITION BY vec_id ORDER BY i) AS upto, sum(q) OVER (PARTITION BY vec_id) AS whole, {_U.format("vec_id || ':9'")} AS u FROM q),
g AS (SELECT vec_id, coalesce(min(i) FILTER (upto > u * whole), 63)::INT AS category FROM s GROUP BY 1)
SELECT g.vec_id, category, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE + 0.05 * (0.3 - v::DOUBLE) / (1 - 0.5 + 1e-6))), 5) + 0.0 AS coords FROM g JOIN embeddings e ON e.vec_id = g.vec_id
""")
def q81_integrator_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step at t = 0.5: coordinates by Euler towards 0.3, the category drawn under uniform noise."""
    flat = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    rows = distributions(spark, sf_dir).join(flat, "vec_id")
    speed = F.transform("x", lambda v: 0.3 - v)
    state = flow.integrator_step(F.col("x"), speed, F.col("p"), (F.col("vec_id") % 64).cast("int"), F.lit(0.5), 0.05, flow.hash_uniform(F.col("vec_id"), seed=9), noise=0.1)
    return rows.select("vec_id", state.alias("s")).select("vec_id", F.col("s.category").alias("category"), r(geom.total(F.col("s.coords")), 5).alias("coords"))


@query("""
WITH e AS (SELECT vec_id, label AS mol, 10 * embedding[64]::DOUBLE AS energy FROM embeddings), s AS (SELECT *, energy - min(energy) OVER (PARTITION BY mol) AS strain FROM e),
k AS (SELECT * FROM s WHERE strain <= 3), w AS (SELECT *, exp(-(energy - min(energy) OVER (PARTITION BY mol)) / (0.001987 * 300)) AS raw FROM k)
SELECT vec_id, mol, round(strain, 6) AS strain, round(raw / sum(raw) OVER (PARTITION BY mol), 6) AS weight FROM w
""")
def q82_ensemble_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain from conformers to a weighted ensemble, without deduplication (tests hold that against brute force)."""
    rows = conformers(spark, sf_dir).withColumn("energy", 10 * F.col("energy"))
    out = ensemble.sample_ensemble(rows, "mol", "vec_id", dedup=None, strain=3.0)
    return out.select("vec_id", "mol", r(F.col("strain")).alias("strain"), r(F.col("weight")).alias("weight"))


@query("""
WITH e AS (SELECT vec_id, vec_id // 40 AS mol, 10 * embedding[64]::DOUBLE AS energy FROM embeddings), s AS (SELECT *, energy - min(energy) OVER (PARTITION BY mol) AS strain FROM e),
k AS (SELECT * FROM s WHERE strain <= 3), w AS (SELECT *, exp(-(energy - min(energy) OVER (PARTITION BY mol)) / (0.001987 * 300)) AS raw FROM k)
SELECT vec_id, mol, round(strain, 6) AS strain, round(raw / sum(raw) OVER (PARTITION BY mol), 6) AS weight FROM w
""")
def q118_deduplicated_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with deduplication: beside each conformer lies its copy, turned and shifted. The copies go, so weights are those of the conformers alone."""
    rows = conformers(spark, sf_dir).select("vec_id", F.expr("vec_id div 40").alias("mol"), geom.scale(F.col("xyz"), 10.0).alias("xyz"), (10 * F.col("energy")).alias("energy"))
    copies = rows.withColumns({"vec_id": F.col("vec_id") + 1_000_000_000_000, "xyz": geom.shift(geom.rotate(F.col("xyz"), TURN), geom.point(*map(F.lit, MOVE)))})
    out = ensemble.sample_ensemble(rows.unionByName(copies), "mol", "vec_id", dedup=0.05, strain=3.0)
    return out.select("vec_id", "mol", r(F.col("strain")).alias("strain"), r(F.col("weight")).alias("weight"))


@query(f"""
WITH {PTS}, s AS (SELECT vec_id, 2 * count(*) AS n, round(2 * sum(x*x + y*y + z*z), 6) AS norm2, sqrt(sum(x)**2 + sum(y)**2 + sum(z)**2) AS middle FROM pts WHERE atom % 3 <> 0 GROUP BY 1)
SELECT vec_id, n, norm2, round(2 * middle, 6) AS middle, true AS rotated, 1 AS mode FROM s
""")
def q119_turned_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles that are all turned, their shape points doubled and their pharmacophores dropped: counts, norms and the length of the sum of points stay."""
    kind = lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), F.when(i % 3 == 0, 2).otherwise(1).alias("type"))
    rows = conformers(spark, sf_dir).select("vec_id", F.transform("xyz", kind).alias("points"))
    out = kernels.augmented_profiles(rows, "vec_id", seed=3, resample=1.0, rotate_prob=1.0, drop_pharm=1.0)
    along = lambda a: geom.total(F.transform("points", lambda p: p[a]))
    whole = {a: along(a) for a in "xyz"}
    norm2 = geom.total(F.transform("points", lambda p: geom.dot(p, p)))
    middle = F.sqrt(sum((c * c for c in whole.values()), F.lit(0.0)))
    return out.select("vec_id", F.size("points").cast("long").alias("n"), r(norm2).alias("norm2"), r(middle).alias("middle"), "rotated", "mode")


@query("""
SELECT CASE event_type WHEN 'click' THEN 'Donor' WHEN 'view' THEN 'Acceptor' ELSE event_type END AS family,
  CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 END AS type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2
""")
def q83_feature_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as families, under a vocabulary that lists acceptors first; other families go."""
    family = F.when(F.col("event_type") == "click", "Donor").when(F.col("event_type") == "view", "Acceptor").otherwise(F.col("event_type"))
    found = table(spark, sf_dir, "events").select(family.alias("family"))
    return features.typed(found, ["Acceptor", "Donor"]).groupBy("family", "type").agg(F.count(F.lit(1)).alias("n"))


_DRAW = _U.format("mol || ':conformer:4'")


@query(f"""
WITH {PTS}, n AS (SELECT mol, list(DISTINCT vec_id ORDER BY vec_id) AS ids FROM pts GROUP BY 1), d AS (SELECT mol, ids[floor({_DRAW} * len(ids))::INT + 1] AS vec_id FROM n),
a AS (SELECT d.mol, p.atom, p.x, p.y, p.z FROM d JOIN pts p USING (vec_id)),
h AS (SELECT mol, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, count(*)::INT AS n_heavy FROM a WHERE atom NOT IN (6, 7) GROUP BY 1),
g AS (SELECT mol, avg(x) AS gx, avg(y) AS gy, avg(z) AS gz FROM a WHERE atom IN (5, 6, 7) GROUP BY 1)
SELECT h.mol, n_heavy, round(gx - cx, 6) + 0.0 AS x, round(gy - cy, 6) + 0.0 AS y, round(gz - cz, 6) + 0.0 AS z,
  (SELECT round(sqrt(sum((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)), 6) FROM a WHERE a.mol = h.mol AND atom NOT IN (6, 7)) AS spread,
  CASE WHEN {_U.format("h.mol || ':size:4'")} >= 0.5 THEN 1 ELSE 0 END AS masked FROM h JOIN g USING (mol)
""")
def q84_molecule_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conformer of each molecule by draw, a group's centroid, hydrogens (atoms 6 and 7) gone, centred; a masked feature."""
    confs = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "xyz"))), lambda c: c["xyz"])
    rows = conformers(spark, sf_dir).groupBy("mol").agg(confs.alias("confs"))
    numbers = F.array(*(F.lit(1 if k in (6, 7) else 6) for k in range(21)))
    rows = rows.withColumns({"numbers": numbers, "groups": F.array(F.array(*map(F.lit, (5, 6, 7)))), "size": F.lit(21.0)})
    out = features.molecule_transform(rows, "mol", seed=4, dropout=0.5, features=["size"])
    spread = F.sqrt(geom.total(F.transform("xyz", lambda p: geom.dot(p, p))))
    at = F.get("group_points", F.lit(0))
    return out.select("mol", F.size("xyz").alias("n_heavy"), *(r(at[a]).alias(a) for a in "xyz"), r(spread).alias("spread"), F.col("size-mask").alias("masked"))


@query(f"""
WITH {PTS} SELECT a.vec_id, min(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)) >= 0.04 AS apart FROM pts a JOIN pts b ON a.vec_id = b.vec_id AND a.atom < b.atom GROUP BY 1
""")
def q85_positions_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are no two atoms of a conformer nearer than 0.04?"""
    return conformers(spark, sf_dir).select("vec_id", features.apart(F.col("xyz"), 0.04).alias("apart"))


@query("""
WITH n AS (SELECT n_regionkey AS graph, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, (n_nationkey % 3 <> 0)::INT AS present FROM nation), m AS (
  SELECT a.graph, a.k AS i, b.k AS j FROM n a JOIN n b ON a.graph = b.graph WHERE a.present = 1 AND b.present = 1 AND a.k <> b.k
), t AS (SELECT a.graph, a.k AS i, b.k AS j, ((a.k + b.k) % 3) AS type FROM n a JOIN n b ON a.graph = b.graph)
SELECT 'mask' AS part, graph, i::INT AS i, j::INT AS j, NULL::INT AS type FROM m UNION ALL SELECT 'edge', graph, i::INT, j::INT, type::INT FROM t WHERE i < j AND type <> 0
""")
def q86_dense_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region is a graph of its nations: the fully connected mask of some, and edges from a dense matrix of bond types."""
    flags = F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: (k % 3 != 0).cast("int"))
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("graph")).agg(flags.alias("present"))
    span = F.sequence(F.lit(0), F.size("present") - 1)
    dense = rows.withColumn("m", F.transform(span, lambda i: F.transform(span, lambda j: (i + j) % 3)))
    mask = graph.connected_mask(rows, "present", loops=False).select(F.lit("mask").alias("part"), "graph", "i", "j", F.lit(None).cast("int").alias("type"))
    return mask.unionByName(graph.from_adjacency(dense, "m").select(F.lit("edge").alias("part"), "graph", "i", "j", "type"))


@query(f"""
WITH {PTS} SELECT vec_id, 2 * count(*) FILTER (atom % 3 <> 0) + count(*) FILTER (atom % 3 = 0) AS n, count(*) FILTER (atom % 3 = 0) AS n_pharm,
  round(2 * sum(x) FILTER (atom % 3 <> 0), 6) + 0.0 AS shape_x, round(sum(y) FILTER (atom % 3 = 0), 6) + 0.0 AS pharm_y FROM pts GROUP BY 1
""")
def q87_augmented_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles whose shape points are all doubled and that are neither turned, dropped nor shaken: the part of the augmentation that SQL can follow."""
    kind = lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), F.when(i % 3 == 0, 2).otherwise(1).alias("type"))
    rows = conformers(spark, sf_dir).select("vec_id", F.transform("xyz", kind).alias("points"))
    out = kernels.augmented_profiles(rows, "vec_id", resample=1.0)
    of = lambda t, a: r(geom.total(F.transform(F.filter("points", lambda p: p["type"] == t), lambda p: p[a])))
    n_pharm = F.size(F.filter("points", lambda p: p["type"] > 1)).cast("long")
    return out.select("vec_id", F.size("points").cast("long").alias("n"), n_pharm.alias("n_pharm"), of(1, "x").alias("shape_x"), of(2, "y").alias("pharm_y"))


@query(f"""
WITH {PTS}, c AS (SELECT vec_id, atom, 10 * x AS x, 10 * y AS y, 10 * z AS z, atom % 3 - 1 AS charge FROM pts)
SELECT p.vec_id, p.atom::INT AS p, l.atom::INT AS l, CASE WHEN l.charge > 0 THEN 'Cationic' ELSE 'Anionic' END AS type, round(sqrt((p.x-l.x)**2 + (p.y-l.y)**2 + (p.z-l.z)**2), 6) AS dist
FROM c p JOIN c l ON p.vec_id = l.vec_id AND p.atom < 10 AND l.atom >= 10 AND p.charge * l.charge < 0 AND sqrt((p.x-l.x)**2 + (p.y-l.y)**2 + (p.z-l.z)**2) <= 1.5
""")
def q88_ionic_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms 0..9 as the pocket, the rest as the ligand, charges by turns: opposite charges within reach."""
    atoms = conformers(spark, sf_dir).select("vec_id", F.posexplode(geom.scale(F.col("xyz"), 10.0)).alias("atom", "point")).withColumn("charge", F.col("atom") % 3 - 1)
    out = interactions.ionic_contacts(atoms.where("atom < 10"), atoms.where("atom >= 10"), ["vec_id"], 1.5)
    return out.select("vec_id", "p", "l", "type", r(F.col("dist")).alias("dist"))


@query(f"""
WITH {PTS}, c AS (SELECT vec_id, atom, 10 * x AS x, 10 * y AS y, 10 * z AS z, CASE atom % 3 WHEN 0 THEN 30 WHEN 1 THEN 8 ELSE 6 END AS el FROM pts),
m AS (SELECT p.vec_id, p.atom::INT AS p, l.atom::INT AS l, p.el AS pe, l.el AS le, sqrt((p.x-l.x)**2 + (p.y-l.y)**2 + (p.z-l.z)**2) AS dist
  FROM c p JOIN c l ON p.vec_id = l.vec_id AND p.atom < 10 AND l.atom >= 10)
SELECT vec_id, p, l, CASE WHEN le = 30 THEN 'MetalDonor' ELSE 'MetalAcceptor' END AS type, round(dist, 6) AS dist
FROM m WHERE dist <= 1.5 AND ((pe = 30 AND le = 8) OR (pe = 8 AND le = 30))
""")
def q98_metal_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms 0..9 as the pocket, the rest as the ligand, elements by turns: zinc and oxygen within reach."""
    z = F.when(F.col("atom") % 3 == 0, 30).when(F.col("atom") % 3 == 1, 8).otherwise(6)
    atoms = conformers(spark, sf_dir).select("vec_id", F.posexplode(geom.scale(F.col("xyz"), 10.0)).alias("atom", "point")).withColumn("z", z)
    out = interactions.metal_contacts(atoms.where("atom < 10"), atoms.where("atom >= 10"), ["vec_id"], 1.5)
    return out.select("vec_id", "p", "l", "type", r(F.col("dist")).alias("dist"))


@query(f"""
WITH {PTS}, c AS (SELECT vec_id, atom, 10 * x AS x, 10 * y AS y, 10 * z AS z, 0.5::DOUBLE + (atom % 3) / 8.0::DOUBLE AS radius FROM pts),
m AS (SELECT p.vec_id, p.atom::INT AS p, l.atom::INT AS l, p.radius + l.radius AS most, sqrt((p.x-l.x)**2 + (p.y-l.y)**2 + (p.z-l.z)**2) AS dist
  FROM c p JOIN c l ON p.vec_id = l.vec_id AND p.atom < 10 AND l.atom >= 10)
SELECT vec_id, p, l, 'VdWContact' AS type, round(dist, 6) AS dist FROM m WHERE dist <= most + 0.25
""")
def q99_vdw_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms 0..9 as the pocket, the rest as the ligand, radii by turns: pairs whose spheres touch."""
    radius = 0.5 + (F.col("atom") % 3) / 8.0
    atoms = conformers(spark, sf_dir).select("vec_id", F.posexplode(geom.scale(F.col("xyz"), 10.0)).alias("atom", "point")).withColumn("radius", radius)
    out = interactions.vdw_contacts(atoms.where("atom < 10"), atoms.where("atom >= 10"), ["vec_id"], 0.25)
    return out.select("vec_id", "p", "l", "type", r(F.col("dist")).alias("dist"))


@query("""
WITH d AS (SELECT l_partkey, draw, floor(('0x' || substring(md5(l_partkey || ':' || draw || ':7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * n)::BIGINT AS turn
  FROM (SELECT l_partkey, count(DISTINCT l_quantity) AS n FROM lineitem GROUP BY 1), range(1, 4) t(draw)),
q AS (SELECT l_partkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity) - 1 AS turn FROM (SELECT DISTINCT l_partkey, l_quantity FROM lineitem))
SELECT l_partkey, draw::INT AS draw, l_quantity FROM d JOIN q USING (l_partkey, turn)
""")
def q89_uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three draws, with replacement, of each part's distinct quantities, all alike."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").distinct()
    return ensemble.uniform_sample(rows, ["l_partkey"], ["l_quantity"], 3, 7).select("l_partkey", "draw", "l_quantity")


@query("SELECT p_brand || '_' || (p_size % 5 - 2) AS token, count(*) AS n FROM part GROUP BY 1")
def q90_charged_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as elements: the token of an element and its charge."""
    return table(spark, sf_dir, "part").groupBy(vocab.charged_symbol(F.col("p_brand"), F.col("p_size") % 5 - 2).alias("token")).agg(F.count(F.lit(1)).alias("n"))
