"""Queries: molecules as atom and bond tables. Each 24 parts are one: bonded in a tree that p_size shapes, with closures at some sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import geom, vocab
from corvane.operators import canonical, circular, interactions, joins, metrics, patterns, stereo, topology, valence
from corvane.operators.patterns import Pattern
from corvane.plans.registry import PTS, conformers, query, r
from corvane.session import settled, table
from corvane.sources import perception

#: Atoms of a molecule; the first half of them is aromatic.
MOLECULE, AROMATIC = 24, 12
ELEMENT = "CASE p_size % 9 WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN 8 WHEN 3 THEN 16 WHEN 4 THEN 35 ELSE 6 END"
CHARGE = "CASE p_size % 23 WHEN 5 THEN 1 WHEN 6 THEN -1 ELSE 0 END"
#: DuckDB: atoms, bonds (each once) and ends (each in both directions).
MOLS = f"""atoms AS (
  SELECT p_partkey // {MOLECULE} AS graph, (p_partkey % {MOLECULE})::INT AS atom, {ELEMENT} AS z, {CHARGE} AS charge, p_size % 4 AS n_h, p_partkey % {MOLECULE} < {AROMATIC} AS aromatic FROM part
), links AS (
  SELECT p_partkey // {MOLECULE} AS graph, (p_partkey % {MOLECULE})::INT AS j, unnest([
    {{i: greatest(p_partkey % {MOLECULE} - 1 - p_size % 2, 0), type: CASE WHEN p_size % 5 = 0 THEN 2 ELSE 1 END}},
    {{i: CASE WHEN p_size % 6 = 0 THEN p_partkey % {MOLECULE} - 5 ELSE -1 END, type: 1}}, {{i: CASE WHEN p_size % 7 = 0 THEN p_partkey % {MOLECULE} - 4 ELSE -1 END, type: 1}}
  ], recursive := true) FROM part WHERE p_partkey % {MOLECULE} > 0
), bonds AS (SELECT graph, i::INT AS i, j, type, i < {AROMATIC} AND j < {AROMATIC} AS aromatic FROM links WHERE i >= 0),
ends AS (SELECT * FROM bonds UNION ALL SELECT graph, j, i, type, aromatic FROM bonds)"""


def molecules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """atoms (graph, atom, z, charge, n_h, aromatic) and bonds (graph, i, j, type, aromatic), settled."""
    part = table(spark, sf_dir, "part").select(F.expr(f"p_partkey div {MOLECULE}").alias("graph"), F.expr(f"int(p_partkey % {MOLECULE})").alias("atom"), "p_size")
    atoms = part.select("graph", "atom", F.expr(ELEMENT).alias("z"), F.expr(CHARGE).alias("charge"), F.expr("p_size % 4").alias("n_h"), (F.col("atom") < AROMATIC).alias("aromatic"))
    ends = F.array(
        F.struct(F.expr("greatest(atom - 1 - p_size % 2, 0)").alias("i"), F.expr("CASE WHEN p_size % 5 = 0 THEN 2 ELSE 1 END").alias("type")),
        F.struct(F.expr("CASE WHEN p_size % 6 = 0 THEN atom - 5 ELSE -1 END").alias("i"), F.lit(1).alias("type")),
        F.struct(F.expr("CASE WHEN p_size % 7 = 0 THEN atom - 4 ELSE -1 END").alias("i"), F.lit(1).alias("type")),
    )
    links = part.where("atom > 0").select("graph", F.col("atom").alias("j"), F.explode(ends).alias("e")).where("e.i >= 0")
    bonds = links.select("graph", "e.i", "j", "e.type", ((F.col("e.i") < AROMATIC) & (F.col("j") < AROMATIC)).alias("aromatic"))
    return settled(atoms), settled(bonds)


@query(f"WITH {MOLS} SELECT graph, (SELECT count(*) FROM bonds b WHERE b.graph = a.graph) - count(*) + 1 AS n_rings FROM atoms a GROUP BY 1")
def q100_ring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of a least cycle basis; a connected graph has as many as bonds beyond a tree."""
    atoms, bonds = molecules(spark, sf_dir)
    return topology.ring_counts(atoms, topology.rings(bonds)).select("graph", "n_rings")


#: DuckDB: for each bond the shortest way around it, as a ring's size.
SMALLEST = """way AS (
  SELECT graph, i, j, i AS node, 0 AS steps FROM bonds
  UNION SELECT w.graph, w.i, w.j, b.j, w.steps + 1 FROM way w JOIN ends b ON b.graph = w.graph AND b.i = w.node AND NOT (least(b.i, b.j) = w.i AND greatest(b.i, b.j) = w.j) AND w.steps < 23
), smallest AS (SELECT graph, i, j, min(steps) + 1 AS size FROM way WHERE node = j AND steps > 0 GROUP BY 1, 2, 3)"""


@query(f"WITH RECURSIVE {MOLS}, {SMALLEST} SELECT graph, i, j, size FROM smallest")
def q101_ring_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bonds that are in a ring, and the size of the smallest one through each."""
    _, bonds = molecules(spark, sf_dir)
    return topology.smallest_ring(topology.rings(bonds))


@query(f"""
WITH RECURSIVE {MOLS}, w AS (SELECT DISTINCT graph, i AS a, j AS b, 1 AS steps FROM ends UNION SELECT w.graph, w.a, x.j, w.steps + 1 FROM w JOIN ends x ON x.graph = w.graph AND x.i = w.b AND w.steps < 23),
d AS (SELECT graph, a, b, min(steps) AS steps FROM w WHERE a <> b GROUP BY 1, 2, 3)
SELECT graph, steps, count(*) AS n FROM d GROUP BY 1, 2
""")
def q102_bond_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of atoms are so many bonds apart."""
    _, bonds = molecules(spark, sf_dir)
    return topology.bond_distances(bonds).groupBy("graph", "steps").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {MOLS}, e AS (SELECT graph, i, j, type FROM ends),
n AS (SELECT graph, atom FROM atoms WHERE z = 7), h AS (SELECT DISTINCT e.graph, e.i AS atom FROM e JOIN atoms a ON a.graph = e.graph AND a.atom = e.j WHERE a.z = 8)
SELECT a.graph, a.atom AS a0, b.j AS a1, c.j AS a2, d.j AS a3, f.j AS a4, g.j AS a5
FROM n a JOIN e b ON b.graph = a.graph AND b.i = a.atom JOIN e c ON c.graph = a.graph AND c.i = b.j AND c.j <> a.atom
JOIN e d ON d.graph = a.graph AND d.i = c.j AND d.j NOT IN (a.atom, b.j) JOIN e f ON f.graph = a.graph AND f.i = d.j AND f.j NOT IN (a.atom, b.j, c.j)
JOIN e z ON z.graph = a.graph AND z.i = f.j AND z.j = a.atom JOIN e g ON g.graph = a.graph AND g.i = c.j AND g.j NOT IN (a.atom, b.j, c.j, d.j, f.j) AND g.type = 1
JOIN atoms y ON y.graph = a.graph AND y.atom = c.j AND y.z = 6 SEMI JOIN h ON h.graph = a.graph AND h.atom = d.j
""")
def q103_pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-rings with a nitrogen, a carbon that has a single bond out of the ring, and next to it an atom bonded to an oxygen."""
    atoms, bonds = molecules(spark, sf_dir)
    beside_oxygen = Pattern(["true", "z = 8"], [(0, 1, "true")])
    ring = [(k, (k + 1) % 5, "true") for k in range(5)]
    return patterns.matches(atoms, bonds, Pattern(["z = 7", "true", "z = 6", "true", "true", "true"], [*ring, (2, 5, "type = 1")], inside=[(3, beside_oxygen)]))


#: DuckDB: ends of chains and atoms inside chains, of x or e.
_TERMINAL = "z = 6 AND NOT aromatic AND (n_h = 3 AND conn = 4 OR n_h = 2 AND conn = 3 OR n_h = 1 AND conn = 2)"
_MIDDLE = "z = 6 AND NOT aromatic AND (n_h = 2 AND conn = 4 OR n_h = 1 AND conn = 3 OR n_h = 0 AND conn = 2)"


@query(f"""
WITH RECURSIVE {MOLS}, {SMALLEST},
x AS (
  SELECT a.*, coalesce(d.n, 0) + n_h AS conn, coalesce(d.v, 0) + n_h AS valence, s.size FROM atoms a LEFT JOIN (SELECT graph, i, count(*) AS n, sum(type) AS v FROM ends GROUP BY 1, 2) d ON d.graph = a.graph AND d.i = a.atom
  LEFT JOIN (SELECT graph, atom, min(size) AS size FROM (SELECT graph, unnest([i, j]) AS atom, size FROM smallest) GROUP BY 1, 2) s ON s.graph = a.graph AND s.atom = a.atom
), y AS (SELECT *, z = 7 AND NOT aromatic AS n, z = 8 AND NOT aromatic AS o, {_TERMINAL} AS t, {_MIDDLE} AS m FROM x),
e AS (
  SELECT b.graph, b.i, b.j, b.type = 1 AND NOT b.aromatic AS sg, b.type = 2 AND NOT b.aromatic AS db, b.type = 1 OR b.aromatic AS pl, y.* EXCLUDE (graph, atom) FROM ends b JOIN y ON y.graph = b.graph AND y.atom = b.j
), two AS (
  SELECT a.graph, a.i, a.j, b.j AS k, a.sg, a.db, a.pl, a.z, a.n, a.o, a.m, a.aromatic, b.sg AS sg2, b.db AS db2, b.pl AS pl2, b.z AS z2, b.n AS n2, b.o AS o2, b.t AS t2, b.m AS m2, b.charge AS charge2
  FROM e a JOIN e b ON b.graph = a.graph AND b.i = a.j AND b.j <> a.i
), f AS (
  SELECT y.*,
    o AND n_h = 1 AND EXISTS (FROM two w WHERE w.graph = y.graph AND w.i = y.atom AND w.pl AND w.z IN (6, 15, 16) AND NOT w.aromatic AND w.db2 AND w.o2) AS acid,
    n AND conn = 3 AND EXISTS (FROM two w WHERE w.graph = y.graph AND w.i = y.atom AND w.sg AND w.db2 AND w.z2 <> 6) AS amide,
    n AND conn = 3 AND EXISTS (FROM e w WHERE w.graph = y.graph AND w.i = y.atom AND w.sg AND w.aromatic) AS aniline,
    n AND EXISTS (FROM two w JOIN two v ON v.graph = w.graph AND v.i = w.i AND v.j = w.j AND v.k <> w.k WHERE w.graph = y.graph AND w.i = y.atom AND w.db AND w.z = 6 AND NOT w.aromatic AND w.pl2 AND (w.n2 OR w.z2 = 6 AND w.k >= {AROMATIC}) AND v.pl2 AND v.n2) AS amidine,
    o AND conn = 2 AND EXISTS (FROM two w JOIN e v ON v.graph = w.graph AND v.i = w.i AND v.j NOT IN (w.j, w.k) WHERE w.graph = y.graph AND w.i = y.atom AND w.pl AND w.z = 6 AND NOT w.aromatic AND w.db2 AND w.o2 AND v.pl AND v.z = 6 AND NOT v.aromatic) AS ester,
    (SELECT count(*) FROM e w WHERE w.graph = y.graph AND w.i = y.atom AND w.aromatic) >= 2 AS between_rings,
    EXISTS (FROM two w WHERE w.graph = y.graph AND w.i = y.atom AND w.db AND w.n AND w.sg2) AS nitroso, EXISTS (FROM two w WHERE w.graph = y.graph AND w.i = y.atom AND w.sg AND w.n AND w.db2 AND w.o2) AS nitro,
    EXISTS (FROM e w WHERE w.graph = y.graph AND w.i = y.atom AND w.pl AND w.charge < 0) AS by_minus, EXISTS (FROM e w WHERE w.graph = y.graph AND w.i = y.atom AND w.pl AND w.charge > 0) AS by_plus,
    z = 6 AND EXISTS (FROM e w WHERE w.graph = y.graph AND w.i = y.atom AND w.z IN (7, 8, 9)) AS hetero, EXISTS (FROM two w WHERE w.graph = y.graph AND w.i = y.atom AND w.pl AND w.pl2 AND w.t2) AS near_end,
    (SELECT count(*) FROM e w WHERE w.graph = y.graph AND w.i = y.atom AND w.pl AND w.t) AS n_ends, m AND EXISTS (FROM e w WHERE w.graph = y.graph AND w.i = y.atom AND NOT w.m) AS beside_others,
    EXISTS (FROM e w WHERE w.graph = y.graph AND w.i = y.atom AND w.z = 6) AS by_carbon, EXISTS (FROM e w WHERE w.graph = y.graph AND w.i = y.atom AND w.z <> 6) AS by_other, EXISTS (FROM e w WHERE w.graph = y.graph AND w.i = y.atom AND w.sg AND w.z = 6) AS on_carbon FROM y
), path AS (
  SELECT graph, [atom] AS p, size FROM x WHERE aromatic AND size BETWEEN 4 AND 8
  UNION ALL SELECT p.graph, list_append(p.p, b.j), p.size FROM path p JOIN ends b ON b.graph = p.graph AND b.i = p.p[-1] AND b.aromatic JOIN x ON x.graph = b.graph AND x.atom = b.j AND x.size = p.size
  WHERE len(p.p) < p.size AND NOT list_contains(p.p, b.j)
), arms AS (
  SELECT a.graph, a.i, a.j AS p, b.j AS q, c.j AS r, a.db AS adb, a.n AS an, a.charge AS ac, b.sg AS bsg, b.pl AS bpl, b.n AS bn, b.charge AS bc, c.sg AS csg, c.pl AS cpl, c.n AS cn, a.o AS ao, b.db AS bdb, b.o AS bo, c.o AS co, c.charge AS cc,
    a.pl AS apl, a.t AS end1, b.t AS end2, c.t AS end3 FROM e a JOIN e b ON b.graph = a.graph AND b.i = a.i AND b.j <> a.j JOIN e c ON c.graph = a.graph AND c.i = a.i AND c.j NOT IN (a.j, b.j)
), chain AS (
  SELECT f.graph, f.atom AS a, w.j AS b, w.k AS c, f.beside_others FROM f JOIN two w ON w.graph = f.graph AND w.i = f.atom AND f.m AND w.m AND w.m2
), found AS (
  SELECT graph, 'Donor' AS family, [atom] AS s FROM f WHERE z IN (7, 16) AND n_h > 0 OR z = 8 AND n_h > 0 AND NOT acid OR z IN (8, 16) AND NOT aromatic AND n_h = 1 AND charge = 0
  UNION ALL SELECT graph, 'Acceptor', [atom] FROM f WHERE o AND n_h = 1 AND valence = 2 OR o AND n_h = 0 AND valence = 2 AND NOT nitroso OR o AND charge = -1 AND NOT nitro OR z = 8 AND aromatic AND charge = 0
    OR o AND NOT ester AND NOT between_rings OR z = 7 AND NOT (aromatic AND conn = 3) AND NOT (n AND conn = 4) AND NOT amide AND NOT aniline AND NOT amidine
  UNION ALL SELECT graph, 'Cation', [atom] FROM f WHERE charge > 0 AND NOT by_minus
  UNION ALL SELECT f.graph, 'Cation', [f.atom] FROM f WHERE n AND conn = 3 AND charge = 1 AND NOT amide AND (SELECT count(*) FROM e WHERE e.graph = f.graph AND e.i = f.atom AND e.pl AND e.z = 6 AND NOT e.aromatic AND e.conn = 4) >= 3
  UNION ALL SELECT f.graph, 'Cation', [f.atom, p, q, r] FROM f JOIN arms a ON a.graph = f.graph AND a.i = f.atom AND z = 6 AND NOT aromatic AND conn = 3 AND adb AND an AND (
    ac = 1 AND bsg AND bn AND cpl AND NOT cn OR bsg AND bn AND bc = 1 AND cpl AND NOT cn OR ac = 1 AND bpl AND bn AND csg AND cn OR f.charge = 1 AND bpl AND bn AND csg AND cn OR bpl AND bn AND bc = 1 AND csg AND cn)
  UNION ALL SELECT graph, 'Anion', [atom] FROM f WHERE charge < 0 AND NOT by_plus
  UNION ALL SELECT f.graph, 'Anion', [f.atom, p, q, r] FROM f JOIN arms a ON a.graph = f.graph AND a.i = f.atom AND z IN (15, 16) AND NOT aromatic AND conn = 4 AND adb AND ao AND bdb AND bo AND cpl AND co AND cc = -1
  UNION ALL SELECT f.graph, 'Anion', [f.atom, a.j, b.j] FROM f JOIN e a ON a.graph = f.graph AND a.i = f.atom AND a.db AND a.o JOIN e b ON b.graph = f.graph AND b.i = f.atom AND b.j <> a.j AND b.pl AND b.o AND b.charge = -1 WHERE f.z IN (6, 15, 16) AND NOT f.aromatic AND f.conn = 3
  UNION ALL SELECT w.graph, 'Anion', [w.i, w.j, w.k, v.j, v.k] FROM two w JOIN two v ON v.graph = w.graph AND v.i = w.k AND v.j NOT IN (w.i, w.j) AND v.k NOT IN (w.i, w.j, w.k) JOIN e u ON u.graph = w.graph AND u.i = v.k AND u.j = w.i AND u.pl
    JOIN y c ON c.graph = w.graph AND c.atom = w.i AND c.z = 6 AND c.aromatic JOIN y h ON h.graph = v.graph AND h.atom = v.j AND h.n_h = 1 AND h.z = 7 AND h.aromatic JOIN y l ON l.graph = v.graph AND l.atom = v.k AND l.z = 7 AND l.aromatic JOIN y k ON k.graph = w.graph AND k.atom = w.k AND k.z = 7 AND k.aromatic
    WHERE w.pl AND w.pl2 AND w.z = 7 AND w.aromatic AND v.pl AND v.pl2
  UNION ALL SELECT graph, 'Hydrophobe', [atom] FROM f WHERE t AND NOT hetero AND NOT near_end OR z = 16 AND NOT aromatic AND by_carbon AND NOT by_other OR z IN (35, 53) AND on_carbon
  UNION ALL SELECT f.graph, 'Hydrophobe', [f.atom, a.j, b.j] FROM f JOIN e a ON a.graph = f.graph AND a.i = f.atom AND a.pl AND a.t JOIN e b ON b.graph = f.graph AND b.i = f.atom AND b.j > a.j AND b.pl AND b.t WHERE n_ends = 2
  UNION ALL SELECT graph, 'Hydrophobe', [i, p, q, r] FROM arms WHERE apl AND bpl AND cpl AND end1 AND end2 AND end3
  UNION ALL SELECT f.graph, 'Hydrophobe', [f.atom, g.atom] FROM f JOIN ends b ON b.graph = f.graph AND b.i = f.atom JOIN f g ON g.graph = b.graph AND g.atom = b.j WHERE f.m AND NOT f.hetero AND g.t AND NOT g.hetero
  UNION ALL SELECT graph, 'Hydrophobe', [a, b, c] FROM chain WHERE beside_others
  UNION ALL SELECT c.graph, 'Hydrophobe', [c.a, c.b, c.c, d.c] FROM chain c JOIN chain d ON d.graph = c.graph AND d.a = c.b AND d.b = c.c AND d.c <> c.a WHERE EXISTS (FROM chain g JOIN f ON f.graph = g.graph AND f.atom = g.c AND f.beside_others WHERE g.graph = c.graph AND g.a = c.a)
  UNION ALL SELECT p.graph, 'Aromatic', p.p FROM path p JOIN ends b ON b.graph = p.graph AND b.i = p.p[-1] AND b.j = p.p[1] AND b.aromatic WHERE len(p.p) = p.size
), s AS (SELECT DISTINCT graph, family, list_sort(s) AS s FROM found)
SELECT graph, family, count(*) AS n FROM s GROUP BY 1, 2
""")
def q104_pharmacophores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many features of each family a molecule has, aromatic rings included."""
    atoms, bonds = molecules(spark, sf_dir)
    found = patterns.pharmacophores(topology.described(atoms, bonds, settled(topology.rings(bonds))), bonds)
    return found.groupBy("graph", "family").agg(F.count(F.lit(1)).alias("n"))


_M = circular.mixed_sql
#: DuckDB: circular features of radius 2 of the molecules, by the same arithmetic, and their sets of 2,048 bits.
CIRCULAR = f"""y0 AS (
  SELECT a.graph, a.atom, {_M("h * 31 + coalesce(d.n, 0) + 1000")} AS id, []::VARCHAR[] AS cover FROM (SELECT *, {_M("h0 * 31 + charge + 1000")} AS h FROM (SELECT graph, atom, charge, {_M("17::BIGINT * 31 + z + 1000")} AS h0 FROM atoms)) a
  LEFT JOIN (SELECT graph, i, count(*) AS n FROM ends GROUP BY 1, 2) d ON d.graph = a.graph AND d.i = a.atom
), t1 AS (
  SELECT b.graph, b.i AS atom, sum({_M("y.id * 8 + b.type")})::BIGINT AS s, flatten(list(y.cover)) AS covers, list(least(b.i, b.j) || '-' || greatest(b.i, b.j)) AS own FROM ends b JOIN y0 y ON y.graph = b.graph AND y.atom = b.j GROUP BY 1, 2
), y1 AS (
  SELECT y.graph, y.atom, {_M("id * 3 + u")} AS id, list_sort(list_distinct(list_concat(cover, covers, own))) AS cover FROM y0 y JOIN (SELECT *, {_M("s + 1")} AS u FROM t1) t USING (graph, atom)
), t2 AS (
  SELECT b.graph, b.i AS atom, sum({_M("y.id * 8 + b.type")})::BIGINT AS s, flatten(list(y.cover)) AS covers, list(least(b.i, b.j) || '-' || greatest(b.i, b.j)) AS own FROM ends b JOIN y1 y ON y.graph = b.graph AND y.atom = b.j GROUP BY 1, 2
), y2 AS (
  SELECT y.graph, y.atom, {_M("id * 3 + u")} AS id, list_sort(list_distinct(list_concat(cover, covers, own))) AS cover FROM y1 y JOIN (SELECT *, {_M("s + 2")} AS u FROM t2) t USING (graph, atom)
), w AS (
  SELECT graph, 1 AS radius, id, cover FROM y1 UNION ALL SELECT graph, 2, id, cover FROM y2
), prints AS (
  SELECT graph, id FROM y0 UNION ALL SELECT graph, min(struct_pack(radius, id)).id FROM w GROUP BY graph, cover
), bits AS (SELECT DISTINCT graph, id % 2048 AS bit FROM prints)"""


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph, bits): circular fingerprints by element, charge and degree."""
    atoms, bonds = molecules(spark, sf_dir)
    degree = bonds.select("graph", F.explode(F.array("i", "j")).alias("atom")).groupBy("graph", "atom").agg(F.count(F.lit(1)).alias("degree"))
    atoms = atoms.join(degree, ["graph", "atom"], "left").fillna(0, ["degree"])
    return circular.folded(circular.circular_features(atoms, bonds, [F.col("z"), F.col("charge"), F.col("degree")], 2), 2048)


@query(f"WITH {MOLS}, {CIRCULAR} SELECT graph, count(*) AS n_bits, sum(bit)::BIGINT AS total, sum(bit * bit)::BIGINT AS squares FROM bits GROUP BY 1")
def q105_circular_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circular fingerprints of radius 2, folded to 2,048 bits."""
    total = lambda f: F.aggregate(F.transform("bits", f), F.lit(0).cast("long"), lambda s, v: s + v)
    return _prints(spark, sf_dir).select("graph", F.size("bits").cast("long").alias("n_bits"), total(lambda b: b).alias("total"), total(lambda b: b * b).alias("squares"))


@query(f"""
WITH {MOLS}, {CIRCULAR}, n AS (SELECT graph, count(*) AS n FROM bits GROUP BY 1),
c AS (SELECT a.graph AS a, b.graph AS b, count(*) AS common FROM bits a JOIN bits b ON a.bit = b.bit AND a.graph < b.graph GROUP BY 1, 2)
SELECT a, b, common, round(common::DOUBLE / (x.n + y.n - common), 6) AS score FROM c JOIN n x ON x.graph = a JOIN n y ON y.graph = b WHERE common::DOUBLE / (x.n + y.n - common) >= 0.12
""")
def q106_circular_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules alike by their circular fingerprints, Tanimoto 0.12 or more. Molecules of equal prints would be one row."""
    reps, named = joins.array_sets(settled(_prints(spark, sf_dir).withColumnRenamed("bits", "tokens")), "graph")
    found = joins.common_bits(settled(reps), 0.12, 2048)
    return found.select("a", "b", "common", r(F.col("score")).alias("score"))


@query("""
WITH l AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS n FROM lineitem),
s AS (SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY n) AS s FROM l GROUP BY 1), k AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, least(s, reverse(s)) AS key FROM s JOIN orders ON o_orderkey = l_orderkey)
SELECT o_orderpriority, count(*) AS n, count(DISTINCT key) AS n_kinds, round(count(DISTINCT key)::DOUBLE / count(key), 6) AS uniqueness,
  round(count(*) FILTER (key NOT IN (SELECT key FROM k WHERE o_orderstatus = 'O'))::DOUBLE / count(*), 6) AS novelty FROM k GROUP BY 1
""")
def q107_canonical_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a chain of its lines, an atom's element the return flag: kinds of molecules by canonical key, and those that no open order has."""
    flags = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    chains = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("graph")).agg(flags.alias("a"))
    atoms = chains.select("graph", F.posexplode("a").alias("atom", "v")).select("graph", "atom", F.ascii("v.l_returnflag").alias("z"))
    bonds = chains.where(F.size("a") > 1).select("graph", F.explode(F.sequence(F.lit(1), F.size("a") - 1)).alias("j")).select("graph", (F.col("j") - 1).alias("i"), "j", F.lit(1).alias("type"))
    keys = settled(canonical.canonical_keys(settled(atoms), settled(bonds), [F.col("z")]))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph"), "o_orderstatus", "o_orderpriority")
    rows = orders.join(keys, "graph")
    known = rows.where("o_orderstatus = 'O'").select("key").distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, "key", "left")
    return metrics.evaluate(rows, {
        "n": F.count(F.lit(1)), "n_kinds": F.count_distinct("key"), "uniqueness": r(metrics.uniqueness(F.col("key"))), "novelty": r(metrics.novelty(F.col("known"), F.col("key"))),
    }, ["o_orderpriority"])


@query(f"""
WITH {PTS}, s AS (SELECT vec_id, atom, 10*x AS x, 10*y AS y, 10*z AS z FROM pts), d AS (
  SELECT d.vec_id, d.atom AS donor, d.x AS dx, d.y AS dy, d.z AS dz, h.x AS hx, h.y AS hy, h.z AS hz FROM s d JOIN s h ON d.vec_id = h.vec_id AND h.atom = d.atom + 1 WHERE d.atom % 3 = 0
), m AS (
  SELECT d.vec_id, donor, a.atom AS acceptor, sqrt((dx-a.x)**2 + (dy-a.y)**2 + (dz-a.z)**2) AS dist,
    degrees(acos(greatest(-1, least(1, ((dx-hx)*(a.x-hx) + (dy-hy)*(a.y-hy) + (dz-hz)*(a.z-hz)) /
      (sqrt((dx-hx)**2 + (dy-hy)**2 + (dz-hz)**2) * sqrt((a.x-hx)**2 + (a.y-hy)**2 + (a.z-hz)**2) + 1e-10))))) AS angle
  FROM d JOIN s a ON a.vec_id = d.vec_id AND a.atom % 3 = 2
)
SELECT vec_id, count(*) AS n, round(avg(dist), 5) AS mean_dist, sum(acceptor)::BIGINT AS acceptors FROM m WHERE dist <= 3.5 AND angle >= 100 AND least(abs(donor - acceptor), 21 - abs(donor - acceptor)) >= 4 GROUP BY 1
""")
def q108_hbonds_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hydrogen bonds inside conformers whose atoms are a ring of 21: donors and acceptors under four bonds apart are left out by the bonds."""
    rows = settled(conformers(spark, sf_dir).select("vec_id", geom.scale(F.col("xyz"), 10.0).alias("xyz")))
    atoms = rows.select("vec_id", F.posexplode("xyz").alias("atom", "p"))
    donors = atoms.where("atom % 3 = 0").select("vec_id", F.col("atom").alias("donor"), F.col("p").alias("d_point"))
    hydrogens = atoms.where("atom % 3 = 1").select("vec_id", (F.col("atom") - 1).alias("donor"), F.col("p").alias("h_point"))
    acceptors = atoms.where("atom % 3 = 2").select("vec_id", F.col("atom").alias("acceptor"), F.col("p").alias("a_point"))
    ring = F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i")
    bonds = rows.select(F.col("vec_id").alias("graph"), ring).select("graph", "i", ((F.col("i") + 1) % 21).alias("j"), F.lit(1).alias("type"))
    steps = topology.bond_distances(bonds, most=3, sources=donors.select(F.col("vec_id").alias("graph"), F.col("donor").alias("a")))
    met = interactions.hydrogen_bonds(donors.join(hydrogens, ["vec_id", "donor"]), acceptors, ["vec_id"], bonds=steps.withColumnRenamed("graph", "vec_id"), least_angle=100.0)
    return met.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dist"), 5).alias("mean_dist"), F.sum(F.col("acceptor").cast("long")).alias("acceptors"))


@query("""
WITH l AS (SELECT l_orderkey, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS n FROM lineitem),
a AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS run FROM l WHERE f = 'A'),
s AS (SELECT l_orderkey, run, count(*) AS size, min(n) AS low, max(n) AS high FROM a GROUP BY 1, 2),
x AS (SELECT s.l_orderkey, bool_or(size % 2 = 1 AND (size > 1 OR EXISTS (FROM l WHERE l.l_orderkey = s.l_orderkey AND f = 'R' AND n IN (low - 1, high + 1)))) AS bad FROM s GROUP BY 1)
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (coalesce(bad, false)) AS n_impossible FROM (SELECT DISTINCT l_orderkey FROM l) k JOIN orders ON o_orderkey = k.l_orderkey LEFT JOIN x USING (l_orderkey) GROUP BY 1
""")
def q115_kekule_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a chain of its lines: A aromatic carbons, R aromatic oxygens, N carbons. A stretch of carbons that can't pair up makes its molecule impossible."""
    flags = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    chains = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("graph")).agg(F.transform(flags, lambda v: v["l_returnflag"]).alias("a"))
    ends = F.when((F.col("atom") == 0) & (F.size("a") == 1), 2).when((F.col("atom") == 0) | (F.col("atom") == F.size("a") - 1), 1).otherwise(0)
    atoms = chains.select("graph", "a", F.posexplode("a").alias("atom", "f"))
    atoms = atoms.select("graph", "atom", F.when(F.col("f") == "R", 8).otherwise(6).alias("z"), F.lit(0).alias("charge"), F.when(F.col("f") == "R", ends).when(F.col("f") == "A", 1).otherwise(0).alias("n_h"))
    pairs = chains.where(F.size("a") > 1).select("graph", F.explode(F.transform(F.sequence(F.lit(1), F.size("a") - 1), lambda j: F.struct((j - 1).alias("i"), j.alias("j"), ((F.get("a", j) != "N") & (F.get("a", j - 1) != "N")).alias("aromatic")))).alias("b"))
    found = valence.checked_molecules(settled(atoms), pairs.select("graph", "b.i", "b.j", F.lit(1).alias("type"), "b.aromatic"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph"), "o_orderpriority")
    return found.join(orders, "graph").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("n_impossible"))


_RESIDUES = list(perception.SIDE_CHAINS)
_TEMPLATES = ", ".join(f"({k}, '{res}', {sum(r[0] == res and 'OXT' not in r[1:3] for r in perception.template_rows())})" for k, res in enumerate(_RESIDUES))


@query(f"""
WITH t AS (FROM (VALUES {_TEMPLATES}) t(k, res, n)),
r AS (SELECT s_nationkey AS chain, s_suppkey AS res_id, CASE WHEN s_suppkey % 7 = 6 THEN NULL ELSE s_suppkey % 20 END AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS turn FROM supplier),
c AS (SELECT chain, count(*) FILTER (res = 'CYS') AS n_cys, sum(n)::BIGINT AS n_template, count(*) FILTER (r.k IS NULL) AS n_ligands FROM r LEFT JOIN t USING (k) GROUP BY 1),
p AS (SELECT a.chain, count(*) AS n FROM r a JOIN r b ON a.chain = b.chain AND b.turn = a.turn + 1 AND a.k IS NOT NULL AND b.k IS NOT NULL GROUP BY 1)
SELECT chain, 'template' AS kind, n_template AS n FROM c WHERE n_template > 0 UNION ALL SELECT chain, 'peptide', n FROM p
UNION ALL SELECT chain, 'disulphide', n_cys // 2 FROM c WHERE n_cys > 1 UNION ALL SELECT chain, 'radius', 3 * n_ligands FROM c WHERE n_ligands > 0
""")
def q116_bond_perception(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier is a residue of its nation's chain, every seventh a ligand of four carbons: bonds by template, along chains, between cysteines and by radius."""
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    names = F.array(*map(F.lit, _RESIDUES))
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.when(F.col("s_suppkey") % 7 == 6, "LIG").otherwise(F.get(names, (F.col("s_suppkey") % 20).cast("int"))).alias("res_name"))
    cysteines = Window.partitionBy("s_nationkey", "res_name").orderBy("s_suppkey")
    rows = rows.withColumns({"turn": F.row_number().over(order), "twin": F.row_number().over(cysteines) - 1})
    parts = {res: list(dict.fromkeys(x for r in perception.template_rows() if r[0] == res for x in r[1:3] if x != "OXT")) for res in _RESIDUES} | {"LIG": ["C1", "C2", "C3", "C4"]}
    held = F.create_map(*(x for res, those in parts.items() for x in (F.lit(res), F.array(*map(F.lit, those)))))
    rows = rows.select("s_nationkey", "s_suppkey", "res_name", "turn", "twin", F.posexplode(F.element_at(held, F.col("res_name"))).alias("k", "name"))
    sulphur, ligand, main = (F.col("name") == "SG"), (F.col("res_name") == "LIG"), F.col("name").isin("N", "C")
    # N and C lie on the chain, 1.3 from the next residue's; sulphurs of two cysteines 2.03 apart; ligands' carbons 1.5.
    px = F.when(sulphur, 10.0 * F.floor(F.col("twin") / 2)).when(ligand, 1.5 * F.col("k")).when(F.col("name") == "C", 5.0 * F.col("turn") + 3.7).otherwise(5.0 * F.col("turn"))
    py = F.when(sulphur, 5000.0).when(ligand, 9000.0 + 10.0 * F.col("turn")).when(main, 0.0).otherwise(50.0 + 9.0 * F.col("k"))
    pz = F.when(sulphur, 2.03 * (F.col("twin") % 2)).otherwise(0.0)
    atoms = rows.select(
        F.col("s_nationkey").cast("long").alias("protein"), (F.col("s_suppkey") * 16 + F.col("k")).cast("int").alias("atom"), F.lit(6).alias("z"), "name", "res_name",
        F.lit("A").alias("chain"), F.col("s_suppkey").cast("int").alias("res_id"), px.alias("px"), py.alias("py"), pz.alias("pz"),
    )
    found = perception.perceived_bonds(settled(atoms))
    return found.groupBy(F.col("protein").alias("chain"), "kind").agg(F.count(F.lit(1)).alias("n"))


#: Of a tree of twenty-one atoms, atom k on atom (k - 1) // 2, the double bonds (the last one ends in a bare atom) and the atoms that aren't carbon.
_DOUBLES = ((0, 1), (2, 5), (4, 10))
_HETERO = {8: 8, 20: 7, 11: 8}


@query(f"""
WITH {PTS}, q AS (FROM (VALUES (0, 1, 2, 3), (2, 5, 0, 11)) q(i, j, si, sj)),
v AS (
  SELECT q.i, q.j, [b.x-p.x, b.y-p.y, b.z-p.z] AS a, [u.x-p.x, u.y-p.y, u.z-p.z] AS u, [w.x-b.x, w.y-b.y, w.z-b.z] AS w FROM q
  JOIN pts p ON p.atom = q.i JOIN pts b ON b.vec_id = p.vec_id AND b.atom = q.j JOIN pts u ON u.vec_id = p.vec_id AND u.atom = q.si JOIN pts w ON w.vec_id = p.vec_id AND w.atom = q.sj
)
SELECT i, j, CASE WHEN list_inner_product(a, a) * list_inner_product(u, w) > list_inner_product(a, u) * list_inner_product(a, w) THEN '2_F_Z' ELSE '2_F_E' END AS token, count(*) AS n FROM v GROUP BY ALL
""")
def q121_stereo_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conformer's atoms as a tree with three double bonds: bond tokens with E or Z by the branches that come first and the side they lie on."""
    rows = settled(conformers(spark, sf_dir).select(F.col("vec_id").alias("graph"), "xyz"))
    points = rows.select("graph", F.posexplode("xyz").alias("atom", "point"))
    z = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in _HETERO.items() for x in kv)), F.col("atom")), F.lit(6))
    atoms = points.select("graph", "atom", z.alias("z"), F.lit(0).alias("n_h"))
    link = points.where("atom > 0").select("graph", F.floor((F.col("atom") - 1) / 2).cast("int").alias("i"), F.col("atom").alias("j"))
    double = (F.col("i") * 100 + F.col("j")).isin(*(100 * i + j for i, j in _DOUBLES))
    bonds = settled(link.withColumns({"type": F.when(double, 2).otherwise(1), "aromatic": F.lit(False)}))
    named = stereo.stereo_bonds(bonds, stereo.double_bond_stereo(atoms, bonds, points)).where("stereo is not null")
    token = vocab.bond_token(F.col("type"), F.col("aromatic"), F.col("stereo"))
    return named.groupBy("i", "j", token.alias("token")).agg(F.count(F.lit(1)).alias("n"))
