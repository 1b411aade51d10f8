"""Pharmacophore features, profiles, conditions and symmetry reports.

Rows of features: mol, feat (order within the molecule), family, atom_ids; of atoms: mol, atom, z, point (struct<x,y,z>);
of bonds: mol, i, j. Feature ids depend on the toolkit, so families are joined by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import geom, ragged, vocab
from corvane.functions.flow import hash_normal, hash_uniform
from corvane.operators.joins import best_overlap
from corvane.session import settled


def positions(features: DataFrame, atoms: DataFrame) -> DataFrame:
    """features with position: the centroid of their atoms."""
    members = features.select("mol", "feat", F.explode("atom_ids").alias("atom")).join(atoms.select("mol", "atom", "point"), ["mol", "atom"])
    mean = F.struct(*(F.avg(f"point.{a}").alias(a) for a in geom.AXES))
    return features.join(members.groupBy("mol", "feat").agg(mean.alias("position")), ["mol", "feat"])


def directed(features: DataFrame, atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """features with direction; a donor becomes a row for each hydrogen on its first atom, numbered by copy.

    Donor: from the heavy atom to the hydrogen. Aromatic with three atoms or more: the normal of its first three.
    Otherwise, and where the length is nil, the zero vector. Donors without hydrogens stay as they are.
    """
    at = atoms.select("mol", "atom", "z", "point")
    ends = bonds.select("mol", F.col("i").alias("heavy"), F.col("j").alias("atom")).unionByName(bonds.select("mol", F.col("j").alias("heavy"), F.col("i").alias("atom")))
    hydrogens = ends.join(at.where("z = 1"), ["mol", "atom"]).select("mol", "heavy", F.col("atom").alias("h"), F.col("point").alias("h_point"))
    zero = geom.point(F.lit(0), F.lit(0), F.lit(0))

    donors = features.where("family = 'Donor'").withColumn("heavy", F.get("atom_ids", F.lit(0))).join(hydrogens, ["mol", "heavy"], "left")
    donors = donors.join(at.select("mol", F.col("atom").alias("heavy"), F.col("point").alias("p_point")), ["mol", "heavy"], "left")
    toward = F.when(F.col("h_point").isNull() | F.col("p_point").isNull(), zero).otherwise(geom.unit(geom.minus(F.col("h_point"), F.col("p_point"))))
    copy = F.row_number().over(Window.partitionBy("mol", "feat").orderBy("h")) - 1
    donors = donors.select(*features.columns, copy.alias("copy"), toward.alias("direction"))

    rest = features.where("family <> 'Donor'").withColumn("copy", F.lit(0))
    for k in range(3):
        side = at.select("mol", F.col("atom").alias(f"_a{k}"), F.col("point").alias(f"_p{k}"))
        rest = rest.withColumn(f"_a{k}", F.get("atom_ids", F.lit(k))).join(side, ["mol", f"_a{k}"], "left")
    normal = geom.unit(geom.cross(geom.minus(F.col("_p1"), F.col("_p0")), geom.minus(F.col("_p2"), F.col("_p0"))))
    ring = (F.col("family") == "Aromatic") & F.col("_p2").isNotNull()
    rest = rest.select(*features.columns, "copy", F.when(ring, normal).otherwise(zero).alias("direction"))
    return donors.unionByName(rest)


def profile(atoms: DataFrame, features: DataFrame) -> DataFrame:
    """(mol, ord, type, position, direction): shape points (type 1, heavy atoms) before features (type family + 2).

    features: mol, feat, copy, family, position, direction. Type 0 is left to padding.
    """
    zero = geom.point(F.lit(0), F.lit(0), F.lit(0))
    shape = atoms.where("z <> 1").select("mol", F.struct(F.lit(0).alias("a"), F.col("atom").cast("int").alias("b"), F.lit(0).alias("c")).alias("_o"), F.lit(1).alias("type"), F.col("point").alias("position"), zero.alias("direction"))
    kind = vocab.encode(F.col("family"), vocab.FEATURE_FAMILIES) + 2
    pharm = features.select("mol", F.struct(F.lit(1).alias("a"), F.col("feat").cast("int").alias("b"), F.col("copy").cast("int").alias("c")).alias("_o"), kind.alias("type"), "position", "direction")
    order = Window.partitionBy("mol").orderBy("_o")
    return shape.unionByName(pharm).withColumn("ord", (F.row_number().over(order) - 1)).select("mol", "ord", "type", "position", "direction")


def binding_profile(interactions: DataFrame, features: DataFrame, atoms: DataFrame) -> DataFrame:
    """(mol, feat, copy): features that some interaction calls for, each once.

    interactions: mol, ord, type, l_atoms. Hydrogens among the ligand atoms don't count; the type asks for a family
    (types without one are left out), and of that family the feature that shares most atoms is taken, the first of equal
    ones. Of a donor's copies the first stands for all.
    """
    family = F.try_element_at(F.create_map(*(F.lit(x) for kv in vocab.INTERACTION_FEATURES.items() for x in kv)), F.col("type"))
    asked = interactions.select("mol", "ord", family.alias("family"), F.explode("l_atoms").alias("atom")).where("family is not null")
    asked = asked.join(atoms.where("z <> 1").select("mol", "atom"), ["mol", "atom"], "left_semi")
    key = F.struct("mol", "family")
    left = asked.select(F.struct("mol", "ord").alias("ask"), key.alias("kind"), F.col("atom").alias("member"))
    right = features.where("copy = 0").select("feat", key.alias("kind"), F.explode("atom_ids").alias("member"))
    best = best_overlap(left, right, "ask", "feat", "kind")
    return best.select(F.col("kind.mol").alias("mol"), "feat", F.lit(0).alias("copy")).distinct()


def typed(found: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Features of the families of a vocabulary, with type: the family's place in it plus 2 (1 is a shape point).

    The vocabulary is an argument, so that it can be another one in each call; families that it lacks go.
    """
    if len(set(vocabulary)) < len(vocabulary):
        raise ValueError("a family is given twice")
    place = F.array_position(F.array(*map(F.lit, vocabulary)), F.col("family"))
    return found.where(F.col("family").isin(*vocabulary)).withColumn("type", (place + 1).cast("int"))


def rotation(*key: Column, seed: int) -> list[list[Column]]:
    """A uniformly random rotation of each row: the matrix of a normalised quaternion of four normal draws."""
    w, x, y, z = (hash_normal(*key, seed=f"{seed}:{a}") for a in "wxyz")
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = w / n, x / n, y / n, z / n
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def molecule_transform(rows: DataFrame, key: str, seed: int = 0, rotate: bool = False, shift_std: float = 0.0, dropout: float = 0.0, features: list[str] | None = None) -> DataFrame:
    """The composite transform of molecules: key, numbers (atomic), confs (array of point arrays), groups (array of atom
    id arrays), any scalar features.

    One conformer is drawn; group_points are the centroids of the groups' atoms, hydrogens included; all points may be
    turned together; hydrogens go; what is left is centred on its centroid and may be shifted by normal noise. A feature
    is kept where its own draw is at least dropout, else 0, with <name>-mask. Draws are by key, so that results don't
    depend on partitions.
    """
    at = F.floor(hash_uniform(F.col(key), F.lit("conformer"), seed=seed) * F.size("confs")).cast("int")
    rows = rows.withColumn("xyz", F.get("confs", at))
    middle = lambda ids: geom.centroid(F.transform(ids, lambda a: F.element_at("xyz", a + 1)))
    rows = rows.withColumn("group_points", F.transform("groups", middle))
    if rotate:
        turned = rotation(F.col(key), seed=seed)
        # The matrix is worked out once a row, not once a point.
        rows = rows.withColumn("_m", F.array(*(F.array(*line) for line in turned)))
        cells = [[F.get(F.get("_m", F.lit(i)), F.lit(j)) for j in range(3)] for i in range(3)]
        rows = rows.withColumns({c: geom.rotate(F.col(c), cells) for c in ("xyz", "group_points")}).drop("_m")
    rows = rows.withColumn("_heavy", ragged.heavy_places(F.col("numbers")))
    rows = rows.withColumns({c: ragged.take(F.col(c), F.col("_heavy")) for c in ("xyz", "numbers")})
    rows = rows.withColumn("_c", geom.centroid(F.col("xyz"))).drop("_heavy")
    rows = rows.withColumns({c: geom.shift(F.col(c), F.col("_c"), -1) for c in ("xyz", "group_points")}).drop("_c")
    if shift_std:
        off = geom.point(*(shift_std * hash_normal(F.col(key), F.lit(a), seed=f"{seed}:shift") for a in "xyz"))
        rows = rows.withColumn("_by", off).withColumns({c: geom.shift(F.col(c), F.col("_by")) for c in ("xyz", "group_points")}).drop("_by")
    for name in features or []:
        there = F.col(name).isNotNull() & (hash_uniform(F.col(key), F.lit(name), seed=seed) >= dropout)
        rows = rows.withColumns({f"{name}-mask": there.cast("int"), name: F.when(there, F.col(name)).otherwise(0.0)})
    return rows.drop("confs", "groups")


def apart(points: Column, least: float = 0.1) -> Column:
    """Row: are all coordinates finite and no two points nearer than least?"""
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    finite = F.forall(points, lambda p: good(p["x"]) & good(p["y"]) & good(p["z"]))
    near = F.exists(F.transform(points, lambda p, i: F.exists(F.slice(points, i + 2, F.size(points)), lambda q: geom.distance(p, q) < least)), lambda hit: hit)
    return finite & ~near


def best_alignment(rows: DataFrame, by: list[str], order: str, weight: float = 0.5) -> DataFrame:
    """The row of each group with the largest weight x shape + (1 - weight) x colour, the first by order of equal ones."""
    score = weight * F.col("shape") + (1 - weight) * F.col("colour")
    turn = Window.partitionBy(*by).orderBy(score.desc_nulls_last(), order)
    return rows.withColumns({"score": score, "_n": F.row_number().over(turn)}).where("_n = 1").drop("_n")


def symmetry_report(rows: DataFrame) -> DataFrame:
    """(snapshot, rmsd_direct, rmsd_rotated, atom_tv): errors at the first, middle and last snapshot.

    rows: system, rotation, snapshot, rmsd_direct, rmsd_rotated, atom_tv. Means over rotations, then over systems;
    rotation 0 is the identity and enters no mean.
    """
    values = ["rmsd_direct", "rmsd_rotated", "atom_tv"]
    per_system = rows.where("rotation <> 0").groupBy("system", "snapshot").agg(*(F.avg(v).alias(v) for v in values))
    out = per_system.groupBy("snapshot").agg(*(F.avg(v).alias(v) for v in values))
    ranked = out.withColumns({"_i": F.row_number().over(Window.orderBy("snapshot")) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    return ranked.where("_i = 0 or _i = floor(_n / 2) or _i = _n - 1").drop("_i", "_n")


def condition_flags(rows: DataFrame, key: str, share: float, sources: list[str], seed: int = 0) -> DataFrame:
    """rows with keep_<source> for each source: its own draw below share, and one draw that all share."""
    below = lambda name: hash_uniform(F.col(key), F.lit(name), seed=seed) < share
    return rows.withColumns({f"keep_{s}": below("all") & below(s) for s in sources})


def target(value: Column, draw: Column, spread: float, mean: float, std: float) -> tuple[Column, Column]:
    """(feature, mask) of a property target: value plus spread x draw, floored at 0, standardised; 0.0 and 0 where absent."""
    drawn = F.greatest(F.lit(0.0), value + spread * draw)
    return F.when(value.isNotNull(), (drawn - mean) / std).otherwise(0.0), value.isNotNull().cast("int")


def with_features(rows: DataFrame, named: list[tuple[str, Column, float | None]], key: str | None = None, mask_prob: float | None = None, seed: int = 0) -> DataFrame:
    """rows with a column for each (name, value, sentinel): null values become the sentinel, or stay an error.

    A name given twice is an error. A null sentinel means that a missing value is an error when it is read. With a mask
    probability p, <name>-mask is 1 where a draw by key exceeds p (p = 0: always, p = 1: never), else 0.
    """
    names = [name for name, *_ in named]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"feature names given twice: {', '.join(twice)}")
    if mask_prob is not None and not 0 <= mask_prob <= 1:
        raise ValueError("the mask probability must be in [0, 1]")
    out = {name: F.coalesce(value, F.raise_error(F.lit(f"feature {name} has no value")) if sentinel is None else F.lit(sentinel)) for name, value, sentinel in named}
    if mask_prob is not None:
        # 1 - u is in (0, 1], so that 0 keeps every row and 1 none.
        out |= {f"{name}-mask": (1 - hash_uniform(F.col(key), F.lit(name), seed=seed) > mask_prob).cast("int") for name in names}
    return rows.withColumns(out)


def persisted(rows: DataFrame, named: list[tuple[str, Column, float | None]], conformers: int | None = None, group: str = "mol", order: str = "conf") -> DataFrame:
    """with_features() worked out once, as a table that later reads take from the shared folder instead of computing again.

    conformers: features are worked out for the first so many conformers of each group by order; the rest goes, as a
    preload of an ensemble asks. A value that is missing without a sentinel is an error here and not when the table is read.
    """
    if conformers is not None:
        turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
        rows = rows.withColumn("_turn", turn).where(F.col("_turn") <= conformers).drop("_turn")
    return settled(with_features(rows, named))
