"""Fixed vocabularies of molecular data and Column functions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tokens of charged atoms between the pad and mask tokens; a token's id is its place.
PAD, MASK, LIGAND = "PAD", "MASK", "LIG"
ATOM_TOKENS = (
    PAD,
    "Br_1", "S_1", "S_0", "F_-1", "O_0", "I_0", "Bi_2", "N_1", "F_0", "O_-1", "C_1", "C_-1", "Bi_0", "P_0", "H_0",
    "Cl_1", "Cl_0", "Br_0", "Cl_-1", "S_2", "I_1", "B_-1", "N_0", "N_-1", "Si_0", "P_-1", "B_0", "N_-2", "H_1", "I_2",
    "P_1", "O_1", "C_0", "Si_1", "S_-1", "S_3",
    MASK,
)

# Bond tokens order_aromatic[_stereo]; a token's id is its place.
BOND_TOKENS = ("0_F", "1_F", "2_F", "3_F", "1_T", "2_T", "3_T", "2_F_E", "2_F_Z", "-1_F")

# Charges, the first standing for none.
CHARGES = (-100, 0, 1, 2, 3, -1, -2, -3)

# Residue names.
RESIDUES = (
    "ILE", "LEU", "ALA", "GLU", "VAL", "PHE", "CYS", "GLN", "THR", "SER", "TYR", "MET", "LYS", "HIS", "GLY", "PRO",
    "ARG", "ASP", "ASN", "CME", "TRP", "LLP", "OAS", "SGB", "CSD", "SEP", "OCY", "TIS", "SCY", "OCS", "QPA", "KPI",
    "PHD", "MEN", "SUN", "TPO", "CSO", "YCM", "UNK", "ALY", "SVX", "PTR", "KCX", "HOX", "PCA", "00C", "DM0", "XCN",
    "SXE", "HYP", "CSX", "CSS", "ORN", "MLY", "2CO", "NEP", "YOF", "SNN",
)

# Interaction types and the groups that related ones may be merged into.
INTERACTIONS = (
    "Hydrophobic", "VdWContact", "MetalAcceptor", "MetalDonor", "Cationic", "Anionic", "XBAcceptor", "XBDonor",
    "CationPi", "PiCation", "PiStacking", "HBAcceptor", "HBDonor",
)
INTERACTION_GROUPS = {
    "metal": {"MetalAcceptor": "metal-interaction", "MetalDonor": "metal-interaction"},
    "ionic": {"Cationic": "ionic-interaction", "Anionic": "ionic-interaction"},
    "halogen": {"XBAcceptor": "halogen-bond", "XBDonor": "halogen-bond"},
    "pi": {"CationPi": "pi-cation", "PiCation": "pi-cation"},
    "hbond": {"HBAcceptor": "hydrogen-bond", "HBDonor": "hydrogen-bond"},
}

# The pharmacophore family that an interaction type calls for.
INTERACTION_FEATURES = {
    "HBDonor": "Donor", "HBAcceptor": "Acceptor", "Cationic": "Cation", "Anionic": "Anion", "Hydrophobic": "Hydrophobe",
    "PiStacking": "Aromatic", "PiCation": "Aromatic", "CationPi": "Cation",
}
FEATURE_FAMILIES = ("Aromatic", "Donor", "Acceptor", "Cation", "Anion", "Hydrophobe")

# Mean and standard deviation by which two ensemble properties are standardised.
STANDARDS = {"mean-pairwise-rmsd": (2.3, 0.5), "psa3d": (105.0, 50.0)}


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def encode(token: Column, vocabulary: tuple[str, ...]) -> Column:
    """A token's id; an unknown token is an error, null stays null."""
    found = F.try_element_at(_literal_map({t: i for i, t in enumerate(vocabulary)}), token)
    return F.when(token.isNull(), F.lit(None)).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("unknown token: "), token))))


def decode(index: Column, vocabulary: tuple[str, ...]) -> Column:
    """An id's token; an id out of range is an error."""
    return F.element_at(F.array(*map(F.lit, vocabulary)), index + 1)


def contains(token: Column, vocabulary: tuple[str, ...]) -> Column:
    return token.isin(*vocabulary)


def charged_symbol(symbol: Column, charge: Column) -> Column:
    return F.concat_ws("_", symbol, charge.cast("string"))


def bond_token(order: Column, aromatic: Column, stereo: Column) -> Column:
    """The token of a bond; stereo is E, Z (either case) or null, anything else is an error."""
    known = F.when(stereo.isNull(), F.lit(None).cast("string")).when(F.upper(stereo).isin("E", "Z"), F.upper(stereo)).otherwise(F.raise_error(F.lit("stereo must be E, Z or null")))
    return F.concat_ws("_", order.cast("string"), F.when(aromatic, "T").otherwise("F"), known)


def bond_vocabulary(spark: SparkSession) -> DataFrame:
    """(bond_id, token, bond_order, aromatic, stereo): the dimension table of bonds."""
    rows = [(i, t, int(t.split("_")[0]), t.split("_")[1] == "T", (t.split("_") + [None])[2]) for i, t in enumerate(BOND_TOKENS)]
    return spark.createDataFrame(rows, "bond_id int, token string, bond_order int, aromatic boolean, stereo string")


def group_interaction(kind: Column, *groups: str) -> Column:
    """The type after merging by the named groups; other types stay."""
    merged = {k: v for g in groups for k, v in INTERACTION_GROUPS[g].items()}
    return F.coalesce(F.try_element_at(_literal_map(merged), kind), kind) if merged else kind
