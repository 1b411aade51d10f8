"""Text formats: SDF (V2000) and PDB in and out, JSON manifests."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.session import shipped

SDF_SCHEMA = (
    "path string, ord int, name string, symbols array<string>, charges array<int>, xyz array<struct<x:double,y:double,z:double>>, "
    "bonds array<struct<i:int,j:int,type:int>>, meta map<string,string>, error string"
)
# Charges by their code in an atom line.
SDF_CHARGES = {1: 3, 2: 2, 3: 1, 5: -1, 6: -2, 7: -3}

PDB_SCHEMA = "path string, chains string, atoms array<struct<serial:int,name:string,res_name:string,chain:string,res_id:int,element:string,x:double,y:double,z:double>>, bonds array<struct<i:int,j:int,type:int>>"


def parse_sdf(block: str) -> dict:
    """One record of an SDF file: name, symbols, charges, xyz, bonds, meta; error says why where it can't be read."""
    lines = block.split("\n")
    out = {"name": lines[0].strip() if lines else "", "symbols": [], "charges": [], "xyz": [], "bonds": [], "meta": {}, "error": None}
    try:
        counts = lines[3]
        n, m = int(counts[0:3]), int(counts[3:6])
        for line in lines[4 : 4 + n]:
            out["xyz"].append({"x": float(line[0:10]), "y": float(line[10:20]), "z": float(line[20:30])})
            out["symbols"].append(line[31:34].strip())
            out["charges"].append(SDF_CHARGES.get(int(line[36:39] or 0), 0))
        for line in lines[4 + n : 4 + n + m]:
            i, j = int(line[0:3]) - 1, int(line[3:6]) - 1
            out["bonds"].append({"i": min(i, j), "j": max(i, j), "type": int(line[6:9])})
        if len(out["xyz"]) != n or len(out["bonds"]) != m:
            raise ValueError("fewer lines than counted")
        key = None
        for line in lines[4 + n + m :]:
            if line.startswith("M  CHG"):
                found = list(map(int, line[9:].split()))
                out["charges"] = [0] * n if not any(c for c in out["charges"]) else out["charges"]
                for at, charge in zip(found[::2], found[1::2], strict=True):
                    out["charges"][at - 1] = charge
            elif line.startswith(">"):
                key = line[line.index("<") + 1 : line.rindex(">")] if "<" in line else None
            elif key and line.strip():
                out["meta"][key] = f"{out['meta'][key]}\n{line}" if key in out["meta"] else line
            elif not line.strip():
                key = None
    except (ValueError, IndexError) as e:
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def _sdf_records(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, int, str, str | None]]:
    """(path, block, turn, text, fault) of the records in a task's pieces (path, block, value), turn counted in each block of a file.

    A piece ends where its file has $$$$. That ends a record only at the end of a line: a piece that ends inside one
    goes on with the next. Where the next is another block's, and so another task's, both parts are kept with a fault.
    """
    key, turn, held = None, 0, None
    for frame in frames:
        for path, block, value in zip(frame["path"], frame["block"], frame["value"], strict=True):
            if (path, block) != key:
                if held is not None:
                    yield (*key, turn, held, None)
                key, turn, held = (path, block), 0, None
                first = block == 0
            else:
                first = False
            piece, fault = value.replace("\r\n", "\n"), None
            if held is not None:
                piece, held = f"{held}$$$${piece}", None
            elif not first and piece.startswith("\n"):
                piece = piece[1:]
            elif not first and piece.strip():
                fault = "begins inside a line with $$$$"
            if not piece.strip():
                continue
            if piece.endswith("\n"):
                yield path, block, turn, piece, fault
                turn += 1
            else:
                held = piece
    if held is not None:
        yield (*key, turn, held, None)


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the SDF files at path; broken records have error set.

    Records end at a line $$$$, whatever the ends of lines, and Spark's reader splits files between them. ord is a
    record's place in its file, from 0: records are counted in each block of a file first, so a file that many tasks read
    is numbered as by one.
    """
    rows = spark.read.option("lineSep", "$$$$").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = Counter((path, block) for path, block, *_ in _sdf_records(frames))
        yield pd.DataFrame([(*key, k) for key, k in n.items()], columns=["path", "block", "n"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records = _sdf_records(frames)
        while some := list(islice(records, 1000)):
            yield pd.DataFrame([{"block": b, "turn": t} | parse_sdf(text) | ({"error": fault} if fault else {}) | {"path": p} for p, b, t, text, fault in some])

    shipped(spark)
    blocks = rows.mapInPandas(counts, "path string, block long, n long")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    found = rows.mapInPandas(run, SDF_SCHEMA.replace("ord int", "block long, turn int"))
    found = found.join(starts, ["path", "block"]).withColumn("ord", (F.col("_start") + F.col("turn")).cast("int"))
    return found.select("path", "ord", "name", "symbols", "charges", "xyz", "bonds", "meta", "error")


def single_reference(rows: DataFrame) -> DataFrame:
    """rows of read_sdf(); anything but exactly one sound record with a 3D conformer is an error when it is read."""
    counted = rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    flat = F.forall("xyz", lambda p: p["z"] == 0)
    fault = F.when(F.col("_n") != 1, "expected exactly one molecule").when(F.col("error").isNotNull(), F.col("error")).when(flat, "no 3D conformer")
    return counted.withColumn("ord", F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("ord"))).drop("_n")


def sdf_text(name: Column, symbols: Column, xyz: Column, bonds: Column, meta: Column | None = None) -> Column:
    """A record as SDF text; Column functions only."""
    place = lambda p: F.format_string("%10.4f%10.4f%10.4f ", p["x"], p["y"], p["z"])
    atoms = F.transform(F.arrays_zip(symbols.alias("s"), xyz.alias("p")), lambda a: F.concat(place(a["p"]), F.rpad(a["s"], 3, " "), F.lit(" 0  0  0  0  0  0  0  0  0  0  0  0")))
    lines = F.transform(bonds, lambda b: F.format_string("%3d%3d%3d  0", b["i"] + 1, b["j"] + 1, b["type"]))
    counts = F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000", F.size(symbols), F.size(bonds))
    extra = F.array().cast("array<string>")
    if meta is not None:
        extra = F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(F.lit(">  <"), e["key"], F.lit(">\n"), e["value"], F.lit("\n")))
    return F.array_join(F.concat(F.array(name, F.lit("  corvane"), F.lit(""), counts), atoms, lines, F.array(F.lit("M  END")), extra, F.array(F.lit("$$$$"))), "\n")


def write_sdf(rows: DataFrame, path: str, index: str, name: Column, symbols: str, xyz: str, bonds: str) -> None:
    """SDF files of rows that have a molecule; rows without one are left out, and index stays as a tag sample_index."""
    there = rows.where(F.col(symbols).isNotNull())
    meta = F.create_map(F.lit("sample_index"), F.col(index).cast("string"))
    there.select(sdf_text(name, F.col(symbols), F.col(xyz), F.col(bonds), meta).alias("value")).write.mode("errorifexists").text(path)


def parse_pdb(text: str) -> dict:
    """Chains, atoms of the first model, and the bonds that CONECT records name: places of atoms, i < j, each pair once.

    A pair that a record repeats is a bond of that order, as some writers mark double bonds. Partners that are no atom of
    the first model are left out. Of an atom's alternate locations the one of greatest occupancy stays, the first of equals.
    """
    atoms, ties = [], []
    places: dict[tuple, int] = {}
    occupancies: list[float] = []
    ended = False
    for line in text.split("\n"):
        if line.startswith("CONECT"):
            serials = [int(line[at : at + 5]) for at in range(6, len(line.rstrip()), 5) if line[at : at + 5].strip()]
            ties.append((serials[0], serials[1:]))
        if ended:
            continue
        if line.startswith(("ATOM  ", "HETATM")):
            atom = {
                "serial": int(line[6:11]), "name": line[12:16].strip(), "res_name": line[17:20].strip(), "chain": line[21].strip(),
                "res_id": int(line[22:26]), "element": line[76:78].strip(), "x": float(line[30:38]), "y": float(line[38:46]), "z": float(line[46:54]),
            }
            occupancy = float(line[54:60].strip() or 1)
            # Atoms with a location letter are one where all else that names them is equal.
            key = (line[21:27], line[17:20], line[12:16]) if line[16].strip() else (len(atoms),)
            if key not in places:
                places[key] = len(atoms)
                atoms.append(atom)
                occupancies.append(occupancy)
            elif occupancy > occupancies[places[key]]:
                atoms[places[key]], occupancies[places[key]] = atom, occupancy
        elif line.startswith("ENDMDL"):
            ended = True  # the first model only; CONECT records follow the last one
    place = {a["serial"]: i for i, a in enumerate(atoms)}
    orders: dict[tuple[int, int], int] = {}
    for a, others in ties:
        for b in set(others):
            if a in place and b in place and a != b:
                pair = (min(place[a], place[b]), max(place[a], place[b]))
                orders[pair] = max(orders.get(pair, 0), others.count(b))
    bonds = [{"i": i, "j": j, "type": n} for (i, j), n in sorted(orders.items())]
    return {"chains": "_".join(sorted({a["chain"] for a in atoms})), "atoms": atoms, "bonds": bonds}


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """A row for each PDB file: atoms of its first model, its chains sorted and joined by _, and the bonds of its CONECT records."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([{"path": p} | parse_pdb(t) for p, t in zip(frame["path"], frame["value"], strict=True)])

    shipped(spark)
    return rows.mapInPandas(run, PDB_SCHEMA)


def pdb_text(atoms: Column) -> Column:
    """PDB text of an array of atoms as read_pdb() gives them."""
    line = lambda a: F.concat(
        F.format_string("ATOM  %5d ", a["serial"]),
        F.rpad(F.when(F.length(a["name"]) < 4, F.concat(F.lit(" "), a["name"])).otherwise(a["name"]), 4, " "),
        F.format_string(" %3s %1s%4d    %8.3f%8.3f%8.3f  1.00  0.00          %2s", a["res_name"], a["chain"], a["res_id"], a["x"], a["y"], a["z"], a["element"]),
    )
    return F.array_join(F.concat(F.transform(atoms, line), F.array(F.lit("END"))), "\n")


def split_manifest(rows: DataFrame, key: str, config: dict) -> DataFrame:
    """(manifest): one JSON text with config, counts by split and the molecules in order of key.

    A manifest lists every row, so it is one value as long as the table's keys; write the rows with write.json where it
    need not be one file.
    """
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("counts"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("index"), "split"))).alias("molecules"))
    settings = F.create_map(*(F.lit(str(x)) for kv in config.items() for x in kv))
    return counts.crossJoin(listed).select(F.to_json(F.struct(settings.alias("config"), "counts", "molecules")).alias("manifest"))


def write_manifest(rows: DataFrame, key: str, config: dict, path: str) -> None:
    """The manifest in parts: path/summary, one JSON text with config and counts by split, and path/molecules, a JSON line a row.

    Rows stay in their partitions, so a manifest of any length is written by as many tasks. An existing path is an error.
    """
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("counts"))
    settings = F.create_map(*(F.lit(str(x)) for kv in config.items() for x in kv)) if config else F.expr("map()").cast("map<string,string>")
    rows.select(F.col(key).alias("index"), "split").write.mode("errorifexists").json(f"{path}/molecules")
    summary = counts.select(F.to_json(F.struct(settings.alias("config"), "counts")).alias("value"))
    summary.coalesce(1).write.mode("errorifexists").text(f"{path}/summary")


def read_manifest(spark: SparkSession, path: str, key: str = "bigint") -> tuple[DataFrame, DataFrame]:
    """(config, counts) and the rows (index, split) of a written manifest; key is the type of its index. Counts that the rows don't bear out are an error."""
    rows = spark.read.schema(f"index {key}, split string").json(f"{path}/molecules")
    kind = "config map<string,string>, counts map<string,bigint>"
    summary = spark.read.text(f"{path}/summary").select(F.from_json("value", kind).alias("m")).select("m.*")
    found = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct("split", "n"))).alias("_found"))
    told = F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.struct(e["key"].alias("split"), e["value"].alias("n"))))
    both = summary.crossJoin(F.broadcast(found))  # one row each
    whole = F.when(told == F.col("_found"), F.col("counts")).otherwise(F.raise_error(F.lit("the manifest's rows differ from its counts")))
    return both.select("config", whole.alias("counts")), rows


def to_interchange(rows: DataFrame) -> DataFrame:
    """(json): each row as JSON text, the interchange form of a molecule, protein or complex."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def from_interchange(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")
