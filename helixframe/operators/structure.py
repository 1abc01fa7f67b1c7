"""Structures as atom tables: chains, sequences, superposition and scores as B-factors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators.alignment import align, pairwise

#: One-letter codes of the standard residues.
RESIDUES = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}


def parse_pdb(lines: DataFrame) -> DataFrame:
    """The atom table of numbered PDB lines (`n`, `value`): columns are cut at their fixed places."""
    cut = lambda a, b: F.trim(F.substring("value", a, b - a + 1))
    number = lambda a, b, kind: cut(a, b).try_cast(kind)
    model = lines.where(F.startswith("value", F.lit("MODEL"))).agg(F.array_sort(F.collect_list("n")).alias("models"))
    atoms = lines.where(F.rlike("value", F.lit("^(ATOM  |HETATM)")))
    return atoms.join(F.broadcast(model)).select(
        F.greatest(F.size(F.filter("models", lambda m: m < F.col("n"))) - 1, F.lit(0)).alias("model"), cut(1, 6).alias("record"), number(7, 11, "int").alias("serial"), cut(13, 16).alias("atom"), cut(18, 20).alias("resname"),
        F.substring("value", 22, 1).alias("chain"), number(23, 26, "int").alias("resseq"), cut(27, 27).alias("icode"), number(31, 38, "double").alias("x"), number(39, 46, "double").alias("y"), number(47, 54, "double").alias("z"), number(61, 66, "double").alias("bfactor"), cut(77, 78).alias("element"), F.col("n").alias("ord"),
    )


def parse_cif(chunks: DataFrame) -> DataFrame:
    """The atom table of mmCIF text (`value`, one row a file or data block): the rows of its atom loop, by the loop's own column names."""
    loop = F.regexp_extract("value", r"(?s)((?:_atom_site\.\S+\s*\n)+(?:(?:ATOM|HETATM)[^\n]*\n?)+)", 1)
    names = F.regexp_extract_all("loop", F.lit(r"_atom_site\.(\S+)"), F.lit(1))
    rows = chunks.select(loop.alias("loop")).select(names.alias("names"), F.posexplode(F.regexp_extract_all("loop", F.lit(r"(?m)^((?:ATOM|HETATM).*)$"), F.lit(1))).alias("ord", "line"))
    cells = F.transform(F.regexp_extract_all("line", F.lit(r"('[^']*'|\"[^\"]*\"|\S+)"), F.lit(1)), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))
    made = rows.select("ord", F.map_from_arrays("names", F.slice(cells, 1, F.size("names"))).alias("c"))
    text = lambda *keys: F.coalesce(*[F.when(~F.try_element_at("c", F.lit(k)).isin("?", "."), F.try_element_at("c", F.lit(k))) for k in keys])
    return made.select(
        (F.coalesce(text("pdbx_PDB_model_num").try_cast("int"), F.lit(1)) - 1).alias("model"), text("group_PDB").alias("record"), text("id").try_cast("int").alias("serial"), text("auth_atom_id", "label_atom_id").alias("atom"), text("auth_comp_id", "label_comp_id").alias("resname"),
        text("auth_asym_id", "label_asym_id").alias("chain"), text("auth_seq_id", "label_seq_id").try_cast("int").alias("resseq"), F.coalesce(text("pdbx_PDB_ins_code"), F.lit("")).alias("icode"), text("Cartn_x").try_cast("double").alias("x"), text("Cartn_y").try_cast("double").alias("y"), text("Cartn_z").try_cast("double").alias("z"),
        text("B_iso_or_equiv").try_cast("double").alias("bfactor"), text("type_symbol").alias("element"), F.col("ord").cast("long").alias("ord"),
    )


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    """The atoms of a .pdb, .ent, .cif or .mmcif file; another suffix is an error."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("cif", "mmcif"):
        return parse_cif(spark.read.option("wholetext", True).text(path))
    if suffix not in ("pdb", "ent"):
        raise ValueError(f"cannot tell the format of {path!r}; use .pdb, .ent, .cif or .mmcif")
    return parse_pdb(spark.read.text(path).withColumn("n", F.monotonically_increasing_id()))


def chain_residues(atoms: DataFrame, model: int = 0) -> DataFrame:
    """Standard residues that have a CA atom, in order, with its place."""
    own = atoms.where((F.col("model") == model) & (F.col("record") == "ATOM") & (F.col("atom") == "CA"))
    return own.select("chain", "resseq", "icode", "resname", S.lookup(RESIDUES, F.col("resname"), "X").alias("letter"), "x", "y", "z", "ord")


def structure_sequences(atoms: DataFrame, model: int = 0) -> DataFrame:
    """`chain`, `sequence` of every chain."""
    letters = F.array_sort(F.collect_list(F.struct("ord", "letter")))
    return chain_residues(atoms, model).groupBy("chain").agg(F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("sequence"))


def superpose(a: np.ndarray, b: np.ndarray) -> float:
    """The least root mean square distance of two sets of points, turned but not mirrored (Kabsch 1976)."""
    p, q = a - a.mean(0), b - b.mean(0)
    u, s, v = np.linalg.svd(p.T @ q)
    s[-1] *= np.sign(np.linalg.det(u) * np.linalg.det(v)) or 1.0
    return float(np.sqrt(max(0.0, (p**2).sum() + (q**2).sum() - 2 * s.sum()) / len(p)))


def superimpose(first: DataFrame, second: DataFrame, chain_a: str = "A", chain_b: str = "A") -> DataFrame:
    """One row, `rmsd` and `n_atoms`, of two chains over the CA atoms that their sequences align without gaps.

    A chain is one molecule, so its atoms fit in a task.
    """
    sides = [chain_residues(df).where(F.col("chain") == c).withColumn("side", F.lit(i)) for i, (df, c) in enumerate(((first, chain_a), (second, chain_b)))]
    for df, name in zip(sides, (chain_a, chain_b), strict=True):
        if not df.limit(1).count():
            raise ValueError(f"chain {name!r} has no residues")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["side"] == i].sort_values("ord") for i in (0, 1))
        _, top, low = align("".join(a["letter"]), "".join(b["letter"]), protein=True)
        i = np.cumsum([c != "-" for c in top]) - 1
        j = np.cumsum([c != "-" for c in low]) - 1
        both = [k for k in range(len(top)) if top[k] != "-" and low[k] != "-"]
        if len(both) < 3:
            raise ValueError("superposition needs three or more aligned residues")
        points = lambda df, at: df[["x", "y", "z"]].to_numpy()[at[both]]
        return pd.DataFrame({"rmsd": [superpose(points(a, i), points(b, j))], "n_atoms": [len(both)]})

    return sides[0].unionByName(sides[1]).groupBy(F.lit(0).alias("all")).applyInPandas(fit, "rmsd double, n_atoms int")


def superimpose_all(atoms: DataFrame, pairs: DataFrame, model: int = 0) -> DataFrame:
    """`pair`, `n_atoms`, `rmsd` of many pairs of chains at once, over the CA atoms that their sequences align without gaps.

    `atoms` are atom tables with a `structure` column; `pairs` has pair (unique), structure_a, chain_a, structure_b and
    chain_b. Pairs are aligned in batches; centres and moments are two aggregates, and a batch of pairs takes one stacked
    SVD. A pair one of whose chains is not there has no atoms; fewer than three aligned residues give a null rmsd.
    """
    order = Window.partitionBy("structure", "chain").orderBy("ord")  # a chain is one molecule
    own = atoms.where((F.col("model") == model) & (F.col("record") == "ATOM") & (F.col("atom") == "CA"))
    placed = own.select("structure", "chain", F.row_number().over(order).alias("at"), S.lookup(RESIDUES, F.col("resname"), "X").alias("letter"), "x", "y", "z")
    letters = F.array_sort(F.collect_list(F.struct("at", "letter")))
    chains = placed.groupBy("structure", "chain").agg(F.array_join(F.transform(letters, lambda c: c["letter"]), "").alias("sequence"))
    side = lambda e: chains.select(F.col("structure").alias(f"structure_{e}"), F.col("chain").alias(f"chain_{e}"), F.col("sequence").alias(e))
    known = pairs.join(side("a"), ["structure_a", "chain_a"]).join(side("b"), ["structure_b", "chain_b"])
    aligned = pairwise(known.select("pair", "a", "b"), protein=True)
    letters_of = lambda e: aligned.select("pair", F.posexplode(S.symbols(F.col(f"aligned_{e}"))).alias("column", "letter")).where("letter <> '-'").select("pair", "column", F.row_number().over(Window.partitionBy("pair").orderBy("column")).alias("at"))
    points = lambda e: letters_of(e).join(pairs.select("pair", F.col(f"structure_{e}").alias("structure"), F.col(f"chain_{e}").alias("chain")), "pair").join(placed, ["structure", "chain", "at"]).select("pair", "column", *[F.col(c).alias(f"{c}{e}") for c in "xyz"])
    both = points("a").join(points("b"), ["pair", "column"])
    axes = [f"{c}{e}" for e in "ab" for c in "xyz"]
    centres = both.groupBy("pair").agg(*[F.avg(c).alias(f"m{c}") for c in axes])
    centred = both.join(centres, "pair").select("pair", *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in axes])
    products = F.array(*[F.sum(F.col(f"{p}a") * F.col(f"{q}b")) for p in "xyz" for q in "xyz"])
    moments = centred.groupBy("pair").agg(F.count("*").cast("int").alias("n_atoms"), F.sum(sum((F.col(c) * F.col(c) for c in axes[1:]), F.col(axes[0]) * F.col(axes[0]))).alias("spread"), products.alias("products"))

    @F.pandas_udf("double")
    def rmsd(n: pd.Series, spread: pd.Series, products: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype=float)
        m = np.stack(products.to_numpy()).reshape(-1, 3, 3)
        u, s, v = np.linalg.svd(m)
        s[:, -1] *= np.where(np.linalg.det(u) * np.linalg.det(v) < 0, -1.0, 1.0)
        return pd.Series(np.sqrt(np.maximum(0.0, spread.to_numpy() - 2 * s.sum(1)) / n.to_numpy()))

    fitted = moments.select("pair", "n_atoms", F.when(F.col("n_atoms") > 2, rmsd("n_atoms", "spread", "products")).alias("rmsd"))
    return pairs.select("pair").join(fitted, "pair", "left").select("pair", F.coalesce("n_atoms", F.lit(0)).alias("n_atoms"), "rmsd")


def scores_to_bfactors(atoms: DataFrame, scores: DataFrame, chain: str, model: int = 0) -> DataFrame:
    """The atom table with `scores(position, score)`, positions from 1, as B-factors of a chain's residues; their numbers must agree."""
    placed = chain_residues(atoms, model).where(F.col("chain") == chain).withColumn("position", F.row_number().over(Window.partitionBy("chain").orderBy("ord")))
    if placed.count() != scores.count():
        raise ValueError("there must be one score for every residue of the chain")
    keys = ["chain", "resseq", "icode"]
    joined = atoms.join(placed.join(scores, "position").select(*keys, "score"), keys, "left")
    return joined.withColumn("bfactor", F.when(F.col("model") == model, F.coalesce("score", "bfactor")).otherwise(F.col("bfactor"))).select(*atoms.columns)


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """`value`: PDB lines of an atom table, in its order."""
    text = F.format_string("%-6s%5d %-4s %3s %s%4d%1s   %8.3f%8.3f%8.3f  1.00%6.2f          %2s", "record", "serial", F.when(F.char_length("atom") < 4, F.concat(F.lit(" "), "atom")).otherwise(F.col("atom")), "resname", "chain", "resseq", "icode", "x", "y", "z", "bfactor", "element")
    return atoms.orderBy("ord").select(text.alias("value"))


#: The columns of an atom loop, and what of the atom table each holds.
CIF_COLUMNS = {"group_PDB": "record", "id": "serial", "type_symbol": "element", "label_atom_id": "atom", "label_comp_id": "resname", "label_asym_id": "chain", "label_seq_id": "resseq", "pdbx_PDB_ins_code": "icode", "Cartn_x": "x", "Cartn_y": "y", "Cartn_z": "z", "B_iso_or_equiv": "bfactor", "pdbx_PDB_model_num": "model"}


def cif_lines(atoms: DataFrame, name: str = "structure") -> DataFrame:
    """`value`: the mmCIF lines of an atom table, in its order; empty and null cells are `?`, cells with quotes or spaces are quoted."""

    def cell(column: str):
        if column == "model":
            return (F.col(column) + 1).cast("string")
        if column in "xyz" or column == "bfactor":
            return F.when(F.col(column).isNull(), "?").otherwise(F.format_string("%.2f" if column == "bfactor" else "%.3f", column))
        text = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("?"))
        return F.when(text.contains("'"), F.concat(F.lit('"'), text, F.lit('"'))).when(text.contains('"') | text.contains(" "), F.concat(F.lit("'"), text, F.lit("'"))).otherwise(text)

    head = [f"data_{name}", "loop_", *[f"_atom_site.{c}" for c in CIF_COLUMNS]]
    spark = atoms.sparkSession
    top = spark.range(len(head)).select(F.lit(0).alias("part"), F.col("id").alias("ord"), F.get(F.array(*[F.lit(h) for h in head]), F.col("id").cast("int")).alias("value"))
    rows = atoms.select(F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), F.concat_ws(" ", *[cell(c) for c in CIF_COLUMNS.values()]).alias("value"))
    return top.unionByName(rows).orderBy("part", "ord").select("value")
