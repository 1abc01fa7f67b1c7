"""Principal components of wide vectors, superposition in bulk, mmCIF output, profiles by type."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import annotation, embedding, profiles, structure


def frame(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "ord int, vector array<double>")


@pytest.mark.parametrize("block", [6, 64])
def test_components_are_those_of_a_decomposition(spark, monkeypatch, block):
    monkeypatch.setattr(embedding, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((90, 40)) * np.linspace(3, 0.5, 40) + 7
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    v = np.array([row if row[np.abs(row).argmax()] > 0 else -row for row in v])
    got = np.array([[r["dim1"], r["dim2"], r["dim3"]] for r in embedding.principal_components(frame(spark, x), 3).orderBy("ord").collect()])
    assert np.allclose(got, (x - x.mean(0)) @ v[:3].T, atol=1e-6)


def test_components_of_odd_vectors(spark):
    same = embedding.principal_components(frame(spark, np.ones((4, 3)))).collect()
    assert all(abs(r["dim1"]) < 1e-9 and abs(r["dim2"]) < 1e-9 for r in same)
    line = embedding.principal_components(frame(spark, np.arange(5.0)[:, None] * np.array([[3.0, 4.0]]))).orderBy("ord").collect()
    assert np.allclose([r["dim1"] for r in line], [-10, -5, 0, 5, 10]) and np.allclose([r["dim2"] for r in line], 0)
    for rows in ([], [(1, [1.0]), (2, [1.0, 2.0])]):
        with pytest.raises(ValueError):
            embedding.principal_components(spark.createDataFrame(rows, "ord int, vector array<double>"))


def test_space_of_signatures(spark):
    rows = [(i, f"s{i}", f"n{i}", s, "dna", []) for i, s in enumerate(["ACGTACGTACGTACGT", "ACGTACGTACGTACGA", "TTTTGGGGCCCCAAAATT"])]
    df = spark.createDataFrame(rows, "ord int, seq_id string, name string, sequence string, seq_type string, tags array<string>")
    got = embedding.sequence_space(df, method="minhash", num_hashes=16).orderBy("ord").collect()
    assert [r["label"] for r in got] == ["dna"] * 3 and abs(sum(r["dim1"] for r in got)) < 1e-3 * max(abs(r["dim1"]) for r in got)
    with pytest.raises(ValueError):
        embedding.sequence_space(df, method="other")


def atoms(spark, name, letters, points, chain="A"):
    three = {v: k for k, v in structure.RESIDUES.items()}
    rows = [(name, 0, "ATOM", i + 1, "CA", three[c], chain, i + 1, "", *map(float, p), 10.0 + i, "C", i) for i, (c, p) in enumerate(zip(letters, points, strict=True))]
    return spark.createDataFrame(rows, "structure string, model int, record string, serial int, atom string, resname string, chain string, resseq int, icode string, x double, y double, z double, bfactor double, element string, ord long")


def test_superpositions_are_those_of_single_pairs(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((8, 3)) * 10
    turn, _ = np.linalg.qr(rng.standard_normal((3, 3)))
    sets = {"a": ("AGSLVKWM", a), "b": ("AGSLVKWM", a @ turn + 5), "c": ("AGSLVKW", a[:7] + rng.standard_normal((7, 3))), "d": ("AG", a[:2])}
    frames = {n: atoms(spark, n, *v) for n, v in sets.items()}
    whole = frames["a"].unionByName(frames["b"]).unionByName(frames["c"]).unionByName(frames["d"])
    pairs = spark.createDataFrame([("ab", "a", "A", "b", "A"), ("ac", "a", "A", "c", "A"), ("aa", "a", "A", "a", "A"), ("ad", "a", "A", "d", "A"), ("no", "a", "A", "x", "Z")], "pair string, structure_a string, chain_a string, structure_b string, chain_b string")
    got = {r["pair"]: (r["n_atoms"], r["rmsd"]) for r in structure.superimpose_all(whole, pairs).collect()}
    for pair in ("ab", "ac", "aa"):
        one = structure.superimpose(frames[pair[0]], frames[pair[1]]).first()
        assert got[pair][0] == one["n_atoms"] and abs(got[pair][1] - one["rmsd"]) < 1e-6
    assert got["ad"] == (2, None) and got["no"] == (0, None)


def test_cif_round_trip(spark):
    own = atoms(spark, "a", "AGS", [[1, 2, 3], [4.5, -5, 6], [7, 8, 9.125]]).drop("structure")
    own = own.withColumn("atom", F.when(F.col("serial") == 2, "O5'").otherwise(F.col("atom"))).withColumn("record", F.when(F.col("serial") == 3, "HETATM").otherwise(F.col("record")))
    text = "\n".join(r["value"] for r in structure.cif_lines(own).collect()) + "\n"
    back = structure.parse_cif(spark.createDataFrame([(text,)], "value string"))
    assert [tuple(r) for r in back.orderBy("ord").collect()] == [tuple(r) for r in own.select(back.columns).orderBy("ord").collect()]


def test_profile_of_the_type(spark):
    rows = [(0, "MK-", "protein"), (1, "MKL", "protein")]
    df = spark.createDataFrame(rows, "ord int, sequence string, seq_type string")
    got = profiles.build_profile(df).orderBy("position").collect()
    assert [r["consensus"] for r in got] == ["M", "K", "-"] and {f"pssm_{a}" for a in profiles.ALPHABETS["protein"]} <= set(got[0].asDict())
    assert abs(got[0]["prob_M"] - 2.5 / 12) < 1e-9
    for ragged in (df.limit(1).unionByName(spark.createDataFrame([(2, "M", "protein")], df.schema)), df.limit(0)):
        for call in (profiles.pfm, profiles.build_profile, profiles.logo_data, profiles.conservation_summary):
            with pytest.raises(ValueError):
                call(ragged)


def test_interpro_tag(spark):
    df = spark.createDataFrame([(["x"], ["IPR1"]), (["y"], [])], "tags array<string>, entries array<string>")
    assert [r["tags"] for r in annotation.annotate(df, interpro=F.col("entries")).collect()] == [["interpro_annotated", "x"], ["y"]]
