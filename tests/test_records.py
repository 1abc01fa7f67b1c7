"""Filters, reports, cleaning, descriptors and annotation against small expectations."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators import annotation as A
from helixframe.operators import cleaning as C
from helixframe.operators import descriptors as D
from helixframe.operators import report as R
from helixframe.operators import selection as sel


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column.alias("x")).first()["x"]


def collection(spark, rows):
    """rows: (ord, name, sequence, seq_type, tags, gc)"""
    df = spark.createDataFrame(rows, "ord long, name string, sequence string, seq_type string, tags array<string>, gc double")
    return df.select("ord", F.col("ord").cast("string").alias("seq_id"), "name", "sequence", "seq_type", F.col("name").alias("description"), "tags", F.struct("gc", F.lit(True).alias("flag")).alias("meta"))


@pytest.fixture(scope="module")
def small(spark):
    return collection(spark, [(0, "Alpha", "ACGTGATTACA", "dna", ["bridged"], 42.3), (1, "beta", "ACGT", "dna", ["cluster_3", "cluster_representative"], 0.0), (2, "gamma", "MKVL", "protein", [], None)])


def test_guess_type(spark):
    got = {s: one(spark, s, S.guess_type(F.col("s"))) for s in ("ACGTN", "ACGU", "MKV", "", "--ACG.T", "U")}
    assert got == {"ACGTN": "dna", "ACGU": "rna", "MKV": "protein", "": "dna", "--ACG.T": "dna", "U": "rna"}


def names(df):
    return [r["name"] for r in df.orderBy("ord").collect()]


def test_filters(small):
    assert names(small.where(sel.by_name("ALP"))) == ["Alpha"]
    assert names(small.where(sel.by_name("^[a-z]", regex=True))) == ["beta", "gamma"]
    assert names(small.where(sel.by_tag_absent("bridged"))) == ["beta", "gamma"]
    assert names(small.where(sel.by_motif("gatta"))) == ["Alpha"]
    assert names(small.where(sel.by_length(4, 4))) == ["beta", "gamma"]
    assert names(small.where(sel.by_field_range(small, "gc", 0, 50))) == ["Alpha", "beta"]
    assert names(small.where(sel.by_field_equals(small, "gc", "42.3"))) == ["Alpha"]
    assert names(small.where(sel.by_field_equals(small, "gc", "None"))) == ["gamma"]
    assert names(small.where(sel.by_field_equals(small, "flag", "True"))) == ["Alpha", "beta", "gamma"]
    assert names(small.where(sel.by_field_equals(small, "absent.key", "None"))) == ["Alpha", "beta", "gamma"]
    assert names(small.where(sel.by_field_not_equals(small, "gc", "0.0"))) == ["Alpha", "gamma"]
    assert names(sel.Selection(seq_type="dna", exclude_ids=["0"]).apply(small)) == ["beta"]
    with pytest.raises(TypeError):
        sel.by_field_range(small, "flag", 0, 1)


def test_python_texts(spark):
    values = [50.0, 1e7, 123456.0, 1234567.0, 0.5, -0.25, 0.00001, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(S.py_g(F.col("v"))).collect()] == [f"{v:g}" for v in values]
    assert [r[0] for r in df.select(S.py_str(F.col("v"), "double")).collect()][:6] == [str(v) for v in values[:6]]


def test_report(small):
    axis = lambda spec: [r[0] for r in small.orderBy("ord").select(R.axis(small, spec)).collect()]
    assert axis("tag_prefix:cluster_") == ["(none)", "3,representative", "(none)"]
    assert axis("field:gc:bin10") == ["[40,50)", "[0,10)", "(none)"]
    assert axis("tag:bridged") == ["yes", "no", "no"]
    assert axis("field:gc") == ["42.3", "0.0", "(none)"]
    assert [tuple(r) for r in R.crosstab(small, ["type", "tag:bridged"]).collect()] == [("dna", "no", 1), ("dna", "yes", 1), ("protein", "no", 1)]
    for bad in ([], ["tag:"], ["field:gc:bin0"], ["field:gc:binx"], ["colour"]):
        with pytest.raises(ValueError):
            R.crosstab(small, bad)


def cleaned(spark, rows, **options):
    df = spark.createDataFrame(rows, "ord long, name string, sequence string, seq_type string, quality array<int>")
    return C.clean(df, C.Cleaning(**options)).orderBy("ord")


def test_trims(spark):
    row = lambda s, q=None: [(0, "r", s, "dna", q)]
    assert cleaned(spark, row("NNACGTNN"), trim_ambiguous=True).first()["sequence"] == "ACGT"
    assert cleaned(spark, row("NNNN"), trim_ambiguous=True).first()["fate"] == "dropped_empty"
    r = cleaned(spark, row("ACGTACGT", [5, 5, 40, 40, 40, 40, 5, 5]), min_quality=20, quality_window=1).first()
    assert (r["sequence"], r["quality"]) == ("GTAC", [40] * 4)
    r = cleaned(spark, row("A-CG.T", [1, 2, 3, 4, 5, 6]), strip_gaps=True).first()
    assert (r["sequence"], r["quality"]) == ("ACGT", [1, 3, 4, 6])
    assert [cleaned(spark, row("AATTTAA"), adapter="aa", adapter_end=e).first()["sequence"] for e in ("5", "3", "both")] == ["TTTAA", "AATTT", "TTT"]
    assert cleaned(spark, row("AAA"), adapter="aaa").first()["fate"] == "dropped_empty"


def test_quality_trim_is_that_of_a_loop(spark):
    quality = [3, 30, 9, 40, 40, 2, 40, 1, 35, 8, 7]
    for window in (1, 3, 4):
        start = next((i for i in range(len(quality)) if sum(q := quality[i : i + window]) / len(q) >= 20), len(quality))
        end = next((i + 1 for i in reversed(range(start, len(quality))) if sum(q := quality[max(0, i - window + 1) : i + 1]) / len(q) >= 20), start)
        got = cleaned(spark, [(0, "r", "ABCDEFGHIJK", "protein", quality)], min_quality=20, quality_window=window, drop_empty=False).first()
        assert got["sequence"] == "ABCDEFGHIJK"[start:end]


def test_pipeline_fates(spark):
    rows = [(0, "good", "ACGTACGT", "dna", None), (1, "dup", "ACGTACGT", "dna", None), (2, "ambiguous", "ACNNNNNG", "dna", None), (3, "short", "AC", "dna", None), (4, "needs_trim", "NNGGGGCCCC", "dna", None), (5, "good", "TTTTTTTT", "dna", None)]
    df = cleaned(spark, rows, dedup_sequence=True, dedup_name=True, trim_ambiguous=True, max_ambiguous_fraction=0.3, min_length=5)
    assert [r["fate"] for r in df.collect()] == ["kept", "dropped_duplicate_sequence", "dropped_ambiguous", "dropped_length", "kept", "dropped_duplicate_name"]
    assert C.report(df).first().asDict()["trimmed_ambiguous_ends"] == 1


def test_nucleotide(spark):
    d = one(spark, "ATGATG", D.nucleotide(F.col("s")))
    assert [tuple(u) for u in d["codon_usage"]] == [("ATG", 1.0)] and d["gc3_percent"] == 100.0 and d["gc_percent"] == 33.333
    assert one(spark, "ATGA", D.nucleotide(F.col("s")))["codon_usage"] is None
    n = one(spark, "ANNG", D.nucleotide(F.col("s")))
    assert (n["gc_percent"], n["at_percent"], n["n_content"]) == (25.0, 75.0, 0.5)
    assert one(spark, "", D.nucleotide(F.col("s")))["gc_percent"] == 0.0


def test_protein(spark):
    assert one(spark, "G", D.molecular_weight(F.col("s"))) == 75.07
    assert one(spark, "AWX", D.gravy(F.col("s"))) is None
    assert one(spark, "AW", D.gravy(F.col("s"))) == 0.45
    assert abs(one(spark, "KKKK", D.isoelectric_point(F.col("s"))) - 10.6) < 0.3
    assert one(spark, "AAG", D.instability_index(F.col("s"), {"AA": 2.0}, 1.0)) == 10.0


def test_orfs(spark):
    s = "ATG" + "GGC" * 40 + "TAA"
    hit = one(spark, s, A.orfs(F.col("s"), 30, False))[0]
    assert (hit["start"], hit["end"], hit["protein"]) == (0, 126, "M" + "G" * 40)
    assert one(spark, s[:-3], A.orfs(F.col("s"), 30, False)) == []


def test_introns_promoters_and_motifs(spark):
    assert one(spark, "CCCCGT" + "C" * 20 + "AGCC", A.introns(F.col("s")))[0]["start"] == 4
    assert [tuple(h) for h in one(spark, "CCTATAAATCCTATATA", A.tata_boxes(F.col("s")))] == [(2, -15, "TATAAAT"), (11, -6, "TATATA")]
    assert [(m["pattern_id"], m["start"], m["end"]) for m in one(spark, "AANATSAA", A.motifs(F.col("s"), ["PS00001"]))] == [("PS00001", 2, 6)]
    assert [m["start"] for m in one(spark, "NATSNNTSA", A.motifs(F.col("s"), ["PS00001"]))] == [0, 4, 5]
    assert one(spark, "MAGAAAAGKSM", A.motifs(F.col("s"), ["WALKER_A"]))[0]["start"] == 2
    with pytest.raises(ValueError):
        A.motifs(F.col("s"), ["NONE"])


def test_motifs_are_those_of_a_search(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("CCHHLGKSTAPRDE") for _ in range(rng.randrange(400))) for _ in range(30)]
    texts += ["", "C", "CLLCLLLLDDDDDDDDHLLLHLH", "CLLCCLLLCDDDDDDDDHHLHHHCLLLLCLLLWDDDDDDDDHLLLLLH", "GLA\nSTG", "é" + "NATSA" * 50]
    found = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, s string").select("i", A.motifs(F.col("s")).alias("m")).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        if r["i"] == len(texts):
            assert r["m"] is None
            continue
        want = [(m.start(), n, i, m[1]) for n, (i, (_, p)) in enumerate(A.MOTIFS.items()) for m in re.finditer(f"(?=({p}))", texts[r["i"]].upper().replace("É", "?"))]
        assert [tuple(h) for h in r["m"]] == [(s, i, s + len(t), t) for s, _, i, t in sorted(want)]


def test_matches_do_not_overlap(spark):
    for text in ("", "TATA", "TATAAATATATAAATATAAA", "xTATATAATATAAAATATAAATy"):
        assert [tuple(h) for h in one(spark, text, A.matches(F.col("s"), A.TATA))] == [(m.start(), m[0]) for m in re.finditer(A.TATA, text)]


def test_protein_windows(spark):
    tm = one(spark, "D" * 20 + "L" * 22 + "D" * 20, A.tm_regions(F.col("s")))
    assert len(tm) == 1 and 20 <= tm[0]["start"] <= tm[0]["end"] <= 42
    low = one(spark, "ACDEFGHIKLMNPQRSTVWY" + "Q" * 20, A.low_complexity(F.col("s")))
    assert low[-1]["end"] == 40
    assert one(spark, "MKK" + "L" * 12 + "SASAQ" + "D" * 20, A.signal_peptide(F.col("s")))["is_signal_peptide"] is True
    assert one(spark, "DDDD", A.coiled_coils(F.col("s"))) == []
    assert one(spark, "", A.hydropathy(F.col("s"))) == []


def test_annotate_adds_tags(spark, small):
    df = A.annotate(small.where("seq_type = 'dna'"), motifs=A.motifs(F.col("sequence"), ["PS00007"]), orfs=A.orfs(F.col("sequence"), 1))
    assert names(df) == ["Alpha", "beta"]
    assert "bridged" in df.where("name = 'Alpha'").first()["tags"]


def test_describe_by_type(spark):
    rows = [(0, "a", "ACGT", "dna"), (1, "b", "MKWV", "protein"), (2, "c", "ACGU", "rna"), (3, "d", "", "protein")]
    df = spark.createDataFrame(rows, "ord long, name string, sequence string, seq_type string").withColumn("meta", F.struct(F.lit("x").alias("lang")))
    got = {r["name"]: r["meta"]["descriptor"] for r in D.describe(df).collect()}
    assert got["a"]["gc_percent"] == 50.0 and got["a"]["molecular_weight"] is None and got["c"]["length"] == 4
    assert got["b"]["gc_percent"] is None and got["b"]["aromaticity"] == 0.25 and got["b"]["length"] == 4 and got["d"] is None
    only = {r["name"]: r["meta"]["descriptor"] for r in D.describe(df, "protein").collect()}
    assert only["a"] is None and only["b"] == got["b"]


def test_status_flat_lists_and_uneven_qualities(spark):
    df = spark.createDataFrame([(0, "i", "n", "AC", "dna", "d", ["b", "a"]), (1, "j", "m", "MK", "protein", "d", ["b"])], "ord long, seq_id string, name string, sequence string, seq_type string, description string, tags array<string>")
    df = df.withColumn("meta", F.struct(F.array(F.lit("g"), F.lit("h")).alias("genes"), F.lit(1).alias("n")))
    assert [tuple(r) for r in R.status(df).collect()] == [("total", None, 2), ("type", "dna", 1), ("type", "protein", 1), ("tag", "b", 2), ("tag", "a", 1)]
    assert {r["meta_genes"] for r in R.flat_rows(df).collect()} == {"g;h"}
    with pytest.raises(Exception, match="different number"):
        C.clean(df.withColumn("quality", F.array(F.lit(1))), C.Cleaning()).collect()
