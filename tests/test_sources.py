"""Readers, writers, parsers, joins by name and the stream, on small files."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from helixframe.operators import clustering, selection
from helixframe.sources import files
from helixframe.streaming.sequences import counts_by_type, read_fasta_stream


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.fasta").write_text(">s1 first one\nACGT\nACGT\n>s2\nMKVLAA\n")
    (tmp_path / "b.fq").write_text("@r1 x\nACGT\n+\n!!II\n@r2\nGG\n+\nI!\n")
    with gzip.open(tmp_path / "c.fa.gz", "wt") as f:
        f.write(">z\nACGU\n")
    (tmp_path / "d.gb").write_text("LOCUS       LOC1  8 bp\nDEFINITION  A short\n            sequence.\nVERSION     LOC1.2\nFEATURES\nORIGIN\n        1 acgt acgt\n//\nLOCUS       LOC2  4 bp\nDEFINITION  B.\nORIGIN\n        1 gggg\n//\n")
    (tmp_path / "e.embl").write_text("ID   X1; SV 3; linear;\nDE   A thing\nDE   of two lines\nSQ   Sequence 6 BP;\n     acgtac        6\n//\n")
    return tmp_path


def test_read(spark, folder):
    df = files.read_collection(spark, [f"{folder}/{n}" for n in ("a.fasta", "b.fq", "c.fa.gz", "d.gb", "e.embl")]).orderBy("ord").collect()
    assert [(r["name"], r["sequence"], r["seq_type"]) for r in df] == [("s1", "ACGTACGT", "dna"), ("s2", "MKVLAA", "protein"), ("z", "ACGU", "rna"), ("r1", "ACGT", "dna"), ("r2", "GG", "dna"), ("LOC1.2", "ACGTACGT", "dna"), ("LOC2", "GGGG", "dna"), ("X1.3", "ACGTAC", "dna")]
    assert df[0]["description"] == "s1 first one" and df[3]["quality"] == [0, 0, 40, 40] and df[5]["description"] == "A short sequence." and df[7]["description"] == "A thing of two lines"
    assert len({r["seq_id"] for r in df}) == 8 and df[0]["meta"]["source_file"].endswith("a.fasta")
    with pytest.raises(ValueError):
        files.guess_format("x.txt")


def test_folders_and_many_splits(spark, folder, tmp_path):
    (folder / "notes.txt").write_text("no sequences")
    (folder / ".hidden.fasta").write_text(">h\nA\n")
    inner = folder / "inner"
    inner.mkdir()
    (inner / "x.fa").write_text(">x\nAC\n")
    assert files.read_collection(spark, [str(folder)]).count() == 8 and files.read_collection(spark, [str(folder)], recursive=True).count() == 9
    with pytest.raises(ValueError):
        files.read_collection(spark, [f"{folder}/notes.txt"])
    big = tmp_path / "big"
    big.mkdir()
    names = [f"r{i}" for i in range(3000)]
    (big / "a.fasta").write_text("".join(f">{n}\nACGT{'ACGT' * (i % 9)}\n" for i, n in enumerate(names)))
    (big / "b.fastq").write_text("".join(f"@{n}\nAC\n+\nII\n" for n in names))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for path, read in (("a.fasta", files.read_fasta), ("b.fastq", files.read_fastq)):
            df = read(spark, [f"{big}/{path}"])
            assert [(r["ord"], r["name"]) for r in df.orderBy("ord").collect()] == list(enumerate(names))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_uniprot(spark, tmp_path):
    (tmp_path / "u.json").write_text('{"primaryAccession": "P1", "proteinDescription": {"recommendedName": {"fullName": {"value": "Thing"}}}, "organism": {"scientificName": "X y"}, "genes": [{"geneName": {"value": "g1"}}], "sequence": {"value": "MKV", "length": 3}, "features": [{"type": "Domain", "description": "d"}], "uniProtKBCrossReferences": [{"database": "Pfam", "id": "PF1"}, {"database": "PDB", "id": "1X"}]}')
    assert files.read_uniprot(spark, f"{tmp_path}/u.json").first()[:] == ("P1", "Thing", "X y", ["g1"], 3, ["Domain"], ["PF1"])


def test_append_rejects_known_ids(spark, folder):
    df = files.read_fasta(spark, [f"{folder}/a.fasta"])
    with pytest.raises(Exception, match="id given twice"):
        files.append(df, df).collect()


def test_write_and_read_again(spark, folder, tmp_path):
    df = files.read_fasta(spark, [f"{folder}/a.fasta"])
    files.write(df, f"{tmp_path}/out", "fasta")
    again = files.read_fasta(spark, [f"{tmp_path}/out"]).orderBy("ord").collect()
    assert [(r["name"], r["description"], r["sequence"]) for r in again] == [("s1", "s1 first one", "ACGTACGT"), ("s2", "s2", "MKVLAA")]
    for fmt in ("csv", "tsv", "json", "parquet"):
        files.write(df, f"{tmp_path}/{fmt}", fmt)
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    with pytest.raises(ValueError):
        files.write(df, f"{tmp_path}/x", "xml")


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "n long, value string")


def test_reports_of_other_tools(spark, tmp_path):
    assert [tuple(r) for r in files.parse_blast(lines(spark, "hit1\t200\t92.50")).collect()] == [("hit1", 0.925)]
    assert [tuple(r) for r in files.parse_hits(lines(spark, "t\t50")).collect()] == [("t", 0.5)]
    row = "Pkinase PF00069.20 260 q1 - 300 1e-50 170.1 0.0 1 1 2e-53 3e-50 169.8 0.0 1 260 10 128 10 128 0.98 kinase"
    hit = files.parse_domtblout(lines(spark, "# comment", row)).collect()
    assert [(h["query"], h["accession"], h["start"], h["end"]) for h in hit] == [("q1", "PF00069.20", 10, 128)]
    (tmp_path / "r.clstr").write_text(">Cluster 0\n0\t10aa, >a... *\n1\t9aa, >b... at 90%\n>Cluster 1\n0\t5aa, >c... at 1%\n1\t5aa, >d... at 1%\n")
    clusters = clustering.read_clstr(spark, f"{tmp_path}/r.clstr")
    assert sorted(tuple(r) for r in clusters.collect()) == [(0, "a", True), (0, "b", False), (1, "c", True), (1, "d", False)]
    known = spark.createDataFrame([(0, "i0", "a"), (1, "i1", "a"), (2, "i2", "c")], "ord long, seq_id string, name string")
    assert {(r["name"], r["seq_id"]) for r in clustering.members_by_name(clusters, known).collect()} == {("a", "i1"), ("c", "i2")}
    assert files.parse_mmseqs_clusters(lines(spark, "r\tm")).first()["name"] == "m"


def test_hits_and_names(spark):
    known = spark.createDataFrame([(0, "i0", "x", ["t"]), (1, "i1", "x", ["u"]), (2, "i2", "y", ["v"])], "ord long, seq_id string, name string, tags array<string>")
    hits = spark.createDataFrame([("x", 1.0), ("none", 0.5)], "hit_id string, score double")
    first = {r["hit_id"]: r["seq_id"] for r in selection.resolve_hits(hits, known).collect()}
    last = {r["hit_id"]: r["seq_id"] for r in selection.resolve_hits(hits, known, first=False).collect()}
    assert (first, last) == ({"x": "i0", "none": None}, {"x": "i1", "none": None})
    rows = selection.enrich_by_name(spark.createDataFrame([("x",), ("q",)], "name string"), known, ["tags"])
    assert {r["name"]: r["tags"] for r in rows.collect()} == {"x": ["t"], "q": []}


def test_lookups_and_domains(spark):
    known = spark.createDataFrame([(0, "i0", "x", ["t"], "dna"), (1, "i1", "y", [], "dna")], "ord long, seq_id string, name string, tags array<string>, seq_type string").withColumn("meta", F.struct(F.lit(1).alias("n")))
    assert selection.get(known, "i1").first()["name"] == "y" and selection.contains(known, "i0") and not selection.contains(known, "i9")
    for ask in (lambda: selection.get(known, "i9"), lambda: selection.annotation_targets(known, tag="none")):
        with pytest.raises(ValueError):
            ask()
    assert known.where(selection.by_exact_name("x")).count() == selection.annotation_targets(known, tag="t").count() == 1
    hits = spark.createDataFrame([("x", "Kin", "PF1.2", 1e-9, 50.0, 3, 40), ("x", "Lig", "PF2.1", 1e-5, 20.0, 1, 2)], "query string, domain string, accession string, evalue double, score double, start int, end int")
    got = {r["name"]: (r["tags"], [d["domain"] for d in r["pfam_domains"]]) for r in selection.domains_to_records(hits, known).collect()}
    assert got == {"x": (["domain:PF1.2", "domain:PF2.1", "t"], ["Lig", "Kin"]), "y": ([], [])}
    rows = spark.createDataFrame([("x", "AC"), ("q", "AG")], "name string, sequence string")
    assert [r["name"] for r in selection.select_alignment(rows, known, selection.Selection(tag="t")).collect()] == ["x"]
    assert selection.select_alignment(rows, known, selection.Selection()) is rows
    resolved = selection.resolve_hits(spark.createDataFrame([("x", 1.0), ("z", 0.5)], "hit_id string, score double"), known)
    assert {(r["hit_id"], r["in_project"]) for r in selection.flat_hits(resolved).collect()} == {("x", True), ("z", False)}


def test_stream(spark, folder, tmp_path):
    query = counts_by_type(read_fasta_stream(spark, f"{folder}/*.fasta")).writeStream.outputMode("complete").format("memory").queryName("fasta_counts").start()
    query.processAllAvailable()
    query.stop()
    got = {r["seq_type"]: (r["records"], r["letters"]) for r in spark.table("fasta_counts").select("seq_type", "records", F.col("letters")).collect()}
    assert got == {"dna": (1, 8), "protein": (1, 6)}


TABLE = [
    "     source          1..40",
    '                     /organism="A thing"',
    "     CDS             complement(join(3..8,",
    "                     J00194.1:100..202,12..>20))",
    '                     /note="of two',
    '                     /lines, a ""quoted"" word"',
    "                     /pseudo",
    '                     /db_xref="a:1"',
    '                     /db_xref="b:2"',
    '                     /translation="MKV',
    '                     LAA"',
    "                     /codon_start=1",
]


@pytest.mark.parametrize("fmt", ["genbank", "embl"])
def test_features(spark, tmp_path, fmt):
    if fmt == "genbank":
        text = "LOCUS       L1  40 bp\nVERSION     L1.1\nFEATURES             Location/Qualifiers\n" + "\n".join(TABLE) + "\nORIGIN\n        1 acgt\n//\nLOCUS       L2 4 bp\nORIGIN\n        1 acgt\n//\n"
    else:
        text = "ID   L1; SV 1; linear;\nFH   Key             Location/Qualifiers\n" + "\n".join("FT" + t[2:] for t in TABLE) + "\nSQ   Sequence 4 BP;\n     acgt\n//\nID   L2; SV 1;\nSQ   Sequence\n     acgt\n//\n"
    (tmp_path / "f.txt").write_text(text)
    rows = files.read_features(spark, [str(tmp_path / "f.txt")], fmt).orderBy("number").collect()
    assert [(r["name"], r["kind"], r["start"], r["end"], r["strand"]) for r in rows] == [("L1.1", "source", 0, 40, 1), ("L1.1", "CDS", 2, 20, -1)]
    assert rows[1]["location"] == "complement(join(3..8,J00194.1:100..202,12..>20))"
    assert [tuple(q) for q in rows[1]["qualifiers"]] == [("note", 'of two /lines, a "quoted" word'), ("pseudo", ""), ("db_xref", "a:1"), ("db_xref", "b:2"), ("translation", "MKVLAA"), ("codon_start", "1")]
    with pytest.raises(ValueError):
        files.read_features(spark, [str(tmp_path / "f.txt")], "fasta")
