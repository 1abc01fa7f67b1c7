"""Readers and writers of sequence files, as transformations of Spark's text source.

Multi-line records are split by the text source itself (`lineSep`), so files are read in parallel, compressed ones too,
and every record knows its file. `ord` orders records by file, then by place in the file: the pieces of each block that a
task reads are numbered in the order in which it reads them, and blocks by the sums of those before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators.profiles import check_aligned

FORMATS = {"fasta": "fasta", "fa": "fasta", "fna": "fasta", "faa": "fasta", "fastq": "fastq", "fq": "fastq", "genbank": "genbank", "gb": "genbank", "gbk": "genbank", "embl": "embl"}
#: Reads that are numbered in one group.
LOT = 1 << 20
SCHEMA = ("ord", "seq_id", "name", "sequence", "seq_type", "description", "tags", "quality", "meta")


def guess_format(path: str) -> str:
    """The format of a path's suffix, one of compression aside; an unknown suffix is an error."""
    parts = path.rsplit("/", 1)[-1].lower().split(".")
    if parts[-1] in ("gz", "bz2", "zst") and len(parts) > 2:
        parts.pop()
    if len(parts) < 2 or parts[-1] not in FORMATS:
        raise ValueError(f"cannot tell the format of {path!r}; name one of {', '.join(sorted(set(FORMATS.values())))}")
    return FORMATS[parts[-1]]


def _numbered(pieces: DataFrame, number: str) -> DataFrame:
    """`pieces(source_file, block, mono)` with their places: in their file for `in_file`, over all files in the files' order for `overall`.

    Only the counts of blocks, which are as many as the tasks that read the files, are added up in one place.
    """
    inside = F.row_number().over(Window.partitionBy("source_file", "block").orderBy("mono")) - 1
    counts = pieces.groupBy("source_file", "block").agg(F.count("*").alias("hf_n"))
    before = Window.partitionBy("source_file") if number == "in_file" else Window.partitionBy(F.lit(0))
    starts = counts.select("source_file", "block", (F.sum("hf_n").over(before.orderBy("source_file", "block")) - F.col("hf_n")).alias("hf_start"))
    return pieces.withColumn("hf_inside", inside).join(starts, ["source_file", "block"]).withColumn("at", F.col("hf_start") + F.col("hf_inside")).drop("hf_inside", "hf_start", "mono", "block")


def _pieces(spark: SparkSession, paths: Sequence[str], separator: str | None, recursive: bool) -> DataFrame:
    """(source_file, block, mono, value): what stands between separators, or lines, with the block of the file that it begins in."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("lineSep", separator) if separator else reader
    text = reader.text(list(paths)).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"))
    return text.withColumn("mono", F.monotonically_increasing_id())


def _chunks(spark: SparkSession, paths: Sequence[str], separator: str, recursive: bool) -> DataFrame:
    return _pieces(spark, paths, separator, recursive).where(F.rlike("value", F.lit(r"\S")))


def _records(parsed: DataFrame, fmt: str, seq_type: str | None) -> DataFrame:
    """Records from (source_file, block, mono, name, description, sequence, quality)."""
    typed = _numbered(parsed, "overall").withColumnRenamed("at", "ord").withColumn("sequence", F.upper(F.regexp_replace("sequence", r"\s", "")))
    kind = F.lit(seq_type) if seq_type else S.guess_type(F.col("sequence"))
    identity = F.substring(F.sha2(F.concat_ws("|", "source_file", "ord", "name"), 256), 1, 12)
    return typed.select("ord", identity.alias("seq_id"), "name", "sequence", kind.alias("seq_type"), "description", F.array().cast("array<string>").alias("tags"), "quality", F.struct("source_file", F.lit(fmt).alias("source_format")).alias("meta"))


def parse_fasta(chunk: Column) -> tuple[Column, Column, Column]:
    """Name, description and sequence of what stands between two record marks."""
    whole = F.regexp_replace(chunk, r"^\s*>?", "")
    header = F.trim(F.substring_index(whole, "\n", 1))
    return F.regexp_extract(header, r"^(\S*)", 1), header, F.when(F.contains(whole, F.lit("\n")), F.regexp_replace(whole, r"^[^\n]*\n", "")).otherwise("")


def read_fasta(spark: SparkSession, paths: Sequence[str], seq_type: str | None = None, recursive: bool = False) -> DataFrame:
    name, description, sequence = parse_fasta(F.col("value"))
    parsed = _chunks(spark, paths, "\n>", recursive).select("source_file", "block", "mono", name.alias("name"), description.alias("description"), sequence.alias("sequence"), F.lit(None).cast("array<int>").alias("quality"))
    return _records(parsed, "fasta", seq_type)


def read_fastq(spark: SparkSession, paths: Sequence[str], seq_type: str | None = None, recursive: bool = False) -> DataFrame:
    """Reads of four lines each, with Phred+33 qualities."""
    lines = _numbered(_pieces(spark, paths, None, recursive), "in_file").withColumn("no", (F.col("at") % 4).cast("int"))
    part = lambda k: F.max(F.when(F.col("no") == k, F.col("value")))
    four = lines.groupBy("source_file", F.floor(F.col("at") / 4).alias("mono")).agg(part(0).alias("header"), part(1).alias("sequence"), part(3).alias("quality"))
    header = F.regexp_replace("header", "^@", "")
    quality = F.transform(S.symbols(F.col("quality")), lambda c: F.ascii(c) - 33)
    # reads of one file are numbered in lots, so that no task orders a whole file
    lot = F.floor(F.col("mono") / LOT)
    parsed = four.where("header <> ''").select("source_file", lot.alias("block"), "mono", F.regexp_extract(header, r"^(\S*)", 1).alias("name"), header.alias("description"), "sequence", quality.alias("quality"))
    return _records(parsed, "fastq", seq_type)


def read_flat(spark: SparkSession, paths: Sequence[str], fmt: str, seq_type: str | None = None, recursive: bool = False) -> DataFrame:
    """GenBank and EMBL entries: identifier, definition and sequence; `read_features` has their features."""
    value = F.col("value")
    lines = lambda key: F.array_join(F.transform(F.regexp_extract_all(value, F.lit(rf"(?m)^{key}\s+(.*)$"), F.lit(1)), F.trim), " ")
    if fmt == "genbank":
        version, locus = F.regexp_extract(value, r"(?m)^VERSION\s+(\S+)", 1), F.regexp_extract(value, r"(?m)^LOCUS\s+(\S+)", 1)
        name = F.when(version != "", version).otherwise(locus)
        description = F.trim(F.regexp_replace(F.regexp_extract(value, r"(?m)^DEFINITION\s+([\s\S]*?)\n(?=\S)", 1), r"\s+", " "))
        body = F.regexp_extract(value, r"(?m)^ORIGIN[^\n]*\n([\s\S]*)", 1)
    else:
        name = F.concat_ws(".", F.regexp_extract(value, r"(?m)^ID\s+([^;\s]+)", 1), F.nullif(F.regexp_extract(value, r"(?m)^ID\s+[^;\s]+;\s*SV\s+(\d+)", 1), F.lit("")))
        description = lines("DE")
        body = F.regexp_extract(value, r"(?m)^SQ\s[^\n]*\n([\s\S]*)", 1)
    chunks = _chunks(spark, paths, "\n//", recursive).where(F.rlike("value", F.lit(r"(?m)^(LOCUS|ID)\s")))
    parsed = chunks.select("source_file", "block", "mono", name.alias("name"), description.alias("description"), F.regexp_replace(body, r"[^A-Za-z*-]", "").alias("sequence"), F.lit(None).cast("array<int>").alias("quality"))
    return _records(parsed, fmt, seq_type)


def read_features(spark: SparkSession, paths: Sequence[str], fmt: str, recursive: bool = False) -> DataFrame:
    """`source_file`, `name`, `number`, `kind`, `location`, `start`, `end`, `strand`, `qualifiers` of the features of GenBank or EMBL entries.

    `start` counts from 0 and `end` is the first place after the feature, over all parts of its location; references to
    other entries do not count. `strand` is -1 where the whole location is a complement, 0 where a part is, else 1.
    Qualifiers are (key, value) in their order, since keys may repeat; one without a value has an empty one. Entries
    without features have no rows.
    """
    if fmt not in ("genbank", "embl"):
        raise ValueError(f"features are read from genbank or embl, not {fmt!r}")
    value = F.col("value")
    if fmt == "genbank":
        version, locus = F.regexp_extract(value, r"(?m)^VERSION\s+(\S+)", 1), F.regexp_extract(value, r"(?m)^LOCUS\s+(\S+)", 1)
        name = F.when(version != "", version).otherwise(locus)
        table = F.regexp_extract(value, r"(?m)^FEATURES[^\n]*((?:\n {5}[^\n]*)+)", 1)
    else:
        name = F.concat_ws(".", F.regexp_extract(value, r"(?m)^ID\s+([^;\s]+)", 1), F.nullif(F.regexp_extract(value, r"(?m)^ID\s+[^;\s]+;\s*SV\s+(\d+)", 1), F.lit("")))
        table = F.array_join(F.transform(F.regexp_extract_all(value, F.lit(r"(?m)^FT( {3}[^\n]*)$"), F.lit(1)), lambda x: F.concat(F.lit("\n  "), x)), "")
    chunks = _chunks(spark, paths, "\n//", recursive).where(F.rlike("value", F.lit(r"(?m)^(LOCUS|ID)\s")))
    items = chunks.select("source_file", name.alias("name"), F.posexplode(F.split(F.regexp_replace(table, "\r", ""), r"\n(?= {5}\S)")).alias("number", "item")).where(F.rlike("item", F.lit(r"^ {5}\S")))
    kind = F.regexp_extract("item", r"^ {5}(\S+)", 1)
    rest = F.regexp_replace(F.regexp_replace("item", r"^ {5}\S+\s*", ""), r"\n\s+", "\n")
    parts = items.select("source_file", "name", "number", kind.alias("kind"), rest.alias("rest"))
    location = F.regexp_replace(F.regexp_extract("rest", r"^([^/]*)", 1), r"\s", "")
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace("location", r"[A-Za-z_][\w.]*:[\d.<>^]+", ""), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    pattern = r'(?m)^/([^=\s]+)(?:=("[^"]*(?:""[^"]*)*"|[^\n]*))?'
    keys, values = F.regexp_extract_all("rest", F.lit(pattern), F.lit(1)), F.regexp_extract_all("rest", F.lit(pattern), F.lit(2))
    plain = lambda k, v: F.regexp_replace(F.regexp_replace(F.regexp_replace(v, '^"|"$', ""), '""', '"'), "\n", F.when(k == "translation", "").otherwise(" "))
    strand = F.when(F.startswith("location", F.lit("complement(")), -1).when(F.contains("location", F.lit("complement(")), 0).otherwise(1)
    return parts.withColumn("location", location).select(
        "source_file", "name", "number", "kind", "location", (F.array_min(numbers) - 1).alias("start"), F.array_max(numbers).alias("end"), strand.alias("strand"),
        F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), plain(k, v).alias("value"))).alias("qualifiers"),
    )


def files_under(spark: SparkSession, path: str, recursive: bool = False) -> list[str] | None:
    """The files of a folder by name, hidden ones left out, those of its folders too if `recursive`; None where the path is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place) or not system.getFileStatus(place).isDirectory():
        return None
    found = []
    for status in system.listStatus(place):
        name = status.getPath().getName()
        if name.startswith((".", "_")):
            continue
        if status.isDirectory():
            found += files_under(spark, status.getPath().toString(), True) or [] if recursive else []
        else:
            found.append(status.getPath().toString())
    return sorted(found)


def read_collection(spark: SparkSession, paths: Sequence[str], fmt: str | None = None, seq_type: str | None = None, recursive: bool = False) -> DataFrame:
    """One collection of files of any formats, in the order of the formats' first files.

    A folder stands for its files; where no format is named, those of it that have no known suffix are skipped.
    """
    by_format: dict[str, list[str]] = {}
    for p in paths:
        inside = files_under(spark, p, recursive)
        for own in [p] if inside is None else inside:
            try:
                by_format.setdefault(fmt or guess_format(own), []).append(own)
            except ValueError:
                if inside is None:
                    raise
    if not by_format:
        raise ValueError(f"no sequence files in {', '.join(paths)}")
    parts = []
    for kind, own in by_format.items():
        read = {"fasta": read_fasta, "fastq": read_fastq}.get(kind)
        parts.append(read(spark, own, seq_type) if read else read_flat(spark, own, kind, seq_type))
    out = parts[0]
    for p in parts[1:]:
        out = append(out, p)
    return out


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """A FASTA file of rows of one length; types are told by the letters without gaps."""
    rows = read_fasta(spark, [path])
    check_aligned(rows)
    return rows


def append(collection: DataFrame, more: DataFrame) -> DataFrame:
    """Both collections, the second after the first; an id in both is an error when rows are read."""
    last = F.coalesce(F.max("ord"), F.lit(-1))
    shift = collection.agg((last + 1).alias("hf_shift"))
    moved = more.join(F.broadcast(shift)).withColumn("ord", F.col("ord") + F.col("hf_shift")).drop("hf_shift")
    known = collection.select("seq_id", F.lit(True).alias("hf_known")).distinct()
    fresh = moved.join(known, "seq_id", "left").where(F.assert_true(F.col("hf_known").isNull(), F.concat(F.lit("id given twice: "), "seq_id")).isNull())
    return collection.unionByName(fresh.select(*collection.columns))


def fasta_lines(collection: DataFrame, width: int = 70) -> DataFrame:
    """`ord`, `value`: each record as FASTA text; the header is the name, then the description without it."""
    own = F.regexp_replace("description", r"^\S+\s*", "")
    rest = F.when(F.startswith("description", F.concat("name", F.lit(" "))), own).when(F.col("description") == F.col("name"), "").otherwise(F.coalesce("description", F.lit("")))
    header = F.concat(F.lit(">"), F.concat_ws(" ", "name", F.nullif(rest, F.lit(""))))
    return collection.select("ord", F.concat(header, F.lit("\n"), F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")).alias("value"))


def write(collection: DataFrame, path: str, fmt: str) -> None:
    """Write a collection as fasta, or its flat rows as csv, tsv, json or parquet, in one part file a task."""
    from helixframe.operators.report import flat_rows

    if fmt == "fasta":
        fasta_lines(collection).orderBy("ord").select("value").write.text(path)
        return
    if fmt not in ("csv", "tsv", "json", "parquet"):
        raise ValueError(f"unknown format {fmt!r}: use fasta, csv, tsv, json or parquet")
    rows = flat_rows(collection)
    if fmt in ("csv", "tsv"):
        rows.write.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    else:
        rows.write.format(fmt).save(path)


def parse_blast(lines: DataFrame) -> DataFrame:
    """(hit_id, score) of tab-separated sseqid, bitscore, pident lines; the score is the identity as a share."""
    cells = F.split("value", "\t")
    return lines.select(F.get(cells, F.lit(0)).alias("hit_id"), (F.get(cells, F.lit(2)).try_cast("double") / 100).alias("score")).where("score IS NOT NULL")


def parse_hits(lines: DataFrame) -> DataFrame:
    """(hit_id, score) of tab-separated target, pident lines."""
    cells = F.split("value", "\t")
    return lines.select(F.get(cells, F.lit(0)).alias("hit_id"), (F.get(cells, F.lit(1)).try_cast("double") / 100).alias("score")).where("score IS NOT NULL")


def parse_domtblout(lines: DataFrame) -> DataFrame:
    """Domain hits of a domain table: query, domain, accession, evalue, score and the aligned range."""
    cells = F.split(F.trim("value"), r"\s+")
    at = lambda i, kind: F.get(cells, F.lit(i)).try_cast(kind)
    own = lines.where(~F.startswith("value", F.lit("#")) & (F.size(cells) >= 22))
    return own.select(at(3, "string").alias("query"), at(0, "string").alias("domain"), at(1, "string").alias("accession"), at(12, "double").alias("evalue"), at(13, "double").alias("score"), at(17, "int").alias("start"), at(18, "int").alias("end"))


def parse_mmseqs_clusters(lines: DataFrame) -> DataFrame:
    """(cluster, name) of tab-separated representative, member lines."""
    cells = F.split("value", "\t")
    return lines.select(F.get(cells, F.lit(0)).alias("cluster"), F.get(cells, F.lit(1)).alias("name")).where("name IS NOT NULL")


def read_uniprot(spark: SparkSession, path: str) -> DataFrame:
    """One row an entry of UniProt JSON files, one entry a line or file: accession, name, organism, genes, length, features and Pfam references."""
    text = "STRUCT<value: STRING>"
    schema = f"primaryAccession STRING, proteinDescription STRUCT<recommendedName: STRUCT<fullName: {text}>>, organism STRUCT<scientificName: STRING>, genes ARRAY<STRUCT<geneName: {text}>>, sequence STRUCT<value: STRING, length: INT>, features ARRAY<STRUCT<type: STRING, description: STRING>>, uniProtKBCrossReferences ARRAY<STRUCT<database: STRING, id: STRING>>"
    entries = spark.read.schema(schema).option("multiLine", True).json(path)
    pfam = F.transform(F.filter("uniProtKBCrossReferences", lambda x: x["database"] == "Pfam"), lambda x: x["id"])
    none = F.array().cast("array<string>")
    return entries.select(
        F.col("primaryAccession").alias("accession"), F.col("proteinDescription.recommendedName.fullName.value").alias("protein_name"), F.col("organism.scientificName").alias("organism"),
        F.coalesce(F.array_compact(F.transform("genes", lambda g: g["geneName"]["value"])), none).alias("genes"), F.coalesce("sequence.length", F.char_length("sequence.value")).alias("length"),
        F.coalesce(F.transform("features", lambda f: f["type"]), none).alias("features"), F.coalesce(pfam, none).alias("pfam"),
    )
