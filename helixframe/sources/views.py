"""Record collections over the given tables: documents read as sequences, with tags and metadata.

A collection has `ord` (its order), `seq_id`, `name`, `sequence`, `seq_type`, `description`, `tags` and `meta`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequences as S

PROTEIN_LETTERS = "ACDEFGHIKLMNPQRSTVWY"
#: What of a text each view keeps.
LETTERS = {"dna": "ACGTacgt", "ambiguous": "ACGTNacgtn", "protein": PROTEIN_LETTERS + PROTEIN_LETTERS.lower(), "gapped": "ACGTacgt ", "letters": "A-Za-z"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequence_of(text: Column, view: str) -> Column:
    """The whole text, reduced to a view's letters, in upper case; spaces of the gapped view are gaps."""
    kept = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{LETTERS[view]}]+", ""))
    return F.translate(kept, " ", "-") if view == "gapped" else kept


def records(spark: SparkSession, sf_dir: str, view: str = "dna", tagged: bool = False) -> DataFrame:
    """Documents as records of a view; with `tagged`, language, source and labels are tags."""
    docs = read(spark, sf_dir, "documents")
    sequence = sequence_of(F.col("text"), view)
    base = docs.select(
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("seq_id"),
        F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("name"),
        sequence.alias("sequence"),
        (F.lit(view) if view in ("dna", "protein") else S.guess_type(sequence)).alias("seq_type"),
        F.concat_ws(" ", "source", "lang").alias("description"),
        F.struct("lang", "source", "n_chars").alias("meta"),
    )
    if not tagged:
        return base.withColumn("tags", F.array().cast("array<string>"))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), "quality", "toxic")
    marks = [F.concat(F.lit("lang:"), "meta.lang"), F.concat(F.lit("src:"), "meta.source"), F.when(F.col("quality") == 1, "high_quality"), F.when(F.col("toxic") == 1, "toxic")]
    return base.join(labels, "ord", "left").withColumn("tags", F.array_sort(F.array_compact(F.array(*marks)))).drop("quality", "toxic")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reads: the ambiguous view, each letter with a quality from its code and place."""
    base = records(spark, sf_dir, "ambiguous")
    return base.withColumn("quality", F.transform(S.symbols(F.col("sequence")), lambda c, i: F.pmod(F.ascii(c) * 7 + i * 13, F.lit(41)).cast("int")))


def tiles(spark: SparkSession, sf_dir: str, width: int = 60) -> DataFrame:
    """An alignment of all whole texts: the gapped view cut into consecutive rows of one width, the last one filled up with gaps."""
    whole = F.rpad("sequence", (F.ceil(F.char_length("sequence") / width) * width).cast("int"), F.lit("-"))
    cut = F.regexp_extract_all(whole, F.lit(f"(.{{{width}}})"), F.lit(1))
    return records(spark, sf_dir, "gapped").select("ord", "seq_id", "meta", F.posexplode(cut).alias("tile", "sequence"))
