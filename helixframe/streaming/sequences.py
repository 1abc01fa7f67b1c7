"""A directory of FASTA files as a stream of records; the operators on single records apply to it as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.sources.files import parse_fasta


def read_fasta_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """`name`, `description`, `sequence`, `seq_type`, `source_file` of every record of files that appear under a path."""
    text = spark.readStream.format("text").schema("value string").option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_trigger).load(path)
    name, description, sequence = parse_fasta(F.col("value"))
    seq = F.upper(F.regexp_replace(sequence, r"\s", ""))
    return text.where(F.rlike("value", F.lit(r"\S"))).select(name.alias("name"), description.alias("description"), seq.alias("sequence"), S.guess_type(seq).alias("seq_type"), F.input_file_name().alias("source_file"))


def counts_by_type(stream: DataFrame) -> DataFrame:
    """Running number of records and letters a type, for output in update or complete mode."""
    return stream.groupBy("seq_type").agg(F.count("*").alias("records"), F.sum(F.char_length("sequence")).alias("letters"))
