"""Helpers that the training-data operators share: table reading, shared storage, word counting."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Read a Parquet table, keeping only `cols` so that the scan prunes the others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, `spark.checkpoint.dir`; without one, executors could not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found


def by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about `limit` bytes; a longer text goes alone."""
    ends = np.cumsum([0 if n is None else n for n in pa.compute.binary_length(batch.column(column)).to_pylist()])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def no_clash(kept, made) -> None:
    """Raise an error where columns to keep have names of the result's own."""
    clash = sorted(set(kept) & set(made))
    if clash:
        raise ValueError(f"rename {', '.join(clash)}: the result has columns of that name")


def give_back() -> None:
    """Return what this Python process has freed to the system: Spark keeps idle workers, which would go on holding it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    This cuts the lineage at files that outlive any executor, so a lost executor costs only its running tasks, and a
    frame that several later steps read is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/helixframe-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.helixframe_path = path
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)  # what is not discarded before goes with the session
    return out


def first_of_each(rows: DataFrame, key: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """`key` and `columns`: of rows equal in `key` the one that comes first by a hash of all columns, so that every run takes the same."""
    place = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return rows.groupBy(*key).agg(F.min_by(F.struct(*columns), place).alias("hf_first")).select(*key, "hf_first.*")


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised frame that nothing reads any more, directly or by a lineage."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.helixframe_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """Bind `value` to a lambda variable so that `body` can use it often while it is evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """All words of a text, in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
