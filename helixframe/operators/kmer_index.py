"""An inverted index of k-mers for exact top-n search.

The index is three tables: postings (k-mer, set size, record), bucketed by k-mer and sorted by size where it is saved, the
length of every k-mer's list, and the records' sets. A search is dealt by records: each task sorts its own sets by k-mer
and counts, for all queries, the records at the places of their k-mers. What a search dealt by k-mer would have to read
is told by `read_share`: a query's rarest lists give a floor, its n-th best score; a record that reaches a similarity t
shares at least t times the query's k-mers with it, so it stands in one of the rarest n - ceil(t n) + 1 lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators.similarity import best_of
from helixframe.operators.storage import written

#: Lists that a query reads for its floor, and buckets of a saved index.
PROBES, BUCKETS = 8, 64


@dataclass
class KmerIndex:
    """`postings(kmer, n, ord)`, `lists(kmer, f)` and `sets(ord, n, kmers)` of the records' k-mer sets."""

    k: int
    postings: DataFrame
    lists: DataFrame
    sets: DataFrame


def marked(records: DataFrame, k: int) -> DataFrame:
    kmers = F.transform(S.kmer_set(F.col("sequence"), k), lambda x: F.xxhash64(x))
    return records.select("ord", kmers.alias("kmers")).withColumn("n", F.size("kmers"))


def build(records: DataFrame, k: int = 12, name: str | None = None) -> KmerIndex:
    """The index of `records`; with a `name` it is saved as bucketed tables that `load` finds again."""
    sets = written(marked(records, k))
    postings = sets.select(F.explode("kmers").alias("kmer"), "n", "ord")
    lists = postings.groupBy("kmer").agg(F.count("*").alias("f"))
    if name is None:
        return KmerIndex(k, postings, lists, sets)
    postings.write.bucketBy(BUCKETS, "kmer").sortBy("kmer", "n").mode("overwrite").saveAsTable(f"{name}_postings")
    lists.write.bucketBy(BUCKETS, "kmer").sortBy("kmer").mode("overwrite").saveAsTable(f"{name}_lists")
    sets.write.bucketBy(BUCKETS, "ord").mode("overwrite").saveAsTable(f"{name}_sets")
    return load(records.sparkSession, name, k)


def load(spark, name: str, k: int) -> KmerIndex:
    return KmerIndex(k, *[spark.table(f"{name}_{part}") for part in ("postings", "lists", "sets")])


def ranked_lists(index: KmerIndex, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (query, nq, q) and their k-mers with the length `f` of each list and its `place`, rare ones first; k-mers without a list come before all."""
    asked = written(marked(queries, index.k).select(F.col("ord").alias("query"), F.col("n").alias("nq"), F.col("kmers").alias("q")))
    own = asked.select("query", "nq", F.explode("q").alias("kmer")).join(index.lists, "kmer", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    return asked, written(own.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("f", "kmer"))))


def scored(index: KmerIndex, asked: DataFrame, met: DataFrame) -> DataFrame:
    """query, ord, score of the distinct pairs (query, ord) of `met`."""
    both = met.select("query", "ord").distinct().join(asked, "query").join(index.sets, "ord")
    shared = F.size(F.array_intersect("q", "kmers"))
    return both.select("query", "ord", (shared / (F.col("nq") + F.col("n") - shared)).alias("score"))


def best(found: DataFrame, top_n: int) -> DataFrame:
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "ord")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top_n)


def needed_lists(index: KmerIndex, queries: DataFrame, top_n: int, min_score: float) -> tuple[DataFrame, DataFrame]:
    """Queries and, of their lists, those that have to be read, with the `floor` of the query."""
    asked, own = ranked_lists(index, queries)
    there = own.where("f > 0").withColumn("rare", F.row_number().over(Window.partitionBy("query").orderBy("place")))
    probed = best(scored(index, asked, there.where(F.col("rare") <= PROBES).join(index.postings, "kmer")), top_n)
    floors = written(probed.groupBy("query").agg(F.when(F.count("*") >= top_n, F.min("score")).alias("floor")))
    floored = own.where("f > 0").join(floors, "query", "left").withColumn("floor", F.greatest(F.coalesce("floor", F.lit(0.0)), F.lit(min_score)))
    return asked, floored.where(F.col("place") <= F.col("nq") - F.ceil(F.col("floor") * F.col("nq") - 1e-9) + 1)


def search(index: KmerIndex, queries: DataFrame, top_n: int = 10, min_score: float = 1e-6) -> DataFrame:
    """query, rank, ord, score: for each of `queries` the `top_n` records of at least `min_score`, which is above 0; ties in the collection's order.

    Records stay in their tasks: each sorts its own sets by k-mer, and the queries, broadcast in bounded parts, count the
    records at the places of their k-mers. So no postings, and no sets of records to be scored, are shuffled.
    """
    if not 0 < min_score <= 1:
        raise ValueError("an index holds no records that share nothing: min_score must be above 0")
    asked = marked(queries, index.k).select(F.col("ord").alias("query"), F.col("kmers").alias("q"), F.xxhash64("ord").alias("part"))
    return best_of(index.sets.select(F.col("ord").alias("o"), F.col("kmers").alias("m")), written(asked), "postings", top_n, min_score)


def read_share(index: KmerIndex, queries: DataFrame, top_n: int = 10, min_score: float = 1e-6) -> DataFrame:
    """postings_read and postings_all of each query: those of the lists it needs, and of all its lists."""
    asked, lists = needed_lists(index, queries, top_n, min_score)
    own = asked.select("query", F.explode("q").alias("kmer")).join(index.lists, "kmer").groupBy("query").agg(F.sum("f").alias("postings_all"))
    return own.join(lists.groupBy("query").agg(F.sum("f").alias("postings_read")), "query", "left").fillna(0, ["postings_read"]).select("query", "postings_read", "postings_all")
