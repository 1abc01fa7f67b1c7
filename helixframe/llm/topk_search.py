"""Operator 8, exact top-k search: an impact-ordered index, read score at a time, over blocks of rows.

Components are integers floor(256 x), and the score is their inner product. Rows and queries are dealt into blocks of
bounded size by a hash; each pair of blocks is one group of a cogrouped map. A block of rows becomes postings
(row, dimension, component), in segments by descending impact quantised in half powers of two, so there are at most 126
of them whatever the values. A query adds up the postings segment by segment. What a row can still gain is bounded by the
length of its unread part times the length of the query's components in just those dimensions; once the rows that can
still reach the query's k-th best are few, the query stops, and those are rescored exactly in 64-bit integers. The first
block of rows is searched first: its k-th best score is a floor for the query in all other blocks, so they stop earlier.
Pairs of blocks yield k rows a query, and a window keeps the best k of those.

Defined results: vectors that are null, or hold a null or a non-finite component, take no part, nor do rows without an
id; a vector shorter than another counts as padded with zeros, an empty one scores 0 everywhere; ties go to the smaller
id; a query is a row, and only that row is no candidate of it, so other rows with its id are; rows equal in id and vector
ask each, with the same result; a query with fewer than k candidates gets all; an empty table gives an empty result;
components so large that a score could need more than 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm._shared import materialise

#: Postings that a block of rows and one of queries hold at most, and rows of either.
POSTINGS, ROWS, ASKED = 1 << 18, 4096, 2048
#: Queries searched together, postings added up together, and the share of the postings read before a proof is tried.
TOGETHER, STRETCH, EARLIEST = 64, 1 << 14, 0.3


class Index:
    """The posting segments of one block of rows, by descending quantised impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.size = np.abs(self.vectors).astype(np.float64)
        row, dim = np.nonzero(self.vectors)
        value = self.vectors[row, dim].astype(np.float64)
        level = np.floor(2 * np.log2(np.abs(value))).astype(np.int64)
        by_impact = np.lexsort((row, -level))
        self.row, self.dim, self.value, level = row[by_impact], dim[by_impact], value[by_impact], level[by_impact]
        ends = np.append(np.flatnonzero(np.diff(level)) + 1, len(level)) if len(level) else np.zeros(1, int)
        #: (first posting, end, least unread impact class) of the segments, high impacts first.
        self.segments = [(int(a), int(b), int(level[a])) for a, b in zip([0, *ends[:-1]], ends, strict=True) if b > a]
        self.read, self.postings, self.rescored = 0, 0, 0

    def add_up(self, so_far: np.ndarray, first: int, end: int, queries: np.ndarray) -> None:
        """Add the postings first..end, sorted by row, to the scores so far, rows by queries."""
        for at in range(first, end, STRETCH):
            rows = self.row[at : min(at + STRETCH, end)]
            part = self.value[at : at + len(rows), None] * queries[self.dim[at : at + len(rows)]]
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            so_far[rows[starts]] += np.add.reduceat(part, starts, axis=0)

    def search(self, asked_ids: np.ndarray, asked: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[int, int, int]]:
        """(place of the query, row id, score): the k best rows of the block for each query, those below its floor left out at will."""
        n, found = len(self.ids), []
        self.postings += len(self.row) * len(asked)
        floors = np.full(len(asked), -np.inf) if floors is None else floors
        for at in range(0, len(asked), TOGETHER):
            found += self.search_some(np.arange(at, min(at + TOGETHER, len(asked))), asked_ids, asked, min(k, n), floors)
        return found

    def search_some(self, open_: np.ndarray, asked_ids: np.ndarray, asked: np.ndarray, need: int, floors: np.ndarray) -> list[tuple[int, int, int]]:
        found, queries = [], asked[open_].T.astype(np.float64)
        so_far = np.zeros((len(self.ids), len(open_)))
        floor = floors[open_]
        for j, q in enumerate(open_):  # the query's own row never takes a place
            same = np.arange(*np.searchsorted(self.ids, [asked_ids[q], asked_ids[q] + 1]))
            own = same[(self.vectors[same] == asked[q]).all(axis=1)]
            so_far[own[:1], j] = -np.inf
        longest = np.sqrt((self.size**2).sum(axis=1).max(initial=0.0))
        few = max(4 * need, len(self.ids) // 32)
        for first, end, level in self.segments or [(0, 0, 0)]:
            self.add_up(so_far, first, end, queries)
            self.read += (end - first) * len(open_)
            last = end == len(self.row)
            if end < EARLIEST * len(self.row):
                continue
            unread = np.where(np.floor(2 * np.log2(np.maximum(self.size, 1e-9))) < level, self.size, 0.0) if not last else np.zeros_like(self.size)
            bound = np.sqrt((unread**2).sum(axis=1))[:, None] * np.sqrt((unread > 0).astype(np.float64) @ queries**2)
            bound += 1e-9 * longest * np.sqrt((queries**2).sum(axis=0))[None, :]  # far more than sums of doubles can be off
            kth = np.partition(so_far - bound, len(self.ids) - need, axis=0)[len(self.ids) - need]
            possible = (so_far + bound >= np.maximum(kth, floor)[None, :]) & (so_far > -np.inf)
            done = last | (possible.sum(axis=0) <= few)
            for j in np.flatnonzero(done):
                rows = np.flatnonzero(possible[:, j])
                exact = self.vectors[rows] @ asked[open_[j]]
                self.rescored += len(rows)
                best = np.lexsort((self.ids[rows], -exact))[:need]
                found += [(int(open_[j]), int(self.ids[rows[i]]), int(exact[i])) for i in best]
            if done.all():
                break
            open_, floor, so_far, queries = open_[~done], floor[~done], so_far[:, ~done], queries[:, ~done]
        return found


def pack(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """A matrix of the lists, padded with zeros to the longest, or to `width`."""
    lists = column.combine_chunks()
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(width, sizes.max(initial=0))), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by `every`."""
    x = F.col(vector_col)
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.col(id_col).isNotNull()
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("hf_id"), F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long")).alias("hf_v"))
    queries = rows.where(F.pmod("hf_id", F.lit(every)) == 0).groupBy(F.col("hf_id").alias("hf_asker"), F.col("hf_v").alias("hf_vector")).agg(F.count("*").alias("hf_copies")).withColumn("hf_asked", F.xxhash64("hf_asker", "hf_vector"))
    largest = F.coalesce(F.max(F.greatest(F.array_max("hf_v"), -F.array_min("hf_v"))), F.lit(0))
    n_rows, width, largest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("hf_v")), F.lit(0)), largest).first()
    if width * largest**2 >= 1 << 63:
        raise OverflowError("the components are so large that a score could need more than 64 bits")
    each = lambda most: max(1, min(most, POSTINGS // max(1, width)))
    row_blocks, query_blocks = max(1, -(-n_rows // each(ROWS))), max(1, -(-queries.count() // each(ASKED)))
    block = lambda key, n: F.pmod(key, F.lit(n)).cast("int")
    spread = lambda first, n: F.explode(F.sequence(F.lit(first), F.lit(n - 1)))
    left = rows.select("hf_id", "hf_v", block(F.xxhash64("hf_id", "hf_v"), row_blocks).alias("hf_rows"))
    repeated = queries.where("hf_copies > 1").select("hf_asked", "hf_copies")
    right = queries.drop("hf_copies").withColumn("hf_queries", block(F.col("hf_asked"), query_blocks))

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        found, keys, ids = [], asked.column("hf_asked").to_numpy(), asked.column("hf_asker").to_numpy()
        if len(own) and len(asked):
            both = [pack(own.column("hf_v")), pack(asked.column("hf_vector"))]
            wide = max(a.shape[1] for a in both)
            mine, theirs = (np.pad(a, ((0, 0), (0, wide - a.shape[1]))) for a in both)
            floors = asked.column("hf_floor").cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy()
            found = Index(own.column("hf_id").to_numpy(), mine).search(ids, theirs, k, floors)
        place, row, score = np.array(found, dtype=np.int64).reshape(-1, 3).T
        return pa.table({"hf_asked": keys[place], "query_id": ids[place], "vec_id": row, "score": score})

    def meet(own: DataFrame, asked: DataFrame, first: int, n: int) -> DataFrame:
        """Every block of `own` from `first` on, `n` in all, with every block of queries."""
        own = own.withColumn("hf_queries", spread(0, query_blocks)).groupBy("hf_rows", "hf_queries")
        asked = asked.withColumn("hf_rows", spread(first, n)).groupBy("hf_rows", "hf_queries")
        return own.cogroup(asked).applyInArrow(search, "hf_asked long, query_id long, vec_id long, score long")

    found = meet(left.where("hf_rows = 0"), right.withColumn("hf_floor", F.lit(None).cast("long")), 0, 1)
    if row_blocks > 1:
        found = materialise(found)
        floors = found.groupBy("hf_asked").agg(F.when(F.count("*") >= k, F.min("score")).alias("hf_floor"))
        found = found.unionByName(meet(left.where("hf_rows > 0"), right.join(floors, "hf_asked", "left"), 1, row_blocks))
    best = Window.partitionBy("query_id", "hf_asked").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(repeated, "hf_asked", "left")
    return ranked.withColumn("hf_copy", F.explode(F.sequence(F.lit(1), F.coalesce("hf_copies", F.lit(1))))).select("query_id", "rank", "vec_id", "score")
