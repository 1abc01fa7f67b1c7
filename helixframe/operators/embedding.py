"""Sequence space: k-mer frequency vectors and their principal components."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators.selection import resolve
from helixframe.operators.similarity import minhash

MOST_DIMENSIONS = 20_000
#: Directions that a pass over the rows multiplies; 20,000 x 64 are 10 MB.
BLOCK = 64


def vocabulary(alphabet: str, k: int) -> list[str]:
    if len(alphabet) ** k > MOST_DIMENSIONS:
        raise ValueError(f"{len(alphabet)} letters to the power {k} are more than {MOST_DIMENSIONS} dimensions")
    return ["".join(x) for x in product(alphabet, repeat=k)]


def kmer_vectors(df: DataFrame, alphabet: str = "ACGT", k: int = 3) -> DataFrame:
    """`ord`, `vector`: the share of every k-mer of the alphabet among those of a sequence; none gives zeros.

    A k-mer's place is its number in base len(alphabet), so no vocabulary is searched.
    """
    n = len(vocabulary(alphabet, k))
    digits = F.create_map(*[F.lit(x) for i, a in enumerate(alphabet) for x in (a, i)])
    number = lambda x: F.aggregate(F.transform(S.symbols(x), lambda c: F.try_element_at(digits, c)), F.lit(0), lambda a, d: a * len(alphabet) + d)
    items = df.select("ord", F.explode(S.kmers(F.col("sequence"), k)).alias("kmer")).where(F.rlike("kmer", F.lit(f"^[{alphabet}]{{{k}}}$")))
    counts = items.groupBy("ord", "kmer").agg(F.count("*").alias("n")).withColumn("at", number(F.col("kmer")))
    sparse = counts.groupBy("ord").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"), F.sum("n").alias("total"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i) / F.col("total"), F.lit(0.0)))
    return df.select("ord").join(sparse, "ord", "left").select("ord", dense.alias("vector"))


def sums_by_place(vectors: DataFrame, width: int, columns: int, of) -> np.ndarray:
    """The sum over all batches of `of(rows)`, a matrix of width x columns: partial sums a task, added up by place.

    What reaches the driver is one such matrix, whatever the number of rows.
    """

    def run(parts):
        total = None
        for pdf in parts:
            if len(pdf):
                got = of(np.vstack(pdf["vector"].to_numpy()))
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"at": np.arange(width), "part": list(total)})

    added = vectors.select("vector").mapInPandas(run, "at int, part array<double>").groupBy("at").agg(F.array(*[F.sum(F.get("part", F.lit(c))) for c in range(columns)]).alias("part"))
    out = np.zeros((width, columns))
    for at, part in added.collect():
        out[at] = part
    return out


def leading_directions(vectors: DataFrame, width: int, size: int, n: int, seed: int = 0, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and the first n directions of largest variance as columns, by a randomised block Krylov method.

    A pass over the rows multiplies the centred scatter with one block of BLOCK directions; each new block is orthogonal
    to all earlier ones, and the passes end when the first n Ritz vectors are exact to `tolerance` of the largest
    variance, or when the blocks span everything. The scatter itself, width x width, is never made.
    """
    mean = sums_by_place(vectors, width, 1, lambda x: x.sum(0)[:, None])[:, 0] / size
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    block = np.linalg.qr(rng.standard_normal((width, min(width, max(BLOCK, n + 8)))))[0]
    while True:
        image = sums_by_place(vectors, width, block.shape[1], lambda x, q=block: (x - mean).T @ ((x - mean) @ q))
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1][:n], turns[:, ::-1][:, :n]
        found, left = basis @ turns, width - basis.shape[1]
        if left == 0 or np.linalg.norm(images @ turns - found * values, axis=0).max() <= tolerance * max(values[0], 1e-300):
            return mean, found
        fresh = image.copy()
        for _ in range(2):  # twice, so that the block is orthogonal to double precision
            fresh -= basis @ (basis.T @ fresh)
        u, s, _ = np.linalg.svd(fresh, full_matrices=False)
        fresh = u[:, s > 1e-12 * max(values[0], 1e-300)][:, :left]
        if fresh.shape[1] == 0:
            return mean, found
        block = np.linalg.qr(fresh - basis @ (basis.T @ fresh))[0]


def principal_components(vectors: DataFrame, n_components: int = 2) -> DataFrame:
    """`ord`, `dim1`..: centred vectors on the components, each turned so that its largest loading is positive.

    There are as many components as asked for, or as rows or dimensions if fewer. Vectors of different lengths, or none,
    are an error; components of equal variance may be turned among each other.
    """
    size, low, high = vectors.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if not size or low != high or high > MOST_DIMENSIONS:
        raise ValueError(f"principal components need vectors of one length of at most {MOST_DIMENSIONS}")
    n = min(n_components, size, high)
    mean, loadings = leading_directions(vectors, high, size, n)
    loadings = loadings * np.where(loadings[np.abs(loadings).argmax(0), np.arange(n)] > 0, 1.0, -1.0)

    @F.pandas_udf("array<double>")
    def projected(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.vstack(v.to_numpy()) - mean) @ loadings) if len(v) else [], dtype=object)

    return vectors.select("ord", projected("vector").alias("p")).select("ord", *[F.get("p", F.lit(i)).alias(f"dim{i + 1}") for i in range(n)])


def minhash_vectors(df: DataFrame, k: int = 9, num_hashes: int = 64) -> DataFrame:
    """`ord`, `vector`: the MinHash signature of every sequence as numbers."""
    return df.select("ord", minhash(F.col("sequence"), k, num_hashes).cast("array<double>").alias("vector"))


def sequence_space(df: DataFrame, label: str | None = None, alphabet: str = "ACGT", k: int | None = None, n_components: int = 2, method: str = "kmer", num_hashes: int = 64) -> DataFrame:
    """`ord`, `seq_id`, `name`, dim1.. and `label` of at least two records: their vectors on the principal components.

    The vectors are shares of k-mers (k is 3 unless given) or MinHash signatures (9).

    The label is a metadata field, or else whether a record has the tag of that name, or its type where none is asked for.
    """
    if method not in ("kmer", "minhash"):
        raise ValueError(f"unknown method {method!r}: use kmer or minhash")
    if df.limit(2).count() < 2:
        raise ValueError("a sequence space needs at least two records")
    vectors = kmer_vectors(df, alphabet, k or 3) if method == "kmer" else minhash_vectors(df, k or 9, num_hashes)
    points = principal_components(vectors, n_components)
    shown_as = F.col("seq_type")
    if label:
        value, kind = resolve(df, label)
        shown_as = F.when(F.array_contains("tags", label), "yes").otherwise("no") if value is None else S.py_str(value, kind.simpleString())
    return df.select("ord", "seq_id", "name", shown_as.alias("label")).join(points, "ord")
