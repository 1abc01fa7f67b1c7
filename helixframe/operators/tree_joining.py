"""Neighbour joining and UPGMA of many trees at once, by rounds over one frame of distances.

The frame has a row for each pair of clusters that are left, `tree, i, j, distance, x, y`: the clusters are named by their
least taxon, i < j, and x and y hold the node number, size and height of each. Names of taxa stay out of it. A round takes
one partial aggregate to find what merges and one pass that rewrites the rows of merged clusters alone; the matrix itself is
never shuffled. UPGMA merges all clusters of a tree that are each other's nearest in one round, which gives the heights of
merging one pair at a time, since an average never comes nearer than its parts. The criterion of neighbour joining changes
with every merge, so a round makes one merge in each tree. Trees of FINISH clusters or fewer are a bounded matrix, so
each of them is finished in a task of its own.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.storage import written

#: Clusters of a tree that one task finishes: at most 130,816 rows and a matrix of 2 MB.
FINISH = 512
#: Rows of clusters, trees times taxa, that are broadcast in a round; a row has 60 bytes.
BROADCAST = 100_000
EDGES = "tree long, node long, parent long, branch_length double"


def cluster(node: Column, size: Column, height: Column) -> Column:
    return F.struct(node.cast("long").alias("node"), size.cast("long").alias("size"), height.cast("double").alias("height"))


def ordered(measure: Column) -> tuple[Column, ...]:
    """The order in which pairs merge: by a measure to twelve places, then by the numbers of both nodes."""
    return F.round(measure, 12).alias("q"), F.least("x.node", "y.node").alias("low"), F.greatest("x.node", "y.node").alias("high")


def each_end(*values: Column | str) -> list:
    return ["tree", F.explode(F.array("i", "j")).alias("c"), *values]


def neighbours(d: DataFrame, left: int, small) -> DataFrame:
    """The pair of each tree that neighbour joining merges, with the lengths of both branches."""
    sums = d.select(*each_end("distance")).groupBy("tree", "c").agg(F.sum("distance").alias("r"))
    of = lambda end, r: small(sums.select("tree", F.col("c").alias(end), F.col("r").alias(r)))
    known = d.join(of("i", "r"), ["tree", "i"]).join(of("j", "s"), ["tree", "j"])
    row = F.struct(*ordered((left - 2) * F.col("distance") - F.col("r") - F.col("s")), "i", "j", "distance", "r", "s", "x", "y")
    first = F.col("distance") / 2 + (F.col("r") - F.col("s")) / (2 * (left - 2))
    best = known.groupBy("tree").agg(F.min(row).alias("m")).select("tree", "m.*")
    return best.select("tree", "i", "j", "distance", "x", "y", first.alias("first"), (F.col("distance") - first).alias("second"))


def mutual(d: DataFrame) -> DataFrame:
    """All pairs of clusters that are each other's nearest, with the lengths of both branches."""
    near = d.select(*each_end(F.struct(*ordered(F.col("distance")), "i", "j", "distance", "x", "y").alias("m"))).groupBy("tree", "c").agg(F.min("m").alias("m"))
    both = near.groupBy("tree", "m").agg(F.count("*").alias("n")).where("n = 2").select("tree", "m.*")
    return both.select("tree", "i", "j", "distance", "x", "y", (F.col("distance") / 2 - F.col("x.height")).alias("first"), (F.col("distance") / 2 - F.col("y.height")).alias("second"))


def merged(d: DataFrame, best: DataFrame, method: str, small) -> DataFrame:
    """The distances after the merges of `best`, whose `z` is the new cluster; a new cluster is named as its first part."""
    ends = best.select(*each_end(F.col("i").alias("to"), "z", F.col("distance").alias("between")))
    of = lambda end, n: small(ends.select("tree", F.col("c").alias(end), *[F.col(c).alias(c + n) for c in ("to", "z", "between")]))
    known = d.join(of("i", "1"), ["tree", "i"], "left").join(of("j", "2"), ["tree", "j"], "left")
    untouched = known.where("to1 IS NULL AND to2 IS NULL").select(*d.columns)
    moved = known.where("to1 IS NOT NULL OR to2 IS NOT NULL").select(
        "tree", F.coalesce("to1", "i").alias("a"), F.coalesce("to2", "j").alias("b"), F.coalesce("z1", "x").alias("p"), F.coalesce("z2", "y").alias("q"),
        "distance", (F.col("x.size") * F.col("y.size")).alias("weight"), F.coalesce("between1", "between2").alias("between"),
    ).where("a <> b")
    turned = lambda low, high: F.when(F.col("a") < F.col("b"), F.col(low)).otherwise(F.col(high))
    placed = moved.select("tree", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), turned("p", "q").alias("x"), turned("q", "p").alias("y"), "distance", "weight", "between")
    distance = (F.sum("distance") - F.first("between")) / 2 if method == "nj" else F.sum(F.col("distance") * F.col("weight")) / F.sum("weight")
    return untouched.unionByName(placed.groupBy("tree", "i", "j").agg(distance.alias("distance"), F.first("x").alias("x"), F.first("y").alias("y")))


def finished(d: DataFrame, method: str, first_node: int) -> DataFrame:
    """The edges of what is left of every tree, at most FINISH clusters; new nodes are numbered from `first_node` on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = pd.concat([pdf[["i", "node_x", "size_x", "height_x"]].set_axis(["c", "node", "size", "height"], axis=1), pdf[["j", "node_y", "size_y", "height_y"]].set_axis(["c", "node", "size", "height"], axis=1)])
        own = ends.drop_duplicates("c").sort_values("node")
        place = pd.Series(range(len(own)), index=own["c"])
        m = np.zeros((len(own), len(own)))
        at, to = place[pdf["i"]].to_numpy(), place[pdf["j"]].to_numpy()
        m[at, to] = m[to, at] = pdf["distance"]
        node, size, height = own["node"].to_numpy().astype(np.int64), own["size"].to_numpy().astype(float), own["height"].to_numpy()
        new, edges = first_node, []
        while len(m) > (3 if method == "nj" else 1):
            r = m.sum(1) if method == "nj" else np.zeros(len(m))
            q = np.round((len(m) - 2) * m - r[:, None] - r[None, :], 12) if method == "nj" else np.round(m, 12)
            q[np.tril_indices(len(m))] = np.inf  # rows are in the order of nodes, so the first least entry is that of least numbers
            a, b = divmod(int(q.argmin()), len(m))
            between, rest = m[a, b], np.delete(np.arange(len(m)), [a, b])
            if method == "nj":
                one = between / 2 + (r[a] - r[b]) / (2 * (len(m) - 2))
                lengths, row = (one, between - one), (m[a] + m[b] - between)[rest] / 2
            else:
                lengths, row = (between / 2 - height[a], between / 2 - height[b]), ((m[a] * size[a] + m[b] * size[b]) / (size[a] + size[b]))[rest]
            edges += [(node[a], new, lengths[0]), (node[b], new, lengths[1])]
            m = np.block([[m[np.ix_(rest, rest)], row[:, None]], [row[None, :], np.zeros((1, 1))]])
            node, size, height = np.append(node[rest], new), np.append(size[rest], size[a] + size[b]), np.append(height[rest], between / 2)
            new += 1
        if method == "nj":  # the last three, or two, hang on the root
            r, whole = m.sum(1), m.sum() / 2
            edges += [(x, new, r[k] - whole / 2 if len(m) == 3 else r[k] / 2) for k, x in enumerate(node)]
        return pd.DataFrame(edges, columns=["node", "parent", "branch_length"]).assign(tree=pdf["tree"].iloc[0])[["tree", "node", "parent", "branch_length"]]

    flat = d.select("tree", "i", "j", "distance", *[F.col(f"{e}.{c}").alias(f"{c}_{e}") for e in "xy" for c in ("node", "size", "height")])
    return flat.groupBy("tree").applyInPandas(run, EDGES)


def joined(pairs: DataFrame, method: str) -> DataFrame:
    """Node tables (tree, node, parent, name, branch_length) of all trees of `pairs(tree, a, b, distance)`.

    The pairs are all pairs of taxa of each tree, once in either order, as many taxa in each. Taxa are numbered by name,
    inner nodes by the order of merges. Ties merge by the numbers of the nodes. No pairs give no nodes.
    """
    if method not in ("nj", "upgma"):
        raise ValueError(f"unknown method {method!r}: use nj or upgma")
    pairs = pairs.withColumn("tree", F.col("tree").cast("long"))
    taxa = pairs.select("tree", F.explode(F.array("a", "b")).alias("name")).distinct()
    leaves = written(taxa.withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy("name")).cast("long") - 1))
    n, trees = leaves.groupBy("tree").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.count("*")).first()
    small = F.broadcast if n * trees <= BROADCAST else lambda frame: frame
    leaf = lambda name, c: leaves.select("tree", F.col("name").alias(name), cluster(F.col("node"), F.lit(1), F.lit(0.0)).alias(c))
    numbered = pairs.join(leaf("a", "p"), ["tree", "a"]).join(leaf("b", "q"), ["tree", "b"])
    turned = lambda low, high: F.when(F.col("p.node") < F.col("q.node"), F.col(low)).otherwise(F.col(high))
    d = numbered.select("tree", F.least("p.node", "q.node").alias("i"), F.greatest("p.node", "q.node").alias("j"), F.col("distance").cast("double").alias("distance"), turned("p", "q").alias("x"), turned("q", "p").alias("y"))
    d, edges, left, rounds = written(d), [], n, 0
    while left > FINISH:
        found = neighbours(d, left, small) if method == "nj" else mutual(d)
        # the nodes of a round are numbered after all earlier ones, in the order of the clusters' names
        best = written(found.withColumn("z", cluster(n + rounds * n + F.col("i"), F.col("x.size") + F.col("y.size"), F.col("distance") / 2)))
        edges += [best.select("tree", F.col(f"{e}.node").alias("node"), F.col("z.node").alias("parent"), F.col(length).alias("branch_length")) for e, length in (("x", "first"), ("y", "second"))]
        d, rounds = written(merged(d, best, method, small)), rounds + 1
        # pairs left tell the clusters left: k clusters have k (k - 1) / 2
        most = 0 if method == "nj" else d.groupBy("tree").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        left = left - 1 if method == "nj" else int(round((1 + (1 + 8 * most) ** 0.5) / 2))
    whole = written(reduce(DataFrame.unionByName, edges, finished(d, method, n + rounds * n)))
    above = whole.select("tree", F.col("parent").alias("node")).distinct().join(whole.select("tree", "node"), ["tree", "node"], "left_anti")
    roots = above.select("tree", "node", F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("branch_length"))
    everything = whole.unionByName(roots).join(leaves, ["tree", "node"], "left")
    dense = written(everything.withColumn("number", F.row_number().over(Window.partitionBy("tree").orderBy("node")) - 1))
    parents = dense.select("tree", F.col("node").alias("parent"), F.col("number").alias("of"))
    return dense.join(parents, ["tree", "parent"], "left").select("tree", F.col("number").alias("node"), F.col("of").alias("parent"), "name", "branch_length")
