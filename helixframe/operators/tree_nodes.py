"""Node tables (`node`, `parent`, `name`, `branch_length`) as frames: ancestors, depths, pruning and consensus.

Ways to the root are followed by jumps that double, so the rounds grow with the logarithm of a tree's depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.storage import written


def doubled(hops: DataFrame) -> DataFrame:
    """`tree`, `node`, `up`: twice as far up as `hops`; nodes whose way ends before have no row."""
    return written(hops.select("tree", "node", F.col("up").alias("mid")).join(hops.select("tree", F.col("node").alias("mid"), "up"), ["tree", "mid"]).select("tree", "node", "up"))


def hops_of(nodes: DataFrame) -> DataFrame:
    return written(nodes.where("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("up")))


def ancestors(nodes: DataFrame) -> DataFrame:
    """`tree`, `node`, `up`: every node with each of its proper ancestors."""
    hops = hops_of(nodes)
    found = hops
    while not hops.isEmpty():
        further = hops.select("tree", "node", F.col("up").alias("mid")).join(found.select("tree", F.col("node").alias("mid"), "up"), ["tree", "mid"]).select("tree", "node", "up")
        found, hops = written(found.unionByName(further)), doubled(hops)
    return found


def leaves_of(nodes: DataFrame, *keys: str) -> DataFrame:
    inner = nodes.where("parent IS NOT NULL").select(*keys, F.col("parent").alias("node")).distinct()
    return nodes.join(inner, [*keys, "node"], "left_anti")


def depths(nodes: DataFrame) -> DataFrame:
    """`node`, `depth`: the branch lengths from the root added up."""
    state = written(nodes.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0.0).otherwise(F.col("branch_length")).alias("depth")))
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = written(state.join(above, "up", "left").select("node", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0.0))).alias("depth")))
    return state.select("node", "depth")


def prune_nodes(nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """The tree of the taxa whose names are in `keep(name)`; nodes left with one child are joined with it.

    The result has a root of length 0 where the old root goes. Names that no leaf has are passed over; no taxon left is
    an error. Inner nodes keep their numbers and names.
    """
    names = keep.select("name").where("name IS NOT NULL").distinct()
    taxa = written(leaves_of(nodes).join(names, "name", "left_semi").select("node"))
    if taxa.isEmpty():
        raise ValueError("no taxon is left in the tree")
    hops, needed = hops_of(nodes.withColumn("tree", F.lit(0))), taxa
    while not hops.isEmpty():  # all nodes on the ways of kept taxa to the root
        needed = written(needed.unionByName(hops.join(needed, "node", "left_semi").select(F.col("up").alias("node"))).distinct())
        hops = doubled(hops)
    own = nodes.join(needed, "node", "left_semi")
    kids = own.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    marked = own.join(kids, "node", "left").join(taxa.withColumn("taxon", F.lit(True)), "node", "left")
    stays = F.coalesce("taxon", F.lit(False)) | (F.coalesce("kids", F.lit(0)) > 1)
    state = written(marked.select("node", F.col("parent").alias("up"), "name", F.coalesce("branch_length", F.lit(0.0)).alias("length"), stays.alias("stays"), F.col("parent").isNull().alias("root")))
    while True:  # a pointer to a node that goes becomes that node's pointer
        gone = state.where(~F.col("stays")).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("length").alias("more"))
        if state.join(gone, "up", "left_semi").isEmpty():
            break
        onto = state.join(gone.withColumn("passes", F.lit(True)), "up", "left")
        state = written(onto.select("node", F.when(F.col("passes"), F.col("next")).otherwise(F.col("up")).alias("up"), "name", (F.col("length") + F.coalesce("more", F.lit(0.0))).alias("length"), "stays", "root"))
    length = F.when(F.col("up").isNull() & ~F.col("root"), 0.0).otherwise(F.col("length"))
    return state.where("stays").select("node", F.col("up").alias("parent"), "name", length.alias("branch_length"))


def taxon_records(nodes: DataFrame, collection: DataFrame) -> DataFrame:
    """The records of a collection that are taxa of the tree; taxa without a record have no row, as many rows as records of that name."""
    return collection.join(leaves_of(nodes).select("name").distinct(), "name", "left_semi")


def splits(nodes: DataFrame, alignment: DataFrame) -> DataFrame:
    """`tree`, `names`, `branch_length`: the taxa on one side of each inner branch, the side without the first of all names.

    Two branches of one split, as on both sides of a root, are added up.
    """
    taxa = nodes.where("name IS NOT NULL").select("tree", "node", "name")
    below = ancestors(nodes).join(taxa, ["tree", "node"]).groupBy("tree", F.col("up").alias("node")).agg(F.array_sort(F.collect_list("name")).alias("below"))
    everything = alignment.agg(F.min("name").alias("first"), F.array_sort(F.collect_set("name")).alias("all"))  # one row
    side = F.when(F.array_contains("below", F.col("first")), F.array_except("all", "below")).otherwise(F.col("below"))
    branches = nodes.where("parent IS NOT NULL").select("tree", "node", "branch_length").join(below, ["tree", "node"]).join(F.broadcast(everything))
    inner = branches.select("tree", F.array_sort(side).alias("names"), "branch_length", F.size("all").alias("n")).where((F.size("names") > 1) & (F.size("names") < F.col("n") - 1))
    return inner.groupBy("tree", "names").agg(F.sum("branch_length").alias("branch_length"))


def nested(groups: DataFrame, taxa: DataFrame) -> DataFrame:
    """`node`, `parent`, `name`, `support`, `branch_length`: the tree of compatible groups and its taxa, its root first.

    `groups(names, support, branch_length)` are nested or disjoint, and `taxa(name, branch_length)` are all taxa. A group
    hangs on the smallest larger one that holds its first name, since one that holds a name of it holds it whole; a
    taxon hangs on the smallest group that holds it. What no group holds hangs on the root.
    """
    group = groups.select(F.array_join("names", "\u0001").alias("key"), F.size("names").alias("n"), F.get("names", F.lit(0)).alias("member"), "names", "support", "branch_length")
    leaf = taxa.select(F.concat(F.lit("\u0002"), "name").alias("key"), F.lit(0).alias("n"), F.col("name").alias("member"), "name", F.lit(None).cast("double").alias("support"), "branch_length")
    items = written(group.drop("names").withColumn("name", F.lit(None).cast("string")).unionByName(leaf))
    holding = group.select(F.explode("names").alias("member"), F.col("key").alias("up"), F.col("n").alias("wide"))
    above = items.join(holding, "member").where("wide > n").groupBy("key").agg(F.min(F.struct("wide", "up"))["up"].alias("up"))
    numbered = written(items.join(above, "key", "left").withColumn("node", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "key"))))  # as many rows as the tree has nodes
    parents = numbered.select(F.col("key").alias("up"), F.col("node").alias("parent"))
    root = items.sparkSession.range(1).select(F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("support"), F.lit(0.0).alias("branch_length"))
    return root.unionByName(numbered.join(parents, "up", "left").select("node", F.coalesce("parent", F.lit(0)).alias("parent"), "name", "support", "branch_length"))
