"""Distances between aligned rows, neighbour joining and UPGMA, bootstrap support and node tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators.alignment import BLOSUM_LETTERS, blosum
from helixframe.operators.profiles import check_aligned
from helixframe.operators.storage import written
from helixframe.operators.tree_joining import joined
from helixframe.operators.tree_nodes import depths, nested, splits


def identity_distance(a: Column, b: Column) -> Column:
    """1 less the share of equal places, two gaps counting as equal."""
    same = F.size(F.filter(F.zip_with(S.symbols(a), S.symbols(b), lambda x, y: x == y), lambda e: e))
    return 1 - same / F.char_length(a)


def blosum_distance(a: Column, b: Column) -> Column:
    """1 less the pair's BLOSUM62 score over the larger of the two self scores, at the places where neither has a gap."""
    scores = F.create_map(*[x for i in BLOSUM_LETTERS for j in BLOSUM_LETTERS for x in (F.lit(i + j), F.lit(float(blosum()[ord(i), ord(j)])))])
    score = lambda x, y: F.coalesce(F.try_element_at(scores, F.concat(x, y)), F.lit(-4.0))
    both = F.filter(F.arrays_zip(S.symbols(a).alias("x"), S.symbols(b).alias("y")), lambda p: (p["x"] != "-") & (p["y"] != "-") & (p["x"] != "*") & (p["y"] != "*"))
    add = lambda p, f: F.aggregate(F.transform(p, f), F.lit(0.0), lambda s, v: s + v)
    return S.let(both, lambda p: 1 - F.try_divide(add(p, lambda q: score(q["x"], q["y"])), F.greatest(add(p, lambda q: score(q["x"], q["x"])), add(p, lambda q: score(q["y"], q["y"])))))


DISTANCES = {"identity": identity_distance, "blosum62": blosum_distance}


def distances(alignment: DataFrame, model: str = "identity") -> DataFrame:
    """`a`, `b`, `distance` of all pairs a < b of an alignment's rows (name, sequence); rows of different lengths are an error."""
    if model not in DISTANCES:
        raise ValueError(f"unknown model {model!r}: use one of {', '.join(DISTANCES)}")
    check_aligned(alignment)
    left, right = alignment.select(F.col("name").alias("a"), F.col("sequence").alias("sa")), alignment.select(F.col("name").alias("b"), F.col("sequence").alias("sb"))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", DISTANCES[model](F.col("sa"), F.col("sb")).alias("distance"))


def tree(pairs: DataFrame, method: str = "nj") -> DataFrame:
    """node, parent, name, branch_length: the tree of `pairs(a, b, distance)`, which cover all pairs of its taxa.

    Neighbour joining leaves three branches at the root, UPGMA two.
    """
    return joined(pairs.withColumn("tree", F.lit(0)), method).drop("tree")


def bootstrap_trees(alignment: DataFrame, replicates: int = 100, method: str = "nj", seed: int = 0) -> DataFrame:
    """Node tables (tree, node, parent, name, branch_length) of alignments whose columns are drawn anew.

    A replicate draws as many columns as there are, each by a hash of replicate and place; the differences of each pair
    are added up by columns, and all replicates' trees are joined together.
    """
    width = check_aligned(alignment)
    rows = alignment.select("name", F.posexplode(S.symbols(F.col("sequence"))).alias("column", "letter"))
    left, right = rows.withColumnsRenamed({"name": "a", "letter": "x"}), rows.withColumnsRenamed({"name": "b", "letter": "y"})
    differ = left.join(right, "column").where("a < b").select("a", "b", "column", (F.col("x") != F.col("y")).cast("long").alias("differs"))
    spark = alignment.sparkSession
    draws = spark.range(replicates).select(F.col("id").alias("tree"), F.explode(F.sequence(F.lit(1), F.lit(width))).alias("draw"))
    drawn = draws.select("tree", F.pmod(F.xxhash64(F.lit(seed), "tree", "draw"), F.lit(width)).cast("int").alias("column")).groupBy("tree", "column").agg(F.count("*").alias("times"))
    return joined(differ.join(drawn, "column").groupBy("tree", "a", "b").agg((F.sum(F.col("differs") * F.col("times")) / width).alias("distance")), method)


def bootstrap_support(alignment: DataFrame, replicates: int = 100, method: str = "nj", seed: int = 0) -> DataFrame:
    """`split`, `support` in percent: how often a group of taxa is parted from the rest in trees of resampled columns.

    A split is named by its side without the first taxon.
    """
    found = splits(bootstrap_trees(alignment, replicates, method, seed), alignment)
    return found.groupBy(F.array_join("names", ",").alias("split")).agg((F.count("*") * 100.0 / replicates).alias("support"))


def consensus_tree(alignment: DataFrame, replicates: int = 100, method: str = "nj", seed: int = 0, more_than: float = 50.0) -> DataFrame:
    """`node`, `parent`, `name`, `support`, `branch_length`: the majority consensus of the bootstrap trees.

    Its groups are the splits in more than `more_than` percent of the replicates, by their side without the first taxon;
    50 is the least allowed, since from there on groups cannot cross. Lengths are means over the replicates that have the branch.
    """
    if not 50 <= more_than <= 100:
        raise ValueError("a majority consensus takes splits in more than 50 percent or higher")
    nodes = written(bootstrap_trees(alignment, replicates, method, seed))
    found = splits(nodes, alignment).groupBy("names").agg((F.count("*") * 100.0 / replicates).alias("support"), F.avg("branch_length").alias("branch_length"))
    taxa = nodes.where("name IS NOT NULL").groupBy("name").agg(F.avg("branch_length").alias("branch_length"))
    return nested(found.where(F.col("support") > more_than), taxa)


def to_newick(nodes: list[tuple]) -> str:
    children: dict = {}
    for row in nodes:
        children.setdefault(row[1], []).append(row)

    def text(row: tuple) -> str:
        kids = children.get(row[0], [])
        inner = f"({','.join(map(text, kids))})" if kids else ""
        return f"{inner}{row[2] or ''}:{row[3]:.5f}"

    return text(children[None][0]).rpartition(":")[0] + ";"


def parse_newick(text: str) -> list[tuple[int, int | None, str | None, float]]:
    """The node table of a Newick tree, its root first."""
    nodes: list[list] = [[0, None, None, 0.0]]
    at = 0
    for token in re.findall(r"'[^']*'|[(),;]|:[^(),;]+|[^(),:;\s]+", text):
        if token in ("(", ","):  # a first child of this node, or the next child of its parent
            parent = at if token == "(" else nodes[at][1]
            nodes.append([len(nodes), parent, None, 0.0])
            at = len(nodes) - 1
        elif token == ")":
            at = nodes[at][1]
        elif token == ";":
            break
        elif token[0] == ":":
            nodes[at][3] = float(token[1:])
        else:
            nodes[at][2] = token.strip("'")
    return [tuple(n) for n in nodes]


def summary(nodes: DataFrame) -> DataFrame:
    """One row: taxa and their names, inner nodes, total branch length and the largest depth of a node table."""
    inner = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    marked = nodes.join(inner, "node", "left").join(depths(nodes), "node")
    leaf = F.col("inner").isNull()
    return marked.agg(F.count(F.when(leaf, 1)).alias("n_taxa"), F.count("inner").alias("n_internal"), F.sum("branch_length").alias("total_branch_length"), F.max("depth").alias("max_depth"), F.sort_array(F.collect_list(F.when(leaf, F.col("name")))).alias("taxa"))


def plot_data(nodes: DataFrame) -> DataFrame:
    """What a tree plot draws: `node`, `parent`, `name`, `x` (depth) and `y` (the taxon's place by name; null for inner nodes)."""
    names = nodes.where("name IS NOT NULL").select("node", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name")).alias("y"))
    return nodes.join(depths(nodes), "node").join(names, "node", "left").select("node", "parent", "name", F.col("depth").alias("x"), "y")


def newick_nodes(spark: SparkSession, text: str) -> DataFrame:
    """The node table of a Newick text as a frame."""
    return spark.createDataFrame(parse_newick(text), "node int, parent int, name string, branch_length double")


def prune(nodes: list[tuple], keep: set[str]) -> list[tuple]:
    """The tree of the taxa in `keep`; nodes left with one child are joined with it. Nothing left is an error."""
    rows = {r[0]: list(r) for r in nodes}
    parents = {r[1] for r in nodes}
    leaves = [r[0] for r in nodes if r[0] not in parents]
    for leaf in leaves:
        if rows[leaf][2] not in keep:
            del rows[leaf]
    changed = True
    while changed:
        changed = False
        count: dict = {}
        for r in rows.values():
            count.setdefault(r[1], []).append(r)
        for node in list(rows):
            kids = count.get(node, [])
            if node not in leaves and len(kids) < 2:
                row = rows.pop(node)
                if kids:
                    kids[0][1], kids[0][3] = row[1], (kids[0][3] + row[3] if row[1] is not None else 0.0)
                changed = True
                break
    if not rows:
        raise ValueError("no taxon is left in the tree")
    return [tuple(r) for r in rows.values()]
