"""Trees against plain loops: joining in rounds and in tasks, ancestors, pruning, splits and consensus."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from helixframe.operators import tree_joining, tree_nodes, trees

PAIRS = "a string, b string, distance double"
NODES = "node int, parent int, name string, branch_length double"


def matrix(n, seed, digits=3):
    rng = random.Random(seed)
    points = [[rng.random() for _ in range(4)] for _ in range(n)]
    return {(i, j): round(sum(abs(x - y) for x, y in zip(points[i], points[j], strict=True)), digits) for i in range(n) for j in range(i + 1, n)}


def loop(d, n, method):
    """Edges (node, parent, length) of merging one pair at a time, clusters numbered as they come."""
    d = {**d, **{(j, i): v for (i, j), v in d.items()}}
    active, size, height, edges, new = list(range(n)), [1.0] * n, [0.0] * n, [], n
    while len(active) > (3 if method == "nj" else 1):
        m = len(active)
        r = {i: sum(d[i, k] for k in active if k != i) for i in active}
        q = lambda i, j: round((m - 2) * d[i, j] - r[i] - r[j] if method == "nj" else d[i, j], 12)
        i, j = min(((i, j) for i in active for j in active if i < j), key=lambda p: (q(*p), *p))
        one = d[i, j] / 2 + (r[i] - r[j]) / (2 * (m - 2)) if method == "nj" else d[i, j] / 2 - height[i]
        edges += [(i, new, one), (j, new, d[i, j] - one if method == "nj" else d[i, j] / 2 - height[j])]
        active = [k for k in active if k not in (i, j)]
        for k in active:
            d[new, k] = d[k, new] = (d[i, k] + d[j, k] - d[i, j]) / 2 if method == "nj" else (d[i, k] * size[i] + d[j, k] * size[j]) / (size[i] + size[j])
        size.append(size[i] + size[j])
        height.append(d[i, j] / 2)
        active.append(new)
        new += 1
    if method == "nj":
        for i in active:
            others = [k for k in active if k != i]
            edges.append((i, new, (sum(d[i, k] for k in others) - d[tuple(others)]) / 2 if len(others) == 2 else d[i, others[0]] / 2))
    return edges


def clades(edges, names):
    """The taxa below each branch, with its length."""
    kids, length = {}, {}
    for node, parent, x in edges:
        kids.setdefault(parent, []).append(node)
        length[node] = x
    below = lambda v: frozenset([names[v]]) if v not in kids else frozenset().union(*[below(k) for k in kids[v]])
    return {below(v): x for v, x in length.items()}


@pytest.mark.parametrize("method", ["nj", "upgma"])
@pytest.mark.parametrize("finish", [4, 512])
def test_trees_are_those_of_a_loop(spark, monkeypatch, method, finish):
    monkeypatch.setattr(tree_joining, "FINISH", finish)
    n = 30 if finish == 512 else 14 if method == "upgma" else 7
    d, names = matrix(n, 3), [f"t{i:03d}" for i in range(n)]
    # every other pair is given the other way round
    rows = [(names[i], names[j], v) if (i + j) % 2 else (names[j], names[i], v) for (i, j), v in d.items()]
    got = [tuple(r) for r in trees.tree(spark.createDataFrame(rows, PAIRS), method).collect()]
    root = [g for g in got if g[1] is None]
    assert len(root) == 1 and root[0][3] == 0 and sorted(g[0] for g in got) == list(range(len(got)))
    assert {g[0]: g[2] for g in got if g[2]} == dict(enumerate(names))
    found, meant = clades([(g[0], g[1], g[3]) for g in got if g[1] is not None], names), clades(loop(d, n, method), names)
    assert found.keys() == meant.keys() and all(abs(found[c] - meant[c]) < 1e-9 for c in meant)


def test_small_and_many_trees(spark):
    two = trees.tree(spark.createDataFrame([("b", "a", 3.0)], PAIRS)).collect()
    assert sorted((r["name"] or "", r["branch_length"]) for r in two) == [("", 0.0), ("a", 1.5), ("b", 1.5)]
    assert trees.tree(spark.createDataFrame([], PAIRS)).count() == 0
    equal = spark.createDataFrame([(t, a, b, 1.0) for t in range(3) for a, b in ("xy", "xz", "yz")], "tree int, " + PAIRS)
    assert {(r["tree"], r["count"]) for r in tree_joining.joined(equal, "upgma").groupBy("tree").count().collect()} == {(0, 5), (1, 5), (2, 5)}


def test_ties_in_rounds(spark, monkeypatch):
    rows = spark.createDataFrame([(f"t{i}", f"t{j}", 2.0) for i in range(5) for j in range(i + 1, 5)], PAIRS)
    whole = sorted(r["branch_length"] for r in trees.tree(rows, "upgma").collect())
    monkeypatch.setattr(tree_joining, "FINISH", 2)
    assert sorted(r["branch_length"] for r in trees.tree(rows, "upgma").collect()) == whole == [0.0] * 4 + [1.0] * 5


@pytest.mark.parametrize("method", ["nj", "upgma"])
def test_two_hundred_taxa(spark, method):
    d = matrix(200, 5)
    rows = spark.createDataFrame([(f"t{i:03d}", f"t{j:03d}", v) for (i, j), v in d.items()], PAIRS)
    start = time.time()
    assert trees.tree(rows, method).count() == (398 if method == "nj" else 399)
    assert time.time() - start < 120


def chain(n):
    """A caterpillar of n taxa, its inner nodes in a row, of lengths that tell them apart."""
    nodes = [(0, None, None, 0.0)]
    for i in range(1, n):
        nodes += [(2 * i - 1, 2 * i - 2 if i > 1 else 0, f"x{i}", 0.5 + i), (2 * i, 2 * i - 2 if i > 1 else 0, None if i < n - 1 else f"x{n}", 1.0 + i / 8)]
    return nodes


def shape(nodes):
    """Leaf names to their ways to the root, as (length, names below) of each branch."""
    nodes = [tuple(n)[:4] for n in nodes]
    leaf_names = {n[0]: n[2] for n in nodes}
    found = clades([(n[0], n[1], n[3]) for n in nodes if n[1] is not None], leaf_names)
    return {c: round(v, 9) for c, v in found.items()}


@pytest.mark.parametrize("keep", [{"x1", "x5", "x9"}, {"x3"}, {"x8", "x9", "no such"}])
def test_prune_is_that_of_a_loop(spark, keep):
    nodes = chain(9)
    got = tree_nodes.prune_nodes(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(k,) for k in [*keep, None]], "name string")).collect()
    assert {tuple(r)[:3] for r in got} == {n[:3] for n in trees.prune(nodes, keep)} and shape(got) == shape(trees.prune(nodes, keep))
    assert [r["branch_length"] for r in got if r["parent"] is None] == [0.0]


def test_prune_to_nothing_is_an_error(spark):
    with pytest.raises(ValueError):
        tree_nodes.prune_nodes(spark.createDataFrame(chain(4), NODES), spark.createDataFrame([("y",)], "name string"))


def test_ancestors_depths_and_records(spark):
    nodes = chain(9)
    frame = spark.createDataFrame([(7, *n) for n in nodes], "tree int, " + NODES)
    up, length = {n[0]: n[1] for n in nodes}, {n[0]: n[3] for n in nodes}

    def way(v):
        return [] if up[v] is None else [up[v], *way(up[v])]

    assert {(r["node"], r["up"]) for r in tree_nodes.ancestors(frame).collect()} == {(v, a) for v in up for a in way(v)}
    depth = {r["node"]: r["depth"] for r in tree_nodes.depths(frame.drop("tree")).collect()}
    assert all(abs(depth[v] - sum(length[x] for x in [v, *way(v)])) < 1e-9 for v in up)
    collection = spark.createDataFrame([("x1", 1), ("x1", 2), ("zz", 3), (None, 4)], "name string, ord int")
    assert sorted(r["ord"] for r in tree_nodes.taxon_records(frame, collection).collect()) == [1, 2]


def test_consensus_tree(spark):
    rng = random.Random(2)
    base = {c: "".join(rng.choice("ACGT") for _ in range(40)) for c in "pq"}
    mutate = lambda s, n: "".join(rng.choice("ACGT") if i in rng.sample(range(40), n) else c for i, c in enumerate(s))
    rows = [(f"{c}{i}", mutate(base[c], 6)) for c in "pq" for i in range(4)]
    alignment = spark.createDataFrame(rows, "name string, sequence string")
    support = {frozenset(r["split"].split(",")): r["support"] for r in trees.bootstrap_support(alignment, 30, seed=1).collect()}
    tree = [tuple(r) for r in trees.consensus_tree(alignment, 30, seed=1).collect()]
    kids = {}
    for r in tree:
        kids.setdefault(r[1], []).append(r)
    below = lambda r: {r[2]} if r[2] else set().union(*[below(k) for k in kids[r[0]]])
    groups = {frozenset(below(r)): r[3] for r in tree if r[3] is not None}
    assert groups == {s: v for s, v in support.items() if v > 50} and frozenset(f"q{i}" for i in range(4)) in groups
    for r in tree:  # every group hangs on the smallest that holds it
        if r[1] is not None:
            own = frozenset(below(r))
            holding = [g for g in groups if own < g]
            assert frozenset(below(next(t for t in tree if t[0] == r[1]))) == (min(holding, key=len) if holding else frozenset(n for n, _ in rows))
    assert sorted(r[2] for r in tree if r[2]) == sorted(n for n, _ in rows) and all(r[4] is not None for r in tree)
    with pytest.raises(ValueError):
        trees.consensus_tree(alignment, 3, more_than=30)
    assert np.isfinite([r[4] for r in tree]).all()
