"""Similarity, profiles, clusters, evolution, alignment, trees, embedding and structures on small inputs."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import alignment, clustering, embedding, evolution, kmer_index, profiles, similarity, structure, trees
from helixframe.operators import linkage as linkage_module


def records(spark, sequences):
    df = spark.createDataFrame(list(enumerate(sequences)), "ord long, sequence string")
    return df.withColumn("seq_id", F.col("ord").cast("string")).withColumn("tags", F.array().cast("array<string>"))


def kmers(s, k):
    return {s[i : i + k] for i in range(len(s) - k + 1)} or {s}


def mutated(rng, n=40, size=120, changes=4):
    base = ["".join(rng.choice("ACGT") for _ in range(size)) for _ in range(4)]
    out = []
    for i in range(n):
        s = list(base[i % 4])
        for _ in range(rng.randrange(changes)):
            s[rng.randrange(size)] = rng.choice("ACGT")
        out.append("".join(s))
    return [*out, out[0], out[0], "", "AC"]


@pytest.fixture(scope="module")
def sequences():
    return mutated(random.Random(7))


def jaccard(a, b, k):
    x, y = kmers(a, k), kmers(b, k)
    return len(x & y) / len(x | y)


def test_similar_pairs_lose_none(spark, sequences):
    first = {}
    for i, s in enumerate(sequences):
        first.setdefault(s, i)
    own = [(i, s) for s, i in first.items() if s]
    want = {(i, j) for i, a in own for j, b in own if i < j and jaccard(a, b, 8) >= 0.6}
    got = {(r["a"], r["b"]) for r in similarity.similar_pairs(records(spark, sequences), 8, 0.6).collect()}
    assert got == want and want


@pytest.mark.parametrize("frequent, threshold", [(4096, 0.5), (4, 0.8), (1, 0.7)])
def test_similar_pairs_of_uneven_sizes(spark, monkeypatch, frequent, threshold):
    """Parts, near copies and sequences of one common passage; frequencies by a broadcast, by both ways or by the join alone."""
    rng = random.Random(11)
    base, common = ["".join(rng.choice("ACGT") for _ in range(90)) for _ in range(3)], "ACGTTGCATTGACC"
    rows = sorted({b[:size] + tail for b in base for size in (40, 60, 72, 81, 90) for tail in ("", common, rng.choice("ACGT"))})
    monkeypatch.setattr(similarity, "FREQUENT", frequent)
    want = {(i, j) for j, b in enumerate(rows) for i, a in enumerate(rows[:j]) if jaccard(a, b, 6) >= threshold}
    got = [(r["a"], r["b"], round(r["score"], 9)) for r in similarity.similar_pairs(records(spark, rows), 6, threshold).collect()]
    assert sorted(got) == sorted((i, j, round(jaccard(rows[i], rows[j], 6), 9)) for i, j in want) and len(want) > 20


def test_search(spark, sequences):
    hits = similarity.search(records(spark, sequences), sequences[0], k=4, top_n=4).collect()
    assert [h["ord"] for h in hits][:1] == [0] and [h["score"] for h in hits] == [1.0] * 4
    mh = similarity.search(records(spark, sequences), sequences[0], "minhash", top_n=3).collect()
    assert {h["ord"] for h in mh} >= {0} and mh[0]["score"] == 1.0
    with pytest.raises(ValueError):
        similarity.search(records(spark, sequences), "A", "other")


def greedy_loop(sequences, k, t):
    out, seeds = {}, []
    for i in sorted((i for i, s in enumerate(sequences) if s), key=lambda i: (-len(sequences[i]), i)):
        home = next((c for c in seeds if jaccard(sequences[i], sequences[c], k) >= t), None)
        if home is None:
            seeds.append(i)
            home = i
        out[i] = home
    return out


def test_greedy_is_that_of_a_loop(spark, sequences):
    got = {r["ord"]: r["cluster"] for r in clustering.greedy(records(spark, sequences), 8, 0.6).collect()}
    assert got == greedy_loop(sequences, 8, 0.6)


def test_hierarchical(spark, sequences):
    df = records(spark, sequences)
    for linkage in clustering.LINKAGES:
        rows = clustering.hierarchical(df, 8, linkage, 0.4).collect()
        assert len(rows) == sum(map(bool, sequences)) and {r["cluster"] for r in rows if r["ord"] in (0, 40, 41)} == {0}
    with pytest.raises(ValueError):
        clustering.hierarchical(df, linkage="other")
    d = np.array([[0, 1, 5, 9], [1, 0, 3, 8], [5, 3, 0, 2.5], [9, 8, 2.5, 0]], dtype=float)
    groups = lambda linkage, t: clustering.link(d, linkage, t, np.ones(4)).tolist()
    assert groups("complete", 4) == [0, 0, 2, 2] and groups("single", 3) == [0, 0, 0, 0] and groups("average", 6.25) == [0, 0, 0, 0] and groups("average", 6.2) == [0, 0, 2, 2]


def test_consensus_and_medoid(spark):
    df = records(spark, ["ACGT", "ACGT", "ACAT", "GG", "GGG"])
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)], "ord long, cluster long")
    assert {tuple(r) for r in clustering.consensus(df, clusters).collect()} == {(0, "ACGT", False), (3, "GGG", True)}
    assert {tuple(r) for r in clustering.medoids(df, clusters, 2).collect()} == {(0, 0), (3, 3)}
    tags = {r["ord"]: r["tags"] for r in clustering.annotate(df, clusters).collect()}
    assert tags[4] == ["cluster_3", "cluster_representative"] and "cluster_centroid" in tags[0]


def test_profile(spark):
    df = records(spark, ["ACGT", "ACGT", "ACGT", "ACAT"])
    assert profiles.check_aligned(df) == 4
    table = {r["position"]: r for r in profiles.pfm(df).collect()}
    assert (table[1]["count_A"], table[1]["count_gap"], table[3]["count_G"]) == (4, 0, 3)
    summary = profiles.conservation_summary(df).first()
    assert summary["consensus"] == "ACGT" and summary["least_conserved"] == 3 and summary["most_conserved"] == 1
    tie = profiles.pfm(records(spark, ["A", "-"])).select(profiles.consensus().alias("c")).first()["c"]
    assert tie == "-"
    with pytest.raises(ValueError):
        profiles.check_aligned(records(spark, ["A", "AC"]))


def test_pssm(spark):
    counts = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0)], "position int, prob_A double, prob_C double, prob_G double, prob_T double")
    row = profiles.pwm(counts).first()
    assert row["pssm_A"] == 200 and row["pssm_C"] == -2000 and row["pwm_C"] == float("-inf")


def test_dn_ds(spark):
    pairs = spark.createDataFrame([("p", "ATGGGAAAAATTTAA", "ATGGGCAAAACTTAA"), ("same", "ATGAAA", "ATGAAA")], "pair string, a string, b string")
    got = {r["pair"]: r for r in evolution.dn_ds(pairs).collect()}
    assert [round(got["p"][c], 4) for c in ("dn", "ds", "omega")] == [0.1093, 0.7166, 0.1525]
    assert got["same"]["omega"] is None
    with pytest.raises(Exception, match="equally long"):
        evolution.dn_ds(spark.createDataFrame([("x", "ATG", "AT")], "pair string, a string, b string")).collect()


def plain_score(a, b, open_=-10.0, extend=-0.5):
    """Global score by the cubic definition: any gap length at every cell."""
    gap = lambda n: open_ + (n - 1) * extend
    best = {(0, 0): 0.0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                options = [best[i - 1, j - 1] + (2.0 if a[i - 1] == b[j - 1] else -1.0)] if i and j else []
                options += [best[i - n, j] + gap(n) for n in range(1, i + 1)] + [best[i, j - n] + gap(n) for n in range(1, j + 1)]
                best[i, j] = max(options)
    return best[len(a), len(b)]


def test_alignment(spark):
    rng = random.Random(3)
    for _ in range(15):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(12))) for _ in range(2))
        score, top, low = alignment.align(a, b)
        assert score == plain_score(a, b) and top.replace("-", "") == a and low.replace("-", "") == b and len(top) == len(low)
    pairs = spark.createDataFrame([(1, "TTACGTTT", "GGACGTGG")], "pair int, a string, b string")
    row = alignment.pairwise(pairs, mode="local").first()
    assert (row["score"], row["aligned_a"]) == (8.0, "ACGT")
    assert alignment.render("AC-T", "AGGT") == "AC-T\n|. |\nAGGT"


def test_trees(spark):
    names = ["a", "b", "c", "d", "e"]
    d = [[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]]
    pairs = spark.createDataFrame([(names[i], names[j], float(d[i][j])) for i in range(5) for j in range(i + 1, 5)], "a string, b string, distance double")
    nodes = [tuple(r) for r in trees.tree(pairs).collect()]
    assert len(nodes) == 2 * len(names) - 2 and abs(sum(n[3] for n in nodes) - 17) < 1e-9
    up = {n[0]: n for n in nodes}

    def way(x):
        node, out, total = next(n[0] for n in nodes if n[2] == x), {}, 0.0
        while node is not None:
            out[node], total, node = total, total + up[node][3], up[node][1]
        return out

    for i, x in enumerate(names):  # additive distances are those of the tree
        for j, y in enumerate(names):
            p, q = way(x), way(y)
            assert abs(min(p[n] + q[n] for n in p if n in q) - d[i][j]) < 1e-9
    back = trees.parse_newick(trees.to_newick(nodes))
    assert sorted(n[2] for n in back if n[2]) == names and abs(sum(n[3] for n in back) - 17) < 1e-3
    kept = trees.prune(nodes, {"a", "b", "d"})
    assert sorted(n[2] for n in kept if n[2]) == ["a", "b", "d"]
    with pytest.raises(ValueError):
        trees.prune(nodes, {"x"})
    upgma = trees.tree(spark.createDataFrame([("a", "b", 2.0), ("a", "c", 6.0), ("b", "c", 6.0)], "a string, b string, distance double"), "upgma").collect()
    assert sum(r["branch_length"] for r in upgma) == 7.0 and len(upgma) == 5


def test_tree_summary_and_bootstrap(spark):
    rows = [("w", "ACGTACGTAA"), ("x", "ACGTACGTAC"), ("y", "TTGTACCTGG"), ("z", "TTGTACCTGC")]
    alignment = spark.createDataFrame(rows, "name string, sequence string")
    table = trees.tree(trees.distances(alignment))
    row = trees.summary(table).first()
    assert (row["n_taxa"], row["n_internal"], row["taxa"]) == (4, 2, ["w", "x", "y", "z"]) and row["max_depth"] > 0
    places = {r["name"]: r["y"] for r in trees.plot_data(table).collect() if r["name"]}
    assert places == {"w": 1, "x": 2, "y": 3, "z": 4}
    support = {r["split"]: r["support"] for r in trees.bootstrap_support(alignment, 20).collect()}
    assert max(support, key=support.get) == "y,z" and all(0 < v <= 100 for v in support.values())
    protein = spark.createDataFrame([("p", "AW-L"), ("q", "AWKL"), ("r", "GGGG")], "name string, sequence string")
    near = {(r["a"], r["b"]): r["distance"] for r in trees.distances(protein, "blosum62").collect()}
    assert near["p", "q"] == 0 and near["p", "r"] > 1
    with pytest.raises(ValueError):
        trees.distances(spark.createDataFrame([("p", "A"), ("q", "AC")], "name string, sequence string"))


def test_all_pairs_of_divergence(spark):
    rows = [("a", "ATGGGAAAAATTTAA"), ("b", "ATGGGCAAAACTTAA"), ("c", "ATGGGCAAAACTTAA")]
    got = {r["pair"]: r["dn"] for r in evolution.dn_ds_matrix(spark.createDataFrame(rows, "name string, sequence string")).collect()}
    assert set(got) == {"a/b", "a/c", "b/c"} and got["b/c"] == 0 and got["a/b"] == got["a/c"]


def test_search_of_many_queries(spark, sequences, monkeypatch):
    monkeypatch.setattr(similarity, "ROWS", 16)
    monkeypatch.setattr(similarity, "ASKED", 3)
    monkeypatch.setattr(similarity, "WIDE", 32)
    df = records(spark, sequences)
    asked = [i for i in range(len(sequences)) if i % 5 == 0]
    for method, k in (("kmer", 4), ("kmer", 6), ("minhash", 6)):
        got = similarity.search_all(df, df.where("ord % 5 = 0"), method, k, 4).collect()
        if method == "kmer":
            score = {(i, j): jaccard(sequences[i], sequences[j], k) for i in asked for j in range(len(sequences))}
        else:
            signed = {r["ord"]: r["s"] for r in df.select("ord", similarity.minhash(F.col("sequence"), k).alias("s")).collect()}
            score = {(i, j): np.mean(np.array(signed[i]) == np.array(signed[j])) for i in asked for j in range(len(sequences))}
        want = {(i, r + 1, j) for i in asked for r, j in enumerate(sorted(range(len(sequences)), key=lambda j: (-score[i, j], j))[:4])}
        assert {(r["query"], r["rank"], r["ord"]) for r in got} == want and all(abs(r["score"] - score[r["query"], r["ord"]]) < 1e-12 for r in got)
    with pytest.raises(ValueError):
        similarity.search_all(df, df, "other")


def test_minhash_clusters_and_medoids_in_blocks(spark, sequences, monkeypatch):
    df = records(spark, sequences)
    signed = {r["ord"]: np.array(r["s"]) for r in df.select("ord", similarity.minhash(F.col("sequence"), 8).alias("s")).collect()}
    first = {}
    for i, s in enumerate(sequences):
        first.setdefault(s, i)
    own = [i for s, i in first.items() if s]
    want = {(i, j) for i in own for j in own if i < j and (signed[i] == signed[j]).mean() >= 0.7}
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(df, 8, 0.7, "minhash").collect()} == want and want
    monkeypatch.setattr(clustering, "BLOCK", 3)
    clusters = clustering.greedy(df, 8, 0.6)
    member = {r["ord"]: r["cluster"] for r in clusters.collect()}
    best = {}
    for c in set(member.values()):
        inside = sorted(i for i in member if member[i] == c)
        total = {i: round(sum(jaccard(sequences[i], sequences[j], 4) for j in inside if j != i), 9) for i in inside}
        best[c] = max(inside, key=lambda i: (total[i], -i))
    assert {r["cluster"]: r["medoid"] for r in clustering.medoids(df, clusters).collect()} == best
    counts = [r["size"] for r in clustering.sizes(clusters).collect()]
    assert counts == sorted(counts, reverse=True)


def test_sequence_space_and_viewer(spark, sequences):
    df = records(spark, sequences).withColumns({"name": F.col("seq_id"), "seq_type": F.lit("dna"), "meta": F.struct(F.lit("x").alias("group"))})
    assert {r["label"] for r in embedding.sequence_space(df, "group", k=2).collect()} == {"x"} and {r["label"] for r in embedding.sequence_space(df, "tagged", k=2).collect()} == {"no"}
    with pytest.raises(ValueError):
        embedding.sequence_space(df.limit(1))
    rows = records(spark, ["ACGT", "ACGT", "ACAT"]).withColumn("name", F.col("seq_id"))
    assert profiles.viewer_data(rows, 3).count() == 9 and profiles.viewer_data(rows, 0).count() == 12
    with pytest.raises(ValueError):
        profiles.profile_table(records(spark, ["A", "AC"]))


def test_embedding(spark, sequences):
    df = records(spark, sequences)
    vectors = {r["ord"]: r["vector"] for r in embedding.kmer_vectors(df, k=2).collect()}
    assert abs(sum(vectors[0]) - 1) < 1e-9 and sum(vectors[42]) == 0
    x = np.array([vectors[i] for i in sorted(vectors)])
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    v = np.array([row if row[np.abs(row).argmax()] > 0 else -row for row in v])
    got = np.array([[r["dim1"], r["dim2"]] for r in embedding.principal_components(embedding.kmer_vectors(df, k=2)).orderBy("ord").collect()])
    assert np.allclose(got, (x - x.mean(0)) @ v[:2].T, atol=1e-6)
    with pytest.raises(ValueError):
        embedding.vocabulary("ACGT", 9)


def pdb(spark, shift=0.0):
    line = "ATOM  {:>5}  CA  {} A{:>4}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00           C"
    rows = [(i, line.format(i + 1, name, i + 1, 3.8 * i + shift, (i % 2) * 1.5 - shift, i * i * 0.1)) for i, name in enumerate(("ALA", "GLY", "SER", "LEU", "VAL"))]
    return structure.parse_pdb(spark.createDataFrame(rows, "n long, value string"))


def test_cif(spark):
    text = "data_X\nloop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.type_symbol\n_atom_site.label_atom_id\n_atom_site.label_comp_id\n_atom_site.label_asym_id\n_atom_site.auth_seq_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\n_atom_site.B_iso_or_equiv\nATOM 1 C CA ALA A 1 0.0 1.5 2.0 9.5\nATOM 2 C CA GLY A 2 3.8 1.0 2.0 8.0\nHETATM 3 O O HOH A ? 1 1 1 1\n#\n"
    atoms = structure.parse_cif(spark.createDataFrame([(text,)], "value string"))
    assert [tuple(r) for r in structure.structure_sequences(atoms).collect()] == [("A", "AG")]
    assert atoms.orderBy("ord").select("resseq", "x", "bfactor").first()[:] == (1, 0.0, 9.5) and atoms.count() == 3
    with pytest.raises(ValueError):
        structure.read_structure(spark, "x.txt")


def test_structure(spark):
    atoms = pdb(spark)
    assert [tuple(r) for r in structure.structure_sequences(atoms).collect()] == [("A", "AGSLV")]
    fit = structure.superimpose(atoms, pdb(spark, 7.0)).first()
    assert fit["n_atoms"] == 5 and fit["rmsd"] < 1e-3
    scores = spark.createDataFrame([(i + 1, i / 10) for i in range(5)], "position int, score double")
    lines = structure.pdb_lines(structure.scores_to_bfactors(atoms, scores, "A")).withColumn("n", F.monotonically_increasing_id())
    assert [r["bfactor"] for r in structure.parse_pdb(lines).orderBy("ord").collect()] == [0.0, 0.1, 0.2, 0.3, 0.4]
    with pytest.raises(ValueError):
        structure.superimpose(atoms, atoms, "A", "B")
    with pytest.raises(ValueError):
        structure.scores_to_bfactors(atoms, scores.limit(2), "A")


def partition(rows):
    """Sets of members, whatever the clusters are called."""
    groups = {}
    for r in rows:
        groups.setdefault(r["cluster"], set()).add(r["ord"])
    return sorted(map(sorted, groups.values()))


def cut_by_number(sequences, k, linkage, number):
    """The plain loop: merge the nearest clusters of records, then undo what is above the least height with few enough."""
    own = [kmers(s, k) for s in sequences]
    d = np.array([[1 - len(x & y) / len(x | y) for y in own] for x in own])
    joins = linkage_module.link_joins(d, linkage, 1.0, np.ones(len(own)))
    heights = sorted({round(h, 12) for _, _, h in joins})
    for limit in (-1.0, *heights):
        label = list(range(len(own)))
        for i, j, h in joins:
            if round(h, 12) <= limit:
                label = [label[i] if x == label[j] else x for x in label]
        if len(set(label)) <= number:
            return partition([{"ord": o, "cluster": c} for o, c in enumerate(label)])


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "weighted"])
def test_clusters_by_number(spark, linkage, monkeypatch):
    """300 records against a loop, in one task a component and in rounds."""
    rng = random.Random(11)
    sequences = [s for s in mutated(rng, 295, 60, 30) if s][:300]
    df = records(spark, sequences)
    distinct = len(set(sequences))
    for small, number in ((1024, 3), (1024, 40), (240, 40)):  # the last takes some rounds first
        monkeypatch.setattr(linkage_module, "SMALL", small)
        if small > 1000 or linkage != "single":
            got = partition(clustering.hierarchical(df, 6, linkage, n_clusters=number).collect())
            assert got == cut_by_number(sequences, 6, linkage, number), (linkage, small, number)
    if linkage == "single":
        whole = partition(clustering.hierarchical(df, 6, linkage, n_clusters=distinct).collect())
        assert len(whole) == distinct
        assert len(partition(clustering.hierarchical(records(spark, ["AAAA", "CCCC", "GGGG"]), 3, linkage, n_clusters=2).collect())) == 1
        for bad in ({"n_clusters": 0}, {"n_clusters": len(sequences) + 1}, {"n_clusters": 2, "distance_threshold": 0.1}):
            with pytest.raises(ValueError):
                clustering.hierarchical(df, 6, linkage, **bad)


def test_kth_smallest(spark):
    values = [0.5, 0.25, 0.25, 1e-12, 0.75, 0.75, 0.75, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [linkage_module.kth_smallest(df, "x", i + 1) for i in range(8)] == sorted(values)


@pytest.mark.parametrize("mode", ["global", "local"])
@pytest.mark.parametrize("protein", [False, True])
def test_pairs_aligned_together(mode, protein, monkeypatch):
    """The same alignments as one by one, whatever lots the pairs are aligned in."""
    rng = random.Random(17)
    letters = "ARNDCQEGHILKMFPSTWYV" if protein else "ACGT"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pairs = [(word(rng.randrange(25)), word(rng.randrange(25))) for _ in range(60)]
    pairs += [(s, s[:5] + word(rng.randrange(9)) + s[8:]) for s in (word(30) for _ in range(60))] + [("", ""), ("ac-gt", "ACGT"), ("A", "")]
    for gaps in ({}, {"gap_open": -2.0, "gap_extend": -1.0}):
        expected = [alignment.align(a, b, mode, protein, **gaps) for a, b in pairs]
        for traces in (1 << 25, 700):
            monkeypatch.setattr(alignment, "TRACES", traces)
            assert alignment.align_all([a for a, _ in pairs], [b for _, b in pairs], mode=mode, protein=protein, **gaps) == expected


def test_batches_of_pairs_are_faster():
    rng = random.Random(18)
    pairs = [("".join(rng.choice("ACGT") for _ in range(60)), "".join(rng.choice("ACGT") for _ in range(60))) for _ in range(1000)]
    start = time.perf_counter()
    together = alignment.align_all([a for a, _ in pairs], [b for _, b in pairs])
    fast = time.perf_counter() - start
    start = time.perf_counter()
    single = [alignment.align(a, b) for a, b in pairs[:200]]
    slow = 5 * (time.perf_counter() - start)
    assert together[:200] == single
    print(f"1,000 pairs of 60 letters: {fast:.2f} s together, {slow:.2f} s one by one")
    assert slow > 3 * fast


def test_aligned_consensus(spark):
    """Members of unequal length, against the columns of a centre star made by hand with `align`."""
    rng = random.Random(19)
    base = "".join(rng.choice("ACGT") for _ in range(50))
    members = [base, base, base[:20] + "TTT" + base[20:], base[:20] + "TTT" + base[20:], base[:20] + "TTT" + base[20:], base[:30] + base[33:], base[1:], "G" + base]
    df = records(spark, [*members, "ACGTACGTAC", "ACGTACGAC"])
    clusters = spark.createDataFrame([(i, 0) for i in range(8)] + [(8, 8), (9, 8)], "ord long, cluster long")
    got = {r["cluster"]: r["consensus"] for r in clustering.aligned_consensus(df, clusters).collect()}
    centre = members[clustering.medoids(df, clusters).where("cluster = 0").first()["medoid"]]
    columns = {}
    for s in members:
        _, top, low = alignment.align(centre, s)
        position = inserted = 0
        for c, letter in zip(top, low, strict=True):
            position, inserted = (position + 1, 0) if c != "-" else (position, inserted + 1)
            columns.setdefault((position, inserted), []).append(letter)
    votes = {at: [(-x.count(c), c) for c in set(x) - {"-"}] for at, x in columns.items()}
    expected = "".join(min(v)[1] for at, v in sorted(votes.items()) if v and -min(v)[0] > len(members) - sum(-n for n, _ in v))
    assert got[0] == expected and got[8] in ("ACGTACGAC", "ACGTACGTAC")
    assert clustering.aligned_consensus(df.limit(0), clusters.limit(0)).count() == 0


def test_kmer_index(spark, sequences, monkeypatch):
    """The index gives what comparing all gives, above a least score, and reads fewer postings."""
    df = records(spark, sequences)
    index = kmer_index.build(df, 8)
    asked = df.where("ord % 5 = 0")
    for probes, top_n, least in ((8, 4, 0.01), (1, 3, 0.5), (2, 60, 0.05)):
        monkeypatch.setattr(kmer_index, "PROBES", probes)
        got = sorted((r["query"], r["rank"], r["ord"], round(r["score"], 9)) for r in kmer_index.search(index, asked, top_n, least).collect())
        expected = []
        for q in range(0, len(sequences), 5):
            scores = sorted((-jaccard(sequences[q], s, 8), o) for o, s in enumerate(sequences))
            expected += [(q, rank + 1, o, round(-x, 9)) for rank, (x, o) in enumerate(y for y in scores[:top_n] if -y[0] >= least)]
        assert got == sorted(expected)
    shares = kmer_index.read_share(index, asked, 3, 0.5).agg(F.sum("postings_read"), F.sum("postings_all")).first()
    assert 0 < shares[0] < 0.8 * shares[1]
    with pytest.raises(ValueError):
        kmer_index.search(index, asked, 3, 0.0)
    saved = kmer_index.build(df, 8, "hf_test_index")
    assert kmer_index.search(saved, asked, 3, 0.5).count() == kmer_index.search(index, asked, 3, 0.5).count()
    assert "hf_test_index_postings" in {t.name for t in spark.catalog.listTables()}


def test_lwl85(spark):
    """By hand from the method's formulas, on a pair with a change of each kind."""
    a = "TTTCTTATGGGTAAAGCTCCCACTGTT" * 2
    b = "TTCCTAATGGGTAAGGCTCCCACTGTT" + a[27:-3] + "GAT"
    row = evolution.lwl85(spark.createDataFrame([("p", a, b), ("same", a, a), ("short", "ATG", "ATG")], "pair string, a string, b string"))
    got = {r["pair"]: r for r in row.collect()}
    codons = [(a[i : i + 3], b[i : i + 3]) for i in range(0, len(a), 3)]
    sites, p, q = dict.fromkeys("024", 0.0), dict.fromkeys("024", 0), dict.fromkeys("024", 0)
    for x, y in codons:
        fx, fy = evolution.degeneracy(x), evolution.degeneracy(y)
        for i in range(3):
            sites[fx[i]] += 0.5
            sites[fy[i]] += 0.5
            if x[i] != y[i]:
                (p if {x[i], y[i]} in ({"A", "G"}, {"C", "T"}) else q)[fx[i]] += 1
    share = {c: (p[c] / sites[c], q[c] / sites[c]) for c in "024"}
    far = {c: (np.log(1 / (1 - 2 * x - y)) / 2 - np.log(1 / (1 - 2 * y)) / 4, np.log(1 / (1 - 2 * y)) / 2) for c, (x, y) in share.items()}
    ds = 3 * (sites["2"] * far["2"][0] + sites["4"] * sum(far["4"])) / (sites["2"] + 3 * sites["4"])
    dn = 3 * (sites["2"] * far["2"][1] + sites["0"] * sum(far["0"])) / (2 * sites["2"] + 3 * sites["0"])
    assert (got["p"]["dn"], got["p"]["ds"]) == (pytest.approx(dn), pytest.approx(ds)) and got["p"]["omega"] == pytest.approx(dn / ds)
    assert got["same"]["dn"] == 0 and got["same"]["ds"] == 0 and got["same"]["omega"] is None and got["short"]["ds"] is None


def shuffled(spark) -> int:
    """Bytes of shuffle written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.fixture(scope="module")
def unlike():
    rng = random.Random(5)
    return ["".join(rng.choice("ACGT") for _ in range(600)) for _ in range(200)]


@pytest.mark.parametrize("query", ["pairs", "aligned"])
def test_no_letters_or_kmers_of_lone_sequences_are_shuffled(spark, unlike, query):
    """F4, F16: of sequences that nothing is similar to, a few bytes a letter go through shuffles."""
    df = records(spark, unlike).repartition(8).localCheckpoint()
    clusters = df.select("ord", F.col("ord").alias("cluster")).localCheckpoint()
    before = shuffled(spark)
    made = {"pairs": lambda: similarity.similar_pairs(df, 12, 0.8), "aligned": lambda: clustering.aligned_consensus(df, clusters)}[query]()
    n = len(made.collect())
    assert n == (0 if query == "pairs" else len(unlike)) and shuffled(spark) - before < 4 * sum(map(len, unlike))


@pytest.mark.parametrize("frequent", [1, 4096])
def test_pairs_of_blocks(spark, monkeypatch, frequent):
    """F16: a block with itself and with another one, rolled hashes of texts of all sizes, against plain sets."""
    rng = random.Random(3)
    rows = [s for s in mutated(rng, 60, 70, 5) if s] + [x * n for x in ("A", "AC", "ΩA") for n in (1, 3, 8, 30)]
    rows = sorted(set(rows), key=lambda s: rng.random())
    monkeypatch.setattr(similarity, "FREQUENT", frequent)
    monkeypatch.setattr(similarity, "PAIRS", 64)
    hashes, row = similarity.kmer_hashes(rows, 7)
    assert [len(set(hashes[row == i].tolist())) for i in range(len(rows))] == [len(kmers(s, 7)) for s in rows]
    for threshold in (0.3, 0.8, 1.0):
        near = {(i, j): jaccard(rows[i], rows[j], 7) for i in range(len(rows)) for j in range(i + 1, len(rows)) if jaccard(rows[i], rows[j], 7) >= threshold}
        for split in (len(rows), 25):
            a, b, score = similarity.near_in_blocks(rows, split, 7, threshold)
            got = {(int(i), int(j)): s for i, j, s in zip(a, b, score, strict=True)}
            assert got == {p: s for p, s in near.items() if split == len(rows) or p[0] < split <= p[1]}
    monkeypatch.setattr(similarity, "MEMBERS", 9)
    want = {(i, j) for j, s in enumerate(rows) for i in range(j) if jaccard(rows[i], s, 7) >= 0.3}
    got = [(r["a"], r["b"]) for r in similarity.similar_pairs(records(spark, rows), 7, 0.3).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_signatures_meet_by_bands(spark):
    """signatures that agree in single places alone do not meet; all pairs at the threshold do."""
    rng = random.Random(9)
    rows = sorted({s for s in mutated(rng, 60, 90, 12) if s})
    df = records(spark, rows)
    signed = {r["ord"]: np.array(r["s"]) for r in df.select("ord", similarity.minhash(F.col("sequence"), 5, 16).alias("s")).collect()}
    for threshold in (0.3, 0.8, 1.0):
        want = {(i, j) for j in signed for i in range(j) if (signed[i] == signed[j]).mean() >= threshold}
        assert {(r["a"], r["b"]) for r in similarity.similar_signatures(df, 5, threshold, 16).collect()} == want
    tails = ["".join(rng.choice("ACGT") for _ in range(300)) for _ in range(600)]
    df = records(spark, ["ACGTTGCAACCA" * 4 + t for t in tails]).repartition(8).localCheckpoint()
    before = shuffled(spark)
    assert not similarity.similar_signatures(df, 8, 0.8, 64).collect()
    assert shuffled(spark) - before < 230_000


@pytest.mark.parametrize("method", ["kmer", "minhash"])
def test_searches_shuffle_no_records(spark, unlike, monkeypatch, method):
    """queries in several broadcasts find the same, and what is shuffled does not grow with blocks of queries."""
    df = records(spark, unlike).repartition(4).localCheckpoint()
    want = similarity.search_all(df, df, method, None, 3).orderBy("query", "rank").collect()
    monkeypatch.setattr(similarity, "ASKED", 10)
    monkeypatch.setattr(similarity, "ROWS", 30)
    monkeypatch.setattr(similarity, "QUERY_BYTES", 100_000)
    before = shuffled(spark)
    assert similarity.search_all(df, df, method, None, 3).orderBy("query", "rank").collect() == want and len(want) == 600
    assert shuffled(spark) - before < 200_000


def test_index_search_shuffles_no_postings(spark, unlike):
    """F8: building the index and searching it, a k-mer of the records costs no row in a shuffle."""
    df = records(spark, unlike).repartition(4).localCheckpoint()
    before = shuffled(spark)
    got = kmer_index.search(kmer_index.build(df, 8), df.where("ord % 10 = 0"), 3, 0.01).collect()
    assert {(r["query"], r["ord"]) for r in got if r["rank"] == 1} == {(i, i) for i in range(0, 200, 10)} and shuffled(spark) - before < 100_000
