"""Queries of similarity, profiles, clusters, evolution, trees and embedding over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators import alignment, clustering, embedding, evolution, kmer_index, profiles, selection, similarity, tree_nodes, trees
from helixframe.operators.storage import written
from helixframe.plans.record_queries import SQL_DNA, SQL_GAPPED
from helixframe.sources import views

QUERIES, ORACLES = {}, {}
K, SIMILAR = 12, 0.8


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def sequences(spark, sf_dir):
    """`ord` and `sequence` of all records, made once for operators that read them several times."""
    return written(views.records(spark, sf_dir).select("ord", "sequence"))


def searched(spark, sf_dir, method):
    """The records most like each of those whose number is divisible by 50."""
    df = views.records(spark, sf_dir)
    return similarity.search_all(df, df.where("ord % 50 = 0"), method).select("query", "rank", "ord", F.round("score", 6).alias("score"))


def kmers_sql(k: int, of: str = SQL_DNA) -> str:
    return f"SELECT DISTINCT ord, CASE WHEN length(sequence) < {k} THEN sequence ELSE substr(sequence, i + 1, {k}) END AS kmer FROM (SELECT ord, sequence, unnest(range(greatest(length(sequence) - {k - 1}, 1))) AS i FROM ({of}))"


@query(f"""WITH k AS ({kmers_sql(4)}), n AS (SELECT ord, count(*) AS n FROM k GROUP BY 1),
b AS (SELECT q.ord AS query, k.ord, count(*) AS shared FROM k q JOIN k ON q.kmer = k.kmer WHERE q.ord % 50 = 0 GROUP BY 1, 2),
s AS (SELECT q.ord AS query, c.ord, coalesce(shared, 0)::DOUBLE / (q.n + c.n - coalesce(shared, 0)) AS score FROM n q JOIN n c ON q.ord % 50 = 0 LEFT JOIN b ON b.query = q.ord AND b.ord = c.ord),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord)::INTEGER AS rank FROM s)
SELECT query, rank, ord, round(score, 6) AS score FROM r WHERE rank <= 10""")
def kmer_top_n(spark, sf_dir):
    return searched(spark, sf_dir, "kmer")


@query(f"""WITH k AS ({kmers_sql(K)}), n AS (SELECT ord, count(*) AS n FROM k GROUP BY 1),
b AS (SELECT q.ord AS query, k.ord, count(*) AS shared FROM k q JOIN k ON q.kmer = k.kmer WHERE q.ord % 50 = 0 GROUP BY 1, 2),
s AS (SELECT query, b.ord, shared::DOUBLE / (q.n + c.n - shared) AS score FROM b JOIN n q ON q.ord = query JOIN n c ON c.ord = b.ord),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord)::INTEGER AS rank FROM s WHERE score >= 0.05)
SELECT query, rank, ord, round(score, 6) AS score FROM r WHERE rank <= 10""")
def kmer_index_top_n(spark, sf_dir):
    """The same search by 12-mers, through an inverted index."""
    df = views.records(spark, sf_dir)
    return kmer_index.search(kmer_index.build(df, K), df.where("ord % 50 = 0"), 10, 0.05).select("query", "rank", "ord", F.round("score", 6).alias("score"))


@query()
def minhash_top_n(spark, sf_dir):
    return searched(spark, sf_dir, "minhash")


#: Distinct sequences by their first record, and all similar pairs of them, by counting shared k-mers.
SQL_REPS = f"SELECT min(ord) AS ord, sequence FROM ({SQL_DNA}) WHERE length(sequence) > 0 GROUP BY sequence"
SQL_PAIRS = f"""WITH k AS ({kmers_sql(K, SQL_REPS)}), n AS (SELECT ord, count(*) AS n FROM k GROUP BY 1),
p AS (SELECT x.ord AS a, y.ord AS b, count(*) AS shared FROM k x JOIN k y ON x.kmer = y.kmer AND x.ord < y.ord GROUP BY 1, 2)
SELECT a, b, shared::DOUBLE / (na.n + nb.n - shared) AS score FROM p JOIN n na ON na.ord = a JOIN n nb ON nb.ord = b WHERE shared::DOUBLE / (na.n + nb.n - shared) >= {SIMILAR}"""


@query(f"SELECT a, b, round(score, 6) AS score FROM ({SQL_PAIRS})")
def near_duplicate_pairs(spark, sf_dir):
    return similarity.similar_pairs(views.records(spark, sf_dir), K, SIMILAR).select("a", "b", F.round("score", 6).alias("score"))


@query(f"""WITH p AS ({SQL_PAIRS}), n AS (SELECT ord, count(*) AS links FROM (SELECT a AS ord FROM p UNION ALL SELECT b FROM p) GROUP BY 1)
SELECT d.ord, s.ord AS rep, coalesce(n.links, 0)::BIGINT AS n_links FROM ({SQL_DNA}) d JOIN ({SQL_REPS}) s USING (sequence) LEFT JOIN n ON n.ord = s.ord""")
def near_duplicate_members(spark, sf_dir):
    """Every record with the first one of its sequence, under which the pairs name it, and the number of its links."""
    df = sequences(spark, sf_dir)
    pairs = similarity.similar_pairs(df, K, SIMILAR)
    links = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    reps = similarity.distinct_sequences(df).select("key", "rep").join(links, "rep", "left")
    own = df.where(F.char_length("sequence") > 0).select("ord", F.md5("sequence").alias("key"))
    return own.join(reps, "key").select("ord", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query()
def cluster_greedy(spark, sf_dir):
    return clustering.greedy(sequences(spark, sf_dir), K, SIMILAR)


@query()
def cluster_greedy_minhash(spark, sf_dir):
    return clustering.greedy(sequences(spark, sf_dir), 9, SIMILAR, "minhash")


SQL_SINGLE = f"""WITH RECURSIVE p AS (SELECT a, b FROM ({SQL_PAIRS}) UNION SELECT b, a FROM ({SQL_PAIRS})),
r(ord, near) AS (SELECT ord, ord FROM ({SQL_REPS}) UNION SELECT r.ord, p.b FROM r JOIN p ON r.near = p.a),
c AS (SELECT ord, min(near) AS cluster FROM r GROUP BY 1)
SELECT d.ord, c.cluster FROM ({SQL_DNA}) d JOIN ({SQL_REPS}) s USING (sequence) JOIN c ON c.ord = s.ord"""
SQL_MEMBERS = f"SELECT c.cluster, d.ord, d.sequence FROM ({SQL_SINGLE}) c JOIN ({SQL_DNA}) d USING (ord)"


@query(SQL_SINGLE)
def cluster_single_linkage(spark, sf_dir):
    return clustering.hierarchical(sequences(spark, sf_dir), K, "single", 1 - SIMILAR)


@query()
def cluster_average_linkage(spark, sf_dir):
    return clustering.hierarchical(sequences(spark, sf_dir), K, "average", 1 - SIMILAR)


@query()
def cluster_single_by_number(spark, sf_dir):
    """Half as many clusters as there are records."""
    df = sequences(spark, sf_dir).where(F.char_length("sequence") > 0)
    return clustering.hierarchical(df, K, "single", n_clusters=max(1, df.count() // 2))


@query()
def cluster_complete_linkage(spark, sf_dir):
    return clustering.hierarchical(sequences(spark, sf_dir), K, "complete", 1 - SIMILAR)


def _clustered(spark, sf_dir):
    """Records in clusters of similar sequences."""
    df = sequences(spark, sf_dir).where(F.char_length("sequence") > 0)
    return df, clustering.hierarchical(df, K, "single", 1 - SIMILAR)


@query(f"SELECT cluster, count(*) AS size, first(ord ORDER BY length(sequence) DESC, ord) AS representative FROM ({SQL_MEMBERS}) GROUP BY 1")
def cluster_representatives(spark, sf_dir):
    return clustering.representatives(*_clustered(spark, sf_dir))


@query(f"SELECT cluster, count(*) AS size FROM ({SQL_SINGLE}) GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return clustering.sizes(_clustered(spark, sf_dir)[1])


@query(f"""WITH m AS ({SQL_MEMBERS}), s AS (SELECT cluster, min(length(sequence)) = max(length(sequence)) AS even, first(sequence ORDER BY length(sequence) DESC, ord) AS rep FROM m GROUP BY 1),
l AS (SELECT cluster, ord, i, sequence[i] AS letter FROM (SELECT cluster, ord, sequence, unnest(range(1, length(sequence) + 1)) AS i FROM m JOIN s USING (cluster) WHERE even)),
v AS (SELECT cluster, i, letter, count(*) AS n, min(ord) AS first FROM l GROUP BY ALL),
b AS (SELECT cluster, i, first(letter ORDER BY n DESC, first) AS letter FROM v GROUP BY ALL),
c AS (SELECT cluster, string_agg(letter, '' ORDER BY i) AS voted FROM b GROUP BY 1)
SELECT cluster, CASE WHEN even THEN voted ELSE rep END AS consensus, NOT even AS approximate FROM s LEFT JOIN c USING (cluster)""")
def cluster_consensus(spark, sf_dir):
    return clustering.consensus(*_clustered(spark, sf_dir))


@query()
def cluster_consensus_aligned(spark, sf_dir):
    return clustering.aligned_consensus(*_clustered(spark, sf_dir))


@query(f"""WITH m AS ({SQL_MEMBERS}), k AS (SELECT x.ord, m.cluster, x.kmer FROM ({kmers_sql(4)}) x JOIN m USING (ord)), n AS (SELECT cluster, ord, count(*) AS n FROM k GROUP BY ALL),
b AS (SELECT x.cluster, x.ord AS a, y.ord AS b, count(*) AS shared FROM k x JOIN k y ON x.cluster = y.cluster AND x.kmer = y.kmer AND x.ord <> y.ord GROUP BY ALL),
t AS (SELECT n.cluster, n.ord, round(coalesce(sum(shared::DOUBLE / (n.n + o.n - shared)), 0), 9) AS total FROM n LEFT JOIN b ON b.cluster = n.cluster AND b.a = n.ord LEFT JOIN n o ON o.cluster = n.cluster AND o.ord = b.b GROUP BY ALL)
SELECT cluster, first(ord ORDER BY total DESC, ord) AS medoid FROM t GROUP BY 1""")
def cluster_medoids(spark, sf_dir):
    return clustering.medoids(*_clustered(spark, sf_dir))


SQL_TILES = f"SELECT source, unnest(list_transform(range((length(sequence) + 59) // 60), lambda t: rpad(substr(sequence, t * 60 + 1, 60), 60, '-'))) AS sequence FROM ({SQL_GAPPED})"
SQL_LETTERS = f"SELECT source, i + 1 AS position, sequence[i + 1] AS letter FROM (SELECT source, sequence, unnest(range(60)) AS i FROM ({SQL_TILES}))"
COUNTS = ", ".join(f"count(*) FILTER (letter = '{a}') AS count_{n}" for a, n in (("A", "A"), ("C", "C"), ("G", "G"), ("T", "T"), ("-", "gap")))
SQL_PFM = f"SELECT position, {COUNTS} FROM ({SQL_LETTERS}) GROUP BY 1"
SQL_PPM = f"SELECT *, {', '.join(f'(count_{a} + 0.5::DOUBLE) / (count_A + count_C + count_G + count_T + 2) AS prob_{a}' for a in 'ACGT')} FROM ({SQL_PFM})"
SQL_H = " + ".join(f"prob_{a} * log2(prob_{a})" for a in "ACGT")
SQL_KL = " + ".join(f"prob_{a} * log2(prob_{a} / 0.25)" for a in "ACGT")
SQL_BEST = "CASE WHEN count_gap >= greatest(count_A, count_C, count_G, count_T) THEN '-' WHEN count_A = greatest(count_A, count_C, count_G, count_T) THEN 'A' WHEN count_C = greatest(count_A, count_C, count_G, count_T) THEN 'C' WHEN count_G = greatest(count_A, count_C, count_G, count_T) THEN 'G' ELSE 'T' END"


@query(SQL_PFM)
def pfm(spark, sf_dir):
    return profiles.pfm(views.tiles(spark, sf_dir))


@query(f"SELECT position, {', '.join(f'round(log2(prob_{a} / 0.25), 6) AS pwm_{a}, round(log2(prob_{a} / 0.25) * 100)::INTEGER AS pssm_{a}' for a in 'ACGT')} FROM ({SQL_PPM})")
def pwm_pssm(spark, sf_dir):
    table = profiles.pwm(profiles.ppm(profiles.pfm(views.tiles(spark, sf_dir))))
    return table.select("position", *[c for a in "ACGT" for c in (F.round(f"pwm_{a}", 6).alias(f"pwm_{a}"), f"pssm_{a}")])


@query(f"SELECT position, {SQL_BEST} AS consensus, round(-({SQL_H}), 4) AS shannon_entropy, round(1 + ({SQL_H}) / 2, 4) AS conservation_score, round({SQL_KL}, 4) AS relative_entropy, {', '.join(f'round(prob_{a}, 4) AS freq_{a}' for a in 'ACGT')}, count_gap AS freq_gap FROM ({SQL_PPM})")
def profile_table(spark, sf_dir):
    return profiles.profile_table(views.tiles(spark, sf_dir))


@query(f"SELECT round(avg(1 + h / 2), 6) AS mean_conservation, round(sum(kl), 6) AS total_information, first(position ORDER BY round(1 + h / 2, 12) DESC, position) AS most_conserved, first(position ORDER BY round(1 + h / 2, 12), position) AS least_conserved, string_agg(best, '' ORDER BY position) AS consensus FROM (SELECT position, {SQL_H} AS h, {SQL_KL} AS kl, {SQL_BEST} AS best FROM ({SQL_PPM}))")
def conservation_summary(spark, sf_dir):
    row = profiles.conservation_summary(views.tiles(spark, sf_dir))
    return row.select(F.round("mean_conservation", 6).alias("mean_conservation"), F.round("total_information", 6).alias("total_information"), "most_conserved", "least_conserved", "consensus")


@query(f"SELECT position, letter, round(height, 6) AS height FROM (SELECT position, unnest(['A', 'C', 'G', 'T']) AS letter, unnest([{', '.join(f'prob_{a} * greatest({SQL_KL}, 0)' for a in 'ACGT')}]) AS height FROM ({SQL_PPM}))")
def logo_data(spark, sf_dir):
    return profiles.logo_data(views.tiles(spark, sf_dir)).select("position", "letter", F.round("height", 6).alias("height"))


@query(f"SELECT position, {', '.join(f'round(prob_{a}, 6) AS prob_{a}, round(log2(prob_{a} / 0.25) * 100)::INTEGER AS pssm_{a}' for a in 'ACGT')}, {SQL_BEST} AS consensus, round({SQL_KL}, 6) AS relative_entropy FROM ({SQL_PPM})")
def built_profile(spark, sf_dir):
    tiles = views.tiles(spark, sf_dir).withColumn("seq_type", F.lit("dna"))
    return profiles.build_profile(tiles).select("position", *[c for a in "ACGT" for c in (F.round(f"prob_{a}", 6).alias(f"prob_{a}"), f"pssm_{a}")], "consensus", F.round("relative_entropy", 6).alias("relative_entropy"))


@query(f"SELECT t.* FROM ({ORACLES['kmer_top_n']}) t JOIN ({SQL_DNA}) s USING (ord) JOIN documents d ON d.doc_id = ord WHERE d.lang = 'en' AND length(s.sequence) >= 40 AND score >= 0.3")
def search_then_filter(spark, sf_dir):
    """The hits of a search that a selection of records keeps; ranks stay those of the whole search."""
    hits = searched(spark, sf_dir, "kmer").where("score >= 0.3")
    chosen = selection.Selection(min_length=40).apply(views.records(spark, sf_dir)).where("meta.lang = 'en'")
    return hits.join(chosen.select("ord"), "ord", "left_semi").select("query", "rank", "ord", "score")


def source_alignment(spark, sf_dir, gaps: bool = False):
    """`name`, `sequence`: the consensus of every source's tiles, an alignment of as many rows as there are sources; gaps vote only if asked."""
    letters = views.tiles(spark, sf_dir).select(F.col("meta.source").alias("name"), F.posexplode(S.symbols(F.col("sequence"))).alias("at", "letter"))
    letters = letters if gaps else letters.where("letter <> '-'")
    votes = letters.groupBy("name", "at", "letter").agg(F.count("*").alias("n"))
    best = votes.groupBy("name", "at").agg(F.max_by("letter", F.struct("n", F.when(F.col("letter") == "-", 1).otherwise(0).alias("gap"), (-F.ascii("letter")).alias("l"))).alias("letter"))
    return best.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "").alias("sequence"))


SQL_GAP_SOURCES = f"WITH v AS (SELECT source AS name, position, letter, count(*) AS n FROM ({SQL_LETTERS}) GROUP BY ALL), b AS (SELECT name, position, first(letter ORDER BY n DESC, (letter = '-') DESC, letter) AS letter FROM v GROUP BY ALL) SELECT name, string_agg(letter, '' ORDER BY position) AS sequence FROM b GROUP BY 1"
SQL_SOURCES = SQL_GAP_SOURCES.replace(f"FROM ({SQL_LETTERS}) GROUP BY ALL), b", f"FROM ({SQL_LETTERS}) WHERE letter <> '-' GROUP BY ALL), b")


@query(SQL_GAP_SOURCES)
def source_consensus(spark, sf_dir):
    return source_alignment(spark, sf_dir, gaps=True)


@query(f"SELECT x.name AS a, y.name AS b, round(1 - len(list_filter(range(60), lambda i: x.sequence[i + 1] = y.sequence[i + 1])) / 60.0::DOUBLE, 6) AS distance FROM ({SQL_SOURCES}) x JOIN ({SQL_SOURCES}) y ON x.name < y.name")
def identity_distances(spark, sf_dir):
    return trees.distances(source_alignment(spark, sf_dir)).select("a", "b", F.round("distance", 6).alias("distance"))


@query()
def neighbour_joining(spark, sf_dir):
    return trees.tree(trees.distances(source_alignment(spark, sf_dir))).select("node", "parent", "name", F.round("branch_length", 6).alias("branch_length"))


@query()
def bootstrap_support(spark, sf_dir):
    return trees.bootstrap_support(source_alignment(spark, sf_dir), 100)


@query()
def bootstrap_consensus(spark, sf_dir):
    """The majority consensus of the sources' bootstrap trees."""
    nodes = trees.consensus_tree(source_alignment(spark, sf_dir), 100)
    return nodes.select("node", "parent", "name", "support", F.round("branch_length", 6).alias("branch_length"))


@query()
def pruned_tree(spark, sf_dir):
    """The sources' UPGMA tree, reduced to the sources whose documents are on average of more than the common quality."""
    nodes = trees.tree(trees.distances(source_alignment(spark, sf_dir)), "upgma")
    labelled = views.read(spark, sf_dir, "documents").join(views.read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    common = labelled.agg(F.avg("quality").alias("common"))
    better = labelled.groupBy("source").agg(F.avg("quality").alias("own")).join(F.broadcast(common), F.col("own") > F.col("common"))
    return tree_nodes.prune_nodes(nodes, better.select(F.col("source").alias("name"))).select("node", "parent", "name", F.round("branch_length", 6).alias("branch_length"))


@query()
def align_sources(spark, sf_dir):
    rows = source_alignment(spark, sf_dir)
    a, b = rows.select(F.col("name").alias("na"), F.col("sequence").alias("a")), rows.select(F.col("name").alias("nb"), F.col("sequence").alias("b"))
    pairs = a.join(b, F.col("na") < F.col("nb")).select(F.concat_ws("/", "na", "nb").alias("pair"), "a", "b")
    return alignment.pairwise(pairs)


#: What the operator's table holds, for the SQL; the table's own rule is tested against published values.
SQL_CODON_TABLE = "(VALUES " + ", ".join(f"('{a}', '{b}', {sites!r}::DOUBLE, {syn!r}::DOUBLE, {non!r}::DOUBLE)" for a, b, sites, syn, non in evolution.codon_table()) + ") AS t(ca, cb, sites, syn, non)"


def dn_ds_sql(pairs: str) -> str:
    """Divergence of (pair, a, b) rows of whole codons in which no pair ends in stops on both sides."""
    jc = lambda x: f"CASE WHEN round({x}, 12) < 0.75 THEN -0.75::DOUBLE * ln(1 - {x} * 4 / 3) END"
    return f"""WITH p AS ({pairs}), c AS (SELECT pair, substr(a, i * 3 + 1, 3) AS ca, substr(b, i * 3 + 1, 3) AS cb FROM (SELECT pair, a, b, unnest(range(length(a) // 3)) AS i FROM (SELECT pair, CASE WHEN z THEN left(a, -3) ELSE a END AS a, CASE WHEN z THEN left(b, -3) ELSE b END AS b FROM (SELECT *, regexp_matches(a, '(TAA|TAG|TGA)$') AND regexp_matches(b, '(TAA|TAG|TGA)$') AS z FROM p)))),
s AS (SELECT pair, sum(sites) AS s, count(*) AS n, sum(syn) AS syn, sum(non) AS non FROM c JOIN {SQL_CODON_TABLE} USING (ca, cb) GROUP BY 1),
r AS (SELECT pair, syn / nullif(s, 0) AS ps, non / nullif(3 * n - s, 0) AS pn FROM s), d AS (SELECT pair, {jc("pn")} AS dn, {jc("ps")} AS ds FROM r)
SELECT pair, round(dn, 6) AS dn, round(ds, 6) AS ds, round(CASE WHEN ds > 0 THEN dn / ds END, 6) AS omega FROM d"""


@query(dn_ds_sql(f"SELECT concat_ws('/', ord::VARCHAR, t::VARCHAR) AS pair, rpad(substr(sequence, (t - 1) * 90 + 1, 90), 90, '-') AS a, rpad(substr(sequence, t * 90 + 1, 90), 90, '-') AS b FROM (SELECT ord, sequence, unnest(range(1, (length(sequence) + 89) // 90)) AS t FROM ({SQL_DNA}))"))
def dn_ds(spark, sf_dir):
    """Neighbouring windows of 30 codons of every whole sequence, the last one filled up with gaps."""
    whole = F.rpad("sequence", (F.ceil(F.char_length("sequence") / 90) * 90).cast("int"), F.lit("-"))
    windows = views.records(spark, sf_dir).select("ord", F.regexp_extract_all(whole, F.lit("(.{90})"), F.lit(1)).alias("w"))
    pairs = windows.select("ord", "w", F.explode(F.when(F.size("w") > 1, F.sequence(F.lit(1), F.size("w") - 1))).alias("i"))
    named = pairs.select(F.concat_ws("/", F.col("ord").cast("string"), F.col("i").cast("string")).alias("pair"), F.get("w", F.col("i") - 1).alias("a"), F.get("w", F.col("i")).alias("b"))
    return evolution.dn_ds(named).select("pair", *[F.round(c, 6).alias(c) for c in ("dn", "ds", "omega")])


@query(dn_ds_sql(f"SELECT concat_ws('/', x.name, y.name) AS pair, x.sequence AS a, y.sequence AS b FROM ({SQL_SOURCES}) x JOIN ({SQL_SOURCES}) y ON x.name < y.name"))
def dn_ds_matrix(spark, sf_dir):
    """All pairs of the sources' consensus sequences."""
    return evolution.dn_ds_matrix(source_alignment(spark, sf_dir)).select("pair", *[F.round(c, 6).alias(c) for c in ("dn", "ds", "omega")])


SQL_CLASSES = "(VALUES " + ", ".join(f"('{c}', '{x}')" for c, x in (
    ("TTT", "002"), ("TTC", "002"), ("TTA", "202"), ("TTG", "202"), ("CTT", "004"), ("CTC", "004"), ("CTA", "204"), ("CTG", "204"), ("ATT", "002"), ("ATC", "002"), ("ATA", "002"), ("ATG", "000"), ("GTT", "004"), ("GTC", "004"), ("GTA", "004"), ("GTG", "004"),
    ("TCT", "004"), ("TCC", "004"), ("TCA", "004"), ("TCG", "004"), ("CCT", "004"), ("CCC", "004"), ("CCA", "004"), ("CCG", "004"), ("ACT", "004"), ("ACC", "004"), ("ACA", "004"), ("ACG", "004"), ("GCT", "004"), ("GCC", "004"), ("GCA", "004"), ("GCG", "004"),
    ("TAT", "002"), ("TAC", "002"), ("CAT", "002"), ("CAC", "002"), ("CAA", "002"), ("CAG", "002"), ("AAT", "002"), ("AAC", "002"), ("AAA", "002"), ("AAG", "002"), ("GAT", "002"), ("GAC", "002"), ("GAA", "002"), ("GAG", "002"),
    ("TGT", "002"), ("TGC", "002"), ("TGG", "000"), ("CGT", "004"), ("CGC", "004"), ("CGA", "204"), ("CGG", "204"), ("AGT", "002"), ("AGC", "002"), ("AGA", "202"), ("AGG", "202"), ("GGT", "004"), ("GGC", "004"), ("GGA", "004"), ("GGG", "004"),
)) + ") AS t(codon, f)"
L85 = {c: (f"(1 - 2 * p{c} - q{c})", f"(1 - 2 * q{c})") for c in (0, 2, 4)}
SQL_AB = ", ".join(f"CASE WHEN round({x}, 12) > 0 AND round({y}, 12) > 0 THEN -ln({x}) / 2 + ln({y}) / 4 END AS a{c}, CASE WHEN round({y}, 12) > 0 THEN -ln({y}) / 2 END AS b{c}" for c, (x, y) in L85.items())
SQL_SHARES = ", ".join(f"n{c} / 2.0::DOUBLE AS l{c}, s{c} / nullif(n{c} / 2.0::DOUBLE, 0) AS p{c}, v{c} / nullif(n{c} / 2.0::DOUBLE, 0) AS q{c}" for c in (0, 2, 4))
SQL_CLASSED = ", ".join(f"count(*) FILTER (fa[i] = '{c}') + count(*) FILTER (fb[i] = '{c}') AS n{c}, count(*) FILTER (fa[i] = '{c}' AND x <> y AND kind) AS s{c}, count(*) FILTER (fa[i] = '{c}' AND x <> y AND NOT kind) AS v{c}" for c in (0, 2, 4))


@query(f"""WITH p AS (SELECT concat_ws('/', x.name, y.name) AS pair, x.sequence AS a, y.sequence AS b FROM ({SQL_SOURCES}) x JOIN ({SQL_SOURCES}) y ON x.name < y.name),
t AS (SELECT pair, CASE WHEN z THEN left(a, -3) ELSE a END AS a, CASE WHEN z THEN left(b, -3) ELSE b END AS b FROM (SELECT *, regexp_matches(a, '(TAA|TAG|TGA)$') AND regexp_matches(b, '(TAA|TAG|TGA)$') AS z FROM p)),
c AS (SELECT pair, substr(a, i * 3 + 1, 3) AS ca, substr(b, i * 3 + 1, 3) AS cb FROM (SELECT *, unnest(range(length(a) // 3)) AS i FROM t)),
d AS (SELECT pair, fa, fb, i, ca[i] AS x, cb[i] AS y, (ca[i] IN ('A', 'G')) = (cb[i] IN ('A', 'G')) AS kind FROM (SELECT c.*, k.f AS fa, l.f AS fb FROM c JOIN (SELECT * FROM {SQL_CLASSES}) k ON k.codon = ca JOIN (SELECT * FROM {SQL_CLASSES}) l ON l.codon = cb), (SELECT unnest([1, 2, 3]) AS i)),
s AS (SELECT pair, {SQL_CLASSED} FROM d GROUP BY 1), f AS (SELECT pair, {SQL_SHARES} FROM s), m AS (SELECT *, {SQL_AB} FROM f),
r AS (SELECT pair, 3 * (l2 * b2 + l0 * (a0 + b0)) / nullif(2 * l2 + 3 * l0, 0) AS dn, 3 * (l2 * a2 + l4 * (a4 + b4)) / nullif(l2 + 3 * l4, 0) AS ds FROM m)
SELECT pair, round(dn, 6) AS dn, round(ds, 6) AS ds, round(CASE WHEN ds > 0 THEN dn / ds END, 6) AS omega FROM r""")
def lwl85_matrix(spark, sf_dir):
    """All pairs of the sources' consensus sequences, by degeneracy classes; the SQL states the classes by itself."""
    rows = source_alignment(spark, sf_dir)
    left, right = rows.select(F.col("name").alias("na"), F.col("sequence").alias("a")), rows.select(F.col("name").alias("nb"), F.col("sequence").alias("b"))
    pairs = left.join(right, F.col("na") < F.col("nb")).select(F.concat_ws("/", "na", "nb").alias("pair"), "a", "b")
    return evolution.lwl85(pairs).select("pair", *[F.round(c, 6).alias(c) for c in ("dn", "ds", "omega")])


@query(f"""WITH k AS (SELECT ord, substr(sequence, i + 1, 3) AS kmer FROM (SELECT ord, sequence, unnest(range(length(sequence) - 2)) AS i FROM ({SQL_DNA}) WHERE length(sequence) >= 3))
SELECT ord, kmer, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY ord), 6) AS freq FROM k GROUP BY 1, 2""")
def kmer_embedding(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in embedding.vocabulary("ACGT", 3)])
    long = embedding.kmer_vectors(views.records(spark, sf_dir)).select("ord", F.explode(F.arrays_zip(names.alias("kmer"), F.col("vector").alias("freq"))).alias("x"))
    return long.select("ord", "x.kmer", F.round("x.freq", 6).alias("freq")).where("freq > 0")


@query()
def pca(spark, sf_dir):
    return embedding.principal_components(embedding.kmer_vectors(views.records(spark, sf_dir)))
