"""Queries of filters, reports, cleaning, descriptors and annotation over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators import annotation, cleaning, descriptors, report
from helixframe.operators import selection as sel
from helixframe.sources import views

SHOWN = ("seq_id", "name", "seq_type")

#: The record views in SQL.
SQL_DNA = "SELECT doc_id AS ord, doc_id::VARCHAR AS seq_id, concat_ws('_', source, doc_id::VARCHAR) AS name, upper(regexp_replace(coalesce(text,''), '[^ACGTacgt]', '', 'g')) AS sequence, 'dna' AS seq_type, lang, source, n_chars FROM documents"
SQL_N = SQL_DNA.replace("[^ACGTacgt]", "[^ACGTNacgtn]")
SQL_PROTEIN = "SELECT doc_id AS ord, doc_id::VARCHAR AS seq_id, concat_ws('_', source, doc_id::VARCHAR) AS name, upper(regexp_replace(coalesce(text,''), '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) AS sequence, 'protein' AS seq_type, lang, source, n_chars FROM documents"
SQL_GAPPED = "SELECT doc_id AS ord, doc_id::VARCHAR AS seq_id, replace(upper(regexp_replace(coalesce(text,''), '[^ACGTacgt ]', '', 'g')), ' ', '-') AS sequence, lang, source FROM documents"
SQL_TAGGED = f"SELECT r.*, list_filter(['lang:' || r.lang, 'src:' || r.source, CASE WHEN l.quality = 1 THEN 'high_quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda t: t IS NOT NULL) AS tags FROM ({SQL_DNA}) r LEFT JOIN labels l ON r.ord = l.doc_id"
GC_SQL = "CASE WHEN length(sequence) = 0 THEN 0.0 ELSE round(length(regexp_replace(sequence, '[^GCS]', '', 'g'))::DOUBLE / length(sequence) * 100, 3) END"

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with SQL for the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def listed(df):
    return df.select(*SHOWN, S.length(F.col("sequence")).alias("length"))


def picked(where: str, of: str = SQL_DNA) -> str:
    return f"SELECT seq_id, name, seq_type, length(sequence)::BIGINT AS length FROM ({of}) WHERE {where}"


def described(spark, sf_dir):
    """DNA records with their descriptors as metadata."""
    base = views.records(spark, sf_dir, "dna", tagged=True)
    return base.withColumn("meta", F.struct("meta.*", descriptors.nucleotide(F.col("sequence")).alias("descriptor")))


def flagship(spark, sf_dir):
    """DNA records of at least 100 letters and 30 to 60 % GC, counted by type and GC in bins of ten."""
    chosen = sel.Selection(seq_type="dna", min_length=100, field="descriptor.gc_percent", field_min=30, field_max=60)
    df = described(spark, sf_dir)
    return report.crosstab(chosen.apply(df), ["type", "field:descriptor.gc_percent:bin10"], ["seq_type", "gc_bin"])


QUERIES["gc_bins"] = flagship
ORACLES["gc_bins"] = f"""SELECT seq_type, '[' || (floor(gc / 10) * 10)::BIGINT || ',' || (floor(gc / 10) * 10 + 10)::BIGINT || ')' AS gc_bin, count(*) AS count
FROM (SELECT *, {GC_SQL} AS gc FROM ({SQL_DNA})) WHERE length(sequence) >= 100 AND gc BETWEEN 30 AND 60 GROUP BY 1, 2"""


SQL_TYPES = (f"SELECT seq_id, CASE WHEN regexp_full_match(s, '[ACGTN]*') THEN 'dna' WHEN regexp_full_match(s, '[ACGUN]*') THEN 'rna' ELSE 'protein' END AS seq_type FROM (SELECT doc_id::VARCHAR AS seq_id, upper(regexp_replace(coalesce(text,''), '[^A-Za-z]', '', 'g')) AS s FROM documents UNION ALL SELECT seq_id, sequence FROM ({SQL_N}))")


@query(SQL_TYPES)
def seq_type_guess(spark, sf_dir):
    letters = views.records(spark, sf_dir, "letters").select("seq_id", "sequence")
    return letters.unionByName(views.records(spark, sf_dir, "ambiguous").select("seq_id", "sequence")).select("seq_id", S.guess_type(F.col("sequence")).alias("seq_type"))


@query(picked("contains(lower(name), 'src1_')"))
def filter_name_substring(spark, sf_dir):
    return listed(views.records(spark, sf_dir).where(sel.by_name("SRC1_")))


@query(picked("regexp_matches(name, '^src1?3_.*3$')"))
def filter_name_regex(spark, sf_dir):
    return listed(views.records(spark, sf_dir).where(sel.by_name("^src1?3_.*3$", regex=True)))


@query(picked("list_contains(tags, 'lang:fr')", SQL_TAGGED))
def filter_tag(spark, sf_dir):
    return listed(views.records(spark, sf_dir, tagged=True).where(sel.by_tag("lang:fr")))


@query(picked("NOT list_contains(tags, 'high_quality')", SQL_TAGGED))
def filter_tag_absent(spark, sf_dir):
    return listed(views.records(spark, sf_dir, tagged=True).where(sel.by_tag_absent("high_quality")))


@query(picked("ord IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def filter_id_in(spark, sf_dir):
    ids = views.read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("seq_id"))
    return listed(sel.ids_from(views.records(spark, sf_dir), ids))


@query(picked("ord NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def filter_id_exclude(spark, sf_dir):
    ids = views.read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("seq_id"))
    return listed(sel.ids_from(views.records(spark, sf_dir), ids, keep=False))


@query(picked("length(sequence) BETWEEN 200 AND 900"))
def filter_length_range(spark, sf_dir):
    return listed(views.records(spark, sf_dir).where(sel.by_length(200, 900)))


@query(picked("regexp_matches(sequence, 'ATG(...)*?TA[AG]')"))
def filter_motif(spark, sf_dir):
    return listed(views.records(spark, sf_dir).where(sel.by_motif("atg(...)*?ta[ag]")))


@query(picked("NOT contains(sequence, 'GATTACA')"))
def filter_motif_absent(spark, sf_dir):
    return listed(views.records(spark, sf_dir).where(sel.by_motif_absent("gattaca", regex=False)))


@query(picked("n_chars BETWEEN 500 AND 2500"))
def filter_field_range(spark, sf_dir):
    df = views.records(spark, sf_dir)
    return listed(df.where(sel.by_field_range(df, "n_chars", 500, 2500)))


@query(picked("coalesce(lang, 'None') = 'de'"))
def filter_field_equals(spark, sf_dir):
    df = views.records(spark, sf_dir)
    return listed(df.where(sel.by_field_equals(df, "lang", "de")))


@query(picked("coalesce(lang, 'None') <> 'en'"))
def filter_field_not_equals(spark, sf_dir):
    df = views.records(spark, sf_dir)
    return listed(df.where(sel.by_field_not_equals(df, "lang", "en")))


@query(picked("contains(lower(name), 'src') AND list_contains(tags, 'lang:en') AND NOT list_contains(tags, 'toxic') AND length(sequence) BETWEEN 100 AND 5000 AND regexp_matches(sequence, 'ATT[AG]') AND NOT regexp_matches(sequence, 'GGGG') AND coalesce(source, 'None') <> 'src3'", SQL_TAGGED))
def filter_combined(spark, sf_dir):
    chosen = sel.Selection(seq_type="dna", name="src", tag="lang:en", exclude_tag="toxic", min_length=100, max_length=5000, motif="att[ag]", exclude_motif="gggg", field="source", field_not_equals="src3")
    return listed(chosen.apply(views.records(spark, sf_dir, tagged=True)))


@query("SELECT seq_type, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(s, '[ACGTN]*') THEN 'dna' WHEN regexp_full_match(s, '[ACGUN]*') THEN 'rna' ELSE 'protein' END AS seq_type FROM (SELECT upper(regexp_replace(coalesce(text,''), '[^A-Za-z]', '', 'g')) AS s FROM documents)) GROUP BY 1")
def type_counts(spark, sf_dir):
    return report.type_counts(views.records(spark, sf_dir, "letters"))


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM ({SQL_TAGGED})) GROUP BY 1")
def tag_counts(spark, sf_dir):
    return report.tag_counts(views.records(spark, sf_dir, tagged=True))


@query(f"SELECT seq_type, count(*) AS count FROM ({SQL_TYPES}) GROUP BY 1")
def report_type(spark, sf_dir):
    both = views.records(spark, sf_dir, "letters").unionByName(views.records(spark, sf_dir, "ambiguous"))
    return report.crosstab(both, ["type"], ["seq_type"])


@query(f"SELECT CASE WHEN list_contains(tags, 'toxic') THEN 'yes' ELSE 'no' END AS toxic, count(*) AS count FROM ({SQL_TAGGED}) GROUP BY 1")
def report_tag(spark, sf_dir):
    return report.crosstab(views.records(spark, sf_dir, tagged=True), ["tag:toxic"], ["toxic"])


@query(f"SELECT CASE WHEN source IS NULL THEN '(none)' ELSE source END AS src, count(*) AS count FROM ({SQL_TAGGED}) GROUP BY 1")
def report_tag_prefix(spark, sf_dir):
    return report.crosstab(views.records(spark, sf_dir, tagged=True), ["tag_prefix:src:"], ["src"])


@query(f"SELECT coalesce(lang, '(none)') AS lang, count(*) AS count FROM ({SQL_DNA}) GROUP BY 1")
def report_field(spark, sf_dir):
    return report.crosstab(views.records(spark, sf_dir), ["field:lang"], ["lang"])


@query(f"SELECT '[' || (n_chars // 250 * 250) || ',' || (n_chars // 250 * 250 + 250) || ')' AS size_bin, count(*) AS count FROM ({SQL_DNA}) GROUP BY 1")
def report_field_bin(spark, sf_dir):
    return report.crosstab(views.records(spark, sf_dir), ["field:n_chars:bin250"], ["size_bin"])


@query(f"SELECT coalesce(lang, '(none)') AS lang, CASE WHEN list_contains(tags, 'high_quality') THEN 'yes' ELSE 'no' END AS good, '[' || (floor(gc / 10) * 10)::BIGINT || ',' || (floor(gc / 10) * 10 + 10)::BIGINT || ')' AS gc_bin, count(*) AS count FROM (SELECT *, {GC_SQL} AS gc FROM ({SQL_TAGGED})) GROUP BY 1, 2, 3")
def report_3d(spark, sf_dir):
    return report.crosstab(described(spark, sf_dir), ["field:lang", "tag:high_quality", "field:descriptor.gc_percent:bin10"], ["lang", "good", "gc_bin"])


@query(f"SELECT seq_id, name, seq_type, length(sequence)::BIGINT AS length, concat_ws(' ', source, lang) AS description, array_to_string(list_sort(tags), ';') AS tags, lang AS meta_lang, source AS meta_source, n_chars::VARCHAR AS meta_n_chars FROM ({SQL_TAGGED})")
def export_flat_rows(spark, sf_dir):
    return report.flat_rows(views.records(spark, sf_dir, tagged=True))


@query("SELECT d.doc_id::VARCHAR AS seq_id, f.first, f.quality FROM documents d LEFT JOIN (SELECT d.source, first(l.doc_id ORDER BY l.doc_id) AS first, first(l.quality ORDER BY l.doc_id) AS quality FROM labels l JOIN documents d USING (doc_id) GROUP BY 1) f USING (source)")
def enrich_by_name(spark, sf_dir):
    """Records named by their source take the figures of the first labelled record of that name."""
    named = views.records(spark, sf_dir).select("ord", "seq_id", F.col("meta.source").alias("name"))
    labels = views.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), "quality").join(named, "ord")
    known = labels.select("name", "ord", F.struct(F.col("ord").alias("first"), "quality").alias("meta"))
    return sel.enrich_by_name(named.drop("ord"), known, ["meta"]).select("seq_id", "meta.first", "meta.quality")


SQL_HITS = "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE 'src' END || (c_custkey % 20) AS hit_id, c_custkey AS hit, c_acctbal AS score FROM customer"


@query(f"SELECT h.hit, h.hit_id, h.score, f.a::VARCHAR AS first_id, f.z::VARCHAR AS last_id FROM ({SQL_HITS}) h LEFT JOIN (SELECT source, min(doc_id) AS a, max(doc_id) AS z FROM documents GROUP BY 1) f ON f.source = h.hit_id")
def hit_resolution(spark, sf_dir):
    """Hits on names that many records share, and on names of none, with the first and the last record of each."""
    customers = views.read(spark, sf_dir, "customer")
    hit_id = F.concat(F.when(F.col("c_custkey") % 3 == 0, "none").otherwise("src"), (F.col("c_custkey") % 20).cast("string"))
    hits = customers.select(F.col("c_custkey").alias("hit"), hit_id.alias("hit_id"), F.col("c_acctbal").alias("score"))
    named = views.records(spark, sf_dir).withColumn("name", F.col("meta.source"))
    ends = [sel.resolve_hits(hits.select("hit_id", "score").distinct(), named, first).select("hit_id", F.col("seq_id").alias(name)).distinct() for first, name in ((True, "first_id"), (False, "last_id"))]
    return hits.join(ends[0], "hit_id").join(ends[1], "hit_id").select("hit", "hit_id", "score", "first_id", "last_id")


@query(f"SELECT seq_id, replace(sequence, '-', '') AS sequence FROM ({SQL_GAPPED})")
def clean_strip_gaps(spark, sf_dir):
    return cleaning.clean(views.records(spark, sf_dir, "gapped"), cleaning.Cleaning(strip_gaps=True, drop_empty=False)).select("seq_id", "sequence")


@query(f"WITH f AS (SELECT seq_id, CASE WHEN starts_with(sequence, 'AT') THEN substr(sequence, 3) ELSE sequence END AS s FROM ({SQL_DNA})) SELECT seq_id, CASE WHEN ends_with(s, 'AT') THEN substr(s, 1, length(s) - 2) ELSE s END AS sequence FROM f")
def clean_adapter(spark, sf_dir):
    return cleaning.clean(views.records(spark, sf_dir), cleaning.Cleaning(adapter="at", drop_empty=False)).select("seq_id", "sequence")


SQL_QUALITY = f"""WITH r AS (SELECT seq_id, sequence, list_transform(range(length(sequence)), lambda i: (ascii(substr(sequence, i + 1, 1)) * 7 + i * 13) % 41) AS q FROM ({SQL_N})),
m AS (SELECT *, list_transform(range(len(q)), lambda i: list_avg(q[i + 1:i + 4])) AS f, list_transform(range(len(q)), lambda i: list_avg(q[greatest(i - 2, 1):i + 1])) AS b FROM r),
s AS (SELECT *, coalesce(list_position(list_transform(f, lambda x: x >= 20), true) - 1, len(q)) AS a, coalesce(list_position(list_transform(list_reverse(b), lambda x: x >= 20), true) - 1, len(q)) AS z FROM m)
SELECT seq_id, substr(sequence, a + 1, greatest(length(sequence) - a - least(z, length(sequence) - a), 0)) AS sequence FROM s"""


@query(SQL_QUALITY)
def clean_quality(spark, sf_dir):
    return cleaning.clean(views.reads(spark, sf_dir), cleaning.Cleaning(min_quality=20, quality_window=4, drop_empty=False)).select("seq_id", "sequence")


@query("SELECT doc_id::VARCHAR AS seq_id, regexp_replace(regexp_replace(s, '^[RYSWKMBDHVN]+', ''), '[RYSWKMBDHVN]+$', '') AS sequence FROM (SELECT doc_id, upper(regexp_replace(coalesce(text,''), '[^ACGTNacgtn]', '', 'g')) AS s FROM documents)")
def clean_ambiguous_ends(spark, sf_dir):
    return cleaning.clean(views.records(spark, sf_dir, "ambiguous"), cleaning.Cleaning(trim_ambiguous=True, drop_empty=False)).select("seq_id", "sequence")


@query(f"SELECT seq_id, CASE WHEN length(sequence) = 0 THEN 0.0 ELSE round(length(regexp_replace(sequence, '[^N]', '', 'g'))::DOUBLE / length(sequence), 6) END AS ambiguous FROM ({SQL_N})")
def clean_ambiguous_fraction(spark, sf_dir):
    return views.records(spark, sf_dir, "ambiguous").select("seq_id", F.round(cleaning.ambiguous_fraction(F.col("sequence"), F.col("seq_type")), 6).alias("ambiguous"))


@query(f"SELECT seq_id, CASE WHEN length(sequence) = 0 THEN 'dropped_empty' WHEN row_number() OVER (PARTITION BY sequence ORDER BY ord) > 1 THEN 'dropped_duplicate_sequence' ELSE 'kept' END AS fate FROM ({SQL_DNA})")
def clean_dedup_sequence(spark, sf_dir):
    return cleaning.clean(views.records(spark, sf_dir), cleaning.Cleaning(dedup_sequence=True)).select("seq_id", "fate")


@query(f"SELECT seq_id, CASE WHEN length(sequence) = 0 THEN 'dropped_empty' WHEN row_number() OVER (PARTITION BY length(sequence) = 0, source ORDER BY ord) > 1 THEN 'dropped_duplicate_name' ELSE 'kept' END AS fate FROM ({SQL_DNA})")
def clean_dedup_name(spark, sf_dir):
    return cleaning.clean(views.records(spark, sf_dir).withColumn("name", F.col("meta.source")), cleaning.Cleaning(dedup_name=True)).select("seq_id", "fate")


@query(f"""WITH t AS (SELECT ord, source, upper(regexp_replace(regexp_replace(sequence, '^[RYSWKMBDHVN]+', ''), '[RYSWKMBDHVN]+$', '')) AS s, sequence FROM ({SQL_N})),
f AS (SELECT *, CASE WHEN length(s) = 0 THEN 'dropped_empty' WHEN length(s) < 50 THEN 'dropped_length' WHEN length(s) > 4000 THEN 'dropped_length' WHEN length(regexp_replace(s, '[^N]', '', 'g'))::DOUBLE / length(s) > 0.25 THEN 'dropped_ambiguous' END AS fate FROM t),
d AS (SELECT *, CASE WHEN fate IS NULL AND row_number() OVER (PARTITION BY fate, s ORDER BY ord) > 1 THEN 'dropped_duplicate_sequence' ELSE coalesce(fate, 'kept') END AS last FROM f)
SELECT count(*) FILTER (last = 'kept') AS kept, count(*) FILTER (last = 'dropped_duplicate_sequence') AS dropped_duplicate_sequence, 0::BIGINT AS dropped_duplicate_name, count(*) FILTER (last = 'dropped_length') AS dropped_length, count(*) FILTER (last = 'dropped_ambiguous') AS dropped_ambiguous, count(*) FILTER (last = 'dropped_empty') AS dropped_empty, 0::BIGINT AS trimmed_gaps, count(*) FILTER (s <> sequence) AS trimmed_ambiguous_ends, 0::BIGINT AS trimmed_adapter, 0::BIGINT AS trimmed_quality FROM d""")
def clean_pipeline_counts(spark, sf_dir):
    options = cleaning.Cleaning(trim_ambiguous=True, min_length=50, max_length=4000, max_ambiguous_fraction=0.25, dedup_sequence=True)
    return cleaning.report(cleaning.clean(views.records(spark, sf_dir, "ambiguous"), options))


@query(f"SELECT seq_id, length(sequence)::BIGINT AS length, {GC_SQL} AS gc_percent, CASE WHEN regexp_matches(sequence, '[^N]') THEN round((1 - length(regexp_replace(sequence, '[^GCS]', '', 'g'))::DOUBLE / length(sequence)) * 100, 3) ELSE 0.0 END AS at_percent, CASE WHEN length(sequence) = 0 THEN 0.0 ELSE round(length(regexp_replace(sequence, '[^N]', '', 'g'))::DOUBLE / length(sequence), 4) END AS n_content FROM ({SQL_N})")
def desc_nucleotide(spark, sf_dir):
    d = views.records(spark, sf_dir, "ambiguous").select("seq_id", descriptors.nucleotide(F.col("sequence")).alias("d"))
    return d.select("seq_id", "d.length", "d.gc_percent", "d.at_percent", "d.n_content")


SQL_CODONS = f"SELECT seq_id, unnest(list_transform(range(length(sequence) // 3), lambda i: substr(sequence, i * 3 + 1, 3))) AS codon FROM ({SQL_N}) WHERE length(sequence) > 0 AND length(sequence) % 3 = 0"


@query(f"SELECT seq_id, codon, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY seq_id), 4) AS freq FROM ({SQL_CODONS}) WHERE NOT contains(codon, 'N') GROUP BY 1, 2")
def desc_codon_usage(spark, sf_dir):
    d = views.records(spark, sf_dir, "ambiguous").select("seq_id", descriptors.nucleotide(F.col("sequence"))["codon_usage"].alias("u"))
    return d.select("seq_id", F.explode("u").alias("u")).select("seq_id", "u.codon", "u.freq")


@query(f"SELECT seq_id, round(avg(CASE WHEN codon[3] IN ('G', 'C') THEN 1.0 ELSE 0.0 END) * 100, 3) AS gc3_percent FROM ({SQL_CODONS}) WHERE NOT contains(codon, 'N') GROUP BY 1")
def desc_gc3(spark, sf_dir):
    d = views.records(spark, sf_dir, "ambiguous").select("seq_id", descriptors.nucleotide(F.col("sequence"))["gc3_percent"].alias("gc3_percent"))
    return d.where("gc3_percent IS NOT NULL")


def _occurs(letter: str) -> str:
    return f"(length(sequence) - length(replace(sequence, '{letter}', '')))::DOUBLE"


def _charge() -> str:
    """The net charge at the middle of lo and hi, by the textbook formula of each charged group."""
    up = lambda n, pk: f"{n} / (1 + pow(10.0::DOUBLE, (lo + hi) / 2 - {pk}))"
    down = lambda n, pk: f"{n} / (1 + pow(10.0::DOUBLE, {pk} - (lo + hi) / 2))"
    end = lambda table, default, letter: "CASE " + " ".join(f"WHEN {letter} = '{a}' THEN {v}::DOUBLE" for a, v in table.items()) + f" ELSE {default}::DOUBLE END"
    positive = [up(f"n_{a}", f"{pk}::DOUBLE") for a, pk in descriptors.POSITIVE_PK.items()]
    negative = [down(f"n_{a}", f"{pk}::DOUBLE") for a, pk in descriptors.NEGATIVE_PK.items()]
    return " + ".join([*positive, up("1", f"({end(descriptors.N_TERM, descriptors.N_TERM_PK, 'first')})")]) + " - " + " - ".join([*negative, down("1", f"({end(descriptors.C_TERM, descriptors.C_TERM_PK, 'last')})")])


SQL_PI = f"""WITH RECURSIVE c AS (SELECT seq_id, left(sequence, 1) AS first, right(sequence, 1) AS last, {', '.join(f'{_occurs(a)} AS n_{a}' for a in (*descriptors.POSITIVE_PK, *descriptors.NEGATIVE_PK))} FROM ({SQL_PROTEIN}) WHERE length(sequence) > 0),
h AS (SELECT *, 0 AS step, 4.05::DOUBLE AS lo, 12.0::DOUBLE AS hi FROM c UNION ALL SELECT * EXCLUDE (positive) REPLACE (step + 1 AS step, CASE WHEN positive THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN positive THEN hi ELSE (lo + hi) / 2 END AS hi) FROM (SELECT *, ({_charge()}) > 0 AS positive FROM h) WHERE step < 20)
SELECT p.seq_id, round((lo + hi) / 2, 3) AS isoelectric_point FROM ({SQL_PROTEIN}) p LEFT JOIN (SELECT * FROM h WHERE step = 20) USING (seq_id)"""


def _weights(table: dict) -> str:
    return " + ".join(f"(length(sequence) - length(replace(sequence, '{a}', ''))) * ({v}::DOUBLE)" for a, v in table.items())


@query(f"SELECT seq_id, length(sequence)::BIGINT AS length, round({_weights(descriptors.MASSES)} - (length(sequence) - 1) * {descriptors.WATER}::DOUBLE, 2) AS molecular_weight, round(length(regexp_replace(sequence, '[^FWY]', '', 'g'))::DOUBLE / length(sequence), 4) AS aromaticity, round(({_weights(descriptors.HYDROPATHY)}) / length(sequence), 4) AS gravy, isoelectric_point FROM ({SQL_PROTEIN}) JOIN ({SQL_PI}) USING (seq_id) WHERE length(sequence) > 0")
def desc_protein(spark, sf_dir):
    df = views.records(spark, sf_dir, "protein").where(F.char_length("sequence") > 0).select("seq_id", descriptors.protein(F.col("sequence")).alias("d"))
    return df.select("seq_id", "d.length", "d.molecular_weight", "d.aromaticity", "d.gravy", "d.isoelectric_point")


@query(f"SELECT seq_id, a AS residue, round((length(sequence) - length(replace(sequence, a, '')))::DOUBLE / length(sequence), 4) AS fraction FROM ({SQL_PROTEIN}), (SELECT unnest(string_split('{' '.join(descriptors.PROTEIN)}', ' ')) AS a) WHERE length(sequence) > 0")
def desc_composition(spark, sf_dir):
    d = views.records(spark, sf_dir, "protein").select("seq_id", F.explode(descriptors.composition(F.col("sequence"))).alias("c"))
    return d.select("seq_id", "c.residue", "c.fraction")


@query(SQL_PI)
def desc_pi(spark, sf_dir):
    return views.records(spark, sf_dir, "protein").select("seq_id", descriptors.isoelectric_point(F.col("sequence")).alias("isoelectric_point"))


SQL_ORFS = f"""WITH s AS (SELECT seq_id, 1 AS strand, sequence FROM ({SQL_DNA}) UNION ALL SELECT seq_id, -1, reverse(translate(sequence, 'ACGT', 'TGCA')) FROM ({SQL_DNA})),
c AS (SELECT seq_id, strand, f AS frame, unnest(range((length(sequence) - f) // 3)) AS i, sequence FROM s, (SELECT unnest([0, 1, 2]) AS f) WHERE length(sequence) - f >= 3),
k AS (SELECT seq_id, strand, frame, i, substr(sequence, i * 3 + frame + 1, 3) AS codon FROM c),
g AS (SELECT *, count(*) FILTER (codon IN ('TAA', 'TAG', 'TGA')) OVER (PARTITION BY seq_id, strand, frame ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM k),
o AS (SELECT seq_id, strand, frame, part, min(i) FILTER (codon = 'ATG') AS a, max(i) FILTER (codon IN ('TAA', 'TAG', 'TGA')) AS z FROM g GROUP BY ALL),
t AS (SELECT o.seq_id, o.strand, o.frame, a, z, string_agg(aa, '' ORDER BY i) AS protein FROM o JOIN k ON k.seq_id = o.seq_id AND k.strand = o.strand AND k.frame = o.frame AND i >= a AND i < z JOIN (VALUES {', '.join(f"('{c}', '{aa}')" for c, aa in S.CODONS.items())}) AS x(codon, aa) USING (codon) WHERE z - a >= 30 GROUP BY ALL)
SELECT seq_id, strand, frame, (a * 3 + frame)::BIGINT AS "start", (z * 3 + 3 + frame)::BIGINT AS "end", (z - a)::BIGINT AS protein_length, protein FROM t"""


@query(SQL_ORFS)
def orf_scan(spark, sf_dir):
    hits = views.records(spark, sf_dir).select("seq_id", F.explode(annotation.orfs(F.col("sequence"), 30)).alias("o"))
    return hits.select("seq_id", "o.strand", "o.frame", "o.start", "o.end", "o.protein_length", "o.protein")


@query(f"""WITH g AS (SELECT seq_id, sequence, unnest(list_filter(range(length(sequence)), lambda i: substr(sequence, i + 1, 2) = 'GT')) AS s FROM ({SQL_DNA})),
a AS (SELECT seq_id, s, least(length(sequence), s + 5000) AS last, position('AG' IN substr(sequence, s + 19)) AS p FROM g)
SELECT seq_id, s::BIGINT AS "start", (s + 18 + p - 1 + 2)::BIGINT AS "end", (18 + p + 1)::BIGINT AS length FROM a WHERE s + 20 < last AND p > 0 AND s + 18 + p + 1 <= last""")
def intron_scan(spark, sf_dir):
    hits = views.records(spark, sf_dir).select("seq_id", F.explode(annotation.introns(F.col("sequence"))).alias("o"))
    return hits.select("seq_id", "o.start", "o.end", "o.length")


SQL_TATA = f"""WITH w AS (SELECT seq_id, length(sequence) AS n, right(sequence, 100) AS s FROM ({SQL_DNA})),
m AS (SELECT seq_id, n, length(s) AS size, regexp_extract_all(s, '{annotation.TATA}') AS hits, regexp_split_to_array(s, '{annotation.TATA}') AS gaps FROM w),
x AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
p AS (SELECT seq_id, n, hits[i] AS matched_text, n - size + list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS pos FROM x)
SELECT seq_id, pos::BIGINT AS "start", (pos - n)::BIGINT AS offset_from_end, matched_text FROM p"""


@query(SQL_TATA)
def tata_scan(spark, sf_dir):
    hits = views.records(spark, sf_dir).select("seq_id", F.explode(annotation.tata_boxes(F.col("sequence"))).alias("o"))
    return hits.select("seq_id", "o.start", "o.offset_from_end", "o.matched_text")


#: Letters that a match of each motif can begin with.
FIRST = {i: p[1 : p.index("]")] if p[0] == "[" else p[0] for i, (_, p) in annotation.MOTIFS.items()}
SQL_MOTIFS = " UNION ALL ".join(f"SELECT seq_id, '{i}' AS pattern_id, i::BIGINT AS \"start\", (i + length(regexp_extract(rest, '^({p})')))::BIGINT AS \"end\" FROM (SELECT seq_id, i, substr(sequence, i + 1, 32) AS rest FROM (SELECT seq_id, sequence, unnest(range(length(sequence))) AS i FROM ({SQL_PROTEIN})) WHERE contains('{FIRST[i]}', sequence[i + 1])) WHERE regexp_matches(rest, '^({p})')" for i, (_, p) in annotation.MOTIFS.items())


@query(SQL_MOTIFS)
def motif_scan(spark, sf_dir):
    hits = views.records(spark, sf_dir, "protein").select("seq_id", F.explode(annotation.motifs(F.col("sequence"))).alias("m"))
    return hits.select("seq_id", "m.pattern_id", "m.start", "m.end")


def _regions(spark, sf_dir, feature):
    hits = views.records(spark, sf_dir, "protein").select("seq_id", F.explode(feature(F.col("sequence"))).alias("r"))
    return hits.select("seq_id", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"), F.round("r.score", 6).alias("score"))


#: Residues with their places, and windowed means of hydropathy in tenths, which add up exactly.
SQL_RESIDUES = f"SELECT seq_id, i, sequence[i] AS aa, n FROM (SELECT seq_id, sequence, length(sequence) AS n, unnest(range(1, length(sequence) + 1)) AS i FROM ({SQL_PROTEIN}))"
SQL_MEANS = f"SELECT seq_id, i, n, sum(h) OVER w / (10.0::DOUBLE * count(*) OVER w) AS m FROM (SELECT r.*, h FROM ({SQL_RESIDUES}) r JOIN (VALUES {', '.join(f"('{a}', {round(v * 10)})" for a, v in descriptors.HYDROPATHY.items())}) AS s(aa, h) USING (aa)) WINDOW w AS (PARTITION BY seq_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING)"


@query(f"""WITH f AS (SELECT seq_id, i, m, i - row_number() OVER (PARTITION BY seq_id ORDER BY i) AS run FROM ({SQL_MEANS}) WHERE m >= 1.6::DOUBLE)
SELECT seq_id, (min(i) - 1)::BIGINT AS "start", max(i)::BIGINT AS "end", round(avg(m), 6) AS score FROM f GROUP BY seq_id, run HAVING count(*) >= 6""")
def tm_regions(spark, sf_dir):
    return _regions(spark, sf_dir, annotation.tm_regions)


#: Sums of tenths over windows of 28 from each place on, of all residues and of each place of the heptad.
SQL_HEPTADS = f"SELECT seq_id, i, n, sum(h) OVER w AS total, {', '.join(f'coalesce(sum(h) FILTER (i % 7 = {k}) OVER w, 0) AS c{k}' for k in range(7))} FROM (SELECT r.*, h FROM ({SQL_RESIDUES}) r JOIN (VALUES {', '.join(f"('{a}', {round(v * 10)})" for a, v in descriptors.HYDROPATHY.items())}) AS s(aa, h) USING (aa)) WINDOW w AS (PARTITION BY seq_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 27 FOLLOWING)"
#: 8 core and 20 other places: core / 8 - (total - core) / 20, in tenths.
SQL_COILS = f"SELECT seq_id, i + 14 AS i, (7 * greatest({', '.join(f'c{k} + c{(k + 3) % 7}' for k in range(7))}) - 2 * total) / 400.0::DOUBLE AS score FROM ({SQL_HEPTADS}) WHERE i + 27 <= n"


@query(f"""WITH f AS (SELECT *, i - row_number() OVER (PARTITION BY seq_id ORDER BY i) AS run FROM ({SQL_COILS}) WHERE score >= 1)
SELECT seq_id, (min(i) - 1)::BIGINT AS "start", max(i)::BIGINT AS "end", round(max(score), 6) AS score FROM f GROUP BY seq_id, run""")
def coiled_coils(spark, sf_dir):
    return _regions(spark, sf_dir, annotation.coiled_coils)


#: Entropy of each window of 12 from counts of every letter, runs of low ones, and the entropy of what those cover.
SQL_LOW = f"""WITH r AS MATERIALIZED ({SQL_RESIDUES}),
w AS (SELECT seq_id, i, n, {', '.join(f"count(*) FILTER (aa = '{a}') OVER w AS c_{a}" for a in descriptors.PROTEIN)} FROM r WINDOW w AS (PARTITION BY seq_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
h AS (SELECT seq_id, i FROM w WHERE i + 11 <= n AND -({' + '.join(f"CASE WHEN c_{a} > 0 THEN c_{a} / 12.0::DOUBLE * log2(c_{a} / 12.0::DOUBLE) ELSE 0 END" for a in descriptors.PROTEIN)}) < 3.0::DOUBLE - 1e-12),
g AS (SELECT seq_id, min(i) - 1 AS a, max(i) + 11 AS z FROM (SELECT *, i - row_number() OVER (PARTITION BY seq_id ORDER BY i) AS run FROM h) GROUP BY seq_id, run),
l AS (SELECT g.seq_id, a, z, aa, count(*) AS n FROM g JOIN r ON r.seq_id = g.seq_id AND r.i > a AND r.i <= z GROUP BY ALL)
SELECT seq_id, a::BIGINT AS "start", z::BIGINT AS "end", round(-sum(n / (z - a)::DOUBLE * log2(n / (z - a)::DOUBLE)), 6) AS score FROM l GROUP BY seq_id, a, z"""


@query(SQL_LOW)
def low_complexity(spark, sf_dir):
    return _regions(spark, sf_dir, annotation.low_complexity)


@query()
def signal_peptide(spark, sf_dir):
    p = views.records(spark, sf_dir, "protein").select("seq_id", annotation.signal_peptide(F.col("sequence")).alias("p"))
    return p.select("seq_id", "p.is_signal_peptide", "p.cleavage_site", "p.score")


@query(f"SELECT seq_id, count(*) AS n, round(max(m), 6) AS most, round(min(m), 6) AS least, round(avg(m), 6) AS mean FROM ({SQL_MEANS}) GROUP BY 1")
def hydropathy(spark, sf_dir):
    p = views.records(spark, sf_dir, "protein").select("seq_id", annotation.hydropathy(F.col("sequence")).alias("p")).where(F.size("p") > 0)
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.size("p")
    return p.select("seq_id", F.size("p").cast("long").alias("n"), F.round(F.array_max("p"), 6).alias("most"), F.round(F.array_min("p"), 6).alias("least"), F.round(mean, 6).alias("mean"))
