"""Descriptors of nucleotide and protein sequences as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequences as S

#: Fixed values (Kyte and Doolittle 1982): hydropathy.
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
#: Average masses of the free amino acids, and of water.
MASSES = {"A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729, "M": 149.2113, "N": 132.1179, "P": 115.1305, "Q": 146.1445, "R": 174.201, "S": 105.0926, "T": 119.1192, "V": 117.1463, "W": 204.2252, "Y": 181.1885}
WATER = 18.0153
#: Fixed values (Bjellqvist and others 1993): pK of side chains and termini, and of termini of some residues.
POSITIVE_PK, NEGATIVE_PK = {"K": 10.0, "R": 12.0, "H": 5.98}, {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
N_TERM_PK, N_TERM = 7.5, {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
C_TERM_PK, C_TERM = 3.55, {"D": 4.55, "E": 4.75}
PROTEIN = "ACDEFGHIKLMNPQRSTVWY"


def nucleotide(sequence: Column) -> Column:
    """length, gc_percent, at_percent, n_content, codon_usage and gc3_percent as one struct.

    GC counts G, C and S over the whole length; AT is the rest if any letter is not N. Codon figures need whole codons of
    A, C, G, T and N; codons with N are left out.
    """
    seq = F.translate(F.upper(sequence), "U", "T")

    def described(s: Column) -> Column:
        size = F.char_length(s)
        part = lambda n: F.try_divide(n, size)
        gc = F.coalesce(part(F.regexp_count(s, F.lit("[GCS]"))), F.lit(0.0))
        known = F.rlike(s, F.lit("[^N]"))
        coding = (size > 0) & (size % 3 == 0) & F.rlike(s, F.lit("^[ACGTN]*$"))
        clean = F.filter(S.codons(s), lambda c: ~F.contains(c, F.lit("N")))
        return F.struct(
            S.length(s).alias("length"),
            F.round(gc * 100, 3).alias("gc_percent"),
            F.round(F.when(known, 1 - gc).otherwise(0.0) * 100, 3).alias("at_percent"),
            F.round(F.coalesce(part(F.regexp_count(s, F.lit("N"))), F.lit(0.0)), 4).alias("n_content"),
            F.when(coding, S.let(clean, usage)).alias("codon_usage"),
            F.when(coding, S.let(clean, lambda c: F.round(F.try_divide(F.size(F.filter(c, lambda x: F.rlike(x, F.lit("[GC]$")))), F.size(c)) * 100, 3))).alias("gc3_percent"),
        )

    return S.let(seq, described)


def usage(codons: Column) -> Column:
    """(codon, freq) by falling frequency, ties in order of first occurrence."""
    places = F.array_distinct(codons)
    counted = F.transform(places, lambda c, i: F.struct((-F.size(F.filter(codons, lambda x: x == c))).alias("n"), i.alias("i"), c.alias("codon")))
    return F.transform(F.array_sort(counted), lambda x: F.struct(x["codon"].alias("codon"), F.round(-x["n"] / F.size(codons), 4).alias("freq")))


def letter_counts(sequence: Column) -> Column:
    """How often each of the twenty amino acids occurs, in the order of `PROTEIN`."""
    return F.array(*[F.char_length(sequence) - F.char_length(F.replace(sequence, F.lit(a), F.lit(""))) for a in PROTEIN])


def of_letter(counts: Column, letter: str) -> Column:
    return F.get(counts, F.lit(PROTEIN.index(letter)))


def weighted(counts: Column, table: dict[str, float]) -> Column:
    """The sum of a table's values over the letters of a sequence, from its letter counts."""
    parts = [of_letter(counts, a) * F.lit(v) for a, v in table.items()]
    return sum(parts[1:], parts[0])


def protein_letters(sequence: Column) -> Column:
    return F.translate(F.upper(sequence), "*-", "")


def residues(sequence: Column) -> Column:
    return F.char_length(sequence)


def known(sequence: Column) -> Column:
    """Whether a protein has letters and all are of the twenty; others have null descriptors."""
    return F.rlike(sequence, F.lit(f"^[{PROTEIN}]+$"))


def protein(sequence: Column) -> Column:
    """length, molecular_weight, aromaticity, gravy, isoelectric_point and aa_composition as one struct, from one count of the letters."""

    def described(s: Column) -> Column:
        def from_counts(c: Column) -> Column:
            size = residues(s)
            share = lambda n: F.round(n / size, 4)
            return F.struct(
                S.length(s).alias("length"),
                F.round(weighted(c, MASSES) - (size - 1) * WATER, 2).alias("molecular_weight"),
                share(sum((of_letter(c, a) for a in "WY"), of_letter(c, "F"))).alias("aromaticity"),
                share(weighted(c, HYDROPATHY)).alias("gravy"),
                isoelectric_from(s, c).alias("isoelectric_point"),
                F.array(*[F.struct(F.lit(a).alias("residue"), share(of_letter(c, a)).alias("fraction")) for a in PROTEIN]).alias("aa_composition"),
            )

        return F.when(known(s), S.let(letter_counts(s), from_counts))

    return S.let(protein_letters(sequence), described)


def molecular_weight(sequence: Column) -> Column:
    return F.when(known(sequence), F.round(S.let(letter_counts(sequence), lambda c: weighted(c, MASSES)) - (residues(sequence) - 1) * WATER, 2))


def aromaticity(sequence: Column) -> Column:
    return F.when(known(sequence), F.round(F.regexp_count(sequence, F.lit("[FWY]")) / residues(sequence), 4))


def gravy(sequence: Column) -> Column:
    return F.when(known(sequence), F.round(S.let(letter_counts(sequence), lambda c: weighted(c, HYDROPATHY)) / residues(sequence), 4))


def composition(sequence: Column) -> Column:
    """(residue, fraction) of the twenty amino acids."""
    return F.when(known(sequence), S.let(letter_counts(sequence), lambda c: F.array(*[F.struct(F.lit(a).alias("residue"), F.round(of_letter(c, a) / residues(sequence), 4).alias("fraction")) for a in PROTEIN])))


def describe(df: DataFrame, only: str | None = None) -> DataFrame:
    """The records with `meta.descriptor`: the nucleotide figures of DNA and RNA, the protein figures of proteins, null for the rest.

    With `only`, records of other types keep a null descriptor.
    """
    chosen = F.lit(True) if only is None else F.col("seq_type") == only
    nucleic = F.when(chosen & F.col("seq_type").isin("dna", "rna"), nucleotide(F.col("sequence")))
    residual = F.when(chosen & (F.col("seq_type") == "protein"), protein(F.col("sequence")))
    made = df.withColumns({"hf_n": nucleic, "hf_p": residual})
    figures = ["gc_percent", "at_percent", "n_content", "codon_usage", "gc3_percent"], ["molecular_weight", "aromaticity", "gravy", "isoelectric_point", "aa_composition"]
    whole = F.struct(F.coalesce("hf_n.length", "hf_p.length").alias("length"), *[F.col(f"{c}.{x}").alias(x) for c, own in zip(("hf_n", "hf_p"), figures, strict=True) for x in own])
    descriptor = F.when(F.col("hf_n").isNotNull() | F.col("hf_p").isNotNull(), whole)
    meta = F.struct("meta.*", descriptor.alias("descriptor")) if "meta" in df.columns else F.struct(descriptor.alias("descriptor"))
    return made.withColumn("meta", meta).drop("hf_n", "hf_p")


def instability_index(sequence: Column, weights: dict[str, float], default: float = 1.0) -> Column:
    """10 / length times the summed weights of neighbouring residues; the dipeptide weights are a parameter."""
    pairs = S.kmers(sequence, 2)
    total = F.aggregate(F.transform(pairs, lambda p: S.lookup(weights, p, default)), F.lit(0.0), lambda a, x: a + x)
    return F.when(known(sequence) & (residues(sequence) > 1), F.round(total * 10 / residues(sequence), 3))


def isoelectric_point(sequence: Column) -> Column:
    return F.when(known(sequence), S.let(letter_counts(sequence), lambda c: isoelectric_from(sequence, c)))


def isoelectric_from(sequence: Column, counts: Column) -> Column:
    """The pH between 4.05 and 12 at which the net charge is nearest zero, by 20 halvings, to three places.

    A net charge depends on the counts of charged residues and the pK of the ends.
    """
    charged = F.array(*[of_letter(counts, a).cast("double") for a in (*POSITIVE_PK, *NEGATIVE_PK)], S.lookup(N_TERM, F.substring(sequence, 1, 1), N_TERM_PK), S.lookup(C_TERM, F.substring(sequence, -1, 1), C_TERM_PK))
    n = len(POSITIVE_PK) + len(NEGATIVE_PK)
    pks = [F.lit(v) for v in (*POSITIVE_PK.values(), *NEGATIVE_PK.values())]

    def net(c: Column, ph: Column) -> Column:
        up = lambda pk: 1 / (1 + F.pow(F.lit(10.0), ph - pk))
        down = lambda pk: 1 / (1 + F.pow(F.lit(10.0), pk - ph))
        signed = [F.get(c, F.lit(i)) * up(pk) if i < len(POSITIVE_PK) else -F.get(c, F.lit(i)) * down(pk) for i, pk in enumerate(pks)]
        return sum(signed, up(F.get(c, F.lit(n))) - down(F.get(c, F.lit(n + 1))))

    start = F.struct(F.lit(4.05).alias("lo"), F.lit(12.0).alias("hi"))
    half = lambda c: lambda s, _: S.let((s["lo"] + s["hi"]) / 2, lambda m: S.let(net(c, m) > 0, lambda p: F.struct(F.when(p, m).otherwise(s["lo"]).alias("lo"), F.when(p, s["hi"]).otherwise(m).alias("hi"))))
    found = S.let(charged, lambda c: F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, half(c), lambda s: (s["lo"] + s["hi"]) / 2))
    return F.round(found, 3)
