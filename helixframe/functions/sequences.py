"""Column expressions over sequences. All are built-in functions, so they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, by codon in the order T, C, A, G of each base.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
STOPS = ("TAA", "TAG", "TGA")
#: The complement of each nucleotide code.
COMPLEMENT = ("ACGTURYMKBDHVN", "TGCAAYRKMVHDBN")
DNA, RNA, PROTEIN = "dna", "rna", "protein"


def let(value: Column, body) -> Column:
    """Evaluate `value` once a row and hand it to `body` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def guess_type(sequence: Column) -> Column:
    """dna, rna or protein by the letters of a sequence; gaps and stops do not count, an empty sequence is dna."""
    letters = F.regexp_replace(F.upper(sequence), r"[-*.]", "")
    return F.when(F.rlike(letters, F.lit("^[ACGTN]*$")), DNA).when(F.rlike(letters, F.lit("^[ACGUN]*U[ACGUN]*$")), RNA).otherwise(PROTEIN)


def length(sequence: Column) -> Column:
    return F.char_length(sequence).cast("long")


def count(sequence: Column, letters: str) -> Column:
    return F.regexp_count(sequence, F.lit(f"[{letters}]")).cast("long")


def symbols(sequence: Column) -> Column:
    """The letters of a sequence; an empty one has none."""
    return F.when(F.char_length(sequence) > 0, F.split(sequence, "")).otherwise(F.array().cast("array<string>"))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(F.upper(sequence), *COMPLEMENT))


def kmers(sequence: Column, k: int) -> Column:
    """All k-letter strings in order, overlapping; a shorter sequence is its own only one."""
    return F.when(F.char_length(sequence) < k, F.array(sequence)).otherwise(F.regexp_extract_all(sequence, F.lit(f"(?=(.{{{k}}}))"), F.lit(1)))


def kmer_set(sequence: Column, k: int) -> Column:
    return F.array_distinct(kmers(sequence, k))


def codons(sequence: Column) -> Column:
    """The whole codons of a sequence, from its first letter."""
    return F.regexp_extract_all(sequence, F.lit("(.{3})"), F.lit(1))


def lookup(table: dict, key: Column, default) -> Column:
    """The value of a small fixed table, or `default`."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def translate(sequence: Column) -> Column:
    """The protein of a coding sequence; codons outside the code give X."""
    return F.array_join(F.transform(codons(F.translate(F.upper(sequence), "U", "T")), lambda c: lookup(CODONS, c, "X")), "")


def py_str(value: Column, kind: str) -> Column:
    """A value as Python's str() shows it; null stays null."""
    if kind == "boolean":
        return F.when(value, "True").when(~value, "False")
    if kind in ("double", "float"):
        whole = F.concat(F.abs(value).cast("decimal(20,0)").cast("string"), F.lit(".0"))
        large = F.when(value < 0, F.concat(F.lit("-"), whole)).otherwise(whole)
        return F.when((F.abs(value) >= 1e7) & (F.abs(value) < 1e16) & (value == F.floor(value)), large).otherwise(value.cast("string"))
    return value.cast("string")


def py_g(value: Column) -> Column:
    """A number as the %g format shows it: six significant digits without trailing zeros."""
    size = F.floor(F.log10(F.abs(value))).cast("int")
    plain = F.regexp_replace(F.regexp_replace(F.round(value, 6).cast("decimal(24,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", value / F.pow(F.lit(10.0), size)), r"0+$", ""), r"\.$", "")
    power = F.format_string("e%s%02d", F.when(size < 0, "-").otherwise("+"), F.abs(size))
    return F.when(value == 0, "0").when((size < -4) | (size >= 6), F.concat(mantissa, power)).otherwise(plain)
