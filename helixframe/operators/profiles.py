"""Profiles of alignments: counts, probabilities, weights, entropies and consensus of every position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequences as S

ALPHABETS = {"dna": "ACGT", "rna": "ACGU", "protein": "ACDEFGHIKLMNPQRSTVWY"}
GAP = "-"


def check_aligned(df: DataFrame) -> int:
    """The common length of all rows; rows of different lengths, or none, are an error."""
    low, high = df.agg(F.min(F.char_length("sequence")), F.max(F.char_length("sequence"))).first()
    if low is None or low != high:
        raise ValueError("an alignment needs rows of one length")
    return low


def pfm(df: DataFrame, alphabet: str = "ACGT") -> DataFrame:
    """`position` (from 1), `count_X` of every letter and `count_gap`; other letters are not counted.

    Rows of different lengths, or none, are an error.
    Rows are split and counted per position with partial sums, so the shuffle carries a row a position and task.
    """
    check_aligned(df)
    letters = df.select(F.posexplode(S.symbols(F.col("sequence"))).alias("at", "letter"))
    counted = [F.count(F.when(F.col("letter") == a, 1)).alias(f"count_{a}") for a in alphabet]
    return letters.groupBy((F.col("at") + 1).cast("long").alias("position")).agg(*counted, F.count(F.when(F.col("letter") == GAP, 1)).alias("count_gap"))


def add_up(parts: Sequence[Column]) -> Column:
    return sum(parts[1:], parts[0])


def ppm(counts: DataFrame, alphabet: str = "ACGT", pseudocount: float = 0.5) -> DataFrame:
    """`prob_X`: letters' shares without gaps, after a pseudocount; a position with neither is uniform."""
    total = add_up([F.col(f"count_{a}") + F.lit(pseudocount) for a in alphabet])
    share = lambda a: F.when(total > 0, (F.col(f"count_{a}") + pseudocount) / total).otherwise(1 / len(alphabet))
    return counts.withColumns({f"prob_{a}": share(a) for a in alphabet})


def pwm(probabilities: DataFrame, alphabet: str = "ACGT", background: dict[str, float] | None = None, scale: int = 100) -> DataFrame:
    """`pwm_X`, log2 of probability over background, minus infinity for 0, and `pssm_X`, that times `scale` as an integer."""
    background = background or {a: 1 / len(alphabet) for a in alphabet}
    weight = lambda a: F.when(F.col(f"prob_{a}") > 0, F.log2(F.col(f"prob_{a}") / background.get(a, 1e-9))).otherwise(float("-inf"))
    out = probabilities.withColumns({f"pwm_{a}": weight(a) for a in alphabet})
    score = lambda a: F.when(F.col(f"pwm_{a}") == float("-inf"), -2000).otherwise(F.rint(F.col(f"pwm_{a}") * scale)).cast("int")
    return out.withColumns({f"pssm_{a}": score(a) for a in alphabet})


def consensus(alphabet: str = "ACGT") -> Column:
    """The most frequent of gap and letters; the gap wins ties, then the first letter of the alphabet."""
    best, count = F.lit(GAP), F.col("count_gap")
    for a in alphabet:
        best, count = F.when(F.col(f"count_{a}") > count, a).otherwise(best), F.greatest(count, F.col(f"count_{a}"))
    return best


def measures(alphabet: str = "ACGT", background: dict[str, float] | None = None) -> dict[str, Column]:
    """Shannon entropy, conservation (1 less the entropy's share of the most possible) and relative entropy."""
    background = background or {a: 1 / len(alphabet) for a in alphabet}
    p = {a: F.col(f"prob_{a}") for a in alphabet}
    positive = lambda a, term: F.when(p[a] > 0, term).otherwise(0.0)
    entropy = -add_up([positive(a, p[a] * F.log2(p[a])) for a in alphabet])
    relative = add_up([positive(a, p[a] * F.log2(p[a] / background.get(a, 1e-9))) for a in alphabet])
    return {"shannon_entropy": entropy, "conservation_score": 1 - entropy / F.log2(F.lit(float(len(alphabet)))), "relative_entropy": relative}


def profile_table(df: DataFrame, alphabet: str = "ACGT", pseudocount: float = 0.5, background: dict[str, float] | None = None) -> DataFrame:
    """One row a position: consensus, the measures and `freq_X`, rounded to four places; `freq_gap` is the number of gaps.

    Rows of different lengths are an error.
    """
    table = ppm(pfm(df, alphabet), alphabet, pseudocount)
    rounded = [F.round(c, 4).alias(n) for n, c in measures(alphabet, background).items()]
    return table.select("position", consensus(alphabet).alias("consensus"), *rounded, *[F.round(f"prob_{a}", 4).alias(f"freq_{a}") for a in alphabet], F.col("count_gap").alias("freq_gap"))


def conservation_summary(df: DataFrame, alphabet: str = "ACGT") -> DataFrame:
    """One row: mean conservation, total information, most and least conserved positions (the first of ties) and the consensus."""
    table = ppm(pfm(df, alphabet), alphabet).withColumns(measures(alphabet)).withColumn("letter", consensus(alphabet))
    score = F.round("conservation_score", 12)
    return table.agg(
        F.avg("conservation_score").alias("mean_conservation"), F.sum("relative_entropy").alias("total_information"),
        F.max_by("position", F.struct(score, -F.col("position"))).alias("most_conserved"), F.min_by("position", F.struct(score, "position")).alias("least_conserved"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "letter"))), lambda x: x["letter"]), "").alias("consensus"),
    )


def logo_data(df: DataFrame, alphabet: str = "ACGT") -> DataFrame:
    """`position`, `letter`, `height`: what a sequence logo draws, the probability times the positive relative entropy."""
    table = ppm(pfm(df, alphabet), alphabet).withColumns(measures(alphabet))
    letters = F.explode(F.array(*[F.struct(F.lit(a).alias("letter"), (F.col(f"prob_{a}") * F.greatest("relative_entropy", F.lit(0.0))).alias("height")) for a in alphabet]))
    return table.select("position", letters.alias("x")).select("position", "x.letter", "x.height")


def alphabet_of(df: DataFrame) -> str:
    """The alphabet of the first record's type."""
    first = df.orderBy("ord").select("seq_type").first()
    return ALPHABETS[first["seq_type"] if first else "dna"]


def build_profile(df: DataFrame, alphabet: str | None = None, pseudocount: float = 0.5, background: dict[str, float] | None = None) -> DataFrame:
    """One row a position with all that a profile has: counts, probabilities, weights, scores, consensus and measures.

    The alphabet is that of the first record's type unless given; a letter without a background counts as 1e-9.
    """
    letters = alphabet or alphabet_of(df)
    weighted = pwm(ppm(pfm(df, letters), letters, pseudocount), letters, background)
    return weighted.withColumns({"consensus": consensus(letters), **measures(letters, background)})


def viewer_data(df: DataFrame, most: int = 200) -> DataFrame:
    """`ord`, `name`, `position`, `letter`, `conservation_score`: what an alignment viewer draws, `most` positions of it, or all for 0."""
    letters = df.select("ord", "name", F.posexplode(S.symbols(F.col("sequence"))).alias("at", "letter")).select("ord", "name", (F.col("at") + 1).cast("long").alias("position"), "letter")
    shown = letters.where(F.col("position") <= most) if most else letters
    return shown.join(profile_table(df).select("position", "conservation_score"), "position").select("ord", "name", "position", "letter", "conservation_score")
