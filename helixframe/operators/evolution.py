"""Synonymous and nonsynonymous divergence (Nei and Gojobori 1986) and conservation, as joins and sums over codons."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequences as S


def synonymous_sites(codon: str) -> float:
    """Over the three places, the share of single changes, stops left out, that keep the amino acid."""
    total = 0.0
    for i in range(3):
        changed = [S.CODONS[codon[:i] + b + codon[i + 1 :]] for b in S.BASES if b != codon[i]]
        kept = [a for a in changed if a != "*"]
        total += sum(a == S.CODONS[codon] for a in kept) / len(kept) if kept else 0.0
    return total


def differences(a: str, b: str) -> tuple[float, float]:
    """Synonymous and nonsynonymous steps from one codon to another, the mean over the shortest paths that pass no stop."""
    places = [i for i in range(3) if a[i] != b[i]]
    paths = []
    for order in permutations(places):
        codon, steps, open_ = a, [0, 0], True
        for i in order:
            after = codon[:i] + b[i] + codon[i + 1 :]
            steps[S.CODONS[codon] != S.CODONS[after]] += 1
            open_ = open_ and (S.CODONS[after] != "*" or after == b)
            codon = after
        paths.append((open_, steps))
    used = [s for ok, s in paths if ok] or [s for _, s in paths]
    return sum(s[0] for s in used) / len(used), sum(s[1] for s in used) / len(used)


def codon_table() -> list[tuple[str, str, float, float, float]]:
    """(codon a, codon b, synonymous sites, synonymous steps, other steps) of all pairs of sense codons."""
    sense = [c for c, a in S.CODONS.items() if a != "*"]
    sites = {c: synonymous_sites(c) for c in sense}
    return [(a, b, (sites[a] + sites[b]) / 2, *differences(a, b)) for a in sense for b in sense]


def codon_frame(spark: SparkSession) -> DataFrame:
    """The table as a frame of 3,721 rows, whatever the data."""
    return spark.createDataFrame(codon_table(), "ca string, cb string, sites double, syn double, non double")


def distance(share: Column) -> Column:
    """Jukes-Cantor distance; null from three quarters on."""
    return F.when(F.round(share, 12) < 0.75, -0.75 * F.ln(1 - share * 4 / 3))


def trim_stops(a: Column, b: Column) -> tuple[Column, Column]:
    """Both sequences without their last codon, if both end in a stop."""
    stop = F.rlike(a, F.lit("(TAA|TAG|TGA)$")) & F.rlike(b, F.lit("(TAA|TAG|TGA)$"))
    cut = lambda s: F.when(stop, F.substring(s, F.lit(1), F.char_length(s) - 3)).otherwise(s)
    return cut(a), cut(b)


def dn_ds(pairs: DataFrame) -> DataFrame:
    """`pair`, `dn`, `ds`, `omega` of `pairs(pair, a, b)`; pairs must be equally long, in whole codons.

    Codons with gaps, ambiguity or a stop are left out. omega is null where ds is null or 0.
    """
    clean = lambda c: F.translate(F.upper(c), "U", "T")
    a, b = trim_stops(clean(F.col("a")), clean(F.col("b")))
    fits = (F.char_length("a") == F.char_length("b")) & (F.char_length("a") % 3 == 0)
    ready = pairs.select("pair", a.alias("a"), b.alias("b")).where(F.assert_true(fits, F.lit("sequences must be equally long, in whole codons")).isNull())
    codons = ready.select("pair", F.explode(F.arrays_zip(S.codons(F.col("a")).alias("ca"), S.codons(F.col("b")).alias("cb"))).alias("c")).select("pair", "c.ca", "c.cb")
    table = F.broadcast(codon_frame(pairs.sparkSession))
    sums = codons.join(table, ["ca", "cb"]).groupBy("pair").agg(F.sum("sites").alias("s"), F.count("*").alias("n"), F.sum("syn").alias("syn"), F.sum("non").alias("non"))
    ds, dn = distance(F.try_divide("syn", "s")), distance(F.try_divide(F.col("non"), 3 * F.col("n") - F.col("s")))
    return sums.select("pair", dn.alias("dn"), ds.alias("ds")).withColumn("omega", F.when(F.col("ds") > 0, F.col("dn") / F.col("ds")))


def dn_ds_matrix(records: DataFrame) -> DataFrame:
    """dN, dS and omega of all pairs of records (name, sequence), the smaller name first; a pair is named by both, parted by a slash."""
    left, right = records.select(F.col("name").alias("na"), F.col("sequence").alias("a")), records.select(F.col("name").alias("nb"), F.col("sequence").alias("b"))
    return dn_ds(left.join(right, F.col("na") < F.col("nb")).select(F.concat_ws("/", "na", "nb").alias("pair"), "a", "b"))


DEGENERACY = (0, 2, 4)


def degeneracy(codon: str) -> str:
    """For each place the class of its changes: 0 where none keeps the amino acid, 4 where all do, else 2."""
    kept = [sum(S.CODONS[codon[:i] + b + codon[i + 1 :]] == S.CODONS[codon] for b in S.BASES if b != codon[i]) for i in range(3)]
    return "".join("0" if n == 0 else "4" if n == 3 else "2" for n in kept)


def degeneracy_frame(spark: SparkSession) -> DataFrame:
    """`codon`, `classes` of the 61 sense codons."""
    return spark.createDataFrame([(c, degeneracy(c)) for c, a in S.CODONS.items() if a != "*"], "codon string, classes string")


def lwl85(pairs: DataFrame) -> DataFrame:
    """`pair`, `dn`, `ds`, `omega` by the method of Li, Wu and Luo (1985), of pairs as `dn_ds` takes them.

    Sites are classed by degeneracy, their numbers being means over both sequences; transitions and transversions are
    counted apart, in the class that the first sequence has there. Each class gives its transitional distance
    A = ln(1 / (1 - 2P - Q)) / 2 - ln(1 / (1 - 2Q)) / 4 and transversional distance B = ln(1 / (1 - 2Q)) / 2. Changes are
    synonymous at fourfold sites and in transitions at twofold ones. Null where a class has no sites or is saturated.
    """
    clean = lambda c: F.translate(F.upper(c), "U", "T")
    a, b = trim_stops(clean(F.col("a")), clean(F.col("b")))
    fits = (F.char_length("a") == F.char_length("b")) & (F.char_length("a") % 3 == 0)
    ready = pairs.select("pair", a.alias("a"), b.alias("b")).where(F.assert_true(fits, F.lit("sequences must be equally long, in whole codons")).isNull())
    codons = ready.select("pair", F.explode(F.arrays_zip(S.codons(F.col("a")).alias("ca"), S.codons(F.col("b")).alias("cb"))).alias("c")).select("pair", "c.ca", "c.cb")
    classes = F.broadcast(degeneracy_frame(pairs.sparkSession))
    rows = codons.join(classes.withColumnsRenamed({"codon": "ca", "classes": "fa"}), "ca").join(classes.withColumnsRenamed({"codon": "cb", "classes": "fb"}), "cb")
    place = lambda name, i: F.substring(name, i, 1)
    pyrimidine = lambda letter: letter.isin("C", "T")
    sums = []
    for c in map(str, DEGENERACY):
        one = lambda condition: F.when(condition, 1).otherwise(0)
        differs = [(place("fa", i) == c) & (place("ca", i) != place("cb", i)) for i in (1, 2, 3)]
        same_kind = [pyrimidine(place("ca", i)) == pyrimidine(place("cb", i)) for i in (1, 2, 3)]
        sums.append(F.sum(sum((one(place(f, i) == c) for f in ("fa", "fb") for i in (1, 2, 3)), F.lit(0)) / 2).alias(f"l{c}"))
        sums.append(F.sum(sum((one(d & k) for d, k in zip(differs, same_kind, strict=True)), F.lit(0))).alias(f"p{c}"))
        sums.append(F.sum(sum((one(d & ~k) for d, k in zip(differs, same_kind, strict=True)), F.lit(0))).alias(f"q{c}"))
    counted = rows.groupBy("pair").agg(*sums)
    shares = counted.withColumns({f"{x}{c}": F.try_divide(f"{x}{c}", f"l{c}") for x in "pq" for c in DEGENERACY})
    log = lambda x: F.when(F.round(x, 12) > 0, -F.ln(x))
    transitional = {f"a{c}": log(1 - 2 * F.col(f"p{c}") - F.col(f"q{c}")) / 2 - log(1 - 2 * F.col(f"q{c}")) / 4 for c in DEGENERACY}
    apart = shares.withColumns({**transitional, **{f"b{c}": log(1 - 2 * F.col(f"q{c}")) / 2 for c in DEGENERACY}})
    ds = F.try_divide(3 * (F.col("l2") * F.col("a2") + F.col("l4") * (F.col("a4") + F.col("b4"))), F.col("l2") + 3 * F.col("l4"))
    dn = F.try_divide(3 * (F.col("l2") * F.col("b2") + F.col("l0") * (F.col("a0") + F.col("b0"))), 2 * F.col("l2") + 3 * F.col("l0"))
    return apart.select("pair", dn.alias("dn"), ds.alias("ds")).withColumn("omega", F.when(F.col("ds") > 0, F.col("dn") / F.col("ds")))
