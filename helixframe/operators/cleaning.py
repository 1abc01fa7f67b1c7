"""The cleaning pipeline: trims and filters as Columns, duplicates by windows, and the fate of every record as a column.

Steps run in a fixed order: gaps, adapter, quality, ambiguous ends, empty, length, ambiguous fraction, duplicate
sequence, duplicate name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequences as S

GAPS = "-."
#: Codes for more than one residue.
AMBIGUOUS = {"protein": "X", "nucleotide": "RYSWKMBDHVN"}


def ambiguous_letters(seq_type: Column, pattern: str) -> Column:
    return F.when(seq_type == S.PROTEIN, pattern.format(AMBIGUOUS["protein"])).otherwise(pattern.format(AMBIGUOUS["nucleotide"]))


def strip_gaps(sequence: Column) -> Column:
    return F.translate(sequence, GAPS, "")


def adapter_ends(sequence: Column, adapter: str, end: str = "both") -> tuple[Column, Column]:
    """Letters to take from the start and from the end; the end is looked at in what the start leaves."""
    adapter = adapter.upper()
    lead = F.when(F.lit(end in ("5", "both")) & F.startswith(sequence, F.lit(adapter)), len(adapter)).otherwise(0)
    rest = F.substring(sequence, lead + 1, F.char_length(sequence))
    return lead, F.when(F.lit(end in ("3", "both")) & F.endswith(rest, F.lit(adapter)), len(adapter)).otherwise(0)


def quality_ends(quality: Column, least: float, window: int = 4) -> tuple[Column, Column]:
    """Letters to trim from either end while the mean of the window that begins, or ends, there is below `least`.

    The backward windows may reach into what the front trim takes. Means come from a fixed number of element reads, so a
    read costs time in proportion to its length.
    """
    size = F.size(quality)

    def mean(at: Column, step: int) -> Column:
        places = [F.get(quality, at + step * k) for k in range(window)]
        total = sum((F.coalesce(p, F.lit(0)) for p in places[1:]), F.coalesce(places[0], F.lit(0)))
        n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in places[1:]), F.when(places[0].isNotNull(), 1).otherwise(0))
        return total / n

    good_front = F.transform(quality, lambda q, i: mean(i, 1) >= least)
    good_back = F.reverse(F.transform(quality, lambda q, i: mean(i, -1) >= least))
    start = F.coalesce(F.nullif(F.array_position(good_front, F.lit(True)), F.lit(0)) - 1, size)
    tail = F.coalesce(F.nullif(F.array_position(good_back, F.lit(True)), F.lit(0)) - 1, size)
    return start.cast("int"), F.least(tail, size - start).cast("int")


def trim_ambiguous(sequence: Column, seq_type: Column) -> tuple[Column, Column, Column]:
    """The sequence without ambiguous codes at its ends, and the letters taken from start and end.

    Both ends are searched for in the sequence itself, so the generated code does not nest one search in the other.
    """
    size = F.char_length(sequence)
    lead = size - F.char_length(F.regexp_replace(sequence, ambiguous_letters(seq_type, "^[{}]+"), F.lit("")))
    tail = size - F.char_length(F.regexp_replace(sequence, ambiguous_letters(seq_type, "(?<![{0}])[{0}]+$"), F.lit("")))
    trail = F.when(lead == size, 0).otherwise(tail)
    return F.substring(sequence, lead + 1, size - lead - trail), lead, trail


def ambiguous_fraction(sequence: Column, seq_type: Column) -> Column:
    size = F.char_length(sequence)
    return F.when(size > 0, F.regexp_count(sequence, ambiguous_letters(seq_type, "[{}]")) / size).otherwise(0.0)


@dataclass
class Cleaning:
    """Which steps run; an option left as it is does nothing, save that empty sequences are dropped."""

    dedup_sequence: bool = False
    dedup_name: bool = False
    strip_gaps: bool = False
    trim_ambiguous: bool = False
    max_ambiguous_fraction: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    adapter: str | None = None
    adapter_end: str = "both"
    min_quality: float | None = None
    quality_window: int = 4
    drop_empty: bool = True


def let(value: Column, body) -> Column:
    """Bind `value`, so that `body` can use it often: filters that are pushed down then hold its expression once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut(df: DataFrame, lead: str, trail: str) -> DataFrame:
    """Take `lead` and `trail` letters, and their qualities, off the ends."""
    ends = F.struct(F.col(lead).alias("lead"), F.col(trail).alias("trail"), F.col("sequence").alias("s"))
    left = lambda e: F.greatest(F.char_length(e["s"]) - e["lead"] - e["trail"], F.lit(0))
    quality = F.when(F.size("quality") > 0, let(ends, lambda e: F.slice("quality", e["lead"] + 1, left(e)))).otherwise(F.col("quality"))
    return df.withColumns({"quality": quality, "sequence": let(ends, lambda e: F.substring(e["s"], e["lead"] + 1, left(e)))})


def clean(df: DataFrame, options: Cleaning) -> DataFrame:
    """The trimmed records with `fate` (kept or dropped_...) and trimmed_gaps, _adapter, _quality, _ambiguous_ends flags."""
    if "quality" in df.columns:  # trimming cuts both alike, so what holds for the input holds for the result
        even = F.coalesce(F.size("quality") <= 0, F.lit(True)) | (F.size("quality") == F.char_length("sequence"))
        df = df.where(F.assert_true(even, F.concat(F.lit("a record has qualities and letters in different number: "), "name")).isNull())
    else:
        df = df.withColumn("quality", F.lit(None).cast("array<int>"))
    flags = dict.fromkeys(("trimmed_gaps", "trimmed_adapter", "trimmed_quality", "trimmed_ambiguous_ends"), F.lit(False))
    df = df.withColumns(flags)
    if options.strip_gaps:
        letters = S.symbols(F.col("sequence"))
        kept = F.transform(F.filter(F.arrays_zip(letters.alias("c"), F.col("quality").alias("q")), lambda x: ~x["c"].isin(*GAPS)), lambda x: x["q"])
        df = df.withColumns({"trimmed_gaps": F.rlike("sequence", F.lit("[-.]")), "quality": F.when(F.size("quality") > 0, kept).otherwise(F.col("quality")), "sequence": strip_gaps(F.col("sequence"))})
    if options.adapter:
        lead, trail = adapter_ends(F.col("sequence"), options.adapter, options.adapter_end)
        df = cut(df.withColumns({"hf_lead": lead, "hf_trail": trail}), "hf_lead", "hf_trail").withColumn("trimmed_adapter", F.col("hf_lead") + F.col("hf_trail") > 0)
    if options.min_quality is not None:
        has = (F.size("quality") > 0) & (F.char_length("sequence") > 0)
        lead, trail = quality_ends(F.col("quality"), options.min_quality, options.quality_window)
        df = cut(df.withColumns({"hf_lead": F.when(has, lead).otherwise(0), "hf_trail": F.when(has, trail).otherwise(0)}), "hf_lead", "hf_trail").withColumn("trimmed_quality", F.col("hf_lead") + F.col("hf_trail") > 0)
    if options.trim_ambiguous:
        _, lead, trail = trim_ambiguous(F.col("sequence"), F.col("seq_type"))
        df = cut(df.withColumns({"hf_lead": lead, "hf_trail": trail}), "hf_lead", "hf_trail").withColumn("trimmed_ambiguous_ends", F.col("hf_lead") + F.col("hf_trail") > 0)

    def judge(sequence: Column) -> Column:
        size = F.char_length(sequence)
        fate = F.when(F.lit(options.drop_empty) & (size == 0), "dropped_empty")
        if options.min_length is not None:
            fate = fate.when(size < options.min_length, "dropped_length")
        if options.max_length is not None:
            fate = fate.when(size > options.max_length, "dropped_length")
        if options.max_ambiguous_fraction is not None:
            fate = fate.when(ambiguous_fraction(sequence, F.col("seq_type")) > options.max_ambiguous_fraction, "dropped_ambiguous")
        return fate

    df = df.drop("hf_lead", "hf_trail").withColumn("fate", let(F.col("sequence"), judge))
    if options.dedup_sequence:
        df = first_of(df, F.sha2(F.upper("sequence"), 256), "dropped_duplicate_sequence")
    if options.dedup_name:
        df = first_of(df, F.col("name"), "dropped_duplicate_name")
    return df.withColumn("fate", F.coalesce("fate", F.lit("kept")))


def first_of(df: DataFrame, key: Column, fate: str) -> DataFrame:
    """Among records without a fate, all but the first by `ord` of each key get `fate`.

    The first of a key is an aggregate, so a key that a third of all records share is reduced before the shuffle; the
    records themselves are only joined with the keys that occur more than once.
    """
    df = df.withColumn("hf_dup", F.when(F.col("fate").isNull(), key))
    firsts = df.where(F.col("hf_dup").isNotNull()).groupBy("hf_dup").agg(F.min("ord").alias("hf_first"), F.count("*").alias("hf_n")).where("hf_n > 1").drop("hf_n")
    joined = df.join(firsts, "hf_dup", "left")
    return joined.withColumn("fate", F.when(F.col("ord") > F.col("hf_first"), fate).otherwise(F.col("fate"))).drop("hf_dup", "hf_first")


FATES = ("kept", "dropped_duplicate_sequence", "dropped_duplicate_name", "dropped_length", "dropped_ambiguous", "dropped_empty")
TRIMS = ("trimmed_gaps", "trimmed_ambiguous_ends", "trimmed_adapter", "trimmed_quality")


def report(cleaned: DataFrame) -> DataFrame:
    """One row with the number of records of every fate and of every trim."""
    counted = [F.count(F.when(F.col("fate") == f, 1)).alias(f) for f in FATES] + [F.count(F.when(F.col(t), 1)).alias(t) for t in TRIMS]
    return cleaned.agg(*counted)


def clean_selected(collection: DataFrame, condition: Column, options: Cleaning) -> DataFrame:
    """Clean the selected records; the result's order is `part` (0 untouched, 1 cleaned and kept), then `ord`."""
    chosen = F.coalesce(condition, F.lit(False))
    kept = clean(collection.where(chosen), options).where("fate = 'kept'").select(*collection.columns)
    return collection.where(~chosen).withColumn("hf_part", F.lit(0)).unionByName(kept.withColumn("hf_part", F.lit(1))).withColumnRenamed("hf_part", "part")
