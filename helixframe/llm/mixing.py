"""Operator 9, mixing sources to target weights: capped water-filling with seeded whole and fractional repetitions.

Everything is DataFrame code. Per-source figures are sums, so a source that holds a third of all rows is pre-aggregated
before it is shuffled; the running sum inside a source is taken in two levels (hash buckets, then rows of a bucket), so
no task ever holds a whole source.

Defined results: a null text has size 0; null sources form one source, ranked last; rows that share an id are rows of
their own, ordered by a hash of id, source and text; rows equal in all three are told apart by their running sum alone;
an empty table gives an empty result. Column names starting with `hf_` are reserved for the operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm._shared import first_of_each, materialise, word_count

#: The share of a source's fractional target above which a document is placed on its own, before the small ones.
LARGE_SHARE = 100
#: Rows of an id or source and a few numbers broadcast at most.
BROADCAST_ROWS = 1 << 18


def water_fill(sources: DataFrame, weights: Sequence[float], budget: float, max_epochs: float) -> DataFrame:
    """Targets of `sources(hf_key, hf_null, hf_source, source_size)`, one row a source.

    Sources take turns with `weights` in code point order, null last. A source is full at `max_epochs` times its size.
    Ordering the sources by the water level at which each is full, those before the final level are full and the
    others share what is left by weight, which is the fixed point of clamping and resharing.
    """
    order = Window.orderBy("hf_null", "hf_source")
    by_level = Window.orderBy("hf_level", "hf_null", "hf_source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    filled = (
        sources.withColumn("hf_weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("hf_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("hf_level", F.col("hf_cap") / F.col("hf_weight"))
        .withColumn("hf_total", F.sum("source_size").over(all_rows) * F.lit(float(budget)))
        .withColumn("hf_weights", F.sum("hf_weight").over(all_rows))
        .withColumn("hf_caps_before", F.coalesce(F.sum("hf_cap").over(before), F.lit(0.0)))
        .withColumn("hf_open_weight", F.col("hf_weights") - F.coalesce(F.sum("hf_weight").over(before), F.lit(0.0)))
        .withColumn("hf_full", F.col("hf_caps_before") + F.col("hf_level") * F.col("hf_open_weight") <= F.col("hf_total"))
        .withColumn("hf_full_caps", F.sum(F.when(F.col("hf_full"), F.col("hf_cap")).otherwise(0.0)).over(all_rows))
        .withColumn("hf_rest_weight", F.sum(F.when(F.col("hf_full"), 0.0).otherwise(F.col("hf_weight"))).over(all_rows))
    )
    share = (F.col("hf_total") - F.col("hf_full_caps")) * F.col("hf_weight") / F.col("hf_rest_weight")
    target = F.when(F.col("hf_full"), F.col("hf_cap")).otherwise(F.least(F.col("hf_cap"), share))
    return filled.select("hf_key", "source_size", target.alias("target"))


def running_sum(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """`out`: the sum of `value` over the rows of the group up to and with this one, by `order`.

    `order[0]` is a hexadecimal hash; its first three digits deal each group out over 4,096 buckets, whose sums are
    added up first, so the windows over rows never see more than a bucket.
    """
    rows = rows.withColumn("hf_bucket", F.substring(order[0], 1, 3))
    sums = rows.groupBy(*group, "hf_bucket").agg(F.sum(value).alias("hf_sum"))
    earlier = Window.partitionBy(*group).orderBy("hf_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "hf_bucket", F.coalesce(F.sum("hf_sum").over(earlier), F.lit(0)).alias("hf_start"))
    inside = Window.partitionBy(*group, "hf_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("hf_inside", F.sum(value).over(inside)).join(starts, [*group, "hf_bucket"]).withColumn(out, F.col("hf_start") + F.col("hf_inside")).drop("hf_start", "hf_inside", "hf_bucket")


def by_source(figures: DataFrame) -> DataFrame:
    """One row a source, broadcast where the sources are few enough, so that rows of a large source need not meet."""
    figures = materialise(figures)
    return F.broadcast(figures) if figures.count() <= BROADCAST_ROWS else figures


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: Sequence[str] = ()) -> DataFrame:
    """How often the mix takes each row: id, `extra` columns, size, source_size, target, hf_reps, taken.

    Each row is taken floor(target / source_size) times, and once more if a seeded order reaches it: documents of more
    than a hundredth of the source's fractional target come first and get that fraction of their words, the small ones
    then fill up the target, so a source ends within half a small document of it. No row is taken more than
    ceil(`max_epochs`) times.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    base = materialise(
        docs.select(F.col(id_col).alias("hf_id"), F.xxhash64(F.col(id_col).cast("string"), F.lit("|"), source_col, F.lit("|"), text_col).alias("hf_row"), *[F.col(c).alias(f"hf_x_{c}") for c in extra], key.alias("hf_key"), word_count(F.col(text_col)).alias("size"))
        .withColumn("hf_hash", F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("hf_id").cast("string"), F.lit("null")))), 1, 16))
    )
    sources = base.groupBy("hf_key").agg(F.sum("size").alias("source_size")).select("hf_key", (F.col("hf_key") == "n").alias("hf_null"), F.expr("substring(hf_key, 2)").alias("hf_source"), "source_size")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = water_fill(sources, weights, budget, max_epochs).withColumn("hf_whole", whole.cast("long")).withColumn("hf_rest", F.col("target") - F.col("hf_whole") * F.col("source_size"))
    rows = base.join(by_source(targets), "hf_key").withColumn("hf_large", F.col("size") * LARGE_SHARE > F.col("hf_rest"))
    sized = running_sum(rows, ["hf_key", "hf_large"], ["hf_hash", "hf_id", "size", "hf_row"], "size", "hf_upto")
    large_sizes = rows.where("hf_large").groupBy("hf_key").agg(F.sum("size").alias("hf_large_size"))
    sized = sized.join(by_source(large_sizes), "hf_key", "left").withColumn("hf_large_part", F.when(F.col("source_size") > 0, F.col("hf_rest") * F.coalesce(F.col("hf_large_size"), F.lit(0)) / F.col("source_size")).otherwise(0.0))
    large_in = F.col("hf_large") & (F.col("hf_upto") <= F.col("hf_large_part"))
    taken_large = sized.where(large_in).groupBy("hf_key").agg(F.sum("size").alias("hf_large_taken"))
    small_in = ~F.col("hf_large") & (F.col("hf_upto") - F.col("size") / F.lit(2.0) <= F.col("hf_rest") - F.coalesce(F.col("hf_large_taken"), F.lit(0)))
    return (
        sized.join(by_source(taken_large), "hf_key", "left")
        .withColumn("hf_reps", F.col("hf_whole") + F.when(large_in | small_in, 1).otherwise(0))
        .select(F.col("hf_id").alias(id_col), *[F.col(f"hf_x_{c}").alias(c) for c in extra], "size", "source_size", "target", "hf_reps", (F.col("size") * F.col("hf_reps")).alias("taken"))
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: every row as often as `mix_sources` takes it, with the columns of `docs`.

    Only hashes of rows and numbers are gathered; texts move at most once. Of rows equal in id, source and text, that
    which comes first by a hash of all columns stands for all and is taken as often as they are together.
    """
    named = {"id_col": "doc_id", "text_col": "text", "source_col": "source"} | {k: v for k, v in options.items() if k.endswith("_col")}
    key = F.xxhash64(F.col(named["id_col"]).cast("string"), F.lit("|"), named["source_col"], F.lit("|"), named["text_col"])
    reps = mix_sources(docs.withColumn("hf_key", key), extra=("hf_key",), **options).groupBy("hf_key").agg(F.sum("hf_reps").cast("int").alias("hf_reps"), F.count("*").alias("hf_rows"))
    reps = materialise(reps.where("hf_reps > 0"))
    small = F.broadcast(reps) if reps.count() <= BROADCAST_ROWS else reps
    taken = docs.withColumn("hf_key", key).join(small, "hf_key")
    if reps.where("hf_rows > 1").limit(1).count():
        taken = taken.where("hf_rows = 1").unionByName(first_of_each(taken.where("hf_rows > 1"), ["hf_key", "hf_reps", "hf_rows"], docs.columns))
    return taken.withColumn("hf_copy", F.explode(F.sequence(F.lit(1), F.col("hf_reps")))).select(*docs.columns)
