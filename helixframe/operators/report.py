"""Counts over collections: status, tags and crosstabs over axes given as short specifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions import sequences as S
from helixframe.operators.selection import resolve, shown

NONE = "(none)"


def axis(df: DataFrame, spec: str) -> Column:
    """type, tag:NAME, tag_prefix:PREFIX, field:KEY or field:KEY:binWIDTH as a text Column."""
    kind, _, rest = spec.partition(":")
    if spec == "type":
        return F.col("seq_type")
    if kind not in ("tag", "tag_prefix", "field"):
        raise ValueError(f"unknown axis {spec!r}: use type, tag:NAME, tag_prefix:PREFIX, field:KEY or field:KEY:binWIDTH")
    if not rest:
        raise ValueError(f"axis {spec!r} needs a value after the colon")
    if kind == "tag":
        return F.when(F.array_contains("tags", rest), "yes").otherwise("no")
    if kind == "tag_prefix":
        matching = F.array_sort(F.filter("tags", lambda t: F.startswith(t, F.lit(rest))))
        cut = F.transform(matching, lambda t: F.when(t == rest, t).otherwise(F.substring(t, F.lit(len(rest) + 1), F.char_length(t))))
        return F.when(F.size(matching) == 0, NONE).otherwise(F.array_join(cut, ","))
    key, binned, width_text = rest.partition(":bin")
    if not binned:
        return F.coalesce(shown(df, key), F.lit(NONE))
    try:
        width = float(width_text)
    except ValueError:
        raise ValueError(f"axis {spec!r} has no number as bin width") from None
    if not width > 0:
        raise ValueError(f"axis {spec!r} needs a positive bin width")
    value, _ = resolve(df, key)
    if value is None:
        return F.lit(NONE)
    number = value.try_cast("double")
    low = F.floor(number / width) * width
    label = F.concat(F.lit("["), S.py_g(low), F.lit(","), S.py_g(low + width), F.lit(")"))
    return F.coalesce(label, shown(df, key), F.lit(NONE))


def crosstab(df: DataFrame, specs: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Records counted by all axes together, in the order of the axes' values."""
    if not specs:
        raise ValueError("a report needs at least one axis")
    names = list(names or specs)
    return df.groupBy(*[axis(df, s).alias(n) for s, n in zip(specs, names, strict=True)]).agg(F.count("*").alias("count")).orderBy(*[F.col(f"`{n}`") for n in names])


def status(df: DataFrame) -> DataFrame:
    """`what`, `name`, `n`: the total, records by type in the types' order, then tags, the most frequent first, ties by first record."""
    total = df.agg(F.count("*").alias("n")).select(F.lit("total").alias("what"), F.lit(None).cast("string").alias("name"), "n", F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"))
    types = df.groupBy("seq_type").agg(F.count("*").alias("n")).select(F.lit("type"), "seq_type", "n", F.lit(1), F.lit(0).cast("long"), F.lit(0).cast("long"))
    tags = df.select("ord", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.min("ord").alias("first")).select(F.lit("tag"), "tag", "n", F.lit(2), -F.col("n"), "first")
    return total.union(types).union(tags).orderBy("a", "b", "c", "name").select("what", "name", "n")


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("seq_type").agg(F.count("*").alias("n"))


def tag_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def flat_rows(df: DataFrame) -> DataFrame:
    """The table form for export: no sequences, tags and lists joined by semicolons, metadata in columns of their own."""
    def cell(f: T.StructField) -> Column:
        value = F.col(f"meta.{f.name}")
        if isinstance(f.dataType, T.ArrayType):
            plain = not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType))
            return F.array_join(F.transform(value, lambda x: x.cast("string") if plain else F.to_json(x)), ";")
        return F.to_json(value) if isinstance(f.dataType, (T.StructType, T.MapType)) else value.cast("string")

    meta = [cell(f).alias(f"meta_{f.name}") for f in df.schema["meta"].dataType.fields]
    return df.select("seq_id", "name", "seq_type", S.length(F.col("sequence")).alias("length"), "description", F.array_join(F.array_sort("tags"), ";").alias("tags"), *meta)
