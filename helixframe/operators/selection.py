"""Filters over a collection, each one a Column, and their conjunction.

Catalyst fuses the conjunction and pushes what it can to the scan; every predicate is safe by itself, since Spark does
not promise an order inside a conjunction.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions import sequences as S


def resolve(df: DataFrame, key: str) -> tuple[Column | None, T.DataType | None]:
    """A dotted key of `meta` as a Column and its type; (None, None) where the schema has no such field."""
    kind, path = df.schema["meta"].dataType, ["meta"]
    for part in key.split("."):
        if isinstance(kind, T.StructType) and part in kind.names:
            kind = kind[part].dataType
        elif isinstance(kind, T.MapType):
            kind = kind.valueType
        else:
            return None, None
        path.append(part)
    return F.col(".".join(f"`{p}`" for p in path)), kind


def shown(df: DataFrame, key: str) -> Column:
    """A metadata value as text, null where it is missing."""
    value, kind = resolve(df, key)
    return F.lit(None).cast("string") if value is None else S.py_str(value, kind.simpleString())


def by_id(ids: Sequence[str]) -> Column:
    return F.col("seq_id").isin(list(ids))


def by_id_exclude(ids: Sequence[str]) -> Column:
    return ~F.col("seq_id").isin(list(ids))


def by_name(pattern: str, regex: bool = False) -> Column:
    """Unanchored regular expression with case, or substring without."""
    return F.rlike("name", F.lit(pattern)) if regex else F.contains(F.lower("name"), F.lit(pattern.lower()))


def by_tag(tag: str) -> Column:
    return F.array_contains("tags", tag)


def by_tag_absent(tag: str) -> Column:
    return ~F.array_contains("tags", tag)


def by_type(seq_type: str) -> Column:
    return F.col("seq_type") == seq_type


def by_length(low: int | None = None, high: int | None = None) -> Column:
    size = F.char_length("sequence")
    return (F.lit(True) if low is None else size >= low) & (F.lit(True) if high is None else size <= high)


def by_motif(pattern: str, regex: bool = True) -> Column:
    """The pattern is upper-cased like the sequences, classes such as \\d with it."""
    return F.rlike("sequence", F.lit(pattern.upper())) if regex else F.contains(F.col("sequence"), F.lit(pattern.upper()))


def by_motif_absent(pattern: str, regex: bool = True) -> Column:
    return ~by_motif(pattern, regex)


def by_field_range(df: DataFrame, key: str, low: float | None = None, high: float | None = None) -> Column:
    """Missing values do not pass; a field that is no number is an error when the query is made."""
    value, kind = resolve(df, key)
    if value is None:
        return F.lit(False)
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"metadata field {key!r} is {kind.simpleString()}, not a number")
    return value.isNotNull() & (F.lit(True) if low is None else value >= low) & (F.lit(True) if high is None else value <= high)


def by_field_equals(df: DataFrame, key: str, expected: str) -> Column:
    return F.coalesce(shown(df, key), F.lit("None")) == expected


def by_field_not_equals(df: DataFrame, key: str, excluded: str) -> Column:
    return F.coalesce(shown(df, key), F.lit("None")) != excluded


@dataclass
class Selection:
    """The shared selection options; those left empty do not select."""

    seq_type: str | None = None
    name: str | None = None
    name_regex: bool = False
    tag: str | None = None
    exclude_tag: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    motif: str | None = None
    exclude_motif: str | None = None
    field: str | None = None
    field_min: float | None = None
    field_max: float | None = None
    field_equals: str | None = None
    field_not_equals: str | None = None
    exclude_ids: Sequence[str] = ()

    def condition(self, df: DataFrame) -> Column:
        parts = [F.lit(True)]
        for value, build in ((self.seq_type, by_type), (self.tag, by_tag), (self.exclude_tag, by_tag_absent), (self.motif, by_motif), (self.exclude_motif, by_motif_absent), (self.exclude_ids, by_id_exclude)):
            if value:
                parts.append(build(value))
        if self.name:
            parts.append(by_name(self.name, self.name_regex))
        if self.min_length is not None or self.max_length is not None:
            parts.append(by_length(self.min_length, self.max_length))
        if self.field and (self.field_min is not None or self.field_max is not None):
            parts.append(by_field_range(df, self.field, self.field_min, self.field_max))
        if self.field and self.field_equals is not None:
            parts.append(by_field_equals(df, self.field, self.field_equals))
        if self.field and self.field_not_equals is not None:
            parts.append(by_field_not_equals(df, self.field, self.field_not_equals))
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.condition(df))


def ids_from(df: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose seq_id is, or is not, in a frame of ids of any size."""
    return df.join(ids.select("seq_id").distinct(), "seq_id", "left_semi" if keep else "left_anti")


def enrich_by_name(rows: DataFrame, collection: DataFrame, cols: Sequence[str] = ("tags", "meta")) -> DataFrame:
    """Rows with columns of the first record of the same name; rows without one keep nulls, and empty tags."""
    first = collection.groupBy("name").agg(F.min_by(F.struct(*cols), "ord").alias("hf_first"))
    joined = rows.drop(*cols).join(first, "name", "left")
    return joined.select(*[c for c in rows.columns if c not in cols], *[(F.coalesce(F.col(f"hf_first.{c}"), F.array().cast("array<string>")) if c == "tags" else F.col(f"hf_first.{c}")).alias(c) for c in cols])


def resolve_hits(hits: DataFrame, collection: DataFrame, first: bool = True) -> DataFrame:
    """Hits (hit_id, score) with the seq_id of the first or last record named so; null where none is."""
    pick = F.min_by if first else F.max_by
    known = collection.groupBy("name").agg(pick("seq_id", "ord").alias("seq_id"))
    return hits.join(known, hits["hit_id"] == known["name"], "left").select("seq_id", "hit_id", "score")


def by_exact_name(name: str) -> Column:
    return F.col("name") == name


def get(df: DataFrame, seq_id: str) -> DataFrame:
    """The record of an id; an id of none is an error."""
    own = df.where(F.col("seq_id") == seq_id)
    if not own.limit(1).count():
        raise ValueError(f"no record has the id {seq_id!r}")
    return own


def contains(df: DataFrame, seq_id: str) -> bool:
    return bool(df.where(F.col("seq_id") == seq_id).limit(1).count())


def annotation_targets(df: DataFrame, tag: str | None = None, seq_type: str | None = None) -> DataFrame:
    """The records that an annotation works on; a selection of none is an error."""
    chosen = Selection(tag=tag, seq_type=seq_type).apply(df)
    if not chosen.limit(1).count():
        raise ValueError("no record matches the selection")
    return chosen


def select_alignment(rows: DataFrame, collection: DataFrame, chosen: Selection) -> DataFrame:
    """Alignment rows that pass a selection on their records' tags and metadata; without options all rows stay."""
    if chosen == Selection():
        return rows
    enriched = enrich_by_name(rows, collection)
    return chosen.apply(enriched).select(*rows.columns)


def flat_hits(hits: DataFrame) -> DataFrame:
    """hit_id, score and whether a record of the collection is meant, of resolved hits."""
    return hits.select("hit_id", "score", F.col("seq_id").isNotNull().alias("in_project"))


def domains_to_records(hits: DataFrame, collection: DataFrame) -> DataFrame:
    """Records with `pfam_domains`, their domain hits by place, and a tag domain:ACCESSION for each; records without hits keep an empty list."""
    own = hits.groupBy(F.col("query").alias("name")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "domain", "accession", "evalue", "score"))).alias("pfam_domains"))
    joined = collection.join(own, "name", "left")
    none = F.filter(F.array(F.struct(*[F.lit(None).cast(k).alias(n) for n, k in (("start", "int"), ("end", "int"), ("domain", "string"), ("accession", "string"), ("evalue", "double"), ("score", "double"))])), lambda x: F.lit(False))
    tags = F.array_sort(F.array_union("tags", F.coalesce(F.transform("pfam_domains", lambda d: F.concat(F.lit("domain:"), d["accession"])), F.array().cast("array<string>"))))
    return joined.select(*[tags.alias("tags") if c == "tags" else F.col(c) for c in collection.columns], F.coalesce("pfam_domains", none).alias("pfam_domains"))
