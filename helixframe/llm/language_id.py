"""Operator 6, language ID: string-kernel classification.

A text is the set of its hashed byte n-grams, lengths 1 to 4 blended; the kernel of two texts is the cosine of their
sets. Landmarks from every language give a Nyström map, on which one ridge regression a language is fitted; documents
are then scored in batches by matrix products. The classifier is fitted on a bounded sample: about `per_language` labelled
documents of each language, fewer where those were more than `sample` in all, chosen by a hash of the id; no language is
left out. Every document is scored on its whole text. Only the sample's packed sets and the model go through the driver.

Defined results: `und` with score 0 for a null or letterless text, and for all texts where nothing is labelled; texts
of any length are read whole, in pieces; ties go to the language first by code point; repeated rows are scored alike;
an empty table gives an empty result; kept columns with names of the result's own are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm._shared import by_bytes, give_back, no_clash

BITS = 13
DIMS = 1 << BITS
LENGTHS = (1, 2, 3, 4)
#: Documents and bytes that one matrix product takes at a time, and bytes of text that a task reads at a time.
BATCH_DOCS, BATCH_BYTES, SLICE_BYTES = 256, 1 << 20, 4 << 20
#: Landmarks in all, where the languages are many, and languages whose counts are broadcast.
LANDMARKS, FEW = 2048, 10_000


def held_out(id_col: Column) -> Column:
    """True for the quarter of the documents that is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def presence(texts: list[bytes]) -> np.ndarray:
    """One row a text, True where a hashed n-gram occurs in it."""
    out = np.zeros(len(texts) * DIMS, dtype=bool)
    first = 0
    while first < len(texts):
        last, total = first + 1, len(texts[first])
        while last < len(texts) and total + len(texts[last]) <= BATCH_BYTES:
            total += len(texts[last])
            last += 1
        sizes = np.array([len(t) for t in texts[first:last]])
        joined = np.frombuffer(b"".join(texts[first:last]), dtype=np.uint8)
        for at in range(0, max(len(joined), 1), BATCH_BYTES):  # a very long text goes in overlapping pieces
            part = joined[at : at + BATCH_BYTES + LENGTHS[-1] - 1].astype(np.uint32)
            owner = np.repeat(np.arange(first, last, dtype=np.int64), sizes)[at : at + len(part)]
            code = np.zeros(len(part), dtype=np.uint32)
            for n in LENGTHS:
                if len(part) < n:
                    break
                code = code[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(n)
                inside = owner[: len(code)] == owner[n - 1 :]
                spot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
                out[(owner[: len(code)] * DIMS + spot)[inside]] = True
        first = last
    return out.reshape(len(texts), DIMS)


def prepare(text: str | None) -> bytes | None:
    """Lower-case bytes of a text between spaces; None if it is null or has no letter."""
    if text is None or not any(map(str.isalpha, text)):
        return None
    return b" " + text.lower().encode("utf-8", "replace") + b" "


def kernel(sets: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    own = np.sqrt(sets.sum(axis=1, dtype=np.float32))
    shared = [sets[at : at + BATCH_DOCS].astype(np.float32) @ landmarks.T for at in range(0, max(len(sets), 1), BATCH_DOCS)]
    return np.concatenate(shared) / np.maximum(own[:, None] * sizes[None, :], 1e-9)


def fit(sets: np.ndarray, langs: list[str], per_class: int = 32, ridge: float = 1e-3) -> dict:
    """Landmarks, the product of Nyström map and ridge weights, and the sharpness of the scores."""
    names = sorted(set(langs))
    label = np.array([names.index(x) for x in langs])
    per_class = max(4, min(per_class, LANDMARKS // len(names)))
    chosen = np.concatenate([np.flatnonzero(label == k)[:per_class] for k in range(len(names))])
    landmarks = sets[chosen].astype(np.float32)
    sizes = np.sqrt(landmarks.sum(axis=1))
    values, vectors = np.linalg.eigh(kernel(sets[chosen], landmarks, sizes).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    mapped = kernel(sets, landmarks, sizes).astype(np.float64) @ whiten
    target = np.where(label[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    weight = np.array([1 / (label == k).sum() for k in range(len(names))])[label][:, None]
    mean, middle = (mapped * weight).sum(0) / weight.sum(), (target * weight).sum(0) / weight.sum()
    a = (mapped - mean) * np.sqrt(weight)
    coef = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ ((target - middle) * np.sqrt(weight)))
    raw = (mapped - mean) @ coef + middle
    losses = {s: -np.log(np.maximum(softmax(raw * s)[np.arange(len(label)), label], 1e-12)).mean() for s in (1.0, 2.0, 4.0, 8.0)}
    return {"names": names, "landmarks": landmarks, "sizes": sizes.astype(np.float32), "weights": (whiten @ coef).astype(np.float32), "bias": (middle - mean @ coef).astype(np.float32), "sharp": min(losses, key=losses.get)}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predict(texts: list[str | None], model: dict | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    ready = [(i, b) for i, b in enumerate(map(prepare, texts)) if b is not None] if model else []
    for at in range(0, len(ready), BATCH_DOCS):
        part = ready[at : at + BATCH_DOCS]
        k = kernel(presence([b for _, b in part]), model["landmarks"], model["sizes"])
        p = softmax((k @ model["weights"] + model["bias"]).astype(np.float64) * model["sharp"])
        for (i, _), row in zip(part, p, strict=True):
            best = int(row.argmax())
            langs[i], scores[i] = model["names"][best], min(1.0, float(row[best]))
    return langs, scores


def train(docs: DataFrame, per_language: int = 400, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """Fit on about `per_language` labelled documents of each language, `sample` in all where the languages are many."""
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    counts = known.groupBy("l").agg(F.count("*").alias("n"))
    n_languages = counts.count()
    if not n_languages:
        return None
    quota = max(4, min(per_language, sample // n_languages))
    drawn = known.join(F.broadcast(counts) if n_languages <= FEW else counts, "l")
    drawn = drawn.where(F.pmod(F.xxhash64(F.lit("language"), "i"), F.lit(1 << 20)) < F.least(F.lit(1.0), quota / F.col("n")) * float(1 << 20)).drop("n")

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ready = [(i, lang, b) for i, lang, b in zip(pdf["i"], pdf["l"], map(prepare, pdf["t"]), strict=True) if b is not None]
            sets = presence([b for _, _, b in ready])
            yield pd.DataFrame({"i": [str(i) for i, _, _ in ready], "l": [x for _, x, _ in ready], "s": [r.tobytes() for r in np.packbits(sets, axis=1)]})

    rows = sorted(drawn.mapInPandas(features, "i string, l string, s binary").collect(), key=lambda r: (r["l"], r["i"], r["s"]))
    per: dict[str, int] = {}
    rows = [r for r in rows if (per.update({r["l"]: per.get(r["l"], 0) + 1}) or per[r["l"]] <= 2 * quota)]
    if not rows:
        return None
    return fit(np.unpackbits(np.frombuffer(b"".join(bytes(r["s"]) for r in rows), dtype=np.uint8).reshape(len(rows), -1), axis=1).astype(bool), [r["l"] for r in rows])


def identify(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, `keep` columns, held_out, lang_pred, score, one row a document."""
    no_clash((id_col, *keep), ("held_out", "lang_pred", "score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col), *keep, held_out(F.col(id_col)).alias("hf_held_out"), F.col(text_col).alias("hf_text"))
    kept = [f for f in source.schema.fields if f.name not in ("hf_text", "hf_held_out")]

    def score(parts):
        import pyarrow as pa

        for whole in parts:
            for batch in by_bytes(whole, "hf_text", SLICE_BYTES):
                langs, scores = predict(batch.column("hf_text").to_pylist(), shared.value)
                columns = [batch.column(f.name) for f in kept] + [batch.column("hf_held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["held_out", "lang_pred", "score"])
        give_back()

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    schema = StructType([*kept, StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return source.mapInArrow(score, schema)
