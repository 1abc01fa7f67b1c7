"""Operator 3, SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read field by field; from it come the normaliser, the metaspace marker, the unigram scores or the
BPE merges, and the byte fallback. Batches are encoded by the library's own threads inside Arrow tasks. The model is
read once on the driver from a path parameter and broadcast as bytes, so executors need no file.

Defined results: a null text has null ids, 0 tokens and a null `round_trip`; an empty text has no ids and true; texts of
any length are encoded whole; repeated rows are encoded alike; an empty table gives an empty result. Columns of `keep`
whose names are the result's own are an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm._shared import by_bytes, give_back, no_clash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces and of models, as numbered in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes of text encoded at a time (a longer text goes alone), and words handed to the library at a time.
BATCH_BYTES, AT_ONCE = 12 << 20, 8192


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of one protobuf message; numbers as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> dict:
    """Pieces as (text, score, kind) and the options of trainer and normaliser that matter for encoding."""
    pieces, trainer, normaliser = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normaliser = dict(fields(value))
    return {
        "pieces": pieces,
        "kind": trainer.get(3, UNIGRAM),
        "suffix": bool(trainer.get(24, 0)),
        "charsmap": normaliser.get(2, b""),
        "dummy_prefix": bool(normaliser.get(3, 1)),
        "one_space": bool(normaliser.get(4, 1)),
        "escape": bool(normaliser.get(5, 1)),
    }


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All splits of a piece into two pieces; the better the score of the whole, the earlier, then by place of the parts."""
    place = {text: i for i, (text, _, kind) in enumerate(pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for text, score, kind in pieces:
        if kind == NORMAL:
            found += [(-score, place[text[:k]], place[text[k:]], text[:k], text[k:]) for k in range(1, len(text)) if text[:k] in place and text[k:] in place]
    return [(a, b) for *_, a, b in sorted(found)]


class Encoder:
    """A model's tokenizer.

    Where no piece goes on past a word and spaces stand alone, a text is the row of its words: each distinct word of a
    batch is encoded, and decoded again, once, by the model alone, which needs neither normaliser nor splitting there.
    Texts with runs of spaces, spaces at an end or literal markers go through the tokenizer whole.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        spec = parse_model(data)
        self.tokenizer = build(data)
        self.by_word = self.tokenizer.pre_tokenizer is not None and spec["dummy_prefix"] and not spec["charsmap"] and not spec["one_space"]
        self.words = Tokenizer(self.tokenizer.model)
        #: The text of each piece that stands for itself; the others make a word's decoding the library's work.
        self.texts = [text if kind == NORMAL else "\0" for text, _, kind in spec["pieces"]]

    def encode_marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of marked words in one array, the number of each, and whether decoding gives the word back."""
        ids, sizes, good = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        text = self.texts.__getitem__
        for at in range(0, len(words), AT_ONCE):
            some = words[at : at + AT_ONCE]
            own = [e.ids for e in self.words.encode_batch_fast(some, add_special_tokens=False)]
            same = [word == "".join(map(text, x)) for word, x in zip(some, own, strict=True)]
            other = [i for i, fits in enumerate(same) if not fits]
            for i, back in zip(other, self.tokenizer.decode_batch([own[i] for i in other], skip_special_tokens=False), strict=True):
                same[i] = some[i] == MARK + back
            ids.append(np.fromiter(chain.from_iterable(own), np.int32))
            sizes.append(np.fromiter(map(len, own), np.int64, len(own)))
            good.append(np.array(same, bool))
        return np.concatenate(ids), np.concatenate(sizes), np.concatenate(good)

    def encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in one array, the number of each text, and whether decoding gives it back."""
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        ids, own_sizes, own_good = self.encode_marked(pc.binary_join_element_wise(MARK, coded.dictionary, "").to_pylist())
        place = coded.indices.to_numpy()
        sizes, starts = own_sizes[place], (np.cumsum(own_sizes) - own_sizes)[place]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        total = np.concatenate([[0], ends])
        bad = np.concatenate([[0], np.cumsum(~own_good[place])])
        return ids[at], np.diff(total[bounds]), np.diff(bad[bounds]) == 0

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Arrays of ids, their number and round_trip, in the order of the texts."""
        plain = np.zeros(len(texts), dtype=bool)
        if self.by_word:
            odd = pc.match_substring_regex(texts, f"^$|^ | $|  |{MARK}")
            plain = pc.fill_null(pc.invert(odd), False).to_numpy(zero_copy_only=False)
        parts, sizes, good = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), np.zeros(len(texts), dtype=bool)
        null = texts.is_null().to_numpy(zero_copy_only=False)
        if plain.any():
            ids, sizes[plain], good[plain] = self.encode_words(texts.filter(pa.array(plain)))
            parts = [ids]
        rest = np.flatnonzero(~plain & ~null)
        whole = texts.take(pa.array(rest)).to_pylist()
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        if lists:
            sizes[rest] = [len(x) for x in lists]
            good[rest] = [x == y for x, y in zip(whole, self.tokenizer.decode_batch(lists, skip_special_tokens=False), strict=True)]
            parts += [np.array(x, np.int32) for x in lists]
        # lay the words' texts and the others out in the order of the rows
        order = np.concatenate([np.flatnonzero(plain), rest]) if len(rest) else np.flatnonzero(plain)
        laid, flat = sizes[order], np.concatenate(parts)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if len(rest):
            moved = np.empty_like(flat)
            moved[np.arange(len(flat)) + np.repeat(offsets[order] - (np.cumsum(laid) - laid), laid)] = flat
            flat = moved
        ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(null, False)), pa.array(flat))
        return ids, pa.array(sizes), pa.array(good, mask=null)


def build(data: bytes):
    """A tokenizers.Tokenizer that encodes as the SentencePiece model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    spec = parse_model(data)
    pieces = spec["pieces"]
    if spec["suffix"] or not spec["escape"] or any(kind == USER for *_, kind in pieces):
        raise ValueError("models with user-defined pieces, suffix markers or unescaped spaces are not supported")
    unknown = next(i for i, (*_, kind) in enumerate(pieces) if kind == UNKNOWN)
    fallback = any(kind == BYTE for *_, kind in pieces)
    if spec["kind"] == UNIGRAM:
        low = min(score for *_, score, _ in pieces) - 10.0
        model = models.Unigram([(text, score if kind == NORMAL else low) for text, score, kind in pieces], unknown, fallback)
    elif spec["kind"] == BPE:
        model = models.BPE({text: i for i, (text, *_) in enumerate(pieces)}, merges(pieces), unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError(f"model kind {spec['kind']} is not supported")
    steps = [normalizers.Precompiled(spec["charsmap"])] if spec["charsmap"] else []
    if spec["one_space"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] * spec["dummy_prefix"] + [normalizers.Replace(" ", MARK)]
    tokenizer = Tokenizer(model)
    tokenizer.normalizer = normalizers.Sequence(steps)
    if not any(MARK in text.lstrip(MARK) for text, *_ in pieces):  # no piece goes on past a word, so words are encoded by themselves and remembered
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * spec["dummy_prefix"]])
    return tokenizer


@lru_cache(maxsize=2)
def cached(data: bytes) -> Encoder:
    return Encoder(data)


def parity(texts: list[str], data: bytes) -> list[int]:
    """Places of the texts whose ids or decoded text differ from those of the sentencepiece library."""
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    own = cached(data)
    made, _, _ = own.encode(pa.array(texts, pa.string()))
    back = own.tokenizer.decode_batch(made.to_pylist(), skip_special_tokens=False)
    return [i for i, (a, b, text) in enumerate(zip(made.to_pylist(), other.encode(texts), back, strict=True)) if a != b or text != other.decode(b)]


def encode_documents(docs: DataFrame, model_path: str = MODEL, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, token_ids, n_tokens, round_trip (decoding gives the text back), one row a document."""
    no_clash(keep, ("token_ids", "n_tokens", "round_trip"))
    shared = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    source = docs.select(*keep, F.col(text_col).alias("hf_text"))
    kept = [f for f in source.schema.fields if f.name != "hf_text"]

    def encode(parts):
        encoder = cached(bytes(shared.value))
        for whole in parts:
            for batch in by_bytes(whole, "hf_text", BATCH_BYTES):
                made = encoder.encode(batch.column("hf_text"))
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + list(made), names=[f.name for f in kept] + ["token_ids", "n_tokens", "round_trip"])
        give_back()

    made = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return source.mapInArrow(encode, T.StructType([*kept, *made]))


def decode_ids(encoded: DataFrame, model_path: str = MODEL, ids_col: str = "token_ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and text: the text that the ids stand for, null for null ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    source = encoded.select(*keep, F.col(ids_col).alias("hf_ids"))
    kept = [f for f in source.schema.fields if f.name != "hf_ids"]

    def decode(parts):
        tokenizer = cached(bytes(shared.value)).tokenizer
        for batch in parts:
            ids = batch.column("hf_ids").to_pylist()
            texts = iter(tokenizer.decode_batch([x for x in ids if x is not None], skip_special_tokens=False))
            column = pa.array([None if x is None else next(texts) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [column], names=[f.name for f in kept] + ["text"])

    return source.mapInArrow(decode, T.StructType([*kept, T.StructField("text", T.StringType())]))
