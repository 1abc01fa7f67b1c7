"""Operator 11, importance resampling towards a target distribution.

Features are all runs of one to three words, hashed by crc32 into buckets. Two counts of the buckets, over the documents
and over the target texts, give one array of gains, and a document's weight is the sum of the gains of its features. With
Gumbel noise from a hash of the id added, the highest scores are a draw without replacement in proportion to the weights.

Counting and scoring read UTF-8 bytes in numpy. Words are found byte by byte, and the crc32 of a run of words is put
together from those of its words, since the crc32 of a joined text is a linear function of the first one's. Every task
hands on at most one row a bucket.

The cutoff is found without sorting all scores: a quantile sketch brackets it, exact counts of the rows outside prove the
bracket or widen it, and only the rows inside are sorted. The drawn rows alone are sorted for their ranks, by ranges.

Defined results: a null or empty text has no features and weight 0; a null id is hashed as an empty one and comes after
the others in ties; rows are documents of their own whatever ids they share, and equal rows take following ranks; a text
of any length is read whole, in pieces that share two words; where the share gives no whole document, or in an empty
table, nothing is drawn; an empty target counts 0 in every bucket; other columns are not read unless named in `keep`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from helixframe.llm._shared import by_bytes, give_back, materialise, no_clash

BUCKETS, LONGEST_RUN = 10_000, 3
#: Bytes of texts read together; a longer text is cut after a word.
PIECE = 1 << 20
#: Words up to this many bytes are hashed together, longer ones one by one.
SHORT = 63
#: Rows that one task sorts, about, and the error of the quantile sketch as a share of the rows.
SORTED_ROWS, SKETCH_ERROR = 1 << 17, 0.001

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _moved(by_byte: np.ndarray, crc: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
    """A linear map of 32 bits, given for each byte of the crc, at offset `base` of the flat table."""
    out = by_byte[base + (crc & 255)]
    for k in (1, 2, 3):
        out = out ^ by_byte[base + (256 * k + ((crc >> (8 * k)) & 255))]
    return out


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Flat maps of a crc to that of the text followed by n zero bytes: for n = 0 to SHORT + 1, and for n = 2^k."""
    step = lambda c: (c >> np.uint32(8)) ^ _CRC[c & 255]
    maps = [np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(SHORT + 1):
        maps.append(step(maps[-1]))
    powers = [maps[1]]
    for _ in range(31):
        powers.append(_moved(powers[-1], powers[-1]))
    return np.concatenate(maps), powers


_BY_LENGTH, _BY_POWER = _shifts()
_SPACE = np.uint32(zlib.crc32(b" "))


def followed(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What the crc contributes where its text is followed by `length` further bytes."""
    out = _moved(_BY_LENGTH, crc, 1024 * np.minimum(length, SHORT + 1))
    far = np.flatnonzero(length > SHORT + 1)
    if len(far):
        value, rest = crc[far], length[far]
        for k, table in enumerate(_BY_POWER):
            value = np.where((rest >> k) & 1, _moved(table, value), value)
        out[far] = value
    return out


def word_crcs(joined: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each word of the bytes; all words advance by a byte together, the longest first."""
    out = np.empty(len(starts), dtype=np.uint32)
    far = np.flatnonzero(lengths > SHORT)
    for i in far:
        out[i] = zlib.crc32(joined[starts[i] : starts[i] + lengths[i]])
    order = np.argsort((SHORT - np.minimum(lengths, SHORT)).astype(np.uint8), kind="stable")
    at, size = starts[order], np.where(lengths[order] > SHORT, 0, lengths[order])
    at, order, size = at[len(far) :], order[len(far) :], size[len(far) :]
    crc = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
    longer = len(at) - np.cumsum(np.bincount(size, minlength=SHORT + 1))
    for k in range(SHORT):
        n = longer[k]
        if not n:
            break
        crc[:n] = _CRC[(crc[:n] ^ joined[at[:n] + k]) & 255] ^ (crc[:n] >> np.uint32(8))
    out[order] = ~crc
    return out


def pieces(texts: list[bytes | None]) -> Iterator[tuple[int, bytes, int]]:
    """(row, bytes, number of leading words that an earlier piece has counted) of every text."""
    for row, text in enumerate(texts):
        text, at, end, carried = text or b"", 0, 0, 0
        while len(text) - end > PIECE:
            end += PIECE
            while end < len(text) and _WORD[text[end]]:
                end += 1
            yield row, text[at:end], carried
            at, carried = end, 0
            while at and carried < LONGEST_RUN - 1:  # step back over the last words, which begin the runs of the next piece
                back = at
                while back and not _WORD[text[back - 1]]:
                    back -= 1
                if not back:
                    break
                while back and _WORD[text[back - 1]]:
                    back -= 1
                at, carried = back, carried + 1
        yield row, text[at:], carried


def lots(texts: list[bytes | None]) -> Iterator[list[tuple[int, bytes, int]]]:
    """Pieces in lots of about `PIECE` bytes."""
    lot, total = [], 0
    for piece in pieces(texts):
        lot.append(piece)
        total += len(piece[1])
        if total >= PIECE:
            yield lot
            lot, total = [], 0
    if lot:
        yield lot


def runs(lot: list[tuple[int, bytes, int]]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of a lot: where each piece's words begin with the end last, which words are new, and (buckets, valid) of the runs that end at each word, short ones first."""
    joined = _LOWER[np.frombuffer(b"\n".join(p[1] for p in lot) + b"\n", dtype=np.uint8)]
    word = _WORD[joined]
    edges = np.flatnonzero(np.diff(word, prepend=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(p[1]) + 1 for p in lot]))
    place = np.arange(len(starts)) - np.repeat(bounds[:-1], np.diff(bounds))
    fresh = place >= np.repeat([p[2] for p in lot], np.diff(bounds))
    crc = word_crcs(joined, starts, lengths)
    spaced = followed(np.full(len(crc), _SPACE), lengths) ^ crc
    found, run = [(crc % np.uint32(BUCKETS), fresh)], crc
    for n in range(1, LONGEST_RUN):
        run = np.concatenate([run[:0], followed(run[:-1], lengths[n:] + 1) ^ spaced[n:]]) if len(run) > 1 else run[:0]
        padded = np.concatenate([np.zeros(min(n, len(crc)), np.uint32), run])
        found.append((padded % np.uint32(BUCKETS), fresh & (place >= n)))
    return bounds, fresh, found


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """`bucket`, `n`: how many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for whole in batches:
            for batch in by_bytes(whole, "hf_text", 4 * PIECE):
                for lot in lots(batch.column(0).cast(pa.binary()).to_pylist()):
                    for buckets, valid in runs(lot)[2]:
                        total += np.bincount(buckets[valid], minlength=BUCKETS)
        give_back()
        hit = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(hit.astype(np.int32)), "hf_n": pa.array(total[hit])})

    counted = texts.select(F.col(text_col).alias("hf_text")).where(F.col("hf_text").isNotNull()).mapInArrow(count, "bucket int, hf_n long")
    return counted.groupBy("bucket").agg(F.sum("hf_n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, in thousandths of a natural logarithm, from the counts of both sides; one number a bucket reaches the driver."""
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for counts, frame in ((s, source), (t, target)):
        for row in frame.collect():
            counts[row["bucket"]] = row["n"]
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, keep: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, `keep`, n_words, n_features, weight of every row."""
    no_clash([id_col, *keep], ["n_words", "n_features", "weight", "score", "rank"])
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kept = [id_col, *[c for c in keep if c != id_col]]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for whole in batches:
            for batch in by_bytes(whole, "hf_text", 4 * PIECE):
                out = np.zeros((3, batch.num_rows), dtype=np.int64)
                for lot in lots(batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()):
                    bounds, fresh, found = runs(lot)
                    ones = (fresh, sum(valid.astype(np.int64) for _, valid in found), sum(np.where(valid, gain[buckets], 0) for buckets, valid in found))
                    rows = [p[0] for p in lot]
                    for k, values in enumerate(ones):
                        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds]
                        np.add.at(out[k], rows, np.diff(sums))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, out)], names=[*kept, "n_words", "n_features", "weight"])
        give_back()

    schema = StructType([*[docs.schema[c] for c in kept], *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]])
    return docs.select(*kept, F.col(text_col).alias("hf_text")).mapInArrow(score, schema)


def gumbel(id_: Column, seed: int) -> Column:
    """Noise in thousandths, the same in every run, from the first 8 hexadecimal digits of sha256 of seed and id."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))


def numbered(rows: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """`out`: the place of each row from 1 on, by `order`: ranges are sorted apart, and the counts of earlier ranges added."""
    ranges = max(1, -(-rows.count() // SORTED_ROWS))
    placed = materialise(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("hf_at", F.monotonically_increasing_id()))
    part = F.shiftright("hf_at", 33)
    before = Window.orderBy("hf_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = placed.groupBy(part.alias("hf_part")).agg(F.count("*").alias("hf_n")).select("hf_part", F.coalesce(F.sum("hf_n").over(before), F.lit(0)).alias("hf_start"))
    inside = F.col("hf_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("hf_part", part).join(F.broadcast(starts), "hf_part").withColumn(out, F.col("hf_start") + inside + 1).drop("hf_part", "hf_start", "hf_at")


def bracket(scored: DataFrame, k: int, n: int) -> tuple[float | None, float | None, int]:
    """(lowest, highest, rows above) of scores between which the k-th highest of n lies; None is open.

    The sketch only proposes; the exact counts outside decide, and widen the bracket until it is right.
    """
    margin = 2 * SKETCH_ERROR
    while True:
        low, high = 1 - k / n - margin, 1 - k / n + margin
        found = scored.approxQuantile("score", [max(0.0, low), min(1.0, high)], SKETCH_ERROR)
        lowest, highest = found[0] if low > 0 else None, found[1] if high < 1 else None
        above = F.lit(0) if highest is None else F.count_if(F.col("score") > F.lit(highest))
        upto = F.count("*") if lowest is None else F.count_if(F.col("score") >= F.lit(lowest))
        over, reached = scored.agg(above, upto).first()
        if over < k <= reached:
            return lowest, highest, over
        margin *= 4


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, keep: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, `keep`, n_words, n_features, weight, score, rank of every document; `rank` is null where it is not drawn.

    Of the N documents of at least `least_words` words, floor(percent * N / 100) are drawn.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    scored = materialise(weigh(docs, gain, keep, id_col, text_col).withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed)))
    able = scored.where(F.col("n_words") >= least_words)
    n = able.count()
    k = percent * n // 100
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("weight"), F.asc("n_features"), F.asc("n_words")]
    lowest, highest, over = bracket(able, k, n)
    score, id_ = F.col("score"), F.col(id_col)
    near = able.where((F.lit(True) if lowest is None else score >= lowest) & (F.lit(True) if highest is None else score <= highest))
    last = numbered(near.select(id_col, "score", "weight", "n_features", "n_words"), order, "hf_place").where(F.col("hf_place") == k - over).first()
    ties = F.lit(True) if last[id_col] is None else F.coalesce(id_ <= F.lit(last[id_col]), F.lit(False))
    reached = (F.col("n_words") >= least_words) & ((score > last["score"]) | ((score == last["score"]) & ties))
    drawn = numbered(scored.where(reached), order, "rank").withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))  # rows equal to the last in score and id may be over
    return drawn.unionByName(scored.where(~reached).withColumn("rank", F.lit(None).cast("long")))
