"""k-mer and MinHash similarity: scores, top-n search and exact joins of similar sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators.storage import written

#: Modulus and seed of the MinHash family; hashes are cut to 31 bits, so products fit in 64.
PRIME, SEED = (1 << 31) - 1, 42


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; two empty ones give 0."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def minhash(sequence: Column, k: int = 9, num_hashes: int = 64) -> Column:
    """A signature that any run repeats: the least value of each hash over the k-mers, hashed inside the JVM."""
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(1, PRIME, num_hashes, dtype=np.int64), rng.integers(0, PRIME, num_hashes, dtype=np.int64)
    hashed = F.transform(S.kmer_set(sequence, k), lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME)))

    @F.arrow_udf("array<long>")
    def least(values: pa.Array) -> pa.Array:
        flat, ends = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64), values.offsets.to_numpy()
        starts = ends[:-1] - ends[0]
        made = np.stack([np.minimum.reduceat((flat * m + c) % PRIME, starts) for m, c in zip(a, b, strict=True)], axis=1) if len(starts) else np.zeros((0, num_hashes), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * num_hashes), pa.array(made.ravel()))

    return least(hashed)


def minhash_similarity(a: Column, b: Column) -> Column:
    """The share of equal places; signatures of different or no length give 0."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(0.0)


def search(collection: DataFrame, query: str, method: str = "kmer", k: int | None = None, top_n: int = 10, min_score: float = 0.0) -> DataFrame:
    """The `top_n` records most like a query sequence, with `score`; ties in the collection's order.

    The sort and the limit are one top-n operator, so no full sort happens. A selection made on the result stays above the limit.
    """
    if method not in ("kmer", "minhash"):
        raise ValueError(f"unknown similarity {method!r}: use kmer or minhash")
    size = k or (4 if method == "kmer" else 9)
    own = F.lit(query)
    if method == "kmer":
        score = jaccard(F.array(*[F.lit(x) for x in sorted({query[i : i + size] for i in range(len(query) - size + 1)} or {query})]), S.kmer_set(F.col("sequence"), size))
    else:  # the query's signature is taken once
        signature = collection.sparkSession.range(1).select(minhash(own, size).alias("s")).first()["s"]
        score = minhash_similarity(F.array(*[F.lit(x).cast("long") for x in signature]), minhash(F.col("sequence"), size))
    return collection.withColumn("score", score).where(F.col("score") >= min_score).orderBy(F.desc("score"), "ord").limit(top_n)


#: Rows and queries of a block, and k-mers that are compared at a time.
ROWS, ASKED, WIDE = 2048, 512, 4096
#: Bytes of the queries' marks, and queries, that are broadcast at a time, at most or about.
QUERY_BYTES, QUERIES = 4 << 20, 4096
#: Sequences that have a k-mer in their prefixes, above which they are taken to meet each other without looking at places.
FREQUENT = 4096
#: Sequences and letters of a block that is compared with others, and pairs looked at together.
MEMBERS, LETTERS, PAIRS = 4096, 2 << 20, 1 << 20


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values of a column of lists, the row of each, and the sizes."""
    own = column.combine_chunks()
    sizes = np.diff(own.offsets.to_numpy())
    return own.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes), sizes


def shared_values(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many values each two sets share, by products of presence matrices over slices of the values, and the sizes of both."""
    (a, a_row, a_size), (b, b_row, b_size) = lists(left), lists(right)
    known = np.unique(b)
    at = np.searchsorted(known, a)
    hit = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == a) if len(known) else np.zeros(len(a), bool)
    a_row, at, b_at = a_row[hit], at[hit], np.searchsorted(known, b)
    out = np.zeros((len(a_size), len(b_size)), dtype=np.float32)
    for low in range(0, len(known), WIDE):
        x, y = np.zeros((len(a_size), WIDE), np.float32), np.zeros((len(b_size), WIDE), np.float32)
        for m, row, place in ((x, a_row, at), (y, b_row, b_at)):
            own = (place >= low) & (place < low + WIDE)
            m[row[own], place[own] - low] = 1
        out += x @ y.T
    return out.astype(np.int64), a_size, b_size


def shared_postings(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `shared_values`, for values that few sets hold: the sets of `right` are sorted by value, and each value of `left` counts those at its place."""
    (a, a_row, a_size), (b, b_row, b_size) = lists(left), lists(right)
    order = np.argsort(b, kind="stable")
    known, holder, wide = b[order], b_row[order], len(b_size)
    first = np.searchsorted(known, a)
    n = np.searchsorted(known, a, "right") - first
    out = np.zeros(len(a_size) * wide, dtype=np.int64)
    there = np.flatnonzero(n)
    total = np.cumsum(n[there])
    for part in np.split(there, np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)) if len(total) else []):
        out += np.bincount(np.repeat(a_row[part] * wide, n[part]) + holder[expanded(first[part], n[part])], minlength=len(out))
    return out.reshape(len(a_size), wide), a_size, b_size


def search_all(collection: DataFrame, queries: DataFrame, method: str = "kmer", k: int | None = None, top_n: int = 10, min_score: float = 0.0) -> DataFrame:
    """query, rank, ord, score: the `top_n` records most like each record of `queries`, ties in the collection's order.

    Records stay where they are: every task compares its own with all queries, which come by broadcasts of about
    `QUERY_BYTES` of marks, one pass over the records each. A task gives its best `top_n` a query, and a window keeps
    the best of those, so what is shuffled grows with the queries and tasks alone.
    """
    if method not in ("kmer", "minhash"):
        raise ValueError(f"unknown similarity {method!r}: use kmer or minhash")
    size = k or (4 if method == "kmer" else 9)
    marks = F.transform(S.kmer_set(F.col("sequence"), size), lambda x: F.xxhash64(x)) if method == "kmer" else minhash(F.col("sequence"), size)
    own = written(collection.select(F.col("ord").alias("o"), marks.alias("m")))
    asked = written(queries.select(F.col("ord").alias("query"), marks.alias("q")).withColumn("part", F.xxhash64("query")))
    return best_of(own, asked, method, top_n, min_score)


def best_of(own: DataFrame, asked: DataFrame, method: str, top_n: int, min_score: float) -> DataFrame:
    """query, rank, ord, score: the best of `own(o, m)` for each of `asked(query, q, part)`, both written; `part` is a hash."""
    n_queries, total = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("q")), F.lit(0))).first()
    chunks = max(1, -(-total * 8 // QUERY_BYTES), -(-n_queries // QUERIES))
    found = [compared(own, asked.where(F.pmod("part", F.lit(chunks)) == i).select("query", "q"), method, top_n, min_score) for i in range(chunks)]
    pairs = written(found[0]) if chunks == 1 else union_of([written(f) for f in found])
    best = Window.partitionBy("query").orderBy(F.desc("score"), "ord")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n).select("query", "rank", "ord", "score")


def union_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compared(own: DataFrame, asked: DataFrame, method: str, top_n: int, min_score: float) -> DataFrame:
    """query, ord, score: the best `top_n` records of each task of `own(o, m)` for each of `asked(query, q)`, which is broadcast."""
    table = asked.toArrow()
    sent = own.sparkSession.sparkContext.broadcast((table.column("query").to_numpy(), *lists(table.column("q"))[::2]))

    def compare(parts):
        names, marks, sizes = sent.value
        ends = np.cumsum(sizes)
        kept_order, kept_score = (np.zeros((len(names), 0), dtype=t) for t in (np.int64, float))
        for batch in (whole.slice(at, ROWS) for whole in parts for at in range(0, whole.num_rows, ROWS)):
            rows = pa.table({"o": batch.column("o"), "m": batch.column("m")})
            order = rows.column("o").to_numpy()
            score = np.empty((len(names), len(order)))
            step = len(names) if method == "postings" else ASKED
            for low in range(0, len(names), step or 1):
                part = slice(low, min(low + step, len(names)))
                own_sizes, first = sizes[part], ends[low] - sizes[low]
                chosen = marks[first : first + own_sizes.sum()]
                if method != "minhash":
                    edges = pa.array(np.concatenate([[0], np.cumsum(own_sizes)]).astype(np.int32))
                    both, b, a = (shared_values if method == "kmer" else shared_postings)(pa.chunked_array([pa.ListArray.from_arrays(edges, pa.array(chosen))]), rows.column("m"))
                    score[part] = both / np.maximum(a[None, :] + b[:, None] - both, 1)
                else:
                    x, y = np.ascontiguousarray(lists(rows.column("m"))[0].reshape(len(rows), -1).T.astype(np.uint32)), chosen.reshape(len(own_sizes), -1).astype(np.uint32)
                    for j, row in enumerate(y):
                        same = np.zeros(len(order), dtype=np.uint16)
                        for place, value in zip(x, row, strict=True):
                            same += place == value
                        score[low + j] = same / len(row)
            kept_order = np.concatenate([kept_order, np.broadcast_to(order, score.shape)], axis=1)
            kept_score = np.concatenate([kept_score, score], axis=1)
            if kept_order.shape[1] > top_n:
                least = -np.partition(-kept_score, top_n - 1, axis=1)[:, top_n - 1]
                best = np.empty((len(names), top_n), dtype=np.int64)
                for j in range(len(names)):
                    there = np.flatnonzero(kept_score[j] >= least[j])
                    best[j] = there[np.lexsort((kept_order[j, there], -kept_score[j, there]))[:top_n]]
                kept_order, kept_score = np.take_along_axis(kept_order, best, axis=1), np.take_along_axis(kept_score, best, axis=1)
        query = np.repeat(names, kept_order.shape[1])
        good = kept_score.ravel() >= min_score
        yield pa.RecordBatch.from_arrays([pa.array(query[good].astype(np.int64)), pa.array(kept_order.ravel()[good]), pa.array(kept_score.ravel()[good])], names=["query", "ord", "score"])

    return own.mapInArrow(compare, "query long, ord long, score double")


def distinct_sequences(collection: DataFrame) -> DataFrame:
    """One row a distinct sequence: `key`, its digest, `rep`, the first `ord` that has it, `copies` and the sequence; empty ones are left out."""
    return collection.where(F.char_length("sequence") > 0).groupBy(F.md5("sequence").alias("key")).agg(F.min("ord").alias("rep"), F.count("*").alias("copies"), F.first("sequence").alias("sequence"))


def similar_pairs(collection: DataFrame, k: int = 12, threshold: float = 0.8, method: str = "kmer", num_hashes: int = 64) -> DataFrame:
    """`a` < `b`, `score`: distinct sequences, named by their first `ord`, whose similarity is at least the threshold.

    By k-mers it is the Jaccard similarity of their sets, by MinHash the share of equal places of their signatures.
    """
    if method == "minhash":
        return similar_signatures(collection, k, threshold, num_hashes)
    if method != "kmer":
        raise ValueError(f"unknown similarity {method!r}: use kmer or minhash")
    return similar_sets(collection, k, threshold)


def similar_signatures(collection: DataFrame, k: int, threshold: float, num_hashes: int) -> DataFrame:
    """Two signatures that differ in at most m places agree in one of m + 1 bands of them, so only those meet in the join."""
    signed = written(distinct_sequences(collection).select("rep", minhash(F.col("sequence"), k, num_hashes).alias("s")))
    bands = min(num_hashes, max(1, num_hashes - int(np.ceil(threshold * num_hashes - 1e-9)) + 1))
    edges = [num_hashes * i // bands for i in range(bands + 1)]
    marks = F.array(*[F.xxhash64(F.slice("s", x + 1, y - x)) for x, y in zip(edges, edges[1:], strict=False)])
    places = written(signed.select("rep", F.posexplode(marks).alias("at", "v")))
    left, right = places.withColumnRenamed("rep", "a"), places.withColumnRenamed("rep", "b")
    met = written(left.join(right, ["at", "v"]).where("a < b").select("a", "b").distinct())
    named = lambda name: signed.select(F.col("rep").alias(name), F.col("s").alias(f"s{name}"))
    scored = met.join(named("a"), "a").join(named("b"), "b").select("a", "b", minhash_similarity(F.col("sa"), F.col("sb")).alias("score"))
    return scored.where(F.col("score") >= threshold)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit values with their bits scattered."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def kmer_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-mers of all texts, repeats too, and the text of each; a shorter text is its own only k-mer."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashes, rows = [], []
    for size in [*np.unique(sizes[(sizes < k) & (sizes > 0)]).tolist(), k]:
        own = np.flatnonzero(sizes >= k if size == k else sizes == size)
        if len(own):
            row = np.repeat(own, sizes[own] - size + 1)
            if len(own) < len(sizes) or size < k:
                first = np.cumsum(sizes[own] - size + 1) - (sizes[own] - size + 1)
                at = np.arange(len(row)) + np.repeat(ends[own] - sizes[own] - first, sizes[own] - size + 1)
                made = sum(letters[at + j] * factors[j] for j in range(size))
            else:
                rolled = np.zeros(len(letters) - k + 1, dtype=np.uint64)
                for j in range(k):
                    rolled += letters[j : len(letters) - k + 1 + j] * factors[j]
                inside = np.ones(len(rolled), dtype=bool)
                for j in range(1, k):
                    inside[ends[:-1] - j] = False
                made = rolled[inside]
            hashes.append(mixed(made + np.uint64(size)))
            rows.append(row)
    return (np.concatenate(hashes), np.concatenate(rows)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that begin at `starts` and hold `counts`, end to end."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def near_in_blocks(texts: list[str], split: int, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and scores of all similar pairs of texts, one of the first `split` with one of the others, or of any two where all are within `split`.

    A pair is a candidate if its first shared k-mer, rare ones first, stands in the prefixes of both and leaves enough. Then
    bits that k-mers flip, which differ in no more places than the sets, and last the sets themselves.
    """
    n_rows, cross = len(texts), split < len(texts)
    low = max(1, (n_rows - 1).bit_length())
    hashes, row = kmer_hashes(texts, k)
    key = np.sort((hashes >> np.uint64(low) << np.uint64(low)) | row.astype(np.uint64))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    row, token = (key & np.uint64((1 << low) - 1)).astype(np.int64), key >> np.uint64(low)
    n = np.bincount(row, minlength=n_rows)
    token = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    there = np.bincount(token)
    first = np.bincount(token, row < split, minlength=len(there)).astype(np.int64)
    meets = first * (there - first) if cross else there * (there - 1) // 2
    order = np.argsort(np.minimum(meets, 65535).astype(np.uint16), kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    # the sets, row by row in the order of rising frequency
    shared = meets[token] > 0
    own = np.sort((row[shared] << 40) | rank[token[shared]])
    own_row, own_rank = own >> 40, own & ((1 << 40) - 1)
    size = np.bincount(own_row, minlength=n_rows)
    begins = np.cumsum(size) - size
    at = np.arange(len(own)) - begins[own_row] + (n - size)[own_row]  # those in no other set come first
    least = lambda x, share: np.ceil(x * share - 1e-9).astype(np.int64)
    head = at < (n - least(n, threshold) + 1)[own_row]
    place = np.argsort((own_rank[head] << low) | own_row[head], kind="stable")
    h_rank, h_row, h_left = own_rank[head][place], own_row[head][place], (n[own_row] - at)[head][place]
    end_of = np.searchsorted(h_rank, h_rank, "right")
    start = np.arange(len(h_rank)) + 1
    if cross:
        start = np.where(h_row < split, np.searchsorted((h_rank << low) | h_row, (h_rank << low) | split), end_of)
    counts = np.maximum(end_of - start, 0)
    long = end_of - np.searchsorted(h_rank, h_rank) > FREQUENT
    second = n_rows - split if cross else n_rows
    base = split if cross else 0
    met = np.zeros((split, second), dtype=bool)
    for i in np.flatnonzero(long & (counts > 0)):
        met[h_row[i], h_row[start[i] : end_of[i]] - base] = True
    few = np.flatnonzero(~long & (counts > 0))
    total = np.cumsum(counts[few])
    for part in np.split(few, np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)) if len(total) else []):
        i, j = np.repeat(part, counts[part]), expanded(start[part], counts[part])
        need = least(n[h_row[i]] + n[h_row[j]], threshold / (1 + threshold))
        fits = np.minimum(h_left[i], h_left[j]) >= need
        met[h_row[i[fits]], h_row[j[fits]] - base] = True
    a, b = np.nonzero(met)
    b += base
    fits = np.minimum(n[a], n[b]) >= np.maximum(n[a], n[b]) * threshold - 1e-9
    a, b = a[fits], b[fits]
    if not len(a):
        return a, b, np.zeros(0)
    # a bit is flipped by each k-mer of its own
    bits = 1 << int(np.clip(np.ceil(np.log2(4 * n.mean() + 1)), 8, 12))
    used = np.zeros(n_rows, dtype=bool)
    used[a], used[b] = True, True
    mine = used[row]
    flips = np.zeros(n_rows * bits, dtype=np.uint8)
    np.add.at(flips, row[mine] * bits + (mixed(token[mine].astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64), 1)
    sketch = np.packbits((flips & 1).reshape(n_rows, bits), axis=1).view(np.uint64)
    most, close = np.floor((n[a] + n[b]) * (1 - threshold) / (1 + threshold) + 1e-9), np.zeros(len(a), dtype=bool)
    for x in range(0, len(a), PAIRS // 16):
        part = slice(x, x + PAIRS // 16)
        close[part] = np.bitwise_count(sketch[a[part]] ^ sketch[b[part]]).sum(axis=1) <= most[part]
    a, b = a[close], b[close]
    both, present, edges = np.zeros(len(a), dtype=np.int64), np.zeros(len(order), dtype=bool), np.flatnonzero(np.diff(a)) + 1
    for part in np.split(np.arange(len(a)), edges):
        if len(part):
            i = a[part[0]]
            own = own_rank[begins[i] : begins[i] + size[i]]
            present[own] = True
            for x in range(0, len(part), 512):
                js = b[part[x : x + 512]]
                hit = present[own_rank[expanded(begins[js], size[js])]]
                both[part[x : x + 512]] = np.bincount(np.repeat(np.arange(len(js)), size[js]), hit, minlength=len(js))
            present[own] = False
    score = both / (n[a] + n[b] - both)
    near = score >= threshold
    return a[near], b[near], score[near]


def similar_sets(collection: DataFrame, k: int, threshold: float) -> DataFrame:
    """Sequences by k-mer sets, exact up to 48-bit hashes of the k-mers or longer ones.

    Similar sets are nearly alike in size: sequences are dealt over bands by the size of their set, such that pairs lie
    within a band or between neighbours, and over blocks in a band. A block is one row of compressed sequences, and goes to
    the groups of itself with every block of those bands. In a group, prefixes in an order of rising frequency give the
    candidates, so k-mers and candidates are never rows.
    """
    size_of = "rep long, n long, letters long, sequence string"

    def sized(parts):
        for batch in parts:
            texts = batch.column("sequence").to_pylist()
            letters, n = np.array([len(x) for x in texts], dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(np.cumsum(letters) // LETTERS)) + 1):
                if len(part):
                    hashes, row = kmer_hashes([texts[i] for i in part], k)
                    order = np.lexsort((hashes, row))
                    hashes, row = hashes[order], row[order]
                    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])
                    n[part] = np.bincount(row[new], minlength=len(part))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(n), pa.array(letters), batch.column("sequence")], names=["rep", "n", "letters", "sequence"])

    sets = written(distinct_sequences(collection).select(F.col("rep").cast("long").alias("rep"), "sequence").mapInArrow(sized, size_of))
    steps = -np.log(min(max(threshold, 1e-9), 1 - 1e-9))
    sets = sets.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(steps)) * (1 - 1e-9)).cast("long"))
    blocks = written(sets.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("letters") / LETTERS)).alias("blocks")))
    place = lambda band, block: F.struct(F.col(band).alias("band"), F.col(block).alias("block"))
    placed = sets.join(F.broadcast(blocks), "band").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks")).select("band", "block", "rep", "sequence")

    def pack(table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        own = table.select(["rep", "sequence"])
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(own.combine_chunks())
        return pa.table({"band": table.column("band")[:1], "block": table.column("block")[:1], "packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    packed = written(placed.groupBy("band", "block").applyInArrow(pack, "band long, block long, packed binary"))
    each = blocks.select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).withColumn("near", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    other = blocks.select(F.col("band").alias("near"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    meets = written(each.join(other, "near").select("band", "block", F.least(place("band", "block"), place("near", "other")).alias("lo"), F.greatest(place("band", "block"), place("near", "other")).alias("hi")))
    groups = meets.join(packed, ["band", "block"]).repartition(min(max(meets.count(), 1), 4096), "lo", "hi").groupBy("lo", "hi")

    def compare(table: pa.Table) -> pa.Table:
        own = [pa.ipc.open_stream(x).read_all() for x in table.column("packed").to_pylist()]
        reps, texts = np.concatenate([x.column("rep").to_numpy() for x in own]), [t for x in own for t in x.column("sequence").to_pylist()]
        a, b, score = near_in_blocks(texts, own[0].num_rows, k, threshold)
        return pa.table({"a": np.minimum(reps[a], reps[b]), "b": np.maximum(reps[a], reps[b]), "score": score})

    return written(groups.applyInArrow(compare, "a long, b long, score double"))
