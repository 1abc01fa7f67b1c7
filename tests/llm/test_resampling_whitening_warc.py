"""Importance resampling, whitening and WARC archives against plain versions, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import importance_resampling as resampling
from helixframe.llm import warc, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def drawn_by_hand(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in side for f in features(x)[1]) for side in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + 10000)) / ((s[b] + 1) * (t.total() + 10000))))
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        rows.append([doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0], r[3], r[2], r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r.append(rank)
    return sorted(([*r, None][:6] for r in rows), key=str)


def test_resampling_by_hand(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SORTED_ROWS", 7)
    rng = random.Random(3)
    vocabulary = ["Apfel", "tree", "été", "x" * 70, "日本語", "7", "a", "Zebra9", "ß" * 40, "word"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(None, None), (500, ""), (501, "..., --"), (502, "@[`{one two"), (None, "tree " * 30), (503, "y" * 3000), (7, docs[7][1]), (7, docs[7][1]), (8, docs[9][1])]
    target = ["tree word tree word", "été", None]
    frame = spark.createDataFrame([(*d, "clash", 5) for d in docs], "doc_id long, text string, bucket string, hf_n int").repartition(5)
    target_frame = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 60, 100):
        got = resampling.resample(frame, target_frame, percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
        assert sorted((list(r) for r in got), key=str) == drawn_by_hand(docs, target, percent)
    kept = resampling.resample(frame, target_frame, keep=("bucket", "text")).where("rank = 1").first()
    assert kept["bucket"] == "clash" and (kept["doc_id"], kept["text"]) in docs


def test_resampling_ties_and_empty(spark):
    same = [(4, "tree " * 25)] * 40 + [(5, "tree " * 25)] * 40
    got = resampling.resample(spark.createDataFrame(same, "doc_id long, text string"), spark.createDataFrame([], "text string"), 50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 41)) and len({r["doc_id"] for r in got if r["rank"]}) == 1
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    few = spark.createDataFrame([(1, "tree " * 25)], "doc_id long, text string")
    assert resampling.resample(few, few).first()["rank"] is None


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(["ab ", "Cde", ", ", "é", " 1", "."]) for _ in range(20000))
    whole = np.zeros(resampling.BUCKETS, int)
    for b, ok in resampling.runs([(0, text.encode(), 0)])[2]:
        whole += np.bincount(b[ok], minlength=resampling.BUCKETS)
    expected = Counter(zlib.crc32(f.encode()) % 10000 for f in features(text)[1])
    assert {i: n for i, n in enumerate(whole) if n} == expected
    for piece in (1, 50, 1000):
        monkeypatch.setattr(resampling, "PIECE", piece)
        cut = np.zeros(resampling.BUCKETS, int)
        for lot in resampling.lots([text.encode(), None, b""]):
            for b, ok in resampling.runs(lot)[2]:
                cut += np.bincount(b[ok], minlength=resampling.BUCKETS)
        assert (cut == whole).all()


def test_the_bracket_is_widened_until_it_holds(spark, monkeypatch):
    scored = spark.range(2000).select((F.col("id") % 3).alias("score"))
    lowest, highest, over = resampling.bracket(scored, 700, 2000)
    assert over < 700 and lowest in (None, 0.0, 1.0)
    real = type(scored).approxQuantile
    calls = []

    def wrong(self, col, at, error):
        calls.append(at)
        return [5e8, 6e8] if len(calls) < 3 else real(self, col, at, error)

    monkeypatch.setattr(type(scored), "approxQuantile", wrong)
    plain = spark.range(2000).select(F.col("id").alias("score"))
    lowest, highest, over = resampling.bracket(plain, 100, 2000)
    assert len(calls) == 3 and over < 100 and (lowest is None or lowest <= 1900) and (highest is None or highest >= 1900)


def cloud(n, d, rng, spread):
    return (rng.standard_normal((n, d)) * spread) @ np.linalg.qr(rng.standard_normal((d, d)))[0]


@pytest.mark.parametrize("spread", [np.linspace(3, 1, 12), np.array([2.0] * 6 + [1.0] * 6), np.array([5, 5, 1e-3, *[0.0] * 9])])
def test_eigenvectors(spread):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    v = q @ np.diag(spread**2) @ q.T
    values, vectors = whitening.principal_components(v, 32)
    true = np.sort(spread**2)[::-1]
    k = int((true > whitening.NOTHING * true[0]).sum())
    assert len(values) == k and np.allclose(values, true[:k], rtol=1e-9, atol=1e-14)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12 and np.abs(v @ vectors - vectors * values).max() < 1e-12 * true[0]


def test_tridiagonal_pieces():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((9, 9))
    a += a.T
    d, e, mirrors = whitening.tridiagonalise(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    q = whitening.carry_back(np.eye(9), mirrors)
    assert np.allclose(q @ t @ q.T, a)
    at = np.linspace(-8, 8, 33)
    assert (whitening.sturm_counts(d, e, at) == (np.linalg.eigvalsh(a)[None] < at[:, None]).sum(axis=1)).all()
    assert np.allclose(whitening.leading_eigenvalues(d, e, 4), np.linalg.eigvalsh(a)[::-1][:4])


def test_whitening_by_hand(spark):
    rng = np.random.default_rng(4)
    vectors = cloud(400, 8, rng, np.linspace(2, 0.3, 8)).astype(np.float32).tolist()
    rows = [(i, v, "clash") for i, v in enumerate(vectors)]
    bad = [(900, None, "x"), (901, [1.0] * 7 + [None], "x"), (902, [float("nan")] * 8, "x"), (903, [float("inf")] + [0.0] * 7, "x")]
    extra = [(None, [0.5] * 8, "x"), (7, vectors[7], "x"), (904, [0.25, 0.5], "x"), (905, [], "x")]
    frame = spark.createDataFrame(rows + bad + extra, "vec_id long, embedding array<float>, component string").repartition(3)
    got = whitening.whiten(frame, 5).toPandas()
    used = vectors + [[0.5] * 8, vectors[7], [0.25, 0.5] + [0.0] * 6, [0.0] * 8]
    x = (np.floor(64 * np.array(used, dtype=np.float32).astype(float)) + 1_000_000).astype(object)
    n, sums = len(x), x.sum(axis=0)
    assert len(got) == 5 * n and set(got["n"]) == {n} and set(got["component"]) == {1, 2, 3, 4, 5}
    assert sorted(got["deviation"]) == sorted(int(((n * r - sums) ** 2).sum()) for r in x for _ in range(5))
    c = x.astype(float) - (sums / n).astype(float)
    values, vectors_ = np.linalg.eigh(c.T @ c / n)
    expected = c @ vectors_[:, ::-1][:, :5] / np.sqrt(values[::-1][:5])
    one = got[got["vec_id"] == 3].sort_values("component")
    assert np.allclose(np.abs(one["whitened"]), np.abs(expected[3]), atol=1e-9)
    assert np.allclose(one["explained"], values[::-1][:5] / values.sum()) and got["identity_error"].nunique() == 1 and got["identity_error"].iat[0] < 1e-10


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], schema)).toPandas()
    assert set(flat["component"]) == {1} and np.isclose(flat["explained"], 1).all() and flat["identity_error"].iat[0] < 1e-9
    with pytest.raises(Exception, match="too large|out of range|overflow"):
        whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [0.0])], schema)).count()


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://a/4", ""), (5, "u\r\nWARC-Type: x", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 4),
    (6, "http://ü/", "é日本\U0001F600" * 700), (7, "http://a/7", "\r\n\r\n"), (None, "http://a/8", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (9, "x", "\r\n0\r\n\r\n" * 5), (10, "long", "line\n" * 40000),
]


@pytest.mark.parametrize("segment_bytes", [7, 300, 1 << 20])
def test_archives_round_trip(spark, tmp_path, segment_bytes):
    pages = spark.createDataFrame([(*p, "clash") for p in (PAGES if segment_bytes > 7 else PAGES[:5] + PAGES[6:10])], "page_id long, url string, html string, digest string").repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=segment_bytes, chunk_bytes=11)
    records = warc.read_records(spark, str(tmp_path / "w"))
    if segment_bytes < 1000:
        assert records.where("type = 'continuation'").count() > 5
    found = {r["row_id"]: r for r in warc.payloads(records).collect()}
    for page_id, _, html in pages.select("page_id", "url", "html").collect():
        if str(page_id) in found:
            assert bytes(found[str(page_id)]["payload"]) == (html or "").encode()
    got = sorted((tuple(r) for r in warc.archive_pages(pages, segment_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem").collect()), key=str)
    first = {}
    for p in sorted((tuple(r) for r in pages.select("page_id", "url", "html").collect()), key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault(p[2] or "", []).append(p[0])
    expected = [(i, len(h.encode()), b32(h.encode()), "revisit" if k else "response", ids[0] if k else None, None) for h, ids in first.items() for k, i in enumerate(ids)]
    assert got == sorted(expected, key=str)


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages, least_bytes=3).collect())
    assert [g[:2] for g in got] == [(1, "response"), (2, "response"), (2, "response"), (3, "response"), (4, "revisit")] and got[-1][2] == 3


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def record(kind, name, block, **more):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *[f"{k.replace('_', '-')}: {v}" for k, v in more.items()], f"content-length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_damaged_and_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    chunk = b"HTTP/1.1 200 OK\r\ntransfer-encoding:\r\n chunked\r\n\r\n4;x=1\r\nWiki\r\n0\r\nTrailer: x\r\n\r\n"
    part = lambda n, no, data, **more: record("continuation" if no > 1 else "response", f"{n}{no}", data, WARC_Segment_Number=no, **({"WARC_Segment_Origin_ID": f"<{n}1>"} if no > 1 else {}), **more)
    (tmp_path / "w").mkdir()
    whole = [record("warcinfo", "i", b"x"), record("response", "plain", http + b"body"), record("response", "chunked", chunk), record("response", "broken", chunk[:-19]), record("response", "digest", http + b"q", WARC_Payload_Digest="sha1:AAAA"), record("revisit", "r", b"", WARC_Refers_To="<nothing>")]
    whole += [part("ok", 2, b"dy", WARC_Segment_Total_Length=len(http) + 4), part("ok", 1, http + b"bo"), part("gap", 1, http), part("gap", 3, b"x", WARC_Segment_Total_Length=20), part("twice", 1, http), part("twice", 2, b"x", WARC_Segment_Total_Length=20), part("twice", 2, b"x", WARC_Segment_Total_Length=20), part("size", 1, http), part("size", 2, b"x", WARC_Segment_Total_Length=99), part("late", 2, b"x", WARC_Segment_Total_Length=1)]
    (tmp_path / "w" / "many.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in whole))  # one member a record
    (tmp_path / "w" / "cut.warc.gz").write_bytes(gzip.compress(record("response", "first", http + b"z") + record("response", "cut", http + b"body")[:-12]))
    records = warc.read_records(spark, str(tmp_path / "w"))
    got = {r["record_id"]: (r["payload"] and bytes(r["payload"]), r["problem"]) for r in warc.payloads(records).collect()}
    assert got == {
        "<plain>": (b"body", None), "<chunked>": (b"Wiki", None), "<broken>": (None, "broken chunks"), "<digest>": (None, "other digest"), "<ok1>": (b"body", None), "<gap1>": (None, "missing segment"),
        "<twice1>": (None, "repeated segment"), "<size1>": (None, "wrong length"), "<late1>": (None, "missing segment"), "<first>": (b"z", None), "<cut>": (None, "cut record"),
    }
    index = {r["record_id"]: r["problem"] for r in warc.index_archives(spark, str(tmp_path / "w")).collect()}
    assert index["<r>"] == "revisit of nothing" and "<i>" not in index
