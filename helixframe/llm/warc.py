"""Operator 13, WARC archives of pages: written as records in segments, read back by reassembling the segments.

Writing is DataFrame code. Every page becomes one logical record whose payload is its body: the first page of those with
equal payloads a response, the others revisits that refer to it. A response holds an HTTP message in chunked transfer
framing and is cut into segments of bounded size, the first a `response`, the others `continuation` records with the
first one's identifier and their number, the last also with the total length. Records are written as gzip files by the
text writer, whose line separator is the end of a record, so tasks may fail and be repeated.

Reading streams each file through the text reader, cut at a string that every record holds once, and puts the exact bytes
together again, so a task holds one record at a time. Continuation records are grouped by the identifier of their origin,
ordered by segment number, and checked for gaps, repeats and the total length; then the chunks are decoded and the digest
is compared. Only segments are shuffled, and a group is one page.

Defined results: a null body is an empty payload; payloads shorter than `least_bytes` are all responses; the first page is
that with the smallest id, null last, then the smallest url, null first; equal rows are records of their own; a null id
or url has no header; line breaks in a url are percent-encoded in its header; a record that cannot be put together has a
`problem` (a cut record, a missing or repeated segment, a wrong length, broken chunks, another digest, a revisit of
nothing) and a null payload; an empty table gives an archive without records and an empty result; other columns are not
read. Plain archives that Spark would split raise an error: WARC files are kept in gzip, of one member or one a record.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from helixframe.llm._shared import discard, give_back, materialise, shared_dir

END = "\r\n\r\n"
#: Every record has it once; a file is cut here for reading.
MARK = "WARC-Type:"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Extension header with the id of a page.
ROW_ID = "Helixframe-Row-ID"
#: Bytes of records that a reading task hands on together.
TOGETHER = 4 << 20
LIGHT = ("record_id", "type", "row_id", "target_uri", "payload_bytes", "payload_digest", "problem")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32, upper case: ten hexadecimal digits at a time are eight of base 32."""
    digits = F.sha1(payload)
    eight = [F.lpad(F.conv(F.substring(digits, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*eight), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def cut(data: Column, size: int, each) -> Column:
    """An array of `each(number from 0, piece)` over pieces of `size` bytes; empty data has none."""
    numbers = F.when(F.length(data) > 0, F.sequence(F.lit(0), F.floor((F.length(data) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: each(i, F.substring(data, i * size + 1, F.lit(size))))


def chunked(payload: Column, size: int) -> Column:
    """The payload in chunked transfer framing."""
    chunk = lambda i, piece: F.concat(F.lower(F.hex(F.length(piece))), F.lit("\r\n"), piece.cast("string"), F.lit("\r\n"))
    return F.concat(F.array_join(cut(payload, size, chunk), ""), F.lit("0" + END)).cast("binary")


def header(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value.cast("string")), F.lit(""))


def record_id(*of: Column) -> Column:
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x1e")) for c in of]), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = 1 << 20, chunk_bytes: int = 1 << 13, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write a record for each row of `pages` into gzip archives in the folder `path`.

    Bodies move once, and of equal ones at most one a task; revisits are found among digests and ids alone. Copies of one
    payload may be any share of the rows: the join by digest can be split, and nothing gathers them.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("payload")).withColumns({"sha": F.sha2("payload", 256), "bytes": F.length("payload")})
    place = [F.col("id").isNull().alias("nameless"), F.col("id").alias("id"), F.col("url").alias("url")]
    light = materialise(own.groupBy("sha", "bytes", "id", "url").agg(F.count("*").cast("int").alias("copies"), F.min(base32_sha1(F.col("payload"))).alias("digest")))
    first_id = lambda a: record_id(F.col(f"{a}.id"), F.col(f"{a}.url"), F.col("sha"), F.lit(1))

    large = own.where(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.min(F.struct(*place, "payload")).alias("f"))
    responses = large.select("f.id", "f.url", "f.payload", first_id("f").alias("record"))
    if least_bytes > 0:
        small = own.where(F.col("bytes") < least_bytes).groupBy("id", "url", "sha").agg(F.min("payload").alias("payload"), F.count("*").cast("int").alias("copies"))
        small = small.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        responses = responses.unionByName(small.select("id", "url", "payload", record_id(F.col("id"), F.col("url"), F.col("sha"), F.col("copy")).alias("record")))
    block = F.concat(F.lit(HTTP_HEAD + END).cast("binary"), chunked(F.col("payload"), chunk_bytes))
    responses = responses.withColumns({"digest": base32_sha1(F.col("payload")), "block": block}).drop("payload").withColumn("total", F.length("block"))
    segments = responses.select("*", F.posexplode(cut(F.col("block"), segment_bytes, lambda i, piece: piece)).alias("at", "piece")).drop("block")
    several, last = F.col("total") > segment_bytes, (F.col("at") + 1) * segment_bytes >= F.col("total")
    opening = F.col("at") == 0
    first_headers = F.concat(header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), header(ROW_ID, F.col("id")), header("Content-Type", F.lit("application/http;msgtype=response")))
    parts = segments.select(F.concat(
        F.lit("WARC/1.1"), header("WARC-Type", F.when(opening, "response").otherwise("continuation")), header("WARC-Record-ID", F.when(opening, F.col("record")).otherwise(record_id(F.col("record"), F.col("at")))), header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.when(opening, first_headers).otherwise(""), header("WARC-Segment-Number", F.when(several, F.col("at") + 1)),
        header("WARC-Segment-Origin-ID", F.when(~opening, F.col("record"))), header("WARC-Segment-Total-Length", F.when(several & last, F.col("total"))), header("Content-Length", F.length("piece")), F.lit(END), F.col("piece").cast("string"),
    ).alias("value"))

    firsts = light.where(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.min(F.struct(*place)).alias("first"), F.sum("copies").alias("n")).where("n > 1")
    again = light.where(F.col("bytes") >= least_bytes).join(firsts, "sha").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    again = again.where((F.col("copy") > 1) | ~F.col("id").eqNullSafe(F.col("first.id")) | ~F.col("url").eqNullSafe(F.col("first.url")))
    revisits = again.select(F.concat(
        F.lit("WARC/1.1"), header("WARC-Type", F.lit("revisit")), header("WARC-Record-ID", record_id(F.col("id"), F.col("url"), F.col("sha"), F.col("copy"))), header("WARC-Date", F.lit(date)), header("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), header(ROW_ID, F.col("id")), header("WARC-Profile", F.lit(PROFILE)), header("WARC-Refers-To", first_id("first")), header("Content-Type", F.lit("application/http;msgtype=response")),
        header("Content-Length", F.lit(len(HTTP_HEAD) + len(END))), F.lit(END + HTTP_HEAD + END),
    ).alias("value"))
    parts.unionByName(revisits).write.option("lineSep", END).option("compression", "gzip").text(path)
    discard(light)


class Records:
    """Records of one archive, from its bytes as they come."""

    def __init__(self):
        self.bytes, self.head, self.begin, self.broken = bytearray(), None, 0, False

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """(headers by lower-case name, block) of each record that is complete; a block of None where the record is cut."""
        self.bytes += data
        while not self.broken:
            if self.head is None:
                while self.bytes[:1] in (b"\r", b"\n"):
                    del self.bytes[:1]
                end = self.bytes.find(END.encode())
                if end < 0:
                    return
                self.head, self.begin = headers(bytes(self.bytes[:end])), end + len(END)
                if not self.head.get("content-length", "").isdigit():
                    self.broken = True
                    yield self.head, None
                    return
            stop = self.begin + int(self.head["content-length"])
            if len(self.bytes) < stop:
                return
            yield self.head, bytes(self.bytes[self.begin : stop])
            self.head = None
            del self.bytes[:stop]

    def close(self) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """What the file ends in: its last bytes may be those of the separator that the reader swallows."""
        if not self.broken and (self.head is not None or self.bytes.strip()):
            yield self.head or {}, None


def headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; lines that begin with a space go on with the one before."""
    out, name = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


RECORD = "record_id string, type string, row_id string, target_uri string, digest string, refers_to_id string, origin_id string, segment_no int, total_length long, problem string, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all gzip archives under `path`, one row each, segments apart."""
    lines = spark.read.option("lineSep", MARK).text(path)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    names = [field.split()[0] for field in RECORD.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, types[f.split()[1]]) for n, f in zip(names, RECORD.split(", "), strict=True)])

    def row(head: dict[str, str], block: bytes | None) -> tuple:
        number = lambda key: int(head[key]) if head.get(key, "").isdigit() else None
        digest = head.get("warc-payload-digest")
        return (head.get("warc-record-id"), head.get("warc-type"), head.get(ROW_ID.lower()), head.get("warc-target-uri"), digest.removeprefix("sha1:") if digest else None, head.get("warc-refers-to"), head.get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), "cut record" if block is None else None, block)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader, ready, size = None, Records(), [], 0
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=schema)
        for batch in batches:
            for value, own, start in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if start:
                    raise ValueError(f"{own} is split: keep archives in gzip")
                data = value.as_py() or b""
                if own != path:
                    ready += [row(*r) for r in reader.close()]
                    path, reader = own, Records()
                else:
                    data = MARK.encode() + data
                for head, block in reader.feed(data):
                    ready.append(row(head, block))
                    size += len(block or b"")
                    if size >= TOGETHER:
                        yield packed(ready)
                        ready, size = [], 0
        ready += [row(*r) for r in reader.close()]
        if ready:
            yield packed(ready)
        give_back()

    return lines.mapInArrow(parse, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Responses with whole blocks: those of one record as they are, those in segments put together by origin."""
    whole = records.where("segment_no IS NULL AND origin_id IS NULL AND coalesce(type, '') IN ('response', '')").select("record_id", "type", "row_id", "target_uri", "digest", "problem", "block")
    parts = records.where("segment_no IS NOT NULL OR origin_id IS NOT NULL").withColumn("origin", F.coalesce("origin_id", "record_id"))
    first = F.max(F.when(F.col("segment_no") == 1, F.struct("type", "row_id", "target_uri", "digest"))).alias("first")
    joined = parts.groupBy("origin").agg(first, F.max("total_length").alias("total"), F.max("problem").alias("problem"), F.array_sort(F.collect_list(F.struct("segment_no", "block"))).alias("s"))
    numbers, blocks = F.col("s.segment_no"), F.transform("s", lambda x: x["block"].cast("string"))
    problem = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.size(F.array_distinct(numbers)) < F.size("s"), "repeated segment")
        .when(F.col("first").isNull() | F.col("total").isNull() | (numbers != F.sequence(F.lit(1), F.size("s"))), "missing segment")
        .when(F.length(F.array_join(blocks, "").cast("binary")) != F.col("total"), "wrong length")
    )
    joined = joined.select(F.col("origin").alias("record_id"), "first.*", problem.alias("problem"), F.array_join(blocks, "").cast("binary").alias("block"))
    return whole.unionByName(joined)


def decode_http(block: bytes) -> bytes | None:
    """The body of an HTTP message, out of its chunks where it has any; None where these are broken."""
    head, found, body = block.partition(END.encode())
    if not found:
        return None
    if "chunked" not in headers(head).get("transfer-encoding", "").lower():
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return None
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def payloads(records: DataFrame) -> DataFrame:
    """record_id, type, row_id, target_uri, payload, payload_bytes, payload_digest, problem of every response."""
    names = ["record_id", "type", "row_id", "target_uri", "digest", "problem"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                out, size, first = [], 0, at
                while at < batch.num_rows and size < TOGETHER:
                    block, problem = batch.column(6)[at].as_py(), batch.column(5)[at].as_py()
                    out.append(None if block is None or problem else decode_http(block))
                    size += len(block or b"")
                    at += 1
                yield pa.RecordBatch.from_arrays([*batch.slice(first, at - first).columns[:6], pa.array(out, pa.binary())], names=[*names, "payload"])
        give_back()

    found = reassemble(records).select(*names, "block").mapInArrow(decode, ", ".join(f"{n} string" for n in names) + ", payload binary").withColumn("hf_digest", base32_sha1(F.col("payload")))
    problem = F.coalesce("problem", F.when(F.col("payload").isNull(), "broken chunks").when(F.col("digest") != F.col("hf_digest"), "other digest"))
    found = found.withColumn("problem", problem).withColumn("payload", F.when(F.col("problem").isNull(), F.col("payload")))
    return found.select("record_id", "type", "row_id", "target_uri", "payload", F.length("payload").cast("long").alias("payload_bytes"), F.when(F.col("payload").isNotNull(), F.col("hf_digest")).alias("payload_digest"), "problem")


def index_archives(spark: SparkSession, path: str, id_type: DataType | str = "long") -> DataFrame:
    """row_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri, problem: one row a logical record; a revisit has the figures of what it refers to."""
    records = materialise(read_records(spark, path))
    responses = materialise(payloads(records).select(*LIGHT))
    again = materialise(records.where("type = 'revisit'").select("record_id", "type", "row_id", "target_uri", "refers_to_id", "digest", "problem"))
    discard(records)
    origin = responses.select(F.col("record_id").alias("refers_to_id"), F.col("row_id").alias("refers_to"), "payload_bytes", "payload_digest", F.lit(True).alias("found"))
    again = again.join(origin, "refers_to_id", "left")
    problem = F.coalesce("problem", F.when(F.col("found").isNull() | F.col("payload_digest").isNull(), "revisit of nothing").when(F.col("payload_digest") != F.col("digest"), "other digest"))
    again = again.withColumn("problem", problem).select(*LIGHT, "refers_to")
    both = responses.withColumn("refers_to", F.lit(None).cast("string")).unionByName(again)
    return both.select(F.col("row_id").cast(id_type).alias("row_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast(id_type).alias("refers_to"), "record_id", "target_uri", "problem")


def archive_pages(pages: DataFrame, segment_bytes: int = 1 << 20, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write `pages` as archives in the shared folder, read them back, and give the index of their records."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/helixframe-warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least_bytes, segment_bytes, id_col=id_col, url_col=url_col, body_col=body_col)
    return index_archives(spark, path, pages.schema[id_col].dataType).withColumnRenamed("row_id", id_col)
