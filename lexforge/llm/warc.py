"""WARC archives: writing, reading back and revisit resolution.

Only headers (id, address, digest, size) are shuffled by payload digest. They say
which records are revisits; those are written from their headers, joined to the
record that holds the payload. Payloads of all others go from the scan straight
into the archives. A scan can't be told an unbounded list of revisits, so it is
told a Bloom filter of bounded size: what the filter lets by is no revisit. Of
what it stops, the headers that were stopped wrongly make a second filter, and
only rows that both stop, about one in ten thousand, are shuffled with their
payload and told apart exactly.

An archive is a file of gzip members, a member for each record, so a record can be
read at its offset. Spark's text writer puts chunks of members on any store that
Spark knows: it ends a line with one byte, and the last byte of a member is zero.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import _shared

CRLF = "\r\n"
#: Payloads below this many bytes are never revisited.
MIN_REVISIT_BYTES = 100
#: Bytes of records, before gzip, from which an archive file is closed.
ARCHIVE_BYTES = 16 << 20
#: Bits of a filter for each key, and at most; two are set for a key.
BITS_PER_KEY, MOST_BITS = 128, 1 << 25
#: An empty gzip member; it ends in zero bytes.
_NOTHING = bytes.fromhex("1f8b08000000000000030300") + bytes(8)
READ_SCHEMA = "page_id long, record_type string, target string, payload_digest string, payload_bytes long, refers_to_digest string, refers_to_id long, refers_to_target string, offset long, payload binary"
HEADER = ["page_id", "url", "payload_digest", "payload_bytes", "date"]


def headers(pages: DataFrame, date: str | Column) -> DataFrame:
    """The rows' headers and payloads; null html is an empty payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.sha2(payload, 256).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        (date if isinstance(date, Column) else F.lit(date)).alias("date"),
        payload.alias("payload"),
    )


def first_records(heads: DataFrame) -> DataFrame:
    """(payload_digest, original, original_url, original_date) for each large payload that occurs twice or more.

    The smallest id is taken by partial minima, so a payload that a third of all
    pages share adds one row for each map task. Null ids are never originals.
    """
    large = heads.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    held = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "date"))).alias("o")
    grouped = large.groupBy("payload_digest").agg(held, F.count("*").alias("n")).filter("n > 1 AND o IS NOT NULL")
    return grouped.select("payload_digest", F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url"), F.col("o.date").alias("original_date"))


def revisits(heads: DataFrame) -> DataFrame:
    """The headers of all revisits with what they refer to."""
    # Written, so that the join has plain exchanges and adaptive execution can split a digest that many pages have.
    first = _shared.materialize(first_records(heads), "originals")
    joined = heads.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES).join(first, "payload_digest")
    return joined.filter(~F.col("page_id").eqNullSafe(F.col("original")))


def _key() -> Column:
    return F.xxhash64("page_id", "payload_digest")


class Filter:
    """A Bloom filter over (page_id, payload_digest) as a table of 64-bit words, of at most MOST_BITS bits."""

    def __init__(self, rows: DataFrame, n: int):
        self.bits = 1 << min(MOST_BITS.bit_length() - 1, max(6, (n * BITS_PER_KEY - 1).bit_length()))
        spots = rows.select(F.explode(F.array(*map(self._spot, range(2)))).alias("spot"))
        words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot & 63 AS INT))")).alias("mask"))
        self.words = _shared.materialize(words, "filter")

    def _spot(self, k: int) -> Column:
        return F.xxhash64(_key(), F.lit(k)).bitwiseAND(F.lit(self.bits - 1).cast("long"))

    def marked(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with a column that is false only where the key is certainly not in the filter."""
        out, held = rows, F.lit(True)
        for k in range(2):
            # At most MOST_BITS / 64 rows, whatever the input.
            words = F.broadcast(self.words.select(F.col("word").alias(f"_w{k}"), F.col("mask").alias(f"_m{k}")))
            out = out.join(words, F.shiftright(self._spot(k), 6) == F.col(f"_w{k}"), "left")
            bit = F.col(f"_m{k}").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), self._spot(k).bitwiseAND(F.lit(63).cast("long")).cast("int")))
            held = held & (F.coalesce(bit, F.lit(0).cast("long")) != 0)
        return out.select(*rows.columns, held.alias(name))


def records(pages: DataFrame, date: str | Column) -> DataFrame:
    """One row per record: its headers, ``original`` and the like for revisits, and the payload of responses."""
    every = headers(pages, date)
    heads = _shared.materialize(every.drop("payload"), "headers")
    again = _shared.materialize(revisits(heads), "revisits")
    n = again.count()
    refers = ["original", "original_url", "original_date"]
    none = [F.lit(None).cast(again.schema[c].dataType).alias(c) for c in refers]
    if not n:
        return every.select(*HEADER, *none, "payload")
    stop = Filter(again, n)
    same = lambda a, b: a["payload_digest"].eqNullSafe(b["payload_digest"]) & a["page_id"].eqNullSafe(b["page_id"])
    known = again.select("page_id", "payload_digest").distinct().hint("merge")
    wrongly = stop.marked(heads, "_stopped").filter("_stopped").drop("_stopped")
    wrongly = _shared.materialize(wrongly.join(known, same(wrongly, known), "left_anti"), "wrongly")
    m = wrongly.count()
    told = stop.marked(every, "_stopped")
    parts = [told.filter("NOT _stopped").select(*HEADER, *none, "payload")]
    if m:
        doubtful = Filter(wrongly, m).marked(told.filter("_stopped").drop("_stopped"), "_doubtful").filter("_doubtful").drop("_doubtful")
        parts.append(doubtful.join(known, same(doubtful, known), "left_anti").select(*HEADER, *none, "payload"))
    parts.append(again.select(*HEADER, *refers, F.lit(None).cast("string").alias("payload")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def record(page: int | None, url: str, digest: str, size: int, date: str, original: int | None, original_url: str | None, original_date: str | None, payload: bytes) -> bytes:
    """One WARC record: a revisit if there is an original, else a response. A revisit's HTTP head still tells the full size."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {size}{CRLF}{CRLF}".encode()
    block = http if original is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if original is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{original}>",
            f"WARC-Refers-To-Target-URI: {original_url}", f"WARC-Refers-To-Date: {original_date}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return CRLF.join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def _archiver(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            if held[-1][-1]:  # a record of 16 MB or more can end in another byte than zero
                held.append(_NOTHING)
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

        for batch in batches:
            for row in zip(*(c.to_numpy(zero_copy_only=False) if pa.types.is_string(c.type) else c.to_pylist() for c in batch.columns)):
                data = record(*row[:-1], (row[-1] or "").encode())
                held.append(member(data))
                size += len(data)
                if size >= archive_bytes:
                    yield chunk()
                    held, size = [], 0
        if held:
            yield chunk()

    return run


def write_archives(pages: DataFrame, path: str, date: str | Column = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write (page_id, url, html) as deduplicated archives.

    Of rows with equal payloads of at least MIN_REVISIT_BYTES the one with the
    smallest id is a response and the others revisit it; all others are responses.
    Null html is an empty payload, a null url ``about:blank``, a null id ``null``,
    never an original. Rows that repeat the smallest id of their payload are all
    responses. A payload of any length is one record; a file ends with the record
    that takes it past ``archive_bytes``. Other columns are not read.
    """
    chunks = records(pages, date).mapInArrow(_archiver(archive_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    # One chunk is one file.
    chunks.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def members(raw: memoryview) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member, one in memory at a time."""
    at = 0
    while at < len(raw):
        reader, content, begin = zlib.decompressobj(31), [], at
        while not reader.eof:
            piece = raw[at : at + (1 << 14)]
            if not piece:
                raise ValueError(f"the gzip member at byte {begin} is cut short")
            content.append(reader.decompress(piece))
            at += len(piece)
        at -= len(reader.unused_data)
        if any(content):
            yield begin, b"".join(content)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and block of each record in uncompressed archive bytes; records are cut by Content-Length, never by marks in payloads."""
    at, view = 0, memoryview(data)
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split(CRLF)
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        begin = stop + 4
        end = begin + int(head["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield head, view[begin:end]
        at = end + 4


def http_payload(block: memoryview) -> tuple[str, memoryview]:
    """The HTTP head, of any length, and the payload after it."""
    raw = bytes(block)
    split = raw.find(b"\r\n\r\n")
    if split < 0:
        raise ValueError("an HTTP head without an end")
    return raw[:split].decode("latin-1"), block[split + 4 :]


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _reader(with_payload: bool):
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names)

    def row(head: dict[str, str], block: memoryview, offset: int) -> tuple:
        kind = head["WARC-Type"]
        http, payload = http_payload(block)
        told = head.get("WARC-Payload-Digest", "").removeprefix("sha256:")
        if kind == "response":
            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
            if re.fullmatch("[0-9a-f]{64}", told) and digest != told:
                raise ValueError(f"{head['WARC-Record-ID']}: its payload is not what its digest says")
        else:
            length = re.search(r"(?im)^content-length: *(\d+)", http)
            digest, size = told, int(length[1]) if length else None
        body = bytes(payload) if with_payload and kind == "response" else None
        again = kind == "revisit"
        return (_page(head["WARC-Record-ID"]), kind, head.get("WARC-Target-URI"), digest, size, told if again else None, _page(head.get("WARC-Refers-To")), head.get("WARC-Refers-To-Target-URI"), offset, body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for offset, data in members(memoryview(content.as_buffer())):
                    for head, block in parse(data):
                        if head["WARC-Type"] not in ("response", "revisit"):
                            continue
                        rows.append(row(head, block, offset))
                        held += len(rows[-1][-1] or b"") + 200
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per response or revisit; digests of responses are taken from the payloads as read, other records are passed over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_reader(with_payload), READ_SCHEMA)


def resolve(found: DataFrame) -> DataFrame:
    """Records with each revisit joined to the response that has its payload; a revisit without one fails the read."""
    heads = found.drop("payload")
    answers = heads.filter("record_type = 'response'").groupBy(F.col("payload_digest").alias("refers_to_digest")).agg(F.min("page_id").alias("refers_to"))
    # Only answers that a revisit asks for, and written, so that a digest with many revisits can be split.
    asked = heads.filter("record_type = 'revisit'").select("refers_to_digest").distinct()
    answers = _shared.materialize(answers.join(asked.hint("merge"), "refers_to_digest", "left_semi"), "answers")
    joined = heads.filter("record_type = 'revisit'").join(answers, "refers_to_digest", "left")
    lost = F.col("refers_to").isNull() | (F.col("refers_to") != F.col("refers_to_id"))
    checked = joined.withColumn("refers_to", F.when(lost, F.raise_error(F.lit("a revisit has no original"))).otherwise(F.col("refers_to")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return heads.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(checked.select(columns))
