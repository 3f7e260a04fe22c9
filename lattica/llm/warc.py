"""WARC archives: write captures as records, read archives back, join each capture's records into one nested row.

Each capture is three records: a response (or a revisit of an equal payload), its request and a metadata record; the latter two name
the first in WARC-Concurrent-To. Each record is a gzip member of its own. A task packs members into files of about ``FILE_BYTES``; a single larger record is a file of its own.
Spark's text writer writes them to any store, with its commit protocol: a file is one row, and the line separator that the writer sets behind it is an empty gzip member,
so the file stays valid. Readers take files in pieces, member by member, and records by Content-Length; archives that are one gzip stream, or not packed, are read alike.

Of pages with equal payloads (length and SHA-1) of at least ``min_payload`` bytes, that with the largest page id is the response, the others
revisit it. The largest id is found by an aggregate that combines before the shuffle; a payload that a third of all pages share
meets its one winner in a join that Spark can split. Reports take length and SHA-1 from the payload that is read back; a revisit's are those of the record that its
WARC-Refers-To names.

Defined results: every row is a capture and gives a row, repeated rows as well (those with the winner's page id are all responses); a null payload is the empty payload; a null
URL gives records without WARC-Target-URI; NUL, TAB, LF and CR in URLs are percent-encoded; null is one page id, smaller than any other; columns of the input other than
the three named, whatever their names, are not read; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.util import Tables

#: Packed bytes of a file, about; bytes that a reader unpacks at once; rows that a repeated row is expanded to by one task.
FILE_BYTES, PIECE, REPEATS = 8 << 20, 1 << 20, 1000
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
LEVEL = 6
CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_SCHEMA = "record_id string, type string, concurrent_to string, target_uri string, refers_to string, payload_digest string, date string, fields map<string,string>, payload_bytes long, payload_sha1 string, payload binary"


def base32_sha1(payload):
    """The 160 bits of the SHA-1 as 32 base-32 characters: 5 hex digits are 4 of them."""
    held = F.sha1(payload)
    digits = []
    for k in range(8):
        number = F.conv(held.substr(5 * k + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(number, s).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def _urn(kind: str, page, url, digest, ordinal):
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), digest, ordinal.cast("string"), F.coalesce(F.md5(url), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (h.substr(k, n), F.lit("-"))], h.substr(21, 12), F.lit(">"))


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, n, ordinal, winner): a row for each row of pages; winner is (page_id, url) of the response where payloads repeat, else null; ordinal counts repeated rows."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("digest", base32_sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    held = Tables(pages.sparkSession).stored(p.groupBy("digest", "n", "page_id", "url").agg(F.count("*").alias("c")), "payloads")
    first = held.filter(F.col("n") >= min_payload).groupBy("digest", "n").agg(F.max(F.struct("page_id", "url")).alias("winner"), F.sum("c").alias("k")).filter("k > 1").drop("k")
    again = held.filter("c > 1").withColumnsRenamed({c: f"r_{c}" for c in ("digest", "n", "page_id", "url")})
    p = p.withColumn("ordinal", F.lit(0).cast("long"))
    if not again.isEmpty():  # equal rows collapse before the shuffle and are counted out again, a bounded number in a task
        on = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in ("digest", "n", "page_id", "url")]
        one = p.join(again, on, "left_semi").dropDuplicates(["digest", "n", "page_id", "url"]).join(again, on).drop(*[c for c in again.columns if c != "c"])
        part = one.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / REPEATS)))).repartition("digest", "page_id", "part")
        each = part.withColumn("ordinal", F.explode(F.sequence(F.col("part") * REPEATS, F.least(F.col("c"), (F.col("part") + 1) * REPEATS) - 1)))
        p = p.join(again, on, "left_anti").unionByName(each.select(*p.columns))
    return p.join(first, ["digest", "n"], "left")


def write(caps: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the records of ``captures()`` under ``path`` as WARC/1.1 files, a gzip member a record."""
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner.page_id"))
    uri = F.col("url")
    for c in (0x00, 0x09, 0x0A, 0x0D):
        uri = F.replace(uri, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    named = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    urn = lambda kind: _urn(kind, F.col("page_id"), F.col("url"), F.col("digest"), F.col("ordinal"))
    own = urn("capture")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    asked = F.concat(F.lit("GET "), F.coalesce(F.col("uri"), F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Accept: */*{CRLF}{CRLF}"))
    told = named("page-id", F.col("page_id").cast("string"))

    def record(kind, record_id, block, content_type, more):
        head = [F.lit(f"WARC/1.1{CRLF}"), named("WARC-Type", kind), named("WARC-Record-ID", record_id), named("WARC-Date", F.lit(date)), named("WARC-Target-URI", F.col("uri")), named("Content-Type", F.lit(content_type)), *more]
        return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block, F.lit(CRLF + CRLF))

    digest = named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    origin = _urn("capture", F.col("winner.page_id"), F.col("winner.url"), F.col("digest"), F.lit(0).cast("long"))
    referred = named("WARC-Refers-To", F.when(revisit, origin)), named("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    to = named("WARC-Concurrent-To", own)
    records = [
        record(F.when(revisit, "revisit").otherwise("response"), own, F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))), "application/http;msgtype=response", [digest, *referred]),
        record(F.lit("request"), urn("request"), asked, "application/http;msgtype=request", [to]),
        record(F.lit("metadata"), urn("metadata"), told, "application/warc-fields", [to]),
    ]
    rows = caps.withColumn("uri", uri).select(F.array(*records).alias("records"))
    most = FILE_BYTES

    def run(batches):
        file, held = [], 0
        for b in batches:
            for capture in b.column(0):
                for text in capture:
                    member = gzip.compress(text.as_buffer(), LEVEL, mtime=0)
                    if file and held + len(member) > most:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(file)], pa.binary())], names=["value"])
                        file, held = [], 0
                    file.append(member)
                    held += len(member)
        if file:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(file)], pa.binary())], names=["value"])

    packed = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))  # the cast keeps the bytes as they are
    packed.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _unpacked(data: bytes):
    """The bytes of an archive in pieces; gzip members, one or many, are unpacked."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), PIECE):
            yield data[at : at + PIECE]
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while not z.eof:
            if at >= len(data):
                raise ValueError("an archive ends within a gzip member")
            given = data[at : at + (PIECE >> 4)]
            at += len(given)
            while given and not z.eof:
                yield z.decompress(given, PIECE)
                given = z.unconsumed_tail
        at -= len(z.unused_data)


def parse(data: bytes):
    """The records of one archive: (headers, block), each as soon as it is whole. Broken archives raise ValueError."""
    held, head, need, done = bytearray(), None, 0, 0
    for piece in _unpacked(data):
        held += piece
        while True:
            if head is None:
                while held[:2] == b"\r\n":  # the end of the record before
                    del held[:2]
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                if held[:5] != b"WARC/":
                    raise ValueError(f"no WARC record after record {done}")
                head = _headers(bytes(held[:end]))
                need = int(head["content-length"])
                del held[: end + 4]
            if len(held) < need:
                break
            yield head, bytes(held[:need])
            del held[:need]
            head, done = None, done + 1
    if head is not None or held.strip(b"\r\n"):
        raise ValueError(f"no WARC record, or a broken one, after record {done}")


def base32_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records under ``path``, in RECORD_SCHEMA; payload, its length and its SHA-1 are null but for responses and come from the bytes read, fields holds what a metadata record tells."""
    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]
    names = ["record_id", "type", "concurrent_to", "target_uri", "refers_to", "payload_digest", "date", "fields", "payload_bytes", "payload_sha1", "payload"]

    def row(head, block):
        kind = head.get("warc-type")
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        fields = list(_headers(block).items()) if kind == "metadata" else None
        told = (None, None) if payload is None else (len(payload), base32_of(payload))
        return (*(head.get(k) for k in ("warc-record-id", "warc-type", "warc-concurrent-to", "warc-target-uri", "warc-refers-to", "warc-payload-digest", "warc-date")), fields, *told, payload)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for head, block in parse(content.as_py()):
                    rows.append(row(head, block))
                    held += len(block)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit, and the request and metadata records that name it in WARC-Concurrent-To.

    (capture_id, target_uri, date, response, request, metadata); a part that the archive lacks is null. Records without their payload column
    give responses without it, and no payload is shuffled."""
    of_main = [c for c in ("record_id", "type", "refers_to", "payload_digest", "payload_bytes", "payload_sha1", "payload") if c in records.columns]
    key = F.coalesce("concurrent_to", "record_id")
    main = F.col("type").isin("response", "revisit")
    part = lambda kind, *cols: F.first(F.when(kind, F.struct(*cols)), ignorenulls=True)
    return (
        records.withColumn("capture_id", key).groupBy("capture_id")
        .agg(
            F.first(F.when(main, F.col("target_uri")), ignorenulls=True).alias("target_uri"), F.first(F.when(main, F.col("date")), ignorenulls=True).alias("date"),
            part(main, *of_main).alias("response"),
            part(F.col("type") == "request", "record_id").alias("request"), part(F.col("type") == "metadata", "record_id", "fields").alias("metadata"),
        )
    )


def page_report(spark: SparkSession, archives: str, id_type: str = "long") -> DataFrame:
    """What the archives under ``archives`` hold of each page: length and SHA-1 of payloads as read; a revisit's by the record that it refers to."""
    page = F.try_element_at(F.col("metadata.fields"), F.lit("page-id")).cast(id_type)
    found = assemble(read(spark, archives).drop("payload")).select("capture_id", page.alias("page_id"), "response.type", "response.refers_to", "response.payload_bytes", "response.payload_sha1")
    found = Tables(spark).stored(found, "captures")
    whole = found.filter("type = 'response'")
    origin = whole.select(F.col("capture_id").alias("origin"), F.col("page_id").alias("o_page"), F.col("payload_bytes").alias("o_bytes"), F.col("payload_sha1").alias("o_sha1"))
    again = found.filter("type = 'revisit'").join(origin, F.col("refers_to") == F.col("origin"), "left")
    columns = lambda n, sha, refers: [F.col("page_id"), F.col(n).alias("payload_bytes"), F.col(sha).alias("payload_digest"), F.col("type").alias("record_type"), refers.alias("refers_to")]
    return whole.select(columns("payload_bytes", "payload_sha1", F.lit(None).cast(id_type))).unionByName(again.select(columns("o_bytes", "o_sha1", F.col("o_page"))))
