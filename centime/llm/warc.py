"""WARC archives written and read with Spark, with record boundaries verified as chains.

A payload may hold what looks like a record. Tasks therefore emit every candidate record with the offset of its successor, and
pointer jumping from the start of each file keeps those that can be reached: the true records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, checkpointed, map_rows, remove_folder

#: Shorter payloads are never revisits; the most records and bytes of payloads that a file holds, which bounds what one task
#: reads at once. A payload of over BYTES_PER_FILE has a file of its own.
REVISIT_BYTES, RECORDS_PER_FILE, BYTES_PER_FILE = 100, 2000, 64 << 20
#: Repeated digests (about 80 bytes each) up to which their table is broadcast.
BROADCAST_DIGESTS = 200_000
#: Links that one task of a pointer-jumping round takes.
ROWS_PER_TASK = 200_000
#: Compressed bytes that are taken at a time.
STEP = 1 << 16
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_END = b"\r\n\r\n"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """(value, size): a WARC record, without the blank lines behind it, for each row of pages (page_id, url, html), and its payload's bytes.

    Of equal payloads of at least REVISIT_BYTES, rows with the least page_id are responses, others revisits that name it.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    size = F.octet_length("payload")
    first = rows.where(size >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = checkpointed(first.where("n > 1").select("digest", "first"))
    if repeated.count() <= BROADCAST_DIGESTS:  # else both sides are exchanged, and adaptive execution splits what is hot
        repeated = F.broadcast(repeated)
    typed = rows.join(repeated, "digest", "left").withColumn("revisit", F.coalesce(F.col("page_id") != F.col("first"), F.lit(False)))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(F.col(c).cast("string")), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    body = F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")))
    full = typed.withColumn("body", body)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", name("page_id")),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        _line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), _line("WARC-Refers-To", name("first")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length("body").cast("string")),
        F.lit("\r\n"),
    )
    return full.select(F.concat(head, F.col("body")).alias("value"), size.alias("size"))


def write_archives(pages: DataFrame, folder: str, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Write archives through Spark's text writer: the line separator is the pair of line ends that closes a record.

    Each file is one gzip stream; offsets are those of the records in it. Payloads whose size is of one power of two go
    together, as many to a file as its bytes allow, so that no file holds more than ``bytes_per_file`` or one record.
    """
    rows = records(pages)
    even = bytes_per_file // RECORDS_PER_FILE
    most = pages.agg(F.coalesce(F.max(F.octet_length("html")), F.lit(0))).first()[0]
    low, high, part = -1, even, 0
    while low < most or not part:
        of = rows.where((F.col("size") > low) & (F.col("size") <= high)) if most > even else rows
        n = max(1, min(RECORDS_PER_FILE, bytes_per_file // max(high, 1)))
        of.select("value").write.option("lineSep", _END.decode()).option("maxRecordsPerFile", n).option("compression", "gzip").text(f"{folder}/part={part}")
        low, high, part = high, high * 2, part + 1


def inflated(data: bytes) -> tuple[bytes, bool]:
    """An archive's bytes, compressed or not, and whether its streams end as they should. Of a cut or damaged one, what comes before the damage."""
    parts, rest = [], memoryview(data)
    if data[:2] != b"\x1f\x8b":
        return data, True
    while rest[:2] == b"\x1f\x8b":
        stream = zlib.decompressobj(wbits=31)
        while rest and not stream.eof:  # step by step, so that what was good before an error is kept
            try:
                parts.append(stream.decompress(rest[:STEP]))
            except zlib.error:
                return b"".join(parts), False
            rest = rest[STEP:] if not stream.eof else memoryview(data)[len(data) - len(rest) + len(rest[:STEP]) - len(stream.unused_data) :]
        if not stream.eof:
            return b"".join([*parts, stream.flush()]), False
    return b"".join(parts), True


def plain(data: bytes) -> bytes:
    return inflated(data)[0]


def candidates_of(data: bytes) -> Iterator[tuple]:
    """Every stretch that parses as a record: its offset, its successor's offset, and what it says.

    A stretch counts if its header ends, has a Content-Length and the record closes with two line ends inside the file.
    """
    for m in _MAGIC.finditer(data):
        end = data.find(_END, m.end())
        if end < 0:
            continue
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in data[m.end() : end].split(b"\r\n"))}
        length = head.get(b"content-length", b"")
        if not (length.isdigit() and len(length) < 19):
            continue
        start = end + 4
        stop = start + int(length)
        if data[stop : stop + 4] != _END:
            continue
        http, _, payload = data[start:stop].partition(_END)
        kind = head.get(b"warc-type", b"").decode("latin-1")
        said = head.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:")
        if kind == "revisit":
            found = re.search(rb"(?im)^content-length: *(\d+)", http)
            size, digest = int(found[1]) if found else None, said
        else:
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        yield m.start(), stop + 4, kind, _page(head.get(b"warc-record-id")), size, digest, _page(head.get(b"warc-refers-to")), head.get(b"warc-target-uri", b"").decode("utf-8", "replace"), digest == said


def _page(name: bytes | None) -> str | None:
    m = re.fullmatch(rb"<urn:page:(.+)>", name or b"")
    return unquote_plus(m[1].decode("latin-1")) if m else None


def scan(archives: DataFrame) -> DataFrame:
    """Candidates of each file of archives (path, content): file, size (of its plain bytes), whole (not cut or damaged as a stream), at, next and the record's fields."""
    schema = "file string, size long, whole boolean, found array<struct<at:long,next:long,record_type:string,page_id:string,payload_bytes:long,payload_digest:string,refers_to:string,url:string,digest_ok:boolean>>"
    names = ("at", "next", "record_type", "page_id", "payload_bytes", "payload_digest", "refers_to", "url", "digest_ok")

    def one(r):
        data, whole = inflated(r[1])
        return r[0].decode(), len(data), whole, [dict(zip(names, c)) for c in candidates_of(data)]

    return map_rows(archives.select("path", "content"), lambda: one, schema).select("file", "size", "whole", F.inline_outer("found"))


def reachable(links: DataFrame) -> DataFrame:
    """(file, at) on the chain of links (file, at, next) from offset 0 of each file, by pointer jumping; its end may be among them.

    Round k knows the first 2**k places of each chain and jumps of 2**k links, and doubles both.
    """
    parts = links.count() // ROWS_PER_TASK + 1  # the rows are small: a folder full of tiny files would cost more than they do
    jumps = checkpointed(links.select("file", "at", "next").coalesce(parts))
    seen = jumps.where("at = 0").select("file", "at")
    while True:
        new = checkpointed(seen.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at")).coalesce(parts))
        if new.isEmpty():
            return seen
        seen = seen.union(new).coalesce(parts)
        onward = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        jumps = checkpointed(jumps.join(onward, ["file", "next"]).select("file", "at", F.col("after").alias("next")).coalesce(parts))


def read_archives(spark, folder: str) -> DataFrame:
    """The true records of all archives in a folder: file, size, at, next, record_type, page_id, payload_bytes, payload_digest, ..."""
    found = checkpointed(scan(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)))
    return found.join(reachable(found.where("at is not null")), ["file", "at"], "left_semi")


def broken_chains(archives: DataFrame) -> DataFrame:
    """(file, size, stops): the files of archives (path, content) whose chain of records does not reach the end, and where it stops.

    What lies behind a damaged record can't be told from payload, so it is reported, not guessed. A compressed file that is cut or
    damaged counts too, even where its plain bytes end with a record. Empty files are whole.
    """
    found = checkpointed(scan(archives))
    reached = found.where("at is not null").join(reachable(found.where("at is not null")), ["file", "at"], "left_semi")
    ends = reached.groupBy("file").agg(F.max("next").alias("stops"))
    files = found.groupBy("file").agg(F.first("size").alias("size"), F.bool_and("whole").alias("whole")).join(ends, "file", "left").withColumn("stops", F.coalesce("stops", F.lit(0)))
    return files.where("stops < size or not whole").drop("whole")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages into archives in a new folder beside the checkpoints, read them back, and take the folder away.

    A null html is an empty payload. Repeated rows give a record each; those with the least page_id are all responses. A null
    page_id is a response without an id. page_id and refers_to have the type that they have in ``pages``. No pages give no records.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    read = checkpointed(read_archives(spark, folder))
    remove_folder(spark, folder)
    return read.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
