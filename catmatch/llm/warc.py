"""WARC archives: write pages as records with revisits, and read archives back with a salvage reader.

Written files are sequences of gzip members, one record a member, with an empty member after each
of them. Spark's own text writer puts them down (the empty member is its line separator), so that
its commit protocol and any file system it knows serve the archives.

Of records with equal payloads of at least `LEAST` bytes the one with the smallest key is the
response; the others revisit it and hold its HTTP head only. Payloads are compared by SHA-256.
A record is compressed before its kind is known, so that the join by digest moves no whole page.

The reader takes an archive apart member by member, or record by record where it is not
compressed. What fails a check (an inflated member's sum and length, version line, headers, content
length, closing line ends, block and payload digests) is quarantined: the reader searches for the next
gzip member or version line that passes all of them, goes on there, and reports the bytes between
as a gap.

Defined cases: a null payload is empty; a null or empty uri is written as none; a null key is never
the smallest, and where all keys of a payload are null all its records are responses; rows of one
payload that share the smallest key are all responses; an empty table makes no records; other columns
are ignored. An archive file must fit a task, as files of the usual gigabyte or less do.
"""
from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads shorter than this are always written whole.
LEAST = 100
#: Records a file holds at most.
FILE_RECORDS = 20_000
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_URI = "urn:key:"
#: A version line and headers longer than this are no record.
HEAD_BYTES = 1 << 16
#: The reader hands on payloads in batches of about so many bytes.
BATCH_BYTES = 8 << 20
_MAGIC = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
_VERSION_LINE = re.compile(rb"WARC/\d{1,3}\.\d{1,3}\r\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/\d{1,3}\.\d{1,3}\r\n")


def compressed(record: bytes, level: int = LEVEL) -> bytes:
    """One gzip member, the same for the same bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


#: What stands behind every record of a written file.
EMPTY_MEMBER = compressed(b"")


def _uri(key: str | None) -> bytes:
    return f"<{KEY_URI}{'' if key is None else urllib.parse.quote(key, safe='')}>".encode()


def record_of(key: str | None, target: str | None, payload: bytes, digest: str, date: str = DATE, *,
              refers_to: str | None = None, payload_bytes: int | None = None) -> bytes:
    """A response record, or with `refers_to` the revisit record of a response with that key."""
    size = len(payload) if payload_bytes is None else payload_bytes
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    lines = [VERSION, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + _uri(key)]
    if target:
        lines.append(b"WARC-Target-URI: " + target.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8"))
    lines += [b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha256:" + digest.encode(),
              b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(),
              b"Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [b"WARC-Refers-To: " + _uri(refers_to), b"WARC-Profile: " + PROFILE]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + _END + block + _END


def archive_members(pages: DataFrame, key: str, uri: str, payload: str, least: int = LEAST, date: str = DATE) -> DataFrame:
    """member: a gzip member for every row of pages."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    known = pages.select(F.col(key).alias("key"), F.octet_length(body).alias("size"), F.sha2(body, 256).alias("digest"))
    firsts = (known.filter(F.col("size") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
              .filter("n > 1 and first is not null").select("digest", "first"))
    rows = pages.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.col(uri).cast("string").alias("uri"),
                        body.alias("body"), F.sha2(body, 256).alias("digest"))

    def respond(batches):
        for batch in batches:
            made, sizes = [], []
            for name, target, content, digest in zip(*(c.to_pylist() for c in batch.columns[1:])):
                made.append(compressed(record_of(name, target, content, digest, date)))
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), batch.column(4), pa.array(made, pa.binary())],
                                             names=["key", "name", "uri", "size", "digest", "member"])

    def revisit(batches):
        for batch in batches:
            made = [member if first is None else compressed(record_of(name, target, b"", digest, date, refers_to=first, payload_bytes=size))
                    for name, target, size, digest, first, member in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])

    whole = rows.mapInArrow(respond, f"key {pages.schema[key].dataType.simpleString()}, name string, uri string, size long, digest string, member binary")
    again = F.col("first").isNotNull() & (F.col("size") >= least) & ~F.col("key").eqNullSafe(F.col("first"))
    return (whole.join(firsts, "digest", "left")
            .select("name", "uri", "size", "digest", F.when(again, F.col("first").cast("string")).alias("first"),
                    F.when(~again, F.col("member")).alias("member"))
            .mapInArrow(revisit, "member binary"))


def write_archives(pages: DataFrame, folder: str, key: str, uri: str = "url", payload: str = "html",
                   least: int = LEAST, date: str = DATE, file_records: int = FILE_RECORDS) -> None:
    """Write a record for every row of pages to files of a new folder."""
    (archive_members(pages, key, uri, payload, least, date).select(F.col("member").cast("string").alias("value"))
     .write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", file_records).text(folder))


def _digest_holds(labelled: str | None, content: bytes) -> bool:
    """Whether a digest header fits the content; one of an algorithm unknown here is taken as it is."""
    algorithm, _, value = (labelled or "").partition(":")
    if algorithm.lower() not in ("sha1", "sha256", "sha512", "md5"):
        return True
    digest = hashlib.new(algorithm.lower(), content).digest()
    return value.lower() == digest.hex() or value.rstrip("=").upper() == base64.b32encode(digest).decode().rstrip("=")


def _headers(lines: list[bytes]) -> dict[str, str] | None:
    """Lower-cased names and values, or None where a line is no header."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        left, colon, right = line.partition(b":")
        if not colon or not left.strip():
            return None
        name = left.strip().decode("utf-8", "replace").lower()
        out[name] = right.strip().decode("utf-8", "replace")
    return out


def _key(uri: str | None) -> str | None:
    bare = (uri or "").removeprefix("<").removesuffix(">")
    if bare.startswith(KEY_URI):
        bare = urllib.parse.unquote(bare[len(KEY_URI):])
    return bare or None


def _record(data: bytes, at: int) -> tuple[int, dict[str, Any]] | str:
    """The record that starts at a place, with where it ends; or why there is none."""
    line = _VERSION_LINE.match(data, at)
    if line is None:
        return "no version line"
    head = data.find(_END, line.end(), at + HEAD_BYTES)
    fields = None if head < 0 else _headers(data[line.end():head].split(b"\r\n"))
    if fields is None:
        return "no whole header"
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        return "no content length"
    begin, end = head + 4, head + 4 + int(fields["content-length"])
    if data[end:end + 4] != _END:
        return "record cut or of another length"
    block = data[begin:end]
    if not _digest_holds(fields.get("warc-block-digest"), block):
        return "block digest differs"
    kind, payload, told = fields.get("warc-type", ""), block, None
    if fields.get("content-type", "").lower().startswith("application/http"):
        split = block.find(_END)
        if split >= 0:
            payload = block[split + 4:]
            told = (_headers(block[:split].split(b"\r\n")[1:]) or {}).get("content-length")
    digest = fields.get("warc-payload-digest")
    if kind == "revisit":
        size = int(told) if told and re.fullmatch(r"[0-9]{1,18}", told) else None
        named = digest.partition(":")[2].lower() if digest and digest.lower().startswith("sha256:") else None
    else:
        if not _digest_holds(digest, payload):
            return "payload digest differs"
        size, named = len(payload), hashlib.sha256(payload).hexdigest()
    refers = fields.get("warc-refers-to")
    return end + 4, {"record_type": kind, "key": _key(fields.get("warc-record-id")), "target": fields.get("warc-target-uri"),
                     "date": fields.get("warc-date"), "payload": None if kind == "revisit" else payload, "payload_bytes": size,
                     "payload_digest": named, "refers_to": _key(refers)}


def _member(data: memoryview, at: int, step: int = 1 << 16) -> tuple[int, bytes] | str:
    """The inflated gzip member that starts at a place, with where it ends; or why there is none."""
    packer, out = zlib.decompressobj(31), []
    try:
        for begin in range(at, len(data), step):
            piece = data[begin:begin + step]
            out.append(packer.decompress(piece))
            if packer.eof:
                return begin + len(piece) - len(packer.unused_data), b"".join(out)
    except zlib.error:
        return "damaged gzip member"
    return "cut gzip member"


def _plain(data: bytes, at: int) -> tuple[int, list[dict[str, Any]]] | str:
    found = _record(data, at)
    return found if isinstance(found, str) else (found[0], [found[1] | {"offset": at, "length": found[0] - at}])


def _unit(data: bytes, view: memoryview, at: int) -> tuple[int, list[dict[str, Any]]] | str:
    """What the member or the record that starts at a place holds, with where it ends; or why there is none."""
    if not data.startswith(_MAGIC, at):
        return _plain(data, at)
    member = _member(view, at)
    if isinstance(member, str):
        return member
    end, inflated = member
    inside = list(salvage(inflated, members=False))
    if inflated and all("gap" in r for r in inside):
        return f"member: {inside[0]['gap']}"
    return end, [r | {"offset": at, "length": end - at, "inner_offset": r["offset"], "inner_length": r["length"]} for r in inside]


def salvage(data: bytes, members: bool = True) -> Iterator[dict[str, Any]]:
    """Records and gaps of an archive in order. A gap holds the bytes between two places where checks pass, and why."""
    view, at = memoryview(data), 0
    read = (lambda place: _unit(data, view, place)) if members else (lambda place: _plain(data, place))
    while at < len(data):
        found = read(at)
        if isinstance(found, str):
            why, gap = found, at
            for candidate in _NEXT.finditer(data, at + 1):
                found = read(candidate.start())
                if not isinstance(found, str):
                    break
            at = len(data) if isinstance(found, str) else candidate.start()
            yield {"gap": why, "offset": gap, "length": at - gap}
            if isinstance(found, str):
                return
        at, rows = found
        yield from rows


FOUND = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("inner_offset", pa.int64()),
                   ("inner_length", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("key", pa.string()),
                   ("target", pa.string()), ("date", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("refers_to", pa.string())])


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all files below a folder, written here or elsewhere, gzipped or not.

    A row is a record, or, with a reason in `gap`, a range of bytes that was quarantined. offset and length are those of the
    file, inner_offset and inner_length those in an inflated member. Without `payloads` their column is null.
    """
    kinds = [f"{f.name} {str(f.type).replace('int64', 'long')}" for f in FOUND]

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for row in salvage(content.as_py()):
                    held += len(row.get("payload") or b"")
                    rows.append(row | {"path": path} | ({} if payloads else {"payload": None}))
                    if held > BATCH_BYTES or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=FOUND)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=FOUND)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInArrow(read, ", ".join(kinds))


def gaps(found: DataFrame) -> DataFrame:
    """The log of quarantined bytes: path, offset, length, inner_offset, inner_length and the reason."""
    return found.filter("gap is not null").select("path", "offset", "length", "inner_offset", "inner_length", F.col("gap").alias("reason"))


def restored(found: DataFrame) -> DataFrame:
    """Every record, revisits with the payload of the response they refer to (null where it was lost)."""
    records = found.filter("gap is null")
    sources = (records.filter("record_type = 'response'").dropDuplicates(["key", "payload_digest"])
               .select(F.col("key").alias("refers_to"), "payload_digest", F.col("payload").alias("source")))
    again = records.filter("record_type = 'revisit'").join(sources, ["refers_to", "payload_digest"], "left")
    return records.filter("record_type <> 'revisit'").unionByName(again.withColumn("payload", F.col("source")).drop("source"))
