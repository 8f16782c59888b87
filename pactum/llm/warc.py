"""WARC archives: a writer with revisit records, and a salvage reader.

The reader checks every gzip member or plain record.  After a failed check it searches for the next
valid gzip member or version line, goes on from there, and reports the bytes between as a gap.  The same
search runs inside a member that holds several records, and in what a damaged member still gives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm.storage import broadcast_if_small

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/"
VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
#: An empty gzip member; its last eight bytes, all zero, are the row separator of the written files.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003") + b"\x03\x00" + b"\0" * 8
ID = "<urn:pactum:record:{}>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(text: str) -> str:
    """A header value: control characters are percent-encoded, so that no value can break its line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def record_bytes(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of ``refers_to`` without."""
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {_field(url)}")
    fields.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block = http + payload
    else:
        block = http
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    fields += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    records_per_file: int = 20_000,
    max_broadcast_rows: int = 200_000,
) -> None:
    """Write a gzip-compressed WARC record for each row to files under ``path``.

    The payload is the text in UTF-8, empty for null.  Of rows with equal payloads of at least
    ``min_bytes`` bytes, that with the smallest id is a response and the others are revisits of it;
    smaller payloads are all responses.  Rows that repeat the smallest id are responses too; a null id
    revisits if another row of its payload has an id.  Each record is a gzip member of its own,
    followed by an empty member.

    The files go through Spark's text writer, which writes a string's bytes as they are, so any file
    system that Spark can write works.  Only digests are grouped, never payloads.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload")))
    repeated = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    joined = rows.join(broadcast_if_small(repeated, max_broadcast_rows), "digest", "left")
    source = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for own, url, first, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = record_bytes(ID.format(own), url, text.encode(), None if first is None else ID.format(first))
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.append(squeeze.compress(raw) + squeeze.flush() + EMPTY_MEMBER[:-8])
                held += len(out[-1])
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    members = joined.select(F.col("id").cast("string"), "url", source.cast("string").alias("first"), "payload").mapInArrow(encode, "record binary")
    text = members.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", "\0" * 8).option("maxRecordsPerFile", records_per_file).text(path)


class _Headers:
    """Where the deflated bytes of gzip members start, names of any length included.

    Zeros are searched once, and a start at which inflating failed is not tried again for another header
    before it, so that junk is told in linear time.
    """

    def __init__(self, content: bytes) -> None:
        self.content, self.zero_from, self.zero = content, 0, -1
        self.failed: set[int] = set()

    def _after_zero(self, at: int) -> int:
        """The position after the next zero byte, or 0."""
        if not self.zero_from <= at <= self.zero:
            found = self.content.find(0, at)
            self.zero_from, self.zero = at, len(self.content) if found < 0 else found
        return self.zero + 1 if self.zero < len(self.content) else 0

    def start(self, at: int) -> int:
        """Where the deflated bytes behind the header at ``at`` start, or 0 if no member can stand there."""
        content = self.content
        if len(content) < at + 10 or content[at + 3] & 0xE0:
            return 0
        flags, at = content[at + 3], at + 10
        if flags & 4:
            at += 2 + int.from_bytes(content[at : at + 2], "little")
        for flag in (8, 16):
            if flags & flag:
                at = self._after_zero(at)
                if not at:
                    return 0
        # A checksum of the header is passed over: that of the content decides.
        at += flags & 2
        return 0 if at >= len(content) or at in self.failed else at


def _inflate(content: memoryview, at: int, headers: _Headers) -> tuple[bytes, int, bool]:
    """(bytes, end, whole) of the gzip member at ``at``; of a damaged or cut one, what comes before the damage."""
    start = headers.start(at)
    if not start:
        return b"", at, False
    raw, end, whole = _inflated(content, start)
    sums = zlib.crc32(raw).to_bytes(4, "little") + (len(raw) & 0xFFFFFFFF).to_bytes(4, "little")
    if whole and content[end : end + 8] == sums:
        return raw, end + 8, True
    headers.failed.add(start)
    return raw, end, False


def _inflated(content: memoryview, at: int) -> tuple[bytes, int, bool]:
    """(bytes, end, whole) of the deflated stream at ``at``."""
    squeeze, parts, end, step = zlib.decompressobj(-15), [], at, 1024
    while not squeeze.eof and end < len(content):
        before = squeeze.copy()
        try:
            parts.append(squeeze.decompress(content[end : end + step]))
            end = min(end + step, len(content))
            step = min(2 * step, 65536)
        except zlib.error:
            # An error takes the whole call's bytes along, so those before it come byte by byte.
            try:
                while True:
                    parts.append(before.decompress(content[end : end + 1]))
                    end += 1
            except zlib.error:
                return b"".join(parts), end, False
    return b"".join(parts), end - len(squeeze.unused_data), squeeze.eof


class _Failed:
    """A failed check: why, and where the record ends if its frame is whole."""

    def __init__(self, why: str, frame_end: int | None = None) -> None:
        self.why, self.frame_end = why, frame_end


def _header(raw: bytes, at: int) -> tuple[dict[str, str], int] | str:
    """(fields, start of the block) of the record at ``at``, or the failed check; folded lines are joined."""
    first = VERSION_LINE.match(raw, at)
    if not first:
        return "no version line"
    head: dict[str, str] = {}
    at, name = first.end(), ""
    while True:
        stop = raw.find(b"\r\n", at)
        if stop < 0:
            return "header has no end"
        if stop == at:
            return head, stop + 2
        line = raw[at:stop].decode("utf-8", "replace")
        at = stop + 2
        if line[0] in " \t" and name:
            head[name] = f"{head[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            return "header line without a colon"
        name = name.strip().lower()
        head[name] = value.strip()


def digest_fits(labelled: str | None, data: bytes) -> bool:
    """Whether ``algorithm:value`` is the digest of ``data``, in base 32 or hexadecimal; unknown algorithms pass."""
    name, _, value = (labelled or "").partition(":")
    if name.lower() not in ("sha1", "sha256", "sha512", "md5"):
        return True
    own = hashlib.new(name.lower(), data).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _record(raw: bytes, at: int) -> tuple[dict, int] | _Failed:
    """(fields, end) of the plain record at ``at``, or the failed check."""
    found = _header(raw, at)
    if isinstance(found, str):
        return _Failed(found)
    head, start = found
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return _Failed("no valid content length")
    end = start + int(length)
    if raw[end : end + 4] != b"\r\n\r\n":
        # Past the end of the bytes: what the header claims is cut.
        return _Failed("block does not end where its length says", len(raw) if end + 4 > len(raw) else None)
    whole = end + 4 if end + 4 == len(raw) or VERSION_LINE.match(raw, end + 4) or raw.startswith(MAGIC, end + 4) else None
    if "warc-type" not in head or "warc-record-id" not in head:
        return _Failed("no type or no record id", whole)
    block = raw[start:end]
    if not digest_fits(head.get("warc-block-digest"), block):
        return _Failed("block digest differs", whole)
    payload: bytes | None = block
    if head.get("content-type", "").startswith("application/http"):
        body = block.find(b"\r\n\r\n")
        if body < 0:
            return _Failed("HTTP header has no end", whole)
        payload = block[body + 4 :]
        sizes = [x.split(b":", 1)[1].strip() for x in block[:body].split(b"\r\n") if x.lower().startswith(b"content-length:")]
        head["payload-bytes"] = sizes[0].decode() if sizes and sizes[0].isdigit() else None
    if head["warc-type"] == "revisit":
        payload = None
    elif not digest_fits(head.get("warc-payload-digest"), payload):
        return _Failed("payload digest differs", whole)
    return {"head": head, "payload": payload}, end + 4


def _inner(raw: bytes, whole: bool) -> list[dict]:
    """The records and gaps of a member's inflated bytes, with ``from`` and ``to`` in them.

    After a failed check the search goes on behind a record whose frame is whole, as its payload may hold
    version lines of its own; else at the next version line.  Of a damaged member, bytes that the header of
    the last record claims beyond the damage are that record's.
    """
    out: list[dict] = []
    at, bad, why = 0, None, ""
    while at < len(raw):
        got = _record(raw, at)
        if isinstance(got, _Failed):
            if bad is None:
                bad, why = at, got.why
            frame = got.frame_end if got.frame_end is not None and (got.frame_end < len(raw) or not whole or "digest" in got.why) else None
            following = raw.find(VERSION, at + 1)
            at = frame if frame is not None else len(raw) if following < 0 else following
            continue
        if bad is not None:
            out.append({"reason": why, "from": bad, "to": at})
            bad = None
        out.append({**got[0], "from": at, "to": got[1]})
        at = got[1]
    if bad is not None:
        out.append({"reason": why, "from": bad, "to": len(raw)})
    return out


class _Marks:
    """The next gzip magic or version mark from a position on; each byte is searched once."""

    def __init__(self, content: bytes) -> None:
        self.content, self.next = content, {MAGIC: -1, VERSION: -1}

    def after(self, at: int) -> int:
        for mark, known in self.next.items():
            if known < at:
                found = self.content.find(mark, at)
                self.next[mark] = len(self.content) if found < 0 else found
        return min(self.next.values())


def salvage(content: bytes) -> Iterator[dict]:
    """The records of one archive and the gaps between them, in byte order.

    Gives ``{"at", "end", "head", "payload"}`` for a record and ``{"at", "end", "reason"}`` for a gap;
    every byte belongs to one of them or to an empty gzip member.  Records and gaps of one gzip member
    have the range of the member, and a gap's reason names its bytes in the inflated member.  What is
    inflated before a member's damage is searched too, but a record there must have a version line
    after it; the damaged member is a gap as well.
    """
    view, at, size = memoryview(content), 0, len(content)
    bad, reason, marks, headers = None, "", _Marks(content), _Headers(content)
    # Records of a damaged member, which may also stand uncompressed in its bytes.
    seen, seen_to = set(), 0
    while at < size:
        found: list[dict] = []
        end = None
        if content[at : at + 3] == MAGIC:
            raw, stop, whole = _inflate(view, at, headers)
            found, why = _inner(raw, whole), "gzip member is damaged"
            if not whole:
                # A record that no version line follows counts as damaged.
                found = [x for x in found if "head" in x and VERSION_LINE.match(raw, x["to"])]
            if whole:
                end = stop
                if found and all("reason" in x for x in found):
                    # A whole member without a record is part of the gap around it.
                    bad, reason = (at, found[0]["reason"]) if bad is None else (bad, reason)
                    at = end
                    continue
            elif found:
                if bad is not None:
                    yield {"at": bad, "end": at, "reason": reason}
                for x in found:
                    yield {"at": at, "end": stop, "head": x["head"], "payload": x["payload"]}
                    seen.add(_key(raw[x["from"] : x["to"]]))
                bad, reason, seen_to = at, f"{why} (inflated up to byte {len(raw)}, last record up to byte {found[-1]['to']})", max(stop, seen_to)
        elif content.startswith(VERSION, at):
            got = _record(content, at)
            if isinstance(got, _Failed):
                why = got.why
                if got.frame_end is not None and "digest" in why:
                    bad, reason = (at, why) if bad is None else (bad, reason)
                    at = got.frame_end
                    continue
            elif at < seen_to and bad is not None and _key(content[at : got[1]]) in seen:
                at = got[1]
                continue
            else:
                found, end = [got[0]], got[1]
        else:
            why = "neither a gzip member nor a version line"
        if end is None:
            if bad is None:
                bad, reason = at, why
            at = marks.after(at + 1)
            continue
        if bad is not None:
            yield {"at": bad, "end": at, "reason": reason}
            bad = None
        for x in found:
            if "reason" in x:
                yield {"at": at, "end": end, "reason": f"{x['reason']} (bytes {x['from']} to {x['to']} of the inflated member)"}
            else:
                yield {"at": at, "end": end, "head": x["head"], "payload": x["payload"]}
        at = end
    if bad is not None:
        yield {"at": bad, "end": size, "reason": reason}


def _key(record: bytes) -> bytes:
    return hashlib.sha1(record).digest()


SCHEMA = (
    "path string, start long, end long, status string, reason string, record_id string, warc_type string, target_uri string, "
    "payload_digest string, payload_bytes long, refers_to string, payload binary"
)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, files: str = "*") -> DataFrame:
    """Records and quarantined gaps of all archives under ``path`` (gzip members, plain records or both).

    A row per record (status ``record``) and per gap (status ``gap`` with its byte range and the check
    that failed first).  A revisit has no payload; its payload_bytes is the length that its HTTP header
    states.  A record with a missing optional field has null there.  An empty archive gives no rows.  A
    task holds one archive at a time, so archives should be at most a few hundred MB, as the writer's are.
    ``files`` is a pattern of file names; all files are read by default, but for names that start with _ or
    a dot.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(
            [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("status", pa.string()), ("reason", pa.string()), ("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for x in salvage(content.as_py()):
                    row = {"path": name.as_py(), "start": x["at"], "end": x["end"]}
                    if "reason" in x:
                        row |= {"status": "gap", "reason": x["reason"]}
                    else:
                        head, payload = x["head"], x["payload"]
                        length = len(payload) if payload is not None else head.get("payload-bytes")
                        digest = head.get("warc-payload-digest", "")
                        row |= {
                            "status": "record",
                            "record_id": head["warc-record-id"],
                            "warc_type": head["warc-type"],
                            "target_uri": head.get("warc-target-uri"),
                            "payload_digest": digest.removeprefix("sha1:") or None,
                            "payload_bytes": None if length is None else int(length),
                            "refers_to": head.get("warc-refers-to"),
                            "payload": payload if with_payload else None,
                        }
                        held += len(payload or b"") if with_payload else 0
                    rows.append(row)
                    if len(rows) >= 5000 or held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", files).load(path)
    return files.select("path", "content").mapInArrow(scan, SCHEMA)


def split_gaps(rows: DataFrame, log_path: str) -> tuple[DataFrame, int]:
    """(records, number of gaps) of rows of :func:`read_warc`; the gaps are logged as a table at ``log_path``.

    The log has path, start, end and reason of every quarantined range of bytes; with no gap it is empty.
    """
    rows.where("status = 'gap'").select("path", "start", "end", "reason").write.parquet(log_path)
    gaps = rows.sparkSession.read.schema("path string, start long, end long, reason string").parquet(log_path).count()
    return rows.where("status = 'record'"), gaps


def record_key(col: str, kind: str = "long") -> Column:
    """The id that :func:`write_warc` put into a record id; null for a null id."""
    key = F.regexp_extract(col, r"^<urn:pactum:record:(.*)>$", 1)
    return F.when(key.isin("", "None"), None).otherwise(key).cast(kind)
