"""Web archives: a WARC record for each page, written as gzip members and read back one after the other.

Writing: each task appends its pages to archives of bounded size in a shared folder, one gzip member for each record. Names are
new in every attempt and only a task that ends lists its archives, so a task that runs again leaves no record twice. Pages with equal payloads of
at least `revisit_bytes` are written once, as the response of the largest page id; the others become revisit records that refer
to it. Payloads are not shuffled unless the groups of equal ones are too many to broadcast.

Reading: a task reads an archive in pieces of fixed size and inflates them as they come. A record's header ends at the
first empty line, its block has Content-Length bytes, and two line ends and the end of the member must follow. Digests of
block and payload are computed on the way and compared with the header's. A record that is cut off, wrongly framed, no gzip or
differs from its digests gives a row that names the `problem`; reading goes on at the next member. Revisits are resolved by joining
them to the responses read.

Null pages are empty payloads; a null id is smaller than all others and is read back as null; null addresses are left out.
Rows of equal id and equal large payload are all responses, each written, with one record id. Blanks, control and non-ASCII
characters of addresses are percent-encoded. Payloads are written whole, whatever their length. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgauge.llm.shared import shared_folder, small_or_shuffled, stored

#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Payloads of fewer bytes are never revisited.
REVISIT_BYTES = 1000
#: Bytes read, and inflated, at once.
PIECE = 1 << 16
#: Most tasks that read archives; each reads several beyond that.
MOST_READERS = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = "archive string, records long, bytes long"
RECORDS = (
    "archive string, place long, record_type string, record_id string, refers_to_record string, uri string, "
    "page_id string, payload_digest string, payload_bytes long, problem string"
)


def _labelled(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _digest(label: str) -> str | None:
    """The lower-case hex form of a labelled SHA-1, in base 32 or hex; None if it is no such."""
    kind, _, value = label.partition(":")
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        return None
    return raw.hex() if kind.lower() == "sha1" and len(raw) == 20 else None


def record(
    kind: str, record_id: str, payload: bytes, page_id: str | None, uri: str | None, refers_to: str | None, date: str = DATE
) -> bytes:
    """One record of a page: a response with its payload, or a revisit with the response's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if uri is None else quote(uri, safe="".join(map(chr, range(0x21, 0x7F)))),
        "WARC-Refers-To": None if refers_to is None else f"<{refers_to}>",
        "WARC-Profile": PROFILE if kind == "revisit" else None,
        "WARC-Payload-Digest": _labelled(hashlib.sha1(payload).digest()),
        "WARC-Block-Digest": _labelled(hashlib.sha1(block).digest()),
        "X-Page-ID": None if page_id is None else quote(page_id, safe=""),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "".join(f"{name}: {value}\r\n" for name, value in fields.items() if value is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(Exception):
    """What is wrong with a record."""


class Members:
    """The gzip members of a stream, inflated piece by piece."""

    def __init__(self, stream):
        self.stream, self.raw, self.taken = stream, b"", 0
        self.inflater, self.buffer, self.start = None, bytearray(), 0

    def _read(self) -> bool:
        more = self.stream.read(PIECE)
        self.taken += len(more)
        self.raw += more
        return bool(more)

    def next(self) -> bool:
        """Go to the next member, over the rest of this one."""
        try:
            while self.inflater is not None and self._inflate():
                self.buffer.clear()
        except Damaged:
            self._skip()
        self.buffer.clear()
        if not self.raw and not self._read():
            return False
        self.start = self.taken - len(self.raw)
        self.inflater = zlib.decompressobj(31)
        return True

    def _skip(self) -> None:
        """After an error: go on where the next member seems to begin."""
        self.inflater, self.raw = None, self.raw[1:]
        while (at := self.raw.find(b"\x1f\x8b\x08")) < 0:
            self.raw = self.raw[-2:]
            if not self._read():
                self.raw = b""
                return
        self.raw = self.raw[at:]

    def _inflate(self) -> bool:
        """Inflate a piece; False at the end of the member."""
        while not self.inflater.eof:
            if not self.raw and not self._read():
                raise Damaged("cut off")
            try:
                made = self.inflater.decompress(self.raw, PIECE)
            except zlib.error:
                raise Damaged("no gzip") from None
            self.raw = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            if made:
                self.buffer += made
                return True
        return False

    def head(self) -> bytes:
        """What comes before the next empty line, which is passed over."""
        looked = 0
        while (at := self.buffer.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(self.buffer)
            if not self._inflate():
                raise Damaged("no end of the header")
        head = bytes(self.buffer[:at])
        del self.buffer[: at + 4]
        return head

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes."""
        while n:
            if not self.buffer and not self._inflate():
                raise Damaged("shorter than its length")
            piece = bytes(self.buffer[:n])
            del self.buffer[: len(piece)]
            n -= len(piece)
            yield piece

    def ends(self) -> bool:
        """Whether two line ends are all that is left of the member."""
        while len(self.buffer) <= 4 and self._inflate():
            pass
        return self.buffer == b"\r\n\r\n" and self.inflater.eof


def _fields(lines: list[str]) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


def _one(members: Members, with_payload: bool) -> dict:
    """The record of the member, its digests compared."""
    version, *lines = members.head().decode("utf-8", "replace").split("\r\n")
    fields = _fields(lines)
    if not version.startswith("WARC/") or not fields.get("content-length", "").isdecimal():
        raise Damaged("no WARC header")
    kind, is_http = fields.get("warc-type"), fields.get("content-type", "").startswith("application/http")
    block, payload, size, kept, head = hashlib.sha1(), hashlib.sha1(), 0, [], None if is_http else b""
    opening = bytearray()
    for piece in members.pieces(int(fields["content-length"])):
        block.update(piece)
        if head is None:  # the payload begins after the HTTP header's empty line
            opening += piece
            if (at := opening.find(b"\r\n\r\n")) < 0:
                continue
            head, piece = bytes(opening[:at]), bytes(opening[at + 4 :])
        payload.update(piece)
        size += len(piece)
        if with_payload:
            kept.append(piece)
    if not members.ends():
        raise Damaged("longer than its length")
    given = _digest(fields.get("warc-payload-digest", ""))
    found = {
        "record_type": kind,
        "record_id": fields.get("warc-record-id", "").strip("<>") or None,
        "refers_to_record": fields.get("warc-refers-to", "").strip("<>") or None,
        "uri": fields.get("warc-target-uri"),
        "page_id": unquote(fields["x-page-id"]) if "x-page-id" in fields else None,
        "payload_digest": payload.hexdigest(),
        "payload_bytes": size,
    }
    if "warc-block-digest" in fields and _digest(fields["warc-block-digest"]) != block.hexdigest():
        return found | {"problem": "block differs from its digest"}
    if kind == "revisit":  # the header tells of the payload that is left out
        length = _fields((head or b"").decode("utf-8", "replace").split("\r\n")).get("content-length", "")
        found |= {"payload_digest": given, "payload_bytes": int(length) if length.isdecimal() else None}
    elif "warc-payload-digest" in fields and given != found["payload_digest"]:
        return found | {"problem": "payload differs from its digest"}
    return found | ({"payload": b"".join(kept)} if with_payload and kind != "revisit" else {})


def records(stream, with_payload: bool = False) -> Iterator[dict]:
    """The records of one archive, in order; see RECORDS."""
    members = Members(stream)
    while True:
        if not members.next():
            return
        try:
            found = _one(members, with_payload)
        except Damaged as problem:
            found = {"problem": str(problem)}
        yield found | {"place": members.start}


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_archives(
    pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE
) -> DataFrame:
    """Write the pages (page_id, url, html) and return ARCHIVES, the list of the files written, as stored rows."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    large = F.octet_length("payload") >= revisit_bytes
    rows = rows.withColumn("key", F.when(large, F.sha2("payload", 256)))
    groups = rows.filter("key is not null").groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = stored(groups.filter("n > 1 and first is not null").drop("n"), "equal-pages")
    rows = rows.join(small_or_shuffled(groups, groups.count()), "key", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select(F.col("page_id").cast("string"), "url", "payload", "key", F.when(again, F.col("first").cast("string")).alias("first"))
    run = uuid.uuid4()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _place(folder)
        system.create_dir(path, recursive=True)
        name, out, n, size = "", None, 0, 0

        def listed() -> pa.RecordBatch:
            out.close()
            columns = [pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["archive", "records", "bytes"])

        for batch in batches:
            for page_id, url, payload, key, first in zip(*(batch.column(i) for i in range(5))):
                page_id, key, first, body = page_id.as_py(), key.as_py(), first.as_py(), payload.as_py()
                if out is None:
                    name, n, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                if key is None:  # small: nothing refers to it
                    number = uuid.uuid4()
                else:
                    number = uuid.uuid5(run, f"{page_id}:{key}")
                refers_to = None if first is None else uuid.uuid5(run, f"{first}:{key}").urn
                kind = "response" if first is None else "revisit"
                data = member(record(kind, number.urn, body, page_id, url.as_py(), refers_to, date))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    yield listed()
                    out = None
        if out is not None:
            yield listed()

    return stored(rows.mapInArrow(write, ARCHIVES), "archives")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """RECORDS of the archives in column `archive`, with their payloads if asked for. Each task reads whole archives."""
    schema = RECORDS + (", payload binary" if with_payload else "")
    kinds = {"place": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [field.split()[0] for field in schema.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in names], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = _place(archive)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for row in records(stream, with_payload):
                        rows.append(row | {"archive": archive})
                        held += len(row.get("payload") or b"")
                        if len(rows) >= 4096 or held >= 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    listed = archives.select("archive")
    return listed.repartition(min(MOST_READERS, max(1, listed.count()))).mapInArrow(read, schema)


def resolved(found: DataFrame) -> DataFrame:
    """The records with `refers_to`, the page of the response that a revisit refers to. A revisit whose response was
    not read, or has another payload, has a problem."""
    wanted = found.filter("record_type = 'revisit' and problem is null").select(F.col("refers_to_record").alias("record_id")).distinct()
    wanted = stored(wanted, "revisited")
    one = F.min(F.struct("page_id", "payload_digest", "payload_bytes")).alias("one")
    responses = found.filter("record_type = 'response' and problem is null")
    responses = responses.join(small_or_shuffled(wanted, wanted.count()), "record_id", "left_semi")
    responses = stored(responses.groupBy(F.col("record_id").alias("refers_to_record")).agg(one), "responses")
    rows = found.join(small_or_shuffled(responses, responses.count()), "refers_to_record", "left")
    same = (F.col("payload_digest") == F.col("one.payload_digest")) & (F.col("payload_bytes") == F.col("one.payload_bytes"))
    lost = (F.col("record_type") == "revisit") & ~F.coalesce(same, F.lit(False))
    problem = F.coalesce("problem", F.when(lost, "revisits no such response"))
    return rows.withColumn("problem", problem).withColumn("refers_to", F.col("one.page_id")).drop("one")


def page_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, archive, uri) of the pages, written to archives in
    the shared folder and read back. A record with a problem is an error."""
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/archives-{uuid.uuid4().hex}"
    found = stored(read_archives(write_archives(pages, folder, revisit_bytes, archive_bytes)), "records")
    found = resolved(found)
    kind = pages.schema["page_id"].dataType
    sound = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(
        F.raise_error(F.concat(F.col("archive"), F.lit(" at "), F.col("place"), F.lit(": "), F.col("problem"))).cast("string")
    )
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"), "archive", "uri",
    )
