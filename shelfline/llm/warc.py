"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The writer makes one record per page, one gzip member per record, in files of
bounded size.  Tasks give their files unique names and list them in a manifest
table; only files of tasks that succeeded are listed, so retried and speculative
tasks leave nothing behind that a reader would see.

The reader streams each file, and the inflated bytes of each gzip member.  A
record that fails a check (version line, header, length, closing line ends, block
and payload digest) is not trusted: the reader searches for the next gzip member
or version line at which a whole valid record begins, goes on from there, and logs
the bytes between as a quarantined gap with the reason; within a member the search
is in the inflated bytes, and the gap has their offsets.  A member whose inflation
or checksum fails keeps the records that their block digest proves, a truncated
one all that pass; the last record of one that breaks off counts only if bytes
follow it.  Plain and gzipped files may be mixed.  A task holds one record in memory.

Nulls and odd rows: a null payload is written as an empty one; a null url leaves
out the target; a null page_id is written as an empty id and read back as null;
repeated pages give one record each (copies of the largest page_id are all
responses); an empty table gives no file; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.session import scratch_path, stored

#: Smallest payload that is worth a revisit record, and bytes after which a file is closed.
REVISIT_BYTES = 1000
FILE_BYTES = 32 << 20

ID = "urn:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_CHUNK = 1 << 18
_FEED = 1 << 14
_AT_ONCE = 16 << 20
_MOST_HEADER = 1 << 20


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit holds the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID}{name}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: {_sha1(block)}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%:/?#[]@!$&'()*+,;=-._~"))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame) -> DataFrame:
    """Pages with digest, record type and the page each revisit refers to.

    Groups of equal payloads are found from (digest, length) alone; the pages then
    join the groups of two or more, which Spark can split where one is large.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    named = named.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    groups = (
        named.where(F.col("bytes") >= REVISIT_BYTES)
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 AND largest IS NOT NULL")
        .select("digest", "bytes", "largest")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return named.join(groups, ["digest", "bytes"], "left").withColumn("refers_to", refers).drop("largest", "bytes")


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes archives below ``folder`` and returns their manifest (path, records, bytes)."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, done, count, size, path = None, [], 0, 0, ""
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{base}/pages-{uuid.uuid4().hex}.warc.gz"
                    out, count, size = store.open_output_stream(path, compression=None), 0, 0
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                raw = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["refers_to"] is not None, date)
                member = pack.compress(raw) + pack.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "bytes"])

    rows = with_revisits(pages).select("page_id", "url", "payload", "digest", "refers_to")
    found = rows.mapInArrow(save, "path string, records long, bytes long")
    return stored(found, "warc-manifest")


class Damaged(ValueError):
    """A failed check; its text is the reason in the log."""


class _File:
    """Reads of any range of one file, in chunks."""

    begins = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")

    def __init__(self, source, size: int) -> None:
        self.source, self.size, self.at, self.held = source, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at or at + n > self.at + len(self.held):
            self.source.seek(at)
            self.at, self.held = at, self.source.read(max(n, _CHUNK))
        return self.held[at - self.at : at - self.at + n]

    def mark(self) -> None:
        """Reads go on from here, or from later places."""


_CUT, _CHECKSUM, _INFLATION = "member beyond the end of the file", "checksum", "inflation"


class _Inflated:
    """The inflated bytes of the gzip member at ``begin``, as far as they go, read like a file.

    A first pass finds their number, the member's end and what failed; reads then
    inflate again, forward, and backward from the last mark.
    """

    begins = _VERSION

    def __init__(self, file: _File, begin: int) -> None:
        self.file, self.begin, self.failure, self.size = file, begin, None, 0
        self._rewind()
        while (data := self._more()) is not None:
            self.size += len(data)
        self.end = self.place
        self._rewind()

    def _rewind(self) -> None:
        self.at, self.held, self.pack, self.place, self.over, self.marked = 0, bytearray(), zlib.decompressobj(31), self.begin, False, None

    def _more(self) -> bytes | None:
        """The next inflated bytes; none after the member's end or a failure."""
        if self.over:
            return None
        data = self.file.read(self.place, min(_FEED, self.file.size - self.place))
        if not data:
            self.failure, self.over = _CUT, True
            return None
        before = self.pack.copy()
        try:
            out = self.pack.decompress(data)
        except zlib.error as error:
            out, self.over = bytearray(), True
            self.failure = _CHECKSUM if re.search("incorrect (data|length) check", str(error)) else _INFLATION
            try:
                for i in range(len(data)):
                    out += before.decompress(data[i : i + 1])
            except zlib.error:
                pass
            return bytes(out)
        self.place += len(data) - len(self.pack.unused_data)
        self.over = self.pack.eof
        return out

    def mark(self) -> None:
        self.marked = (self.at, bytes(self.held), None if self.over else self.pack.copy(), self.place, self.over)

    def read(self, at: int, n: int) -> bytes:
        if at < self.at:
            if self.marked and self.marked[0] <= at:
                self.at, held, pack, self.place, self.over = self.marked
                self.held, self.pack = bytearray(held), pack and pack.copy()
            else:
                self._rewind()
        while True:
            drop = min(at - self.at, len(self.held))
            del self.held[:drop]
            self.at += drop
            if at + n <= self.at + len(self.held) or (data := self._more()) is None:
                return bytes(self.held[at - self.at : at - self.at + n])
            self.held += data

    def trust(self, record: dict, end: int) -> None:
        """Fails for a record that a damaged member does not prove."""
        if self.failure in (_CUT, _INFLATION) and end == self.size:
            raise Damaged(self.failure)
        if self.failure in (_CHECKSUM, _INFLATION) and not record["proven"]:
            raise Damaged(f"{self.failure}, and no block digest")


def _head(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields (lower-case names) and the block's place in a record's bytes."""
    if not _VERSION.match(data):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("header without end")
    fields: dict[str, str] = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or re.search(rb"[\x00-\x08\x0a-\x1f]", line):
            raise Damaged("malformed header line")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", ""), re.ASCII):
        raise Damaged("no content length")
    if not {"warc-type", "warc-record-id", "warc-date"} <= fields.keys():
        raise Damaged("a mandatory field is missing")
    return fields, end + 4


def _checked(fields: dict[str, str], block: bytes) -> dict:
    """A parsed record, its digests held against its bytes."""
    kind = fields.get("warc-type", "")
    http, payload, told = {}, block, None
    if fields.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = dict(x.decode("utf-8", "replace").lower().split(": ", 1) for x in top.split(b"\r\n")[1:] if b": " in x)
        told = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    stated = fields.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated != _sha1(block):
        raise Damaged("block digest")
    digest = fields.get("warc-payload-digest", "")
    if kind != "revisit":
        actual = _sha1(payload)
        if digest.startswith("sha1:") and digest != actual:
            raise Damaged("payload digest")
        digest, told = actual, len(payload)
    elif digest.startswith("sha1:") and not re.fullmatch("sha1:[A-Z2-7]{32}", digest):
        raise Damaged("payload digest")
    proven = stated.startswith("sha1:")
    return {"proven": proven, "type": kind, "fields": fields, "payload": None if kind == "revisit" else payload, "bytes": told, "digest": digest}


def _plain(file: _File | _Inflated, at: int) -> tuple[dict, int]:
    """The record at ``at`` of uncompressed bytes, and where it ends."""
    n = 1 << 13
    while b"\r\n\r\n" not in (data := file.read(at, min(n, file.size - at))) and n < min(_MOST_HEADER, file.size - at):
        n *= 4
    fields, begin = _head(data)
    end = at + begin + int(fields["content-length"])
    if end + 4 > file.size:
        raise Damaged("record beyond the end of the file")
    if end + 4 - at <= _AT_ONCE:
        file.read(at, end + 4 - at)
    if file.read(end, 4) != b"\r\n\r\n":
        raise Damaged("no line ends after the block")
    return _checked(fields, file.read(at + begin, end - at - begin)), end + 4


def _inside(inner: _Inflated) -> Iterator[dict]:
    """Records and gaps of a member, with their places in its inflated bytes."""
    at, told = 0, inner.failure is None
    while at < inner.size:
        inner.read(at, 1)
        inner.mark()
        try:
            found, end = _record_at(inner, at)
        except Damaged as damage:
            end, reason = _next_valid(inner, at + 1), str(damage)
            if end == inner.size and inner.failure:
                told, reason = True, inner.failure
            yield {"kind": "gap", "inflated_start": at, "inflated_end": end, "reason": reason}
        else:
            yield {"kind": "record", "inflated_start": at, "inflated_end": end} | found
        at = end
    if not told:
        yield {"kind": "gap", "inflated_start": at, "inflated_end": at, "reason": inner.failure}


def _member(file: _File, at: int) -> tuple[_Inflated, Iterator[dict]]:
    """The gzip member at ``at`` and what is in it; fails if no record is."""
    inner = _Inflated(file, at)
    items, lead = _inside(inner), []
    for x in items:
        lead.append(x)
        if x["kind"] == "record":
            return inner, chain(lead, items)
    raise Damaged(inner.failure or (lead[0]["reason"] if lead else "empty member"))


def _record_at(inner: _Inflated, at: int) -> tuple[dict, int]:
    found, end = _plain(inner, at)
    inner.trust(found, end)
    return found, end


def _check_at(file: _File | _Inflated, at: int) -> None:
    """Fails if no valid record begins at ``at``, or in the member there."""
    if isinstance(file, _Inflated):
        _record_at(file, at)
    elif file.read(at, 3) == _MAGIC:
        _member(file, at)
    else:
        _plain(file, at)


def _next_valid(file: _File | _Inflated, at: int) -> int:
    """The first place from ``at`` on where a member or version line begins a valid record, or the bytes' end."""
    while at < file.size:
        data = file.read(at, min(_CHUNK, file.size - at))
        file.mark()
        for m in file.begins.finditer(data):
            try:
                _check_at(file, at + m.start())
            except Damaged:
                continue
            return at + m.start()
        at += max(1, len(data) - 9)
        if len(data) < 10:
            break
    return file.size


def salvaged(source, size: int) -> Iterator[dict]:
    """Records and gaps of a seekable file, in order; each has kind, start and end.

    Those of a gzip member have its start and end (if it is damaged, up to where
    the reader goes on) and their places in its inflated bytes.
    """
    file, at = _File(source, size), 0
    while at < size:
        try:
            if file.read(at, 3) == _MAGIC:
                inner, items = _member(file, at)
                end = _next_valid(file, at + 1) if inner.failure else inner.end
            else:
                found, end = _plain(file, at)
                items = [{"kind": "record"} | found]
        except Damaged as damage:
            end = _next_valid(file, at + 1)
            items = [{"kind": "gap", "reason": str(damage)}]
        for x in items:
            yield {"start": at, "end": end} | x
        at = end


SCHEMA = (
    "path string, kind string, start long, end long, reason string, record_type string, record_id string, target string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary, inflated_start long, inflated_end long"
)
_ARROW = pa.schema(
    [(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in SCHEMA.split(", "))]
)


def read(spark: SparkSession, paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of the archives in column ``path``; digests in lower-case hex."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                held, size = [], 0
                with store.open_input_file(name) as source:
                    for x in salvaged(source, source.size()):
                        fields = x.get("fields", {})
                        digest = x.get("digest", "").removeprefix("sha1:")
                        body = x.get("payload") if payloads else None
                        held.append(
                            {
                                "path": path, "kind": x["kind"], "start": x["start"], "end": x["end"], "reason": x.get("reason"),
                                "record_type": x.get("type"), "record_id": fields.get("warc-record-id"), "target": fields.get("warc-target-uri"),
                                "refers_to": fields.get("warc-refers-to"), "payload_bytes": x.get("bytes"),
                                "payload_digest": base64.b32decode(digest).hex() if digest else None, "payload": body,
                                "inflated_start": x.get("inflated_start"), "inflated_end": x.get("inflated_end"),
                            }
                        )
                        size += len(body or b"") + 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, _ARROW)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").repartition(tasks, "path").mapInArrow(scan, SCHEMA)


def page_records(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back: one row per page."""
    manifest = write(pages, scratch_path(spark, "warc"))
    found = read(spark, manifest, payloads=False).where("kind = 'record'")
    number = lambda name: F.regexp_extract(name, f"<{ID}(-?[0-9]+)>", 1).try_cast("long")
    return found.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
