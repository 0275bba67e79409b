"""WARC archives: writing, and reading back with a salvage reader.

Archives hold one gzip member for each record. The reader checks each member (gzip checksum, version
line, header, length, digests). After a failed check it searches the bytes behind for the next valid
member, or in unpacked archives for the next version line, goes on from there and logs the bytes
between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .places import ShardReader, placed, write_shards
from .shared import attempt_name, discard, materialise, open_input, open_output, scratch, shuffle_partitions

VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that are read from an archive at once.
BLOCK = 1 << 20
#: Unpacked bytes of the largest record that a reader accepts unless told otherwise.
LARGEST = 1 << 31


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


@dataclass
class Record:
    """A record's named fields, its block, and where its member lies in the archive."""

    fields: dict[str, str]
    block: bytes
    begin: int = 0
    end: int = 0

    @property
    def kind(self) -> str:
        return self.fields.get("warc-type", "")

    def http(self) -> tuple[dict[str, str], bytes]:
        """Header fields and payload of an application/http block."""
        head, _, payload = self.block.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


@dataclass(frozen=True)
class Gap:
    """Bytes from ``begin`` up to ``end`` that hold no valid record, and the check that failed first."""

    begin: int
    end: int
    reason: str


class BadRecord(ValueError):
    pass


def clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record_bytes(fields: dict[str, str], block: bytes, pack: bool = True) -> bytes:
    """One record, as a gzip member of its own if ``pack``."""
    fields = fields | {"WARC-Block-Digest": "sha1:" + payload_digest(block), "Content-Length": str(len(block))}
    head = VERSION + b"\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields.items()).encode("utf-8", "replace")
    raw = head + b"\r\n" + block + b"\r\n\r\n"
    if not pack:
        return raw
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


@dataclass(frozen=True)
class Head:
    """A record's fields, and where its block begins and ends."""

    fields: dict[str, str]
    begin: int
    end: int


def parse_head(raw: bytes | bytearray, at: int = 0) -> Head:
    """The head of the record that begins at ``at``; BadRecord if a check fails, and IndexError if the bytes end too early."""
    if not raw.startswith(b"WARC/1.", at):
        if b"WARC/1.".startswith(bytes(raw[at : at + 7])):
            raise IndexError("version line")
        raise BadRecord("no version line")
    head_end = raw.find(b"\r\n\r\n", at, at + BLOCK + 4)
    if head_end < 0:
        if len(raw) - at > BLOCK:
            raise BadRecord("header without end")
        raise IndexError("header")
    fields = {}
    for line in bytes(raw[at:head_end]).decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadRecord("header line without colon")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdecimal()):
        raise BadRecord("no content length")
    return Head(fields, head_end + 4, head_end + 4 + int(length))


def parse_block(raw: bytes | bytearray, head: Head) -> Record:
    """The record whose head was read from ``raw``; all its bytes must be there."""
    if raw[head.end : head.end + 4] != b"\r\n\r\n":
        raise BadRecord("no end of record where the length puts it")
    block = bytes(memoryview(raw)[head.begin : head.end])
    said = head.fields.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != payload_digest(block):
        raise BadRecord("block digest differs")
    return Record(head.fields, block)


def parse_record(raw: bytes, at: int = 0) -> tuple[Record, int]:
    """The record that begins at ``at`` and the place behind it; errors as ``parse_head`` has them."""
    head = parse_head(raw, at)
    if len(raw) < head.end + 4:
        raise IndexError("block")
    return parse_block(raw, head), head.end + 4


class _Window:
    """A file's bytes from ``base`` on; ``at`` is the place in them up to which all is done.

    Bytes are appended to one buffer, whose done part is cut off when it has grown as large as the rest,
    so that each byte is moved a bounded number of times.
    """

    def __init__(self, file):
        self.file, self.base, self.data, self.at, self.over = file, 0, bytearray(), 0, False

    @property
    def place(self) -> int:
        return self.base + self.at

    def left(self) -> int:
        return len(self.data) - self.at

    def more(self) -> bool:
        if self.at >= BLOCK and 2 * self.at >= len(self.data):
            del self.data[: self.at]
            self.base, self.at = self.base + self.at, 0
        part = self.file.read(BLOCK)
        self.data += part
        self.over = not part
        return bool(part)


@dataclass
class SalvageReader:
    """Records of one archive, in order; ``gaps`` holds what was passed over.

    Memory holds the record at hand, packed and unpacked, and a block. ``largest`` bounds a record's
    unpacked bytes: what says or proves to be larger, a damaged length or a decompression bomb, is
    quarantined. A damaged length of an unpacked record below it can make the reader hold that many bytes
    before it salvages the records among them.
    """

    file: object
    largest: int = LARGEST
    gaps: list[Gap] = field(default_factory=list)

    def __iter__(self) -> Iterator[Record]:
        window = _Window(self.file)
        bad_from: int | None = None
        reason = ""
        while True:
            while window.left() < 8 and not window.over:
                window.more()
            if not window.left():
                break
            try:
                record, size = self._member(window)
            except BadRecord as error:
                if bad_from is None:
                    bad_from, reason = window.place, str(error)
                self._seek(window)
                continue
            if bad_from is not None:
                self.gaps.append(Gap(bad_from, window.place, reason))
                bad_from = None
            record.begin, record.end = window.place, window.place + size
            window.at += size
            yield record
        if bad_from is not None:
            self.gaps.append(Gap(bad_from, window.place, reason))

    def _member(self, window: _Window, step: int = 1 << 14) -> tuple[Record, int]:
        """The record at the window's place and how many bytes it takes there."""
        if window.data.startswith(GZIP, window.at):
            unpack, out, fed = zlib.decompressobj(31), [], 0
            room = self.largest
            while not unpack.eof:
                if fed == window.left() and not window.more():
                    raise BadRecord("member without end")
                part = bytes(window.data[window.at + fed : window.at + fed + step])
                fed += len(part)
                try:
                    while part and not unpack.eof:
                        out.append(unpack.decompress(part, room + 1))
                        room -= len(out[-1])
                        if room < 0:
                            raise BadRecord("member too large")
                        part = unpack.unconsumed_tail
                except zlib.error as error:
                    raise BadRecord(f"gzip: {error}") from error
            raw = b"".join(out)
            try:
                record, end = parse_record(raw)
            except IndexError as error:
                raise BadRecord(f"member ends in the {error}") from error
            if end != len(raw):
                raise BadRecord("member holds more than its record")
            return record, fed - len(unpack.unused_data)
        return self._unpacked(window)

    def _unpacked(self, window: _Window) -> tuple[Record, int]:
        """The unpacked record at the window's place. Its head is read once; its bytes come in blocks."""
        while True:
            try:
                head = parse_head(window.data, window.at)
                break
            except IndexError as error:
                if not window.more():
                    raise BadRecord(f"archive ends in the {error}") from error
        size = head.end + 4 - window.at
        if size > self.largest:
            raise BadRecord("record too large")
        begin = head.begin - window.at
        while window.left() < size:
            if not window.more():
                raise BadRecord("archive ends in the block")
        return parse_block(window.data, Head(head.fields, window.at + begin, window.at + size - 4)), size

    def _seek(self, window: _Window) -> None:
        """Go on to the next possible member or version line, or to the end."""
        window.at += 1
        while True:
            found = [x for x in (window.data.find(GZIP, window.at), window.data.find(b"WARC/1.", window.at)) if x >= 0]
            if found:
                window.at = min(found)
                return
            # The last bytes may be the start of a mark that goes on in the next block.
            window.at = max(window.at, len(window.data) - 6)
            if not window.more():
                window.at = len(window.data)
                return


def page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    text = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdecimal() else None


def response_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or a revisit that names the page which has it.

    A revisit's block is the HTTP header alone, which still states the payload's length.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    fields = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": page_uri(page_id), "WARC-Target-URI": url or "about:blank", "WARC-Date": date,
        "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": page_uri(refers_to)}
    return record_bytes(fields, http if revisit else http + payload)


@dataclass(frozen=True)
class ArchiveSet:
    """The committed manifest of written archives: (path, records, bytes)."""

    manifest: DataFrame


def write_archives(pages: DataFrame, folder: str | None = None, least_revisit: int = 0) -> ArchiveSet:
    """One record for each row of (page_id, url, html), payload the html in UTF-8 (null: empty).

    Of rows with equal payloads of at least ``least_revisit`` bytes, that with the largest page_id (nulls
    last) is written as response and the others as revisits to it; rows that repeat this page_id are
    responses too. Null page_ids and urls are written as such, payloads of any length whole; other
    columns, whatever their names, are ignored; an empty table gives no archive. Each task writes an
    archive of its own; the manifest lists those of tasks that ended well.

    Pages are read twice, for digests and to be written, and never shuffled: digests and the places of
    revisits are.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    found = placed(pages)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    names = found.rows.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(F.encode(html, "utf-8"))).alias("sha"), F.col(f"`{found.file}`").alias("file"), F.col(f"`{found.row}`").alias("row"))
    # Tables, so that both sides of the join are shuffled for it and a payload that many pages share is split.
    digested, digested_uri = materialise(names, "page-digests")
    keepers, keepers_uri = materialise(digested.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("sha", "keeper"), "keepers")
    shards = write_shards(digested.join(keepers.hint("merge"), "sha").where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select("file", "row", F.col("keeper").alias("value")), "revisits")
    discard(spark, digested_uri)
    discard(spark, keepers_uri)

    def write(batches):
        reader, out, path, records = ShardReader(shards), None, "", 0
        for batch in batches:
            again, keeper = reader.find(batch.column(3).to_numpy(), batch.column(4).to_numpy())
            for page_id, url, payload, revisit, keeps in zip(*(c.to_pylist() for c in batch.columns[:3]), again.tolist(), keeper.tolist(), strict=True):
                if out is None:
                    path = f"{folder}/{attempt_name('archive')}.warc.gz"
                    out = open_output(path)
                    out.write(record_bytes({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:info:archive>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                revisit = revisit and len(payload) >= least_revisit
                out.write(response_record(page_id, url, payload, payload_digest(payload), keeps, revisit))
                records += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": records, "bytes": size}], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    rows = found.rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(html, "utf-8").alias("payload"), F.col(f"`{found.file}`").alias("file"), F.col(f"`{found.row}`").alias("row"))
    manifest, _ = materialise(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")
    return ArchiveSet(manifest)


PAGE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, gap_begin long, gap_end long, gap_reason string"


def read_archives(archives: ArchiveSet) -> DataFrame:
    """Rows of all records and of all gaps (those have a gap_begin), one archive to a task.

    A response whose payload doesn't match its payload digest is quarantined like any failed check.
    """
    spark = archives.manifest.sparkSession
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in PAGE_SCHEMA.split(", ")]

    def rows(path: str) -> Iterator[tuple]:
        with open_input(path) as file:
            reader = SalvageReader(file)
            for record in reader:
                if record.kind not in ("response", "revisit"):
                    continue
                head, payload = record.http()
                said = record.fields.get("warc-payload-digest", "").removeprefix("sha1:")
                if record.kind == "response":
                    size, digest = len(payload), payload_digest(payload)
                    if digest != said:
                        reader.gaps.append(Gap(record.begin, record.end, "payload digest differs"))
                        continue
                else:
                    size, digest = int(head.get("content-length", 0)), said
                yield (page_of(record.fields.get("warc-record-id")), size, digest, record.kind, page_of(record.fields.get("warc-refers-to")), path, None, None, None)
            for gap in reader.gaps:
                yield (None, None, None, None, None, path, gap.begin, gap.end, gap.reason)

    def batch_of(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    part.append(row)
                    if len(part) == 10_000:
                        yield batch_of(part)
                        part = []
        if part:
            yield batch_of(part)

    return archives.manifest.select("path").repartition(shuffle_partitions(spark)).mapInArrow(read, PAGE_SCHEMA)


def roundtrip(pages: DataFrame) -> DataFrame:
    """Per page, read back from written archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Fails if a gap was found, as these archives were written whole. Nulls, empty and long payloads, ties
    and repeated rows are as in ``write_archives``; an empty table gives an empty result.
    """
    archives = write_archives(pages, least_revisit=0)
    found = read_archives(archives)
    whole = F.when(F.col("gap_begin").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat(F.lit("damaged archive "), F.col("path"), F.lit(": "), F.col("gap_reason"))).cast("long"))
    return found.select(whole.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
