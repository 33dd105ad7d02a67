"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

Writer: every row is one record in its own gzip member (or plain), in archives of up to ``max_bytes`` in a folder that all executors share. Of rows with
equal payloads of ``MIN_REVISIT`` bytes or more, the smallest id's is a ``response``, all others are ``revisit`` records that name it and hold no payload. A
table of archives (path, records, bytes) is the commit: an archive that a lost task left behind is in no table and never read.

Reader: one task per archive, in bounded memory. A record counts when its member inflates to its end with the right checksum, it starts with a version line, has a
length, ends with two line breaks, and fits its block and payload digests. After a failed check the reader looks for the next member or version line that holds a
valid record, goes on from there, and reports the bytes between as a gap with the reason of the failure. A failed try reads little more than it refutes, so
that magic bytes or version lines in a row cost linear time. A member holds records, no further members.

Nulls: a null payload is empty, a null URI is left out, a null id is written as such and comes last among equals. Rows that repeat an id and a payload and hold
the smallest id are responses all. Empty table: no archive. Payloads and URIs of any content and length; control characters in a URI are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.llm.common import Batches, batch_of, id_type, scratch_path, written

MIN_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 1 << 18
#: Bytes of a first look at a member, a header or the way to the next candidate.
LOOK_BYTES = 1 << 9
MAGIC = b"\x1f\x8b\x08"
# Flags in byte 3 of a gzip member's head, and the sizes of its fixed part and of its trailer.
HEAD_CRC, EXTRA, NAME, COMMENT, RESERVED = 2, 4, 8, 16, 0xE0
MEMBER_HEAD, TRAILER = 10, 8
VERSION = re.compile(rb"WARC/\d\.\d\r\n")
FIELD = re.compile(rb"[!-9;-~]+[ \t]*:|[ \t]")  # a name and its colon, or the continuation of the line before
CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
VERSION_BYTES = 10
PREFIX, NO_ID = "<urn:halocline:page:", "<urn:halocline:no-page>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """One record with its block digest and length."""
    head = {"WARC-Type": kind, "WARC-Date": DATE, **fields, "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}
    lines = [f"{name}: {value}" for name, value in head.items() if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def uri_of(key: object) -> str:
    return NO_ID if key is None else f"{PREFIX}{quote(str(key), safe='')}>"


def page_record(key: object, uri: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Record-ID": uri_of(key),
        "WARC-Target-URI": None if uri is None else re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), uri),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
    }
    if revisit:
        return record("revisit", fields | {"WARC-Refers-To": uri_of(refers_to), "WARC-Profile": PROFILE}, head)
    return record("response", fields, head + payload)


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    max_bytes: int = ARCHIVE_BYTES, compress: bool = True,
) -> DataFrame:
    """Write all rows below ``folder``, a path that executors can write; the table of archives."""
    kind = id_type(pages, id_col)
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{url_col}`").alias("u"), payload.alias("t"))
    rows = rows.withColumns({"sha": F.sha2("t", 256), "n": F.octet_length("t")})
    copies = rows.filter(F.col("n") >= MIN_REVISIT).groupBy("sha").agg(F.min("k").alias("first"), F.count("*").alias("n_rows"))
    copies, _ = written(copies.filter("n_rows > 1").select("sha", "first", F.lit(True).alias("copied")), "warc-copies")
    # A left join: the table of copies is broadcast where its files are small, else a payload that fills a third of the rows is split by AQE.
    planned = rows.join(copies, "sha", "left").select(
        "k", "u", "t", "sha", "first", (F.col("copied").isNotNull() & ~F.col("k").eqNullSafe(F.col("first"))).alias("revisit")
    )

    def write(batches: Batches) -> Batches:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, n, size = None, "", 0, 0

        def put(data: bytes) -> int:
            if compress:
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(data) + packer.flush()
            out.write(data)
            return len(data)

        def close() -> None:
            if out is not None:
                out.close()
                done.append((f"{folder.rstrip('/')}/{name}", n, size))

        for batch in batches:
            for k, u, t, sha, first, revisit in zip(*(batch.column(c).to_pylist() for c in ("k", "u", "t", "sha", "first", "revisit"))):
                if out is None or size >= max_bytes:
                    close()
                    name, n = f"{uuid.uuid4().hex}.warc{'.gz' if compress else ''}", 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                    size = put(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"},
                                      b"software: halocline\r\nformat: WARC File Format 1.1\r\n"))
                size += put(page_record(k, u, t, sha, first, revisit))
                n += 1
        close()
        if done:
            yield batch_of(**{c: pa.array(v, t) for (c, t), v in zip((("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())), zip(*done))})

    return written(planned.mapInArrow(write, "path string, records long, bytes long"), "warc-archives")[0]


class Found(NamedTuple):
    """A record, or a gap (``type`` null and ``reason`` given), at its bytes of the archive."""

    offset: int
    length: int
    reason: str | None = None
    type: str | None = None
    record_id: str | None = None
    target_uri: str | None = None
    refers_to: str | None = None
    payload_digest: str | None = None
    payload_bytes: int | None = None
    payload: bytes | None = None


class Broken(Exception):
    """A failed check; ``end`` is where a search may go on when the bytes up to there are known."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


class Bytes:
    """Random reads from bytes or an open file; short reads close to each other are served from one window."""

    def __init__(self, source):
        self.source = source
        self.size = len(source) if isinstance(source, bytes) else source.size()
        self.start, self.window = (0, source) if isinstance(source, bytes) else (0, b"")
        self.zero_known, self.refuted = (0, -1), (-1, "")

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.start or at + n > self.start + len(self.window):
            self.source.seek(at)
            if n >= READ_BYTES:
                return self.source.read(n)
            self.start, self.window = at, self.source.read(READ_BYTES)
        return self.window[at - self.start : at - self.start + n]

    def zero(self, at: int) -> int:
        """The place of the first zero byte from ``at`` on, or the size; kept for the places in between."""
        if at >= self.size:
            return self.size
        known_from, found = self.zero_known
        if not known_from <= at <= found:
            found, size = at, LOOK_BYTES
            while piece := self.read(found, size):
                if (hit := piece.find(0)) >= 0:
                    found += hit
                    break
                found, size = found + len(piece), READ_BYTES
            self.zero_known = at, found
        return found


def digest_fits(stated: str | None, content: bytes) -> bool:
    """Whether a digest header fits; algorithms that are not known here are taken on trust."""
    algorithm, _, value = (stated or "").strip().partition(":")
    if algorithm.lower() not in ("sha256", "sha1", "md5"):
        return True
    made = hashlib.new(algorithm.lower(), content)
    return value.lower() == made.hexdigest() or value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=")


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space continues the one before."""
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    return {name.strip().lower(): value.strip() for name, sep, value in (line.partition(":") for line in lines) if sep}


def entity(fields: dict[str, str], block: bytes) -> tuple[bytes, int | None, bool]:
    """(payload, stated length, whether a payload digest can be checked) of a block; of an HTTP message, what follows its head.

    A body with a transfer encoding is left as it is; digests of it are taken over other bytes.
    """
    if not fields.get("content-type", "").startswith("application/http"):
        return block, None, True
    head, _, body = block.partition(b"\r\n\r\n")
    http = fields_of(head)
    stated = http.get("content-length", "")
    return body, int(stated) if stated.isdigit() else None, "transfer-encoding" not in http


def header_at(data: Bytes, at: int) -> tuple[bytes, int]:
    """The header fields of a record that starts at ``at``, and where its block begins. The look ends at the first line that is no field."""
    size = LOOK_BYTES
    while True:
        start = data.read(at, size)
        if not VERSION.match(start):
            raise Broken("no version line")
        stop = start.find(b"\r\n\r\n")
        whole = start[VERSION_BYTES : stop if stop >= 0 else start.rfind(b"\r\n")]
        if (whole or stop >= 0) and not all(FIELD.match(line) for line in whole.split(b"\r\n")):
            raise Broken("header line without a field")
        if stop >= 0:
            return whole, at + stop + 4
        if at + len(start) >= data.size:
            raise Broken("header without end")
        size *= 2


def record_at(data: Bytes, at: int) -> tuple[Found, int]:
    """The record that starts at ``at`` and where it ends."""
    head, body = header_at(data, at)
    fields = fields_of(head)
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Broken("no length")
    n = int(length) if len(length) < 19 else data.size
    if body + n + 4 > data.size:
        raise Broken("block cut off")
    if data.read(body + n, 4) != b"\r\n\r\n":
        raise Broken("block of another length")
    block, end = data.read(body, n), body + n + 4
    if not digest_fits(fields.get("warc-block-digest"), block):
        raise Broken("block digest")
    payload, stated, plain = entity(fields, block)
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest")
    if plain and kind != "revisit" and not digest_fits(digest, payload):
        raise Broken("payload digest")
    if kind is None:
        raise Broken("no type")
    size = stated if kind == "revisit" and stated is not None else len(payload)
    names = ("warc-record-id", "warc-target-uri", "warc-refers-to")
    return Found(at, end - at, None, kind, *map(fields.get, names), digest, size, payload), end


def deflated_at(data: Bytes, at: int) -> int:
    """Where the compressed bytes of the gzip member at ``at`` begin, after its name and comment of any length."""
    head = data.read(at, MEMBER_HEAD)
    if len(head) < MEMBER_HEAD:
        raise Broken("member cut off")
    flags, pos = head[3], at + MEMBER_HEAD
    if flags & RESERVED:
        raise Broken("member damaged")
    if flags & EXTRA:
        pos += 2 + int.from_bytes(data.read(pos, 2), "little")
    for flag in (NAME, COMMENT):
        if flags & flag:
            pos = data.zero(pos) + 1
    return pos + (2 if flags & HEAD_CRC else 0)


def member_at(data: Bytes, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at ``at`` and where it ends. Heads in a row may lead to the same bytes, which are tried once."""
    start = deflated_at(data, at)
    if start == data.refuted[0]:
        raise Broken(data.refuted[1])
    try:
        return inflated(data, start)
    except Broken as broken:
        data.refuted = start, broken.reason
        raise


def inflated(data: Bytes, at: int) -> tuple[bytes, int]:
    """What the compressed bytes at ``at`` hold, by the trailer's checks, and where the trailer ends."""
    unpacker, parts, pos, size = zlib.decompressobj(-15), [], at, LOOK_BYTES
    while not unpacker.eof:
        piece = data.read(pos, size)
        if not piece:
            raise Broken("member cut off")
        pos, size = pos + len(piece), READ_BYTES
        try:
            parts.append(unpacker.decompress(piece))
        except zlib.error as error:
            raise Broken("member damaged") from error
    content, end = b"".join(parts), pos - len(unpacker.unused_data)
    trailer = data.read(end, TRAILER)
    if len(trailer) < TRAILER:
        raise Broken("member cut off")
    if struct.unpack("<II", trailer) != (zlib.crc32(content), len(content) & 0xFFFFFFFF):
        raise Broken("member damaged")
    return content, end + TRAILER


def next_candidate(data: Bytes, at: int, candidate: re.Pattern) -> int:
    """The next place from ``at`` on that may start a member or record; the end if there is none."""
    size = LOOK_BYTES
    while at < data.size:
        piece = data.read(at, size)
        if hit := candidate.search(piece):
            return at + hit.start()
        if at + len(piece) >= data.size:
            break
        at, size = at + len(piece) - VERSION_BYTES, READ_BYTES
    return data.size


def salvage(data: Bytes, members: bool = True) -> Iterator[Found]:
    """All valid records and all gaps of an archive, in order; together they cover every byte once, but for the records of one
    member, which all stand at the member's bytes. Without ``members`` there are records only."""
    at, gap, reason = 0, None, ""
    while at < data.size:
        try:
            if members and data.read(at, len(MAGIC)) == MAGIC:
                content, end = member_at(data, at)
                inside = list(salvage(Bytes(content), members=False))
                found = [f._replace(offset=at, length=end - at) for f in inside if f.reason is None]
                if not found:
                    raise Broken(inside[0].reason if inside else "empty member", end)
                found += [f._replace(offset=at, length=end - at, reason=f"{f.reason} inside a member") for f in inside if f.reason]
            else:
                one, end = record_at(data, at)
                found = [one]
        except Broken as broken:
            if gap is None:
                gap, reason = at, broken.reason
            at = next_candidate(data, broken.end or at + 1, CANDIDATE if members else VERSION)
            continue
        if gap is not None:
            yield Found(gap, at - gap, reason)
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield Found(gap, data.size - gap, reason)


TYPES = (
    ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("type", pa.string()),
    ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("payload", pa.binary()),
)


def read_archives(archives: DataFrame, path_col: str = "path", with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives at ``path_col``. A gap has a reason and no type; ``offset`` and ``length`` are bytes of the archive.

    A revisit's ``payload_bytes`` is the length that its HTTP head states. Payloads are left out without ``with_payload``.
    """
    names = [name for name, _ in TYPES if with_payload or name != "payload"]

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, inner = pafs.FileSystem.from_uri(path)
                with files.open_input_file(inner) as source:
                    rows, held = [], 0
                    for found in salvage(Bytes(source)):
                        if not with_payload:
                            found = found._replace(payload=None)
                        rows.append((path, *found))
                        held += 200 + len(found.payload or b"")
                        if held >= 1 << 22:
                            yield as_batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return batch_of(**{name: pa.array(column, kind) for (name, kind), column in zip(TYPES, zip(*rows)) if name in names})

    paths = archives.select(F.col(f"`{path_col}`").alias("path"))
    spread = paths.repartition(max(1, paths.count()))  # one archive is the unit of work; a given number is not coalesced
    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return spread.mapInArrow(read, ", ".join(f"`{name}` {kinds[kind]}" for name, kind in TYPES if name in names))


def records(found: DataFrame) -> DataFrame:
    return found.filter("reason IS NULL")


def gaps(found: DataFrame) -> DataFrame:
    """The quarantine log: bytes that hold no valid record, and which check failed there."""
    return found.filter("reason IS NOT NULL").select("path", "offset", "length", "reason")


def page_facts(found: DataFrame, id_type_ddl: str = "long", id_col: str = "page_id") -> DataFrame:
    """One row per page record: id, payload_bytes, payload_digest, record_type, refers_to."""
    of_page = F.col("record_id").startswith(PREFIX) | (F.col("record_id") == NO_ID)
    pages = records(found).filter(F.col("type").isin("response", "revisit") & of_page)

    def page(column: str) -> Column:
        name = F.url_decode(F.expr(f"substring({column}, {len(PREFIX) + 1}, length({column}) - {len(PREFIX) + 1})"))
        return F.when(F.col(column).startswith(PREFIX), name).cast(id_type_ddl)

    return pages.select(
        page("record_id").alias(id_col), "payload_bytes", F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
        F.col("type").alias("record_type"), page("refers_to").alias("refers_to"),
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **settings) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back: one row per page."""
    folder = scratch_path(pages.sparkSession, "archives")
    archives = write_archives(pages, folder, id_col, url_col, html_col, **settings)
    return page_facts(read_archives(archives, with_payload=False), id_type(pages, id_col), id_col)
