"""Legacy archive converter: ARC files become WARC files.

ARC (version 1 and 2) announces its record line in a version block; each record is one such line and then exactly the
declared number of bytes. The converter parses both versions and makes up what WARC asks for and ARC lacks: record
identifiers, ISO timestamps, record types and digests. Records that cannot be read are reported and the rest goes on.
Archives are rows ``(archive, content)`` of a table, content
being the file's bytes with a gzip member per record, so they live wherever Spark can write; ``export_archives`` writes
them as files.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import byte_column, join_hot, staged

#: The field names of ARC record lines, by version (fixed by the format).
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Names the records' identifiers are derived in.
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:newsloom:arc-records")
ARCHIVES = "archive string, content binary"


def _member(data: bytes, level: int = 1) -> bytes:
    """``data`` as a gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


_GZIP = b"\x1f\x8b\x08"


def unzipped(content: bytes) -> Iterator[bytes | zlib.error]:
    """The gzip members of an archive, or all of one that is not compressed.

    A broken member is given as the error it made; the next one is looked for behind it.
    """
    if not content.startswith(_GZIP):
        if content:
            yield content
        return
    while content:
        z = zlib.decompressobj(31)
        try:
            yield z.decompress(content) + z.flush()
            if not z.eof:
                yield zlib.error("a gzip member is cut off")
            content = z.unused_data
            if content and not content.startswith(_GZIP):
                raise zlib.error("no gzip member follows")
        except zlib.error as error:
            yield error
            at = content.find(_GZIP, 1)
            content = content[at:] if at >= 0 else b""


def http_message(payload: bytes, page_id: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


def split_http(message: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = message.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, body


# --- ARC ---------------------------------------------------------------------------------------------------------


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 newsloom\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Archive-length": str(len(body))}
    return " ".join(fields.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str | None, date: str, message: bytes, name: str, offset: int) -> bytes:
    fields = {
        "URL": quote(url or "-", safe="%/:=&?~#+!$,;'@()*[]"), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200",
        "Checksum": hashlib.md5(message).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(message)),
    }
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + message + b"\n"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    body: bytes


@dataclass
class BadRecord:
    """What cannot be read of an archive: where (in its content without compression), and why."""

    at: int
    reason: str


#: A record line: a URL, an address, a date, what the version has besides, and the length.
_LINE = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*:[^\n]* [0-9A-Fa-f.:]+ \d{4,14} [^\n]*\d+\r?\n")


def record_line(line: bytes, names: tuple[str, ...]) -> dict[str, str]:
    """The fields of a record line. Only the URL in front may hold blanks, so the line is split from the right."""
    found = line.decode("latin-1").rstrip("\r").rsplit(" ", len(names) - 1)
    if len(found) != len(names):
        raise ValueError(f"ARC record line has {len(found)} fields, not {len(names)}")
    if not found[-1].isdecimal():
        raise ValueError(f"ARC record declares no length but {found[-1][:40]!r}")
    return dict(zip(names, found))


def arc_version(body: bytes) -> tuple[str, ...]:
    """The field names that the body of a version block announces."""
    first, _, rest = body.partition(b"\n")
    version = first.split(b" ", 1)[0]
    names = ARC_FIELDS.get(int(version)) if version.isdigit() else None
    if names is None:
        raise ValueError(f"ARC version {version[:20]!r} is not known")
    if tuple(rest.split(b"\n")[0].decode("latin-1").split()) != names:
        raise ValueError(f"ARC version {int(version)} block names other fields")
    return names


def parse_arc(content: bytes) -> Iterator[ArcRecord | BadRecord]:
    """The records of an archive after its version block, which says how their lines are to be read.

    Archives may be compressed by record, as a whole, or not at all. A record ends where its declared length says,
    whatever its bytes are. What does not fit is reported as a ``BadRecord``, and reading goes on with the next gzip
    member or the next line that looks like a record's. Without a version block nothing can be read.
    """
    names: tuple[str, ...] | None = None
    before = 0
    for data in unzipped(content):
        if isinstance(data, zlib.error):
            yield BadRecord(before, str(data))
            continue
        at = 0
        while at < len(data):
            if data[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end = data.find(b"\n", at)
            try:
                if end < 0:
                    raise ValueError("ARC record line does not end")
                # both versions' lines end in the length, which is all that is needed of the first one
                fields = record_line(data[at:end], names or ("line", "Archive-length"))
                size = int(fields["Archive-length"])
                body = data[end + 1 : end + 1 + size]
                if len(body) != size:
                    raise ValueError(f"ARC record declares {size} bytes, {len(body)} are left")
                if names is None:
                    names = arc_version(body)
                else:
                    yield ArcRecord(fields, body)
                at = end + 1 + size
            except ValueError as error:
                yield BadRecord(before + at, str(error))
                if names is None:
                    return
                found = _LINE.search(data, max(at + 1, end))
                at = found.start() if found else len(data)
        before += len(data)


# --- WARC --------------------------------------------------------------------------------------------------------


def warc_time(date: str) -> str:
    """A 14-digit ARC date (shorter ones are filled up) as a WARC timestamp."""
    d = (date + "00000101000000"[len(date) :])[:14] if re.fullmatch(r"\d{4,14}", date) else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, index: int, record: ArcRecord | None = None) -> str:
    """An identifier of its own for everything that differs in place, address, date or content."""
    said = "" if record is None else " ".join([*record.fields.values(), hashlib.sha1(record.body).hexdigest()])
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{archive}/{index} {said}')}>"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def convert_record(record: ArcRecord, archive: str, index: int, original: dict | None) -> bytes:
    """A WARC response record, or a revisit of ``original`` (record, uri, date, page) that leaves the payload out."""
    http, payload = split_http(record.body)
    head = record.body[: len(record.body) - len(payload)]
    headers = [
        ("WARC-Type", "revisit" if original else "response"),
        ("WARC-Record-ID", record_id(archive, index, record)),
        ("WARC-Date", warc_time(record.fields["Archive-date"])),
        ("WARC-Target-URI", record.fields["URL"]),
        ("WARC-IP-Address", record.fields["IP-address"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"),
    ]
    block = record.body
    if original:
        block = head
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", original["record"]),
            ("WARC-Refers-To-Target-URI", original["uri"]),
            ("WARC-Refers-To-Date", original["date"]),
            ("X-Refers-To-Page", "" if original["page"] is None else str(original["page"])),
        ]
    headers.append(("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"))
    return warc_record(headers, block)


def warcinfo(archive: str, source: str) -> bytes:
    block = f"software: newsloom\r\nformat: WARC File Format 1.1\r\nisPartOf: {source}\r\n".encode()
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(archive, -1)), ("WARC-Date", warc_time("")), ("WARC-Filename", archive), ("Content-Type", "application/warc-fields")], block)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers with lower-case names, block)`` of every record; raises on a bad version line, length or digest."""
    for data in unzipped(content):
        if isinstance(data, zlib.error):
            raise ValueError(f"not a WARC archive: {data}")
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            first, *lines = data[at:end].decode().split("\r\n")
            if not first.startswith("WARC/1."):
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            size = int(headers["content-length"])
            block = data[end + 4 : end + 4 + size]
            if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
                raise ValueError("WARC record does not end where its length says")
            if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
                raise ValueError("WARC block does not match its digest")
            yield headers, block
            at = end + 8 + size


# --- tables ------------------------------------------------------------------------------------------------------


def _archives(rows: Iterable[tuple[str, bytes]]) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["archive", "content"])


def write_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000", records: int = 400, size: int = 4 << 20) -> DataFrame:
    """Pages as ARC archives, versions 1 and 2 in turn, of at most ``records`` records and about ``size`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held, offset, n, version = TaskContext.get().partitionId(), 0, [], 0, 0, 1

        def opened():
            return f"pages-{part:06d}-{at:05d}.arc.gz", 1 + at % 2

        for batch in batches:
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_column(batch, "html")):
                if not held:
                    name, version = opened()
                    held, n = [_member(arc_version_block(version, name, date))], 0
                    offset = len(held[0])
                held.append(_member(arc_record(version, url, date, http_message(html or b"", page_id), name, offset)))
                offset, n = offset + len(held[-1]), n + 1
                if n >= records or offset >= size:
                    yield _archives([(name, b"".join(held))])
                    held, at = [], at + 1
        if held:
            yield _archives([(name, b"".join(held))])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, ARCHIVES)


def arc_payloads(arcs: DataFrame) -> DataFrame:
    """``(archive, idx, page_id, size, digest, record, uri, date, same, bad)`` of every ARC record.

    ``same`` holds for equal payloads alone: their size, SHA-1 and 256 bits of BLAKE2. ``bad`` says why a record cannot be read, and ``idx`` then where it lies; it is null for all others.
    """
    names = ["archive", "idx", "page_id", "size", "digest", "record", "uri", "date", "same", "bad"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, i = [], 0
                for record in parse_arc(content):
                    if isinstance(record, BadRecord):
                        rows.append((archive, record.at, *[None] * 7, record.reason))
                        continue
                    http, payload = split_http(record.body)
                    sha = hashlib.sha1(payload).hexdigest()
                    rows.append((
                        archive, i, number(http.get("x-page-id")), len(payload), sha, record_id(warc_name(archive), i, record), record.fields["URL"],
                        warc_time(record.fields["Archive-date"]), f"{len(payload)}:{sha}:{hashlib.blake2b(payload, digest_size=32).hexdigest()}", None,
                    ))
                    i += 1
                cols = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)

    return arcs.mapInArrow(run, "archive string, idx long, page_id long, size long, digest string, record string, uri string, date string, same string, bad string")


def number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdecimal() else None


def revisits(payloads: DataFrame, least: int = 1000) -> DataFrame:
    """Per archive, which of its records revisit which other: ``(archive, refers array<struct<idx, record, uri, date, page>>)``.

    Of equal payloads of at least ``least`` bytes the largest page id is the response (ties: the last archive and
    place); groups are aggregated before any join, and joined as one row each, those of very many payloads apart.
    """
    big = payloads.where((F.col("size") >= least) & F.col("bad").isNull())
    original = F.struct("page_id", "archive", "idx", "record", "uri", "date")
    groups = staged(big.groupBy("same").agg(F.max(original).alias("o"), F.count("*").alias("n")).where("n > 1"), "originals")
    hits = join_hot(big.select("archive", "idx", "same"), groups, "same", payloads.count()).where((F.col("archive") != F.col("o.archive")) | (F.col("idx") != F.col("o.idx")))
    refer = F.struct("idx", "o.record", "o.uri", "o.date", F.col("o.page_id").alias("page"))
    return hits.groupBy("archive").agg(F.collect_list(refer).alias("refers"))


def convert_arcs(arcs: DataFrame, refers: DataFrame) -> DataFrame:
    """ARC archives to WARC archives, one for one; records that cannot be read are left to ``arc_payloads``' report."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content, refer in zip(*(batch.column(i).to_pylist() for i in range(3))):
                to = {r["idx"]: r for r in refer or ()}
                name = warc_name(archive)
                out = io.BytesIO()
                out.write(_member(warcinfo(name, archive)))
                for i, record in enumerate(r for r in parse_arc(content) if isinstance(r, ArcRecord)):
                    out.write(_member(convert_record(record, name, i, to.get(i))))
                yield _archives([(name, out.getvalue())])

    return arcs.join(refers, "archive", "left").select("archive", "content", "refers").mapInArrow(run, ARCHIVES)


def warc_name(archive: str) -> str:
    return re.sub(r"\.arc(\.gz)?$", "", archive) + ".warc.gz"


def read_warcs(warcs: DataFrame) -> DataFrame:
    """Rows of the archives' response and revisit records.

    ``(page_id, url, record_id, record_type, date, payload_bytes, payload_digest, refers_to, payload)``: for a revisit,
    bytes and digest are those of the payload it stands for, and ``payload`` is null.
    """
    names = ["page_id", "url", "record_id", "record_type", "date", "payload_bytes", "payload_digest", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1).to_pylist():
                rows = []
                for headers, block in parse_warc(content):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, payload = split_http(block)
                    digest = headers["warc-payload-digest"].partition(":")[2]
                    if kind == "response" and digest != hashlib.sha1(payload).hexdigest():
                        raise ValueError("payload does not match its digest")
                    rows.append((
                        number(http.get("x-page-id")), headers.get("warc-target-uri"), headers["warc-record-id"], kind, headers["warc-date"],
                        len(payload) if kind == "response" else number(http.get("content-length")), digest, number(headers.get("x-refers-to-page")), payload if kind == "response" else None,
                    ))
                for at in range(0, len(rows), 100):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[at : at + 100]), types)], names=names)

    return warcs.mapInArrow(run, "page_id long, url string, record_id string, record_type string, date string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """Pages -> ARC -> WARC, as a staged table of WARC archives.

    One record per row. Null html is an empty payload; a null url reads "-"; a null page id stays null and is smaller
    than any other; rows with the same id are records of their own, and of equal payloads exactly one is a response;
    other columns are not read; an empty table makes no archive.
    """
    arcs = staged(write_arcs(pages, id_col, url_col, html_col), "arcs")
    payloads = staged(arc_payloads(arcs), "payloads")
    # staged, so that its size is known: where it is small the archives are not shuffled to meet it
    refers = staged(revisits(payloads, least), "refers")
    return staged(convert_arcs(arcs, refers), "warcs")


def export_archives(archives: DataFrame, folder: str) -> list[str]:
    """Write archives as files into a folder of the driver, one at a time; their names."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for row in archives.toLocalIterator():
        with open(os.path.join(folder, row["archive"]), "wb") as f:
            f.write(row["content"])
        names.append(row["archive"])
    return sorted(names)
