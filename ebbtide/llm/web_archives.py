"""Legacy ARC archives, and their conversion to WARC.

ARC files hold records of a header line, as many bytes as it declares, and a line end. The
first record names the version and the fields of all header lines. Conversion parses those,
makes the identifiers, dates, types and digests WARC wants, and writes `revisit` records
instead of payloads that are stored elsewhere. Files are plain gzip text written and read by
Spark, one per task, so any store it can reach will do, and a reader holds one compressed file
and one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import map_rows
from ebbtide.plans import remove_folder, shared_folder

CAPTURED = "20240101000000"
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 16
UUID_SPACE = int.from_bytes(hashlib.sha1(b"page records").digest()[:6], "big")
PAGE = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _write(df: DataFrame, path: str, line_end: str) -> None:
    (
        df.write.option("lineSep", line_end)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


class _Unzipped(io.RawIOBase):
    """A gzip file's text as a stream, a piece at a time."""

    def __init__(self, content: bytes):
        self.rest, self.at = memoryview(content), 0
        self.zip = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            piece = self.zip.unconsumed_tail or self.rest[self.at : self.at + 65536]
            if not self.zip.unconsumed_tail:
                self.at += len(piece)
            out = self.zip.decompress(piece, len(into))
            if self.zip.eof and self.zip.unused_data:  # another member follows
                self.at -= len(self.zip.unused_data)
                self.zip = zlib.decompressobj(31)
            if out or not len(piece):
                into[: len(out)] = out
                return len(out)


def _stream(content: bytes) -> io.BufferedReader:
    return io.BufferedReader(_Unzipped(content), 1 << 20)


# ARC


def _url(url: str | None) -> str:
    """A URL that fits a header line: blanks and controls escaped; `-` for none."""
    return "".join(f"%{ord(c):02X}" if c <= " " else c for c in url or "") or "-"


def _http(page_id: int | None, size: int) -> str:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n{own}\r\n"


def write_arc(pages: DataFrame, path: str) -> None:
    """Write ARC files, one per partition of `pages` (page_id, url, html), in both versions of
    the format by turns. A null html is an empty payload; other columns are not read."""

    def run(rows):
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"pages-{part:05d}.arc"
        block = f"{version} 0 pages\n{FIELDS[version]}\n"
        yield ([_arc_record(version, f"filedesc://{name}", "text/plain", name, block)],)
        for ids, urls, bodies in rows:
            out = []
            for page_id, url, html in zip(ids, urls, bodies):
                html = html or ""
                body = _http(page_id, len(html.encode())) + html
                out.append(_arc_record(version, _url(url), "text/html", name, body))
            yield (out,)

    _write(map_rows(pages, ["page_id", "url", "html"], run, "value string"), path, "\n")


def _arc_record(version: int, url: str, kind: str, name: str, body: str) -> str:
    size = len(body.encode())
    middle = f"{kind} 200 - - 0 {name}" if version == 2 else kind
    return f"{url} 0.0.0.0 {CAPTURED} {middle} {size}\n{body}"


def read_arc(content: bytes) -> Iterator[dict]:
    """Records of one ARC file, of either version: url, date, status, head, payload.

    The version block says which fields header lines have; the last is the declared length.
    """
    stream = _stream(content)
    fields: list[str] = []
    while line := stream.readline():
        parts = line.decode().rstrip("\r\n").split(" ")
        size = int(parts[-1])
        body = stream.read(size)
        if len(body) != size or stream.read(1) != b"\n":
            raise ValueError(f"an ARC record is not as long as it declares: {parts[0]}")
        if not fields:
            version, _, rest = body.decode().partition(" ")
            fields = rest.split("\n")[1].split(" ")
            if fields != FIELDS.get(int(version), "").split(" "):
                raise ValueError(f"unknown ARC version {version}")
            continue
        record = dict(zip(fields, parts, strict=True))
        head, _, payload = body.partition(b"\r\n\r\n")
        yield {
            "url": record["URL"],
            "date": record["Archive-date"],
            "status": record.get("Result-code", "200"),
            "head": head.decode(),
            "payload": payload,
        }


def _page_id(head: str) -> int | None:
    found = [x.partition(": ")[2] for x in head.split("\r\n") if x.startswith("X-Page-Id: ")]
    return int(found[0]) if found else None


# WARC


def _record_id(page_id: int) -> str:
    """A UUID of the free-form version 8 that carries the page id."""
    value = page_id & (1 << 64) - 1
    number = UUID_SPACE << 80 | 8 << 76 | value >> 62 << 64 | 2 << 62 | value & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def _page_of(record_id: str) -> int:
    number = uuid.UUID(record_id.strip("<>").removeprefix("urn:uuid:")).int
    value = (number >> 64 & 0xFFF) << 62 | number & (1 << 62) - 1
    return value - (1 << 64) if value >> 63 else value


def _warc_record(fields: dict[str, str], block: str) -> str:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block.encode())}\r\n\r\n{block}"


def _converted(record: dict, where: str, refers_to: int | None) -> str:
    page_id, payload = _page_id(record["head"]), record["payload"]
    block = record["head"] + "\r\n\r\n"
    d = record["date"]
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, where)}>" if page_id is None else _record_id(page_id)
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": own,
        "WARC-Date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "WARC-Target-URI": record["url"],
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
    }
    if refers_to is None:
        block += payload.decode()
    else:
        fields["WARC-Refers-To"], fields["WARC-Profile"] = _record_id(refers_to), REVISIT
    fields["WARC-Block-Digest"] = f"sha1:{base32_sha1(block.encode())}"
    fields["Content-Type"] = "application/http; msgtype=response"
    return _warc_record(fields, block)


def _revisits(files: DataFrame, at_least: int) -> DataFrame:
    """path, revisits (place in the file, page that holds the payload): which records repeat a
    payload of `at_least` bytes or more that a page with a larger id has.

    Copies are counted per digest with a partial aggregate first. The table of repeated
    digests is then spread over SALTS and joined on digest and salt, so a payload that a third
    of the pages share is dealt to as many tasks.
    """

    def run(rows):
        for paths, contents in rows:
            for path, content in zip(paths, contents):
                out: list[tuple] = []
                for at, record in enumerate(read_arc(content)):
                    payload = record["payload"]
                    if len(payload) >= at_least:
                        out.append((path, at, _page_id(record["head"]), hashlib.sha1(payload).digest()))
                if out:
                    yield [list(c) for c in zip(*out)]

    schema = "path string, at bigint, page_id bigint, digest binary"
    seen = map_rows(files, ["path", "content"], run, schema, 1).filter("page_id is not null")
    repeated = (
        seen.groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        .drop("n")
    )
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("path", "at"), F.lit(SALTS)).cast("int"))
    return (
        salted.join(repeated, ["digest", "salt"])
        .filter("page_id < first")
        .groupBy("path")
        .agg(F.collect_list(F.struct("at", "first")).alias("revisits"))
    )


def arc_to_warc(spark: SparkSession, arc: str, warc: str, at_least: int = 0) -> None:
    """Convert the ARC files in folder `arc` to WARC files in `warc`.

    Of records with equal payloads of `at_least` bytes or more the one with the largest page
    id becomes the response, and so do others with that same id; the rest become revisits of
    it. Records without a page id are always responses. Compressed files, not payloads, are
    what meets the list of revisits.
    """
    files = _files(spark, arc)

    def run(rows):
        info = {
            "WARC-Type": "warcinfo",
            "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{warc}#{TaskContext.get().partitionId()}')}>",
            "WARC-Date": "2024-01-01T00:00:00Z",
            "Content-Type": "application/warc-fields",
        }
        yield ([_warc_record(info, "format: WARC File Format 1.1\r\n")],)
        for paths, contents, revisits in rows:
            for path, content, own in zip(paths, contents, revisits):
                refers = {r["at"]: r["first"] for r in own or ()}
                out, size = [], 0
                for at, record in enumerate(read_arc(content)):
                    out.append(_converted(record, f"{path}#{at}", refers.get(at)))
                    size += len(out[-1])
                    if size > 1 << 22:
                        yield (out,)
                        out, size = [], 0
                yield (out,)

    both = files.join(_revisits(files, at_least), "path", "left")
    _write(map_rows(both, ["path", "content", "revisits"], run, "value string", 1), warc, "\r\n\r\n")


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one WARC file."""
    stream = _stream(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError("a WARC record does not start where the last one ends")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"a WARC record is not as long as it declares: {fields}")
        yield fields, block


def warc_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the responses and
    revisits in the WARC files of a folder. A response whose payload has not the digest or
    length its record states is an error."""

    def run(rows):
        for _, contents in rows:
            out: list[tuple] = []
            for fields, block in read_warc(contents[0]):
                if fields["WARC-Type"] not in ("response", "revisit"):
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                lines = [x.partition(": ") for x in head.decode().split("\r\n")]
                size = int(next(v for k, _, v in lines if k == "Content-Length"))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                refers = fields.get("WARC-Refers-To")
                if refers is None and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                target = None if refers is None else _page_of(refers)
                out.append((_page_id(head.decode()), size, digest, fields["WARC-Type"], target))
            if out:
                yield [list(c) for c in zip(*out)]

    return map_rows(_files(spark, path), ["path", "content"], run, PAGE, 1)


def pages_through_archives(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """What `warc_pages` reads after `pages` went through ARC and WARC files.

    Null html is an empty payload; rows with a null page_id are responses; of rows with one
    page_id and one payload all are alike; an empty table gives no rows. The ARC files are
    removed at once, the WARC files with the session's folder.
    """
    spark = pages.sparkSession
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(pages, arc)
    arc_to_warc(spark, arc, warc, at_least)
    remove_folder(spark, arc)
    return warc_pages(spark, warc)
