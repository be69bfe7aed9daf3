"""WARC archives: a writer, and a sequential reader with one gzip member per record."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, stage

READ_BYTES = 1 << 16
#: A task starts a new archive beyond about this many compressed bytes.
FILE_BYTES = 256 << 20
PAGE_URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format or a digest that doesn't match."""


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes | None
    payload_bytes: int
    payload_digest: str


class _Members:
    """Bytes of one gzip member after the other, decompressed as they are asked for."""

    def __init__(self, file: BinaryIO):
        self.file, self.raw, self.out, self.unzip = file, b"", bytearray(), None

    def start(self) -> bool:
        """Go to the next member; False at the end of the file."""
        self.raw = self.raw or self.file.read(READ_BYTES)
        self.out.clear()
        self.unzip = zlib.decompressobj(31) if self.raw else None
        return bool(self.raw)

    def more(self) -> bool:
        """Decompress a further piece; False at the end of the member."""
        while not self.unzip.eof:
            if not self.raw:
                self.raw = self.file.read(READ_BYTES)
                if not self.raw:
                    raise WarcError("the file ends within a gzip member")
            got = self.unzip.decompress(self.raw, READ_BYTES)
            self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            if got:
                self.out += got
                return True
        return False

    def line(self) -> bytes:
        while (end := self.out.find(b"\r\n")) < 0:
            if not self.more():
                raise WarcError("the member ends within a header")
        line = bytes(self.out[:end])
        del self.out[: end + 2]
        return line

    def take(self, most: int) -> bytes:
        """Between 1 and ``most`` bytes."""
        if not self.out and not self.more():
            raise WarcError("the member is shorter than its Content-Length")
        got = bytes(self.out[:most])
        del self.out[: len(got)]
        return got


def _fields(lines: Iterator[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise WarcError(f"no header field: {name[:80]}")
        found[name.strip().lower()] = value.strip()
    return found


def read_records(file: BinaryIO, keep_payload: bool = True) -> Iterator[Record]:
    """Records of an archive in order. Checks the framing, block digest and payload digest of each.

    Holds one piece of at most 64 KB at a time, and the payload only if it is kept.
    """
    members = _Members(file)
    while members.start():
        version = members.line()
        if not version.startswith(b"WARC/"):
            raise WarcError(f"no WARC record: {version[:40]!r}")
        headers = _fields(iter(members.line, b""))
        left = int(headers["content-length"])
        block, payload, kept, http_lines, length = sha256(), sha256(), [], [], 0
        in_http, pending = headers.get("content-type", "").startswith("application/http"), b""
        while left:
            piece = members.take(left)
            left -= len(piece)
            block.update(piece)
            if in_http:
                pending += piece
                head, end, rest = pending.partition(b"\r\n\r\n")
                if not end:
                    continue
                http_lines, piece, in_http = head.split(b"\r\n")[1:], rest, False
            payload.update(piece)
            length += len(piece)
            if keep_payload:
                kept.append(piece)
        if in_http and pending:
            raise WarcError("an HTTP block without the end of its header")
        trailer = bytes(members.out)
        while members.more():
            trailer = bytes(members.out)
        if trailer != b"\r\n\r\n":
            raise WarcError("a record that doesn't end with its Content-Length")
        http = _fields(iter(http_lines))
        revisit = headers["warc-type"] == "revisit"
        if headers.get("warc-block-digest") != f"sha256:{block.hexdigest()}":
            raise WarcError(f"block digest of {headers.get('warc-record-id')}")
        stated = headers.get("warc-payload-digest", "").removeprefix("sha256:")
        if not revisit and stated != payload.hexdigest():
            raise WarcError(f"payload digest of {headers.get('warc-record-id')}")
        yield Record(headers, http, None if revisit or not keep_payload else b"".join(kept), int(http["content-length"]) if revisit else length, stated)


def _one_line(text: str) -> str:
    return " ".join(text.split())


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A record as one gzip member: a response, or a revisit of another page's response."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{PAGE_URN}{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": _one_line(url or "about:blank"),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": f"sha256:{sha256(block).hexdigest()}",
        "WARC-Payload-Digest": f"sha256:{digest}",
    }
    if revisit:
        fields |= {"WARC-Refers-To": f"<{PAGE_URN}{refers_to}>", "WARC-Profile": PROFILE}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(head.encode() + block + b"\r\n\r\n") + member.flush()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive pages under ``folder``; returns the manifest (path, n_records, n_bytes) of what was written.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the smallest id is the
    response and the others revisit it. A null html is an empty payload. Rows that repeat both id and
    payload of the smallest are responses too. A row with a null id is a response where no other
    page has its payload, else a revisit. Extra columns are not read.

    Plan: digests are aggregated before the shuffle, so a payload that a third of the pages share is
    one row a task; only payloads held twice are joined back (AQE splits a hot one; keys that can't
    match are spread). The manifest lists the files of the attempts that succeeded, so a lost or
    repeated task leaves at most files that nobody reads.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.unhex(F.sha2("html", 256)))
    long = F.octet_length("html") >= least_bytes
    twice = pages.filter(long).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1 and first is not null").select(F.col("digest").alias("key"), "first")
    twice = stage(twice, "warc-payloads")
    spread = F.encode(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")), "utf-8")
    joined = pages.withColumn("own", F.when(long, F.col("digest")).otherwise(spread)).join(twice, F.col("own") == F.col("key"), "left")
    joined = joined.select("page_id", "url", "html", F.lower(F.hex("digest")).alias("digest"), F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))
    root = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        where, base = fs.FileSystem.from_uri(root)
        where.create_dir(base, recursive=True)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        done, file, count = [], None, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page, url, html, digest, refers = (c[i].as_py() for c in columns)
                if file is None:
                    path = f"{name}-{len(done):03d}.warc.gz"
                    file, count = where.open_output_stream(f"{base}/{path}", compression=None), 0
                file.write(record_bytes(page, url, html.encode(), digest, refers, date))
                count += 1
                if file.tell() >= FILE_BYTES:
                    done.append((f"{root}/{path}", count, file.tell()))
                    file.close()
                    file = None
        if file is not None:
            done.append((f"{root}/{path}", count, file.tell()))
            file.close()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "n_records", "n_bytes"), map(list, zip(*done)))))

    return stage(joined.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_warc(manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Read archives back, a task a file: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload).

    ``payload`` is null for revisits and where it isn't kept. A record that fails a check fails the job.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def page(urn: str | None) -> int | None:
        digits = (urn or "").strip("<>").removeprefix(PAGE_URN)
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, base = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with where.open_input_stream(base, compression=None) as file:
                    for r in read_records(file, keep_payload):
                        h = r.headers
                        rows.append((page(h["warc-record-id"]), h.get("warc-target-uri"), r.payload_bytes, r.payload_digest, h["warc-type"], page(h.get("warc-refers-to")), r.payload))
                        held += len(r.payload or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    files = max(1, manifest.count())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return manifest.select("path").repartition(min(files, 10_000)).mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read their records back, without payloads."""
    manifest = write_warc(pages, new_path(pages.sparkSession, "warc"))
    return read_warc(manifest, keep_payload=False)
