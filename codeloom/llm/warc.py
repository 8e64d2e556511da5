"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own.  A reading task gets a byte range of a file, looks
for the gzip magic, takes a candidate as a member if it inflates to a WARC header, and owns
the records that start inside its range.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shared_files import attempt_name, create, open_input
from codeloom.session import scratch_path, stored

MAGIC = b"\x1f\x8b\x08"
SPLIT = 8 << 20
STEP = 1 << 20
ID_PREFIX = "urn:x-page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 6


def _record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A gzip member: response with its payload, or revisit with the HTTP header only."""
    def name(key):
        return f"<{ID_PREFIX}{'' if key is None else key}>"

    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, *, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); gives the stored manifest
    (path, n_bytes, n_records).

    Null html is an empty payload.  Of equal payloads the row with the smallest page_id is a
    response, the others are revisits of it; repeated rows with that id are responses too.
    A row with a null id is a response unless an id with the same payload exists.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.unhex(F.sha1("html")))
    # as a stored table the smaller side is a plain shuffle, so that a digest with very many
    # pages can be split among tasks
    first = stored(rows.groupBy("digest").agg(F.min("page_id").alias("first")))
    linked = rows.join(first, "digest").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = attempt_name(folder, ".warc.gz")
        out, size, count = None, 0, 0
        for batch in batches:
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or create(path)
                data = _record(page, url, html.encode(), refers_to, date)
                out.write(data)
                size, count = size + len(data), count + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([count])], ["path", "n_bytes", "n_records"])

    return stored(linked.mapInArrow(write, "path string, n_bytes long, n_records long"))


class _Window:
    """Bytes of a file from a position on, read as they are asked for."""

    def __init__(self, source, size: int):
        self.source, self.size, self.base, self.data = source, size, 0, b""

    def at(self, start: int, least: int) -> memoryview:
        """What is held from ``start`` on, at least ``least`` bytes unless the file ends."""
        if start < self.base or start > self.base + len(self.data):
            self.base, self.data = start, b""
        while self.base + len(self.data) < min(self.size, start + least):
            here = self.base + len(self.data)
            self.source.seek(here)
            more = self.source.read(min(STEP, self.size - here))
            if not more:
                raise EOFError("the file is shorter than its manifest says")
            self.data = self.data[start - self.base :] + more
            self.base = start
        return memoryview(self.data)[start - self.base :]


def _member(window: _Window, start: int, header_only: bool = False) -> tuple[bytes, int] | None:
    """(inflated bytes, end of the member) if a WARC member starts here, else None."""
    inflate = zlib.decompressobj(31)
    parts: list[bytes] = []
    at, seen = start, 0
    while not inflate.eof:
        piece = window.at(at, 1)[:65536]
        if not len(piece):
            return None
        try:
            part = inflate.decompress(piece)
        except zlib.error:
            return None
        parts.append(part)
        at += len(piece)
        if seen < 7:
            head = b"".join(parts)[:7]
            seen = len(head)
            if head != b"WARC/1."[:seen]:
                return None
    return (b"".join(parts), at - len(inflate.unused_data)) if seen == 7 else None


def _parse(data: bytes) -> tuple:
    """(page_id, url, payload bytes, digest, type, refers_to, payload or None)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")

    def key(name: str) -> int | None:
        text = fields.get(name, "").strip("<>").removeprefix(ID_PREFIX)
        return int(text) if text else None

    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return key("WARC-Record-ID"), fields.get("WARC-Target-URI"), length, digest, kind, key("WARC-Refers-To"), payload if kind == "response" else None


def records_in(path: str, start: int, stop: int, size: int) -> Iterator[tuple]:
    """The records which start in [start, stop) of a file."""
    with open_input(path) as source:
        window = _Window(source, size)
        at = start
        while at < stop:
            found = _member(window, at) if bytes(window.at(at, 3)[:3]) == MAGIC else None
            if found:
                yield _parse(found[0])
                at = found[1]
                continue
            held = bytes(window.at(at + 1, STEP)[:STEP])
            if not held:
                return
            k = held.find(MAGIC)
            at = at + 1 + (k if k >= 0 else max(1, len(held) - 2))


def read_archives(manifest: DataFrame, *, split: int = SPLIT, payloads: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]).

    ``manifest`` lists files (path, n_bytes); tasks read ranges of ``split`` bytes.  A
    response whose payload differs from its digest is an error.
    """
    ranges = manifest.where("n_bytes > 0").select(
        "path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split).cast("long"))).alias("start")
    )
    fields = [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ][: 7 if payloads else 6]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                held: list[tuple] = []
                weight = 0
                for record in records_in(path, start, min(size, start + split), size):
                    held.append(record)
                    weight += record[2]
                    if weight > 4 * STEP:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])
                        held, weight = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(tasks).mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame, *, folder: str | None = None) -> DataFrame:
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder))
