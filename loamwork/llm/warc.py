"""WARC archives: written as one gzip stream a file, normalised to one member a record with an offset index, read back.

Files lie in a shared folder that pyarrow's file systems can open on every executor (a path without a scheme must be a
mount that all of them have). A task writes under a name of its
own and the winner is what its output row names, so that retried and speculative tasks leave no half file in use.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.store import join_checked, materialise, prepare, scratch_path

#: Equal payloads of at least so many bytes become revisits.
REVISIT_BYTES = 100
#: Uncompressed bytes after which a writer begins the next archive.
ARCHIVE_BYTES = 64 << 20
BLOCK = 1 << 16
#: The standard's name for a revisit whose payload equals that of the record it refers to.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, record_at long, record_len long, record_id string, record_type string"


def record(page_id: int | None, row: int, url: str | None, kind: str, payload: bytes, digest: str, length: int, refers: str | None) -> bytes:
    """One WARC/1.1 record. row tells apart the records of rows with equal or null page ids."""
    body = payload if kind == "response" else b""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{row}>", f"WARC-Target-URI: {clean}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}", f"Content-Length: {len(body)}",
    ]
    if kind == "response":
        head.append("Content-Type: text/html; charset=utf-8")
    else:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class Reader:
    """Records of a byte stream, one at a time: (headers, body, whole record)."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held, self.ended = blocks, bytearray(), False

    def _more(self) -> bool:
        block = next(self.blocks, None)
        self.ended = block is None
        self.held += block or b""
        return not self.ended

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        while True:
            seen = 0
            while (at := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
                seen = len(self.held)
                if not self._more():
                    if self.held:
                        raise ValueError(f"the stream ends inside a record's head, {len(self.held)} bytes on")
                    return
            lines = self.held[:at].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record begins here: {lines[0][:40]!r}")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            end = at + 4 + int(headers["Content-Length"])
            while len(self.held) < end + 4:
                if not self._more():
                    raise ValueError("the stream ends inside a record's body")
            if self.held[end : end + 4] != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            whole = bytes(self.held[: end + 4])
            del self.held[: end + 4]
            yield headers, whole[at + 4 : -4], whole


def inflate(source) -> Iterator[bytes]:
    """Inflate a gzip stream of one member or many, block by block, each byte once."""
    engine = zlib.decompressobj(31)
    while raw := source.read(BLOCK):
        while raw:
            if out := engine.decompress(raw, 4 * BLOCK):
                yield out
            raw = engine.unconsumed_tail or engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")
    return system, path


def _names(uri: str) -> Callable[[], tuple[str, object]]:
    system, path = _folder(uri)
    system.create_dir(path, recursive=True)

    def new():
        name = f"{uuid.uuid4().hex}.warc.gz"
        return f"{path}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)

    return new


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """(page_id, row_id, url, html, digest, n_bytes, refers string) -> (archive, records); a gzip stream a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, out, engine, size, count, done = _names(folder), None, None, 0, 0, []
        for batch in batches:
            for page, row, url, html, digest, length, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    (name, out), engine, size, count = new(), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                data = record(page, row, url, "response" if refers is None else "revisit", (html or "").encode(), digest, length, refers)
                out.write(engine.compress(data))
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.write(engine.flush())
                    out.close()
                    done.append((name, count))
                    out = None
        if out is not None:
            out.write(engine.flush())
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["archive", "records"])

    return pages.select("page_id", "row_id", "url", "html", "digest", "n_bytes", "refers").mapInArrow(write, "archive string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Monolithic archives (archive) -> the sidecar index, a row a record of the rewritten ones.

    Each stream is inflated once; each record becomes a gzip member of its own in a new file. The index, record offsets
    and lengths in the new file, is also written beside it as <name>.cdx, tab-separated.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = _names(folder)
        for batch in batches:
            for old in batch[0].to_pylist():
                system = _folder(folder)[0]
                name, out = new()
                at, index = 0, []
                with system.open_input_stream(old, compression=None) as source:
                    for headers, _, whole in Reader(inflate(source)):
                        engine = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = engine.compress(whole) + engine.flush()
                        out.write(member)
                        index.append((name, at, len(member), headers["WARC-Record-ID"], headers["WARC-Type"]))
                        at += len(member)
                out.close()
                with system.open_output_stream(f"{name}.cdx", compression=None) as side:
                    for x in index:
                        side.write(("\t".join(map(str, x[1:])) + "\n").encode())
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in index], kinds[j]) for j in range(5)], names=[x.split()[0] for x in INDEX.split(", ")])

    return archives.select("archive").mapInArrow(rewrite, INDEX)


def read_indexed(index: DataFrame, folder: str) -> DataFrame:
    """Fetch each record of the index by its offset: the record's headers, payload and checks."""
    schema = "page_id long, row_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = _folder(folder)[0]
        name, source = None, None
        for batch in batches:
            rows = []
            for archive, at, length in zip(*(batch.column(k).to_pylist() for k in ("archive", "record_at", "record_len")), strict=True):
                if archive != name:
                    name, source = archive, system.open_input_file(archive)
                engine = zlib.decompressobj(31)
                whole = engine.decompress(source.read_at(length, at))
                if not engine.eof or engine.unused_data:
                    raise ValueError(f"{archive} at {at}: the index does not name one whole member")
                ((h, body, _),) = Reader(iter([whole]))
                digest, size = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                if h["WARC-Type"] == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != size):
                    raise ValueError(f"{archive} at {at}: the payload is not what its digest says")
                page, row = h["WARC-Record-ID"][1:-1].split(":")[2:]
                refers = h.get("WARC-Refers-To")
                rows.append((int(page) if page else None, int(row), h["WARC-Target-URI"], size, digest, h["WARC-Type"], int(refers[1:-1].split(":")[2]) if refers else None, body))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(8)], names=[x.split()[0] for x in schema.split(", ")])

    return index.mapInArrow(read, schema)


def archive(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row, normalise the archives, read them back by their index.

    Null html is an empty payload, null url an empty target. Of rows with equal payloads of REVISIT_BYTES or more, the
    one with the smallest page id is the response (all of them, should rows share that id; a null id only beside null
    ids), the others revisit it. Every row gives a record; an empty table gives no file and no row. Only
    digests and ids are shuffled, so a payload that a third of all rows share is one aggregated row.
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or scratch_path(spark, "warc")
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    payload = F.encode("html", "UTF-8")
    hashed = base.select("*", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"))
    groups = hashed.filter(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null")
    groups = materialise(groups.select("digest", "first_id"), "payloads")
    joined = join_checked(hashed, groups, ["digest"], "left")
    # rows of the group's own smallest id, should it repeat, all hold the payload: none of them refers to itself
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id").cast("string"))
    rows = joined.withColumn("refers", refers).withColumn("row_id", F.monotonically_increasing_id())
    written = materialise(write_monolithic(rows, f"{folder}/monolithic"), "archives")
    tasks = max(1, min(spark.sparkContext.defaultParallelism * 4, written.count()))
    index = materialise(normalise(written.repartition(tasks), f"{folder}/members"), "index")
    return read_indexed(index, folder)
