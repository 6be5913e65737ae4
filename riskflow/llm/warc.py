"""WARC archives: writing, revisit records, and the normaliser for whole-file gzip.

A crawl dump is one gzip stream over many records, from which no record can be read
alone. The normaliser inflates each such file once, as a stream, rewrites every record
as a gzip member of its own and writes a sidecar index (page, offset, length) beside it,
by which the records are read.
Records whose payload occurs elsewhere become revisits on the way, so payloads are
never shuffled: only (digest, page, file) rows are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import materialise, partitions, scratch, utf8
from riskflow.llm.tokenfile import _fs, _put

LEAST = 100                  # payload bytes from which equal payloads are told once
CHUNK = 1 << 18
READ_BYTES = 8 << 20         # payload bytes of one batch of records read
NO_PAGE = -2**63             # of a record without a page, in the sidecar
LEVEL = 6
# Of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

INDEX = "file string, page long, offset long, length long"


def record(kind: str, page: str, payload: bytes, digest: str, size: int, refers: str | None = None) -> bytes:
    """One record; ``size`` and ``digest`` are those of the full payload, also for a revisit."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", DATE),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size)), ("Content-Type", "text/html; charset=utf-8")]
    if refers is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", PROFILE)]
    head.append(("Content-Length", str(len(payload))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError("not a WARC record")
    return dict(x.split(": ", 1) for x in lines[1:] if x)


def _inflated(stream) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of one member or several, CHUNK by CHUNK."""
    z = zlib.decompressobj(31)
    while raw := stream.read(CHUNK):
        while raw:
            yield z.decompress(raw, CHUNK)
            raw = z.unconsumed_tail
            if z.eof:
                raw, z = z.unused_data, zlib.decompressobj(31)
    yield z.flush()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head, payload) of each record of a gzip stream; holds one record at a time."""
    held, source = bytearray(), _inflated(stream)

    def need(n: int) -> bool:
        while len(held) < n:
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not need(len(held) + 1):
                if held.strip():
                    raise ValueError("the archive ends within a record")
                return
        head = parse_head(bytes(held[:at]))
        size = int(head["Content-Length"])
        if not need(at + 4 + size + 4):
            raise ValueError("the archive ends within a record")
        yield head, bytes(held[at + 4:at + 4 + size])
        del held[:at + 4 + size + 4]


def _page(urn: str) -> str:
    return urn.removeprefix("<urn:page:").removesuffix(">")


def _dump_batches(uri: str):
    """Rows (page, html) -> one monolithic archive a partition, and a row a record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        fs, root = _fs(uri)
        fs.create_dir(root, recursive=True)
        name = f"dump-{ctx.partitionId():06d}.warc.gz"
        said: list[tuple] = []

        def body(out):
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            for b in batches:
                data, off = utf8(b.column("html"))
                for page, a, c in zip(b.column("page").to_pylist(), off[:-1], off[1:]):
                    payload = data[a:c].tobytes()
                    digest = hashlib.sha256(payload).hexdigest()
                    out.write(z.compress(record("response", "" if page is None else str(page), payload, digest, len(payload))))
                    said.append((name, len(said), page, digest, len(payload)))
            out.write(z.flush())

        _put(fs, f"{root}/{name}", ctx.taskAttemptId(), body)
        cols = list(zip(*said)) if said else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()])],
                                         ["file", "at", "page", "digest", "size"])
    return run


def dump(pages: DataFrame, uri: str, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Write monolithic archives; returns (file, at, page, digest, size) of every record."""
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return materialise(rows.mapInArrow(_dump_batches(uri), "file string, at long, page long, digest string, size long"), "records")


def revisits(said: DataFrame) -> DataFrame:
    """(file, at, refers): the records whose payload of LEAST bytes or more belongs to a
    smaller page, or to the same page in an earlier file and place."""
    big = said.where(f"size >= {LEAST}").withColumn("key", F.struct(F.coalesce("page", F.lit(2**63 - 1)).alias("p"), "file", "at", "page"))
    first = big.groupBy("digest").agg(F.min("key").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    return (big.join(materialise(first, "first"), "digest").where("key != low")          # stored, so that AQE can split the join
            .select("file", "at", F.coalesce(F.col("low.page").cast("string"), F.lit("")).alias("refers")))


def _normalise_batches(uri: str, out_uri: str):
    """(file, list of (at, refers)) -> the file with one member a record, its index, and index rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(uri)
        out_fs, out_root = _fs(out_uri)
        out_fs.create_dir(out_root, recursive=True)
        for b in batches:
            for file, points in zip(b.column("file").to_pylist(), b.column("points").to_pylist()):
                refers = {p["at"]: p["refers"] for p in points or ()}
                name, index = file.replace("dump-", "part-"), []

                def body(out):
                    offset = 0
                    with fs.open_input_stream(f"{root}/{file}", compression=None) as src:
                        for at, (head, payload) in enumerate(records(src)):
                            digest, page = head["WARC-Payload-Digest"].removeprefix("sha256:"), _page(head["WARC-Record-ID"])
                            if at in refers:
                                raw = record("revisit", page, b"", digest, len(payload), refers[at])
                            else:
                                raw = record("response", page, payload, digest, len(payload))
                            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                            member = z.compress(raw) + z.flush()
                            out.write(member)
                            index.append((int(page) if page else None, offset, len(member)))
                            offset += len(member)

                _put(out_fs, f"{out_root}/{name}", TaskContext.get().taskAttemptId(), body)
                _put(out_fs, f"{out_root}/{name}.idx", TaskContext.get().taskAttemptId(),
                     lambda out: out.write(b"".join(struct.pack("<qqq", NO_PAGE if p is None else p, o, n) for p, o, n in index)))
                cols = list(zip(*index)) if index else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(index), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], ["file", "page", "offset", "length"])
    return run


def normalise(said: DataFrame, points: DataFrame, uri: str, out_uri: str) -> DataFrame:
    """Rewrite the dumps; returns the index (file, page, offset, length). A file is read by
    one task as a stream; its list of revisits is bounded by its records."""
    files = said.select("file").distinct()
    each = files.join(points.groupBy("file").agg(F.collect_list(F.struct("at", "refers")).alias("points")), "file", "left")
    # dealt round, as the join has left its few small rows in one partition, dealt by the same key
    return materialise(each.repartition(partitions(said.sparkSession)).mapInArrow(_normalise_batches(uri, out_uri), INDEX), "index")


def read_index(fs, path: str) -> list[tuple[int | None, int, int]]:
    """(page, offset, length) of each record, from the sidecar of an archive."""
    with fs.open_input_file(f"{path}.idx") as f:
        return [(None if p == NO_PAGE else p, o, n) for p, o, n in struct.iter_unpack("<qqq", f.read())]


def _read_batches(uri: str):
    """Names of archives -> the records, each inflated from its own member by one ranged read
    at the place that the sidecar gives."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(uri)
        for file in (f for b in batches for f in b.column("file").to_pylist()):
            out, held = [], 0
            with fs.open_input_file(f"{root}/{file}") as src:
                for said, offset, length in read_index(fs, f"{root}/{file}"):
                    raw = zlib.decompress(src.read_at(length, offset), 31)
                    at = raw.index(b"\r\n\r\n")
                    head, payload = parse_head(raw[:at]), raw[at + 4:-4]
                    kind, digest, page = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), _page(head["WARC-Record-ID"])
                    if (int(page) if page else None) != said:
                        raise ValueError(f"the index of {file} names page {said} at {offset}, where {page or 'none'} lies")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of page {page} does not fit its digest")
                    refers = _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else ""
                    out.append((said, int(head["X-Payload-Length"]), digest, kind, int(refers) if refers else None, payload if kind == "response" else None))
                    held += len(payload)
                    if held > READ_BYTES:
                        yield rows(out)
                        out, held = [], 0
            yield rows(out)
    return run


def read(index: DataFrame, uri: str) -> DataFrame:
    """(page, payload_bytes, payload_digest, record_type, refers_to, payload) of the archives
    named in ``index``, one task an archive, by their sidecars."""
    files = materialise(index.select("file").distinct(), "files")
    return (files.repartition(partitions(index.sparkSession))
            .mapInArrow(_read_batches(uri), "page long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"))


def archive(pages: DataFrame, uri: str, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Write ``pages`` as monolithic dumps, normalise them under ``uri`` and return the index.

    Null payloads are empty. Of equal payloads of LEAST bytes the smallest page is the
    response (of repeated rows of a page the first in its file); pages without an id come
    after all others. An empty table gives an empty index. Other columns are not written.
    """
    raw = scratch(pages.sparkSession, "dump")
    said = dump(pages, raw, page_id, html)
    return normalise(said, revisits(said), raw, uri)
