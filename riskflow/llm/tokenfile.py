"""Token shards with Elias-Fano document boundaries.

A shard holds the ids of consecutive documents, one after the other, in ``<name>.ids``
(little-endian, 2 bytes an id where the vocabulary allows, else 4) and an index of two
Elias-Fano sequences in ``<name>.ef``: the document ids and the end of each document.
A monotone sequence of n values below u takes about n * (2 + log2(u / n)) bits: low
bits packed, high bits in unary, and the position of every SAMPLE-th one, from which
``select`` finds any value without a table of offsets.

Files are written under a task attempt's own name and moved into place, so a task that
runs again replaces what a lost one left.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import materialise, partitions, utf8
from riskflow.llm.tokens import encoder

MAGIC = b"EFTOKEN1"
SAMPLE = 256            # ones between two samples of the select structure
READ_IDS = 1 << 20      # ids read at once
_HEAD = struct.Struct("<qqqqi")       # first value, count, universe, ones' bytes, low bits


@dataclass
class EliasFano:
    """A non-decreasing sequence of integers; only their distance from the first is stored."""
    base: int
    n: int
    universe: int
    bits: int
    low: np.ndarray          # bit-packed low parts
    high: np.ndarray         # unary high parts
    samples: np.ndarray      # position of every SAMPLE-th one

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        base = int(v[0]) if len(v) else 0
        v = (v - base).astype(np.uint64)
        n, universe = len(v), int(v[-1]) + 1 if len(v) else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(base, n, universe, bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4" if len(high) < 1 << 32 else "<u8"))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.base, self.n, self.universe, len(self.high), self.bits)
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        base, n, universe, size, bits = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        part = []
        wide = "<u4" if size * 8 < 1 << 32 else "<u8"
        for count, kind in (((n * bits + 7) // 8, np.uint8), (size, np.uint8), (-(-n // SAMPLE), wide)):
            part.append(np.frombuffer(raw, kind, count, at))
            at += part[-1].nbytes
        return cls(base, n, universe, bits, *part), at

    def _low(self, a: int, b: int) -> np.ndarray:
        first, last = a * self.bits, b * self.bits
        raw = np.unpackbits(self.low[first // 8:(last + 7) // 8], bitorder="little")[first % 8:first % 8 + last - first]
        return (raw.reshape(-1, self.bits).astype(np.int64) << np.arange(self.bits)).sum(1) if self.bits else np.zeros(b - a, np.int64)

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it to the one that stands for it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte:byte + 64], bitorder="little")) + byte * 8
            ones = ones[ones >= at]
            if len(ones) > left:
                return self.base + ((int(ones[left]) - i) << self.bits) + int(self._low(i, i + 1)[0])
            left, byte = left - len(ones), byte + 64
            at = byte * 8

    def values(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        return self.base + ((ones - np.arange(self.n)) << self.bits) + self._low(0, self.n)


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _put(fs, path: str, attempt: int, write) -> None:
    own = f"{path}.{attempt}.tmp"
    with fs.open_output_stream(own, compression=None) as out:
        write(out)
    fs.move(own, path)


def _write_batches(uri: str, tokenizer: str, pieces: str | None, end: int, width: int | None):
    """Sorted rows (doc, text) of a partition -> one shard, and its row of the manifest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        fs, root = _fs(uri)
        fs.create_dir(root, recursive=True)
        enc, ids, ends, total = encoder(tokenizer, pieces), [], [], 0
        path = f"{root}/shard-{part:06d}"
        largest = max(enc.largest, end)
        size = width or (2 if largest < 1 << 16 else 4)
        if largest >= 1 << 8 * size:
            raise ValueError(f"ids up to {largest} do not fit in {size} bytes")

        def body(out):
            nonlocal total
            for b in batches:
                data, off = utf8(b.column("text"))
                raw = data[off[0]:off[-1]].tobytes()
                at = (off - off[0]).tolist()
                x, cut = enc([raw[a:c].decode("utf-8", "replace") for a, c in zip(at, at[1:])])
                x = np.insert(x, cut[1:], end)
                out.write(x.astype(f"<u{size}").tobytes())
                ids.append(b.column("doc").to_numpy(zero_copy_only=False))
                ends.append(total + cut[1:] + np.arange(1, len(cut)))
                total += len(x)

        _put(fs, f"{path}.ids", attempt, body)
        docs = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        index = MAGIC + struct.pack("<i", size) + EliasFano.encode(docs).to_bytes() + EliasFano.encode(np.concatenate(ends) if ends else docs).to_bytes()
        _put(fs, f"{path}.ef", attempt, lambda out: out.write(index))
        yield pa.RecordBatch.from_pydict({"part": [part], "shard": [f"shard-{part:06d}"], "n_docs": [len(docs)], "n_ids": [total]})
    return run


def read_index(uri: str, shard: str) -> tuple[int, EliasFano, EliasFano]:
    """Bytes an id, the document ids and their ends in the shard."""
    fs, root = _fs(uri)
    with fs.open_input_file(f"{root}/{shard}.ef") as f:
        raw = f.read()
    if raw[:len(MAGIC)] != MAGIC:
        raise ValueError(f"not a token index: {shard}")
    width, = struct.unpack_from("<i", raw, len(MAGIC))
    docs, at = EliasFano.from_bytes(raw, len(MAGIC) + 4)
    return width, docs, EliasFano.from_bytes(raw, at)[0]


def read_document(uri: str, shard: str, i: int) -> np.ndarray:
    """Ids of the i-th document of a shard, by two selects and one ranged read."""
    width, _, ends = read_index(uri, shard)
    a, b = ends.select(i - 1) if i else 0, ends.select(i)
    fs, root = _fs(uri)
    with fs.open_input_file(f"{root}/{shard}.ids") as f:
        return np.frombuffer(f.read_at((b - a) * width, a * width), f"<u{width}").astype(np.uint32)


def _read_batches(uri: str):
    """Manifest rows (shard, n_docs, base) -> each document from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(uri)
        for b in batches:
            for shard, base in zip(b.column("shard").to_pylist(), b.column("base").to_pylist()):
                width, docs, ends = read_index(uri, shard)
                doc, end = docs.values(), ends.values()
                start = np.concatenate([[0], end[:-1]])
                with fs.open_input_file(f"{root}/{shard}.ids") as f:
                    i = 0
                    while i < len(end):
                        j = max(i + 1, int(np.searchsorted(end, start[i] + READ_IDS, "right")))
                        raw = np.frombuffer(f.read_at(int(end[j - 1] - start[i]) * width, int(start[i]) * width), f"<u{width}").astype("<u4")
                        ids = [raw[a:c].tobytes() for a, c in zip(start[i:j] - start[i], end[i:j] - start[i])]
                        yield pa.RecordBatch.from_arrays([pa.array(doc[i:j]), pa.array(base + start[i:j]), pa.array(end[i:j] - start[i:j]), pa.array(ids, pa.binary())], ["doc", "start", "n_tokens", "ids"])
                        i = j
    return run


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, pieces: str | None = None, end: int = 0, width: int | None = None,
                 text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write all rows in ascending id order under ``uri``; returns the manifest
    (part, shard, n_docs, n_ids, base), where base counts the ids of all shards before.

    An id takes 2 bytes where the vocabulary and ``end`` allow it, else 4; with a ``width`` too
    small for them the job raises. Null and empty texts are the end id alone; long ones are
    encoded in segments. Rows that share an id follow one another,
    ordered by a hash of the text. A row without an id has no place in the order: such rows raise no
    error and are left out. An empty table writes empty shards.
    """
    spark = docs.sparkSession
    rows = (docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc is not null")
            .withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(spark), "doc", "tie").sortWithinPartitions("doc", "tie", "text"))
    done = materialise(rows.mapInArrow(_write_batches(uri, tokenizer, pieces, end, width), "part long, shard string, n_docs long, n_ids long"), "manifest")
    # one row a shard, so the running sum sees as many rows as there are partitions
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame, uri: str) -> DataFrame:
    """(doc, start, n_tokens, ids) of every document in the files; ids as little-endian
    unsigned 32-bit. One task a shard, READ_IDS ids (or one document) at a time."""
    n = partitions(manifest.sparkSession)
    return (manifest.where("n_docs > 0").select("shard", "base").repartition(n, "shard")
            .mapInArrow(_read_batches(uri), "doc long, start long, n_tokens long, ids binary"))
