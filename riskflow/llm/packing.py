"""Bounded-space online packing of token ids into sequences of fixed length.

Each partition reads its documents as they come, encodes them and cuts each into full
sequences and a rest. Rests go best-fit into at most OPEN open windows; when none fits,
the fullest window is emitted. The pieces in windows still open at the end of a partition are
leftovers: FAN partitions at a time they are packed again, largest first, and all but the
OPEN emptiest windows are emitted; the rest goes up a level, until one group is left. So
a task holds OPEN windows, or those of FAN groups, however large the table is.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import materialise, utf8
from riskflow.llm.tokens import encoder

LENGTH = 2048
OPEN = 128           # open windows a partition
FAN = 32             # groups of leftovers that one task merges
PART_BIT, LEVEL_BIT = 32, 56     # a sequence id is its level, its task and its number there

PIECES = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                    ("window", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()), ("part", pa.int64())])
PIECES_SQL = "doc long, start long, length long, ids binary, doc_tokens long, window long, offset long, open boolean, part long"


class Windows:
    """At most ``most`` open windows of ``length``; ``put`` returns the windows it closes."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.free: list[tuple[int, int]] = []            # (free tokens, number), ascending
        self.items: dict[int, list] = {}
        self.next = 0

    def put(self, size: int, item) -> list[tuple[int, list]]:
        """Best fit: the window that the item fills most. An item of a whole window is one of
        its own and leaves the open ones alone."""
        if size == self.length:
            self.next += 1
            return [(self.next - 1, [(0, item)])]
        out = []
        at = bisect.bisect_left(self.free, (size, -1))
        if at == len(self.free):
            if len(self.free) >= self.most:
                out.append(self._close(0))               # the fullest
            number, room = self.next, self.length
            self.next += 1
            self.items[number] = []
        else:
            room, number = self.free.pop(at)
        self.items[number].append((self.length - room, item))
        bisect.insort(self.free, (room - size, number))
        if room == size:
            out.append(self._close(0))
        return out

    def _close(self, at: int) -> tuple[int, list]:
        _, number = self.free.pop(at)
        return number, self.items.pop(number)

    def rest(self) -> list[tuple[int, list]]:
        out = [(number, self.items[number]) for _, number in sorted(self.free, key=lambda x: x[1])]
        self.free, self.items = [], {}
        return out


def _pack_batches(path: str, pieces: str | None, end: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        windows, enc = Windows(length, OPEN), encoder(path, pieces)
        rows: list[tuple] = []

        def emit(closed, is_open):
            for number, items in closed:
                for offset, (doc, start, ids, total) in items:
                    rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, number, offset, is_open, part))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(PIECES), PIECES)], schema=PIECES)
            rows.clear()
            return out

        for b in batches:
            data, off = utf8(b.column("text"))
            docs = b.column("doc").to_pylist()
            raw = data.tobytes() if off[0] == 0 and off[-1] == len(data) else data[off[0]:off[-1]].tobytes()
            ids, at = enc([raw[off[i] - off[0]:off[i + 1] - off[0]].decode("utf-8", "replace") for i in range(len(docs))])
            for i, doc in enumerate(docs):
                own = np.append(ids[at[i]:at[i + 1]], np.uint32(end))
                for start in range(0, len(own), length):
                    piece = own[start:start + length]
                    emit(windows.put(len(piece), (doc, start, piece.copy(), len(own))), False)
            yield flush()
        emit(windows.rest(), True)
        yield flush()
    return run


def _merge_batches(length: int, last: bool):
    """Leftover pieces (group, part, window, at, size), largest first -> the window and
    offset each one gets. Emitted windows are final; pieces of the others go up a level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, group, closed = Windows(length, OPEN * FAN), None, []

        def rows(done, is_open):
            flat = [(*item, group, number, offset, is_open) for number, items in done for offset, item in items]
            cols = list(zip(*flat)) if flat else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*[pa.int64()] * 7, pa.bool_()])],
                                              ["part", "window", "at", "size", "p", "w", "offset", "open"])

        def end():
            stay = {number for _, number in windows.free[-OPEN:]} if not last else set()
            rest = windows.rest()
            yield rows(closed + [x for x in rest if x[0] not in stay], False)
            yield rows([x for x in rest if x[0] in stay], True)

        for b in batches:
            for g, part, window, at, size in zip(*(b.column(i).to_pylist() for i in range(5))):
                if group is not None and g != group:
                    yield from end()
                    closed, windows = [], Windows(length, OPEN * FAN)
                group = g
                closed += windows.put(size, (part, window, at, size))
            if closed:
                yield rows(closed, False)
                closed = []
        yield from end()
    return run


def pack(docs: DataFrame, path: str, pieces: str | None = None, end: int = 1, length: int = LENGTH,
         text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, start, length, ids, doc_tokens, sequence_id, offset): the pieces of every row.

    ``ids`` are little-endian unsigned 32-bit. Null and empty texts are one piece with
    the end id alone. Repeated rows are packed as often as they occur, with equal
    (doc, start); a null id is kept. An empty table gives an empty table. Other columns
    are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    first = materialise(rows.mapInArrow(_pack_batches(path, pieces, end, length), PIECES_SQL), "pieces")
    left = first.where("open").select("part", "window", F.col("offset").alias("at"), F.col("length").alias("size"), F.col("part").alias("p"))
    cols = ["doc", "start", "length", "ids", "doc_tokens"]
    number = F.shiftleft("p", PART_BIT) + F.col("w")
    out = first.where("not open").select(*cols, (F.shiftleft("part", PART_BIT) + F.col("window")).alias("sequence_id"), "offset")
    level = 1
    while (top := left.agg(F.max("p")).first()[0]) is not None:
        groups = left.select((F.col("p") / FAN).cast("long").alias("g"), "part", "window", "at", "size").repartition(top // FAN + 1, "g")
        moved = materialise(groups.sortWithinPartitions("g", F.desc("size"), "part", "window", "at")
                            .mapInArrow(_merge_batches(length, top < FAN), "part long, window long, at long, size long, p long, w long, offset long, open boolean"), "moved")
        final = moved.where("not open").select("part", "window", "at", (F.lit(level << LEVEL_BIT) + number).alias("sequence_id"), "offset")
        out = out.unionByName(first.where("open").withColumnRenamed("offset", "at").join(final, ["part", "window", "at"])
                              .select(*cols, "sequence_id", "offset"))
        left = moved.where("open").select("part", "window", "at", "size", "p")
        level += 1
    return out
