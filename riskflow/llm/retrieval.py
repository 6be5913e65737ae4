"""Ranked lexical search: term-at-a-time scoring with a limited number of accumulators.

The documents become postings of the query terms once. Each task then scores blocks of
documents against every item, term by term, the rarest first. A document gets an
accumulator when one of its terms is met, until the largest scores that the remaining
terms can still give no longer reach the k-th best partial score; from then on the
accumulators there are updated exactly and no new ones are made. The k best of a task
are merged with those of the others.

A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), all else 64-bit integer:
m = 100 - B + (B n N) div L, score = sum of w * ((10^9 tf) div (1000 tf + 8 m)).

The queries are read in blocks of BLOCK_TERMS terms, so that what a task holds of them is
bounded; each block ranks all documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskflow.llm.common import materialise, segments, tune

TOP = 10
LENGTH_PERCENT = 90
#: Distinct (item, term) pairs of the queries that one pass over the documents serves.
BLOCK_TERMS = 100_000
#: Documents and postings that one round of scoring holds.
BLOCK_DOCS, BLOCK_POSTINGS = 20_000, 2_000_000
#: Shares in which the results of the tasks are merged first.
MERGE = 64

# Terms are runs of ASCII letters and digits and of all characters beyond ASCII; in UTF-8
# the latter are the bytes from 0x80.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
NO_TERM = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in pieces that bound what is held at once."""
    for part in segments(raw, NO_TERM):
        yield TERM.findall(part.lower())


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, out = [], []
        for i, raw in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
            found = {w for part in terms(raw or b"") for w in part}
            at += [i] * len(found)
            out += found
        yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(at, pa.int64())), pa.array(out, pa.binary()).cast(pa.string())], ["item", "term"])


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """[(item, its terms)], at most ``size`` pairs a block (or one item)."""
    block, held = [], 0
    item, words = None, []

    def add():
        nonlocal block, held
        if words and held and held + len(words) > size:
            done, block, held = block, [], 0
            block.append((item, words))
            held = len(words)
            return done
        if words:
            block.append((item, words))
            held += len(words)
        return None

    for row in items.sort("item", "term").toLocalIterator():
        if row["item"] != item:
            if (done := add()) is not None:
                yield done
            item, words = row["item"], []
        words.append(row["term"].encode())
    if (done := add()) is not None:
        yield done
    if block:
        yield block


def _postings(vocab: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sizes, ids, tfs = [], [0], [], []
            for raw in b.column("text").cast(pa.binary()).to_pylist():
                total, found = 0, []
                for part in terms(raw or b""):
                    total += len(part)
                    got = np.fromiter(map(vocab.get, part, repeat(-1)), np.int32, len(part))
                    found.append(got[got >= 0])
                t, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                n.append(total)
                ids.append(t)
                tfs.append(c)
                sizes.append(sizes[-1] + len(t))
            off = pa.array(sizes, pa.int32())
            cat = lambda x, dtype: np.concatenate(x).astype(dtype) if x else np.zeros(0, dtype)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(off, pa.array(cat(ids, np.int32))),
                                              pa.ListArray.from_arrays(off, pa.array(cat(tfs, np.int64)))], ["doc", "n", "terms", "tfs"])
    return run


class Scorer:
    """The running k best of each item over blocks of documents."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.k = items, weights, n_docs, n_terms, k
        self.best: list[list[tuple[int, object]]] = [[] for _ in items]
        self.created = self.postings = 0

    def add(self, docs: pa.Array, n: np.ndarray, doc_of: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """One block: postings (doc_of, term, tf) of the documents ``docs`` of ``n`` terms."""
        m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * self.n_docs) // self.n_terms
        by = np.argsort(term, kind="stable")
        doc_of, term, tf = doc_of[by], term[by], tf[by]
        gain = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc_of]))
        start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.weights)))])
        most = np.zeros(len(self.weights), np.int64)
        there = np.flatnonzero(np.diff(start))
        if len(there):
            most[there] = np.maximum.reduceat(gain, start[there])
        place = pc.rank(docs, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
        acc = np.zeros(len(docs), np.int64)
        for i, mine in enumerate(self.items):
            mine = mine[start[mine + 1] > start[mine]]
            if not len(mine):
                continue
            acc[:] = 0
            self._accumulate(acc, mine, doc_of, gain, start, most, self.floor(i))
            least = max(self.floor(i), self._kth(acc), 1)
            at = np.flatnonzero(acc >= least)
            at = at[np.lexsort((place[at], -acc[at]))[:self.k]]
            found = zip((-acc[at]).tolist(), docs.take(pa.array(at)).to_pylist())
            self.best[i] = sorted([*self.best[i], *found])[:self.k]

    def floor(self, i: int) -> int:
        """The k-th best score of the item so far."""
        return -self.best[i][-1][0] if len(self.best[i]) == self.k else 0

    def _kth(self, acc: np.ndarray) -> int:
        return int(np.partition(acc, -self.k)[-self.k]) if len(acc) >= self.k else 0

    def _accumulate(self, acc, mine, doc_of, gain, start, most, floor) -> None:
        rest = np.cumsum(most[mine][::-1])[::-1]
        creating = True
        for j, t in enumerate(mine):
            a, b = start[t], start[t + 1]
            # a document met only from here on gets rest[j] at most; equal scores may still win by their id
            if creating and (floor > rest[j] or self._kth(acc) > rest[j]):
                creating = False
            docs, add = doc_of[a:b], gain[a:b]
            self.postings += b - a
            if creating:
                self.created += int(np.count_nonzero(acc[docs] == 0))
            else:
                live = acc[docs] > 0
                docs, add = docs[live], add[live]
            acc[docs] += add


def _rank(items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int, doc_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(items, weights, n_docs, n_terms, k)
        held, docs, posts = [], 0, 0

        def flush():
            nonlocal held, docs, posts
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column("terms").combine_chunks() if t.num_rows else None
            lens = pc.list_value_length(lists).to_numpy()
            score.add(t.column("doc").combine_chunks(), t.column("n").to_numpy(), np.repeat(np.arange(t.num_rows), lens),
                      lists.flatten().to_numpy(), t.column("tfs").combine_chunks().flatten().to_numpy())
            held, docs, posts = [], 0, 0

        for b in batches:
            for a in range(0, b.num_rows, BLOCK_DOCS):
                part = b.slice(a, BLOCK_DOCS)
                held.append(part)
                docs += part.num_rows
                posts += pc.sum(pc.list_value_length(part.column("terms"))).as_py() or 0
                if docs >= BLOCK_DOCS or posts >= BLOCK_POSTINGS:
                    flush()
        if docs:
            flush()
        rows = [(i, -s, d) for i, best in enumerate(score.best) for s, d in best]
        share = TaskContext.get().partitionId() % MERGE
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], doc_type),
                                          pa.array([r[1] for r in rows], pa.int64()), pa.array([share] * len(rows), pa.int32())], ["at", "doc", "score", "share"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", doc_id: str = "doc_id",
           item_text: str = "text", item_id: str = "item_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, doc, score): the ``k`` best documents with a score above 0 of each item.

    Equal scores go by ascending document id. Null and empty texts, and texts without a
    term, match nothing and count nowhere. Documents without an id count in the
    statistics and are not ranked; items without an id are left out. Repeated document
    rows rank once each; rows of one item id are one item with the terms of all of them.
    Texts may be of any length: they are read in pieces. Other columns, whatever their
    names, are not looked at. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    tune(spark)
    src = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null")
    item_type, doc_type = asked.schema["item"].dataType, src.schema["doc"].dataType
    pairs = materialise(asked.mapInArrow(_item_terms, f"item {item_type.simpleString()}, term string").distinct(), "terms")
    out = spark.createDataFrame([], f"item {item_type.simpleString()}, rank int, doc {doc_type.simpleString()}, score long")
    for block in _blocks(pairs, block_terms):
        out = out.unionByName(_search_block(src, block, k, item_type, doc_type))
    return out


def _search_block(src: DataFrame, block, k: int, item_type, doc_type) -> DataFrame:
    spark = src.sparkSession
    vocab = {t: i for i, t in enumerate(sorted({t for _, ts in block for t in ts}))}
    posts = materialise(src.mapInArrow(_postings(vocab), f"doc {doc_type.simpleString()}, n long, terms array<int>, tfs array<long>").where("n > 0"), "postings")
    total = posts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = np.zeros(len(vocab), np.int64)
    for t, c in posts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():     # one row a term of the block
        df[t] = c
    weights = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    asked = []
    for _, ts in block:
        mine = np.array([vocab[t] for t in ts], np.int64)
        mine = mine[df[mine] > 0]
        asked.append(mine[np.lexsort((mine, df[mine]))])
    found = (posts.where("doc is not null")
             .mapInArrow(_rank(asked, weights, total["n"], max(1, total["l"]), k, to_arrow_type(doc_type)), f"at int, doc {doc_type.simpleString()}, score long, share int"))
    for by in (["at", "share"], ["at"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"at int, item {item_type.simpleString()}")
    return found.join(F.broadcast(names), "at").select("item", "rank", "doc", "score")
