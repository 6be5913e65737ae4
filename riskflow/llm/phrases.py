"""Phrase collocation mining over vertically partitioned, depth-truncated suffix subtrees.

Texts are pieces of words; a suffix is the DEPTH words from a position to the end of its
piece at most. The suffixes are partitioned by their prefixes: words (with their language)
are dealt into as many groups as their counts need at BUDGET suffixes a group. A word over
its share of a budget is heavy: a prefix of heavy words is replaced by its extensions by one
word, as no phrase is more frequent than its rarest word, and these are dealt over groups
of the first word's own. Each group sorts its suffixes into a subtree and reads the count of
every phrase from the leaf totals under its node; only nodes of heavy words alone lie in
several groups and are summed. Words rarer than a phrase may be end a suffix, as no
candidate holds them.

Equal suffixes of a block of text are merged before they are sent. What is broadcast is a
bitmap of fixed size (which words are frequent) and the words over budget, at most HEAVY.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import FILTER_BITS, materialise, mix, segments, tune

DEPTH = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
COVER = 80
#: Suffixes that one group holds, and words of one block of text.
BUDGET = 1_500_000
BLOCK_WORDS = 1_000_000
#: Most prefixes that are extended to full depth.
HEAVY = 1 << 16
NO_LANG = "und"

TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]")
SPACE = re.compile(rb"[ \t\n-\r]")
END = re.compile(rb"[.,;:!?\n-\r]")


def tokens(raw: bytes) -> Iterator[list[bytes]]:
    """Words and the marks that end a piece, in parts that bound what is held at once."""
    for part in segments(raw, SPACE):
        yield TOKEN.findall(part.lower())


def _bit(lang: bytes, word: bytes) -> int:
    return zlib.crc32(lang + b"\0" + word) % FILTER_BITS


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    for b in batches:
        yield from zip(b.column("lang").cast(pa.binary()).to_pylist(), b.column("text").cast(pa.binary()).to_pylist())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f) summed over blocks."""
    seen: dict[bytes, Counter] = {}
    held = 0

    def out():
        for lang, c in seen.items():
            words = [w for w in c if not END.match(w)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.binary()).cast(pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
                                              pa.array([c[w] for w in words], pa.int64())], ["lang", "word", "f"])

    for lang, raw in _texts(batches):
        for part in tokens(raw or b""):
            seen.setdefault(lang, Counter()).update(part)
            held += len(part)
        if held >= 4 * BLOCK_WORDS:
            yield from out()
            seen, held = {}, 0
    yield from out()


class Router:
    """Which group a suffix goes to: its first word's, or one by its prefix up to the first
    word that is not heavy."""

    def __init__(self, groups: int, heavy: dict[bytes, tuple[int, int]]):
        self.groups, self.heavy = groups, heavy         # heavy: lang NUL word -> (first group, shares)

    def is_heavy(self, lang: bytes, words: list[bytes]) -> np.ndarray:
        return np.fromiter((lang + b"\0" + w in self.heavy for w in words), bool, len(words))

    def deal(self, lang: bytes, words: list[bytes], ids: np.ndarray) -> np.ndarray:
        """Groups of the suffixes ``ids`` (rows of DEPTH word numbers, -1 beyond the end)."""
        crc = np.fromiter((zlib.crc32(lang + b"\0" + w) for w in words), np.uint64, len(words))
        first, shares = (mix(crc + np.uint64(1)) % np.uint64(self.groups)).astype(np.int64), np.ones(len(words), np.uint64)
        heavy = self.is_heavy(lang, words)
        for i in np.flatnonzero(heavy):
            first[i], shares[i] = self.heavy[lang + b"\0" + words[i]]
        h, on = np.zeros(len(ids), np.uint64), np.ones(len(ids), bool)
        for k in range(DEPTH):
            at, there = np.maximum(ids[:, k], 0), ids[:, k] >= 0
            h = np.where(on, mix(h * np.uint64(31) + np.where(there, crc[at], np.uint64(7)) + np.uint64(k)), h)
            on &= there & heavy[at]
        return first[ids[:, 0]] + (h % shares[ids[:, 0]]).astype(np.int64)


def _merged(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes of two words or more of a stream of word numbers (-1 ends a piece), with counts."""
    n = len(stream)
    padded = np.concatenate([stream, np.full(DEPTH, -1, stream.dtype)])
    cols = [padded[k:n + k].astype(np.int64) for k in range(DEPTH)]
    for k in range(1, DEPTH):
        cols[k] = np.where(cols[k - 1] >= 0, cols[k], -1)
    on = cols[1] >= 0
    size = int(stream.max(initial=0)) + 2
    pair = [((cols[k] + 1) * size + cols[k + 1] + 1)[on] for k in (0, 2)]
    by = np.lexsort(pair[::-1])
    pair = [p[by] for p in pair]
    new = np.ones(len(by), bool)
    new[1:] = (pair[0][1:] != pair[0][:-1]) | (pair[1][1:] != pair[1][:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(by)))
    ids = np.stack([pair[0][at] // size, pair[0][at] % size, pair[1][at] // size, pair[1][at] % size], axis=1) - 1
    return ids, counts


def _emit(lang: bytes, words: list[bytes], stream: np.ndarray, router: Router) -> Iterator[pa.RecordBatch]:
    """Rows (grp, lang, text, counts): the block's suffixes of each group, one a line."""
    ids, counts = _merged(stream)
    if not len(ids):
        return
    grp = router.deal(lang, words, ids)
    by = np.argsort(grp, kind="stable")
    ids, counts, grp = ids[by], counts[by], grp[by]
    table = pa.array(words, pa.large_binary())
    col = [table.take(pa.array(np.maximum(ids[:, k], 0), mask=ids[:, k] < 0)) for k in range(DEPTH)]
    lines = pc.binary_join_element_wise(*col, pa.scalar(b" ", pa.large_binary()), null_handling="skip")
    lines = pc.binary_join_element_wise(lines, pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    off = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:lines.offset + len(lines) + 1]
    data = lines.buffers()[2]
    cut = np.append(np.flatnonzero(np.diff(grp, prepend=-1)), len(grp))
    codec = pa.Codec("zstd", 1)
    for a, b in zip(cut[:-1], cut[1:]):
        text = data[int(off[a]):int(off[b])]
        yield pa.RecordBatch.from_arrays([
            pa.array([int(grp[a])], pa.int64()), pa.array([lang], pa.binary()).cast(pa.string()),
            pa.array([codec.compress(text).to_pybytes()], pa.binary()), pa.array([len(text)], pa.int64()),
            pa.array([codec.compress(counts[a:b].astype(np.int64).tobytes()).to_pybytes()], pa.binary()), pa.array([int(b - a)], pa.int64())],
            ["grp", "lang", "text", "size", "counts", "n"])


def _suffixes(bitmap: bytes, router: Router):
    frequent = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[bytes, tuple[dict, list, list]] = {}
        held = 0

        def out():
            for lang, (known, words, parts) in blocks.items():
                yield from _emit(lang, words, np.concatenate(parts), router)

        for lang, raw in _texts(batches):
            known, words, parts = blocks.setdefault(lang, ({}, [], []))
            for part in tokens(raw or b""):
                for w in set(part).difference(known):
                    if END.match(w) or not frequent[_bit(lang, w)]:
                        known[w] = -1
                    else:
                        known[w] = len(words)
                        words.append(w)
                parts.append(np.fromiter(map(known.__getitem__, part), np.int32, len(part)))
                held += len(part)
            parts.append(np.array([-1], np.int32))
            if held >= BLOCK_WORDS:
                yield from out()
                blocks, held = {}, 0
        yield from out()
    return run


def subtree(text: bytes, counts: np.ndarray) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """Nodes of the subtree over suffix lines: (depth, words, word numbers, leaf totals) for
    each depth from two words on."""
    buf = np.frombuffer(text, np.uint8).copy()
    gap = np.flatnonzero((buf == 32) | (buf == 10))
    line_end = buf[gap] == 10
    buf[gap] = 32
    off = pa.py_buffer(np.concatenate([[0], gap + 1]).astype(np.int64).tobytes())
    words = pa.Array.from_buffers(pa.large_binary(), len(gap), [None, off, pa.py_buffer(buf.tobytes())])
    coded = words.dictionary_encode()
    names = [w[:-1] for w in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy().astype(np.int64)
    line = np.concatenate([[0], np.cumsum(line_end)[:-1]])
    start = np.concatenate([[0], np.flatnonzero(line_end)[:-1] + 1])
    ids = np.full((len(start), DEPTH), -1, np.int64)
    ids[line, np.arange(len(code)) - start[line]] = code
    size = len(names) + 1
    keys = [(ids[:, k] + 1) * size + ids[:, k + 1] + 1 for k in (2, 0)]
    by = np.lexsort(keys)
    ids, counts = ids[by], counts[by]
    # words shared with the suffix before: where a node of some depth begins
    shared = np.zeros(len(ids), np.int64)
    same = np.ones(max(0, len(ids) - 1), bool)
    for k in range(DEPTH):
        same &= ids[1:, k] == ids[:-1, k]
        shared[1:] += same
    for depth in range(2, DEPTH + 1):
        new = np.flatnonzero(shared < depth)
        total = np.add.reduceat(counts, new) if len(new) else counts[:0]
        on = ids[new, depth - 1] >= 0
        yield depth, names, ids[new[on], :depth], total[on]


def _nodes(least: int, router: Router):
    """Sorted rows of (grp, lang) -> (lang, phrase, depth, a) of each node. A node of heavy
    words alone that is not of full depth may have other parts elsewhere."""
    def read(key, texts, counts):
        lang = key[1]
        for depth, names, ids, total in subtree(b"".join(texts), np.concatenate(counts)):
            keep = total >= least
            if depth < DEPTH:
                keep |= router.is_heavy(lang.encode(), names)[ids].all(axis=1)
            ids, total = ids[keep], total[keep]
            for a in range(0, len(total), 50_000):
                part = ids[a:a + 50_000]
                table = pa.array(names, pa.binary())
                text = pc.binary_join_element_wise(*[table.take(pa.array(part[:, k])) for k in range(depth)], pa.scalar(b" ", pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), text.cast(pa.string()), pa.array([depth] * len(part), pa.int32()),
                                                  pa.array(total[a:a + 50_000], pa.int64())], ["lang", "phrase", "depth", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        key, texts, counts = None, [], []
        for b in batches:
            for r in b.to_pylist():
                if (r["grp"], r["lang"]) != key:
                    if texts:
                        yield from read(key, texts, counts)
                    key, texts, counts = (r["grp"], r["lang"]), [], []
                texts.append(codec.decompress(r["text"], r["size"], asbytes=True))
                counts.append(np.frombuffer(codec.decompress(r["counts"], 8 * r["n"], asbytes=True), np.int64))
        if texts:
            yield from read(key, texts, counts)
    return run


def _bitmap(words: DataFrame) -> bytes:
    """FILTER_BITS bits (2 MB) with one set for each (lang, word)."""
    bit = (F.crc32(F.concat(F.encode("lang", "UTF-8"), F.lit(b"\0"), F.encode("word", "UTF-8"))) % FILTER_BITS).alias("x")
    width = 1 << 15
    rows = (words.select(bit).groupBy(F.shiftright("x", 15).alias("b"))
            .agg(F.bitmap_construct_agg(F.col("x").bitwiseAND(width - 1)).alias("m")).collect())
    out = bytearray(FILTER_BITS // 8)
    for r in rows:
        out[r["b"] * width // 8:(r["b"] + 1) * width // 8] = r["m"]
    return bytes(out)


def phrase_counts(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """((lang, n) of all word occurrences, (lang, phrase, depth, a) of the phrases of one to
    DEPTH words that occur ``least`` times or more)."""
    src = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).cast("string").alias("text")).where("text is not null")
    words = src.mapInArrow(_count_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    words = materialise(words, "words")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    common = words.where(F.col("f") >= least)
    total = common.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    share = max(budget // 4, total // HEAVY, 1)
    heavy, groups = {}, max(1, -(-total // max(1, budget)))
    at = groups
    for r in common.where(F.col("f") > share).sort("lang", "word").collect():       # at most total / share <= HEAVY words
        n = -(-r["f"] // budget)
        heavy[r["lang"].encode() + b"\0" + r["word"].encode()] = (at, n)
        at += n
    router = Router(groups, heavy)
    rows = src.mapInArrow(_suffixes(_bitmap(common), router), "grp long, lang string, text binary, size long, counts binary, n long")
    nodes = (rows.repartitionById(at, F.col("grp").cast("int")).sortWithinPartitions("grp", "lang")
             .mapInArrow(_nodes(least, router), "lang string, phrase string, depth int, a long")
             .groupBy("lang", "phrase", "depth").agg(F.sum("a").alias("a")).where(F.col("a") >= least))
    one = common.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("depth"), F.col("f").alias("a"))
    return sizes, materialise(nodes.unionByName(one), "phrases")


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang", budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    ``lang`` null counts as ``und``; null and empty texts have no words, and a language
    without words has no rows. Repeated rows count each time. Equal scores go by the
    count, then by the phrase in byte order. Texts may be of any length; only the two
    named columns are looked at. Empty tables give an empty table.
    """
    tune(docs.sparkSession)
    sizes, freq = phrase_counts(docs, least, text, lang, budget)
    long = freq.where("depth > 1").withColumn("ws", F.split("phrase", " "))
    cut = long.select("lang", "phrase", "depth", "a", "ws", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "depth", "a", "k", F.concat_ws(" ", F.slice("ws", F.lit(1), F.col("k"))).alias("left"),
                     F.concat_ws(" ", F.slice("ws", F.col("k") + 1, F.col("depth") - F.col("k"))).alias("right"))
    part = freq.select("lang", "phrase", "a")
    cut = (cut.join(part.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
           .join(part.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"]))
    # products may pass 64 bits
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = (cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
            .select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    # phrases of two words or more inside longer ones
    inner = [(k, m) for m in range(2, DEPTH) for k in range(1, DEPTH - m + 2)]
    parts = F.array_compact(F.array(*[F.when(F.col("depth") >= F.greatest(F.lit(k + m - 1), F.lit(m + 1)), F.concat_ws(" ", F.slice("ws", k, m))) for k, m in inner]))
    around = (long.where("depth > 2").select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("longer"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    kept = (best.join(around, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * COVER)).drop("longer"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))
    return (kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).join(sizes, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
