"""Longest-previous-factor deduplication over a sparse, partitioned suffix array.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts in a
document with a smaller id. Comparing all suffixes would shuffle the text many
times over, so suffixes are sampled: in each window the 20-byte string with the
smallest hash is its *anchor*. Equal windows choose equal anchors, so equal
windows meet in the group of their anchor, and only there.

1. ``anchors``: numpy passes over whole texts give (anchor hash, hash of the 80
   bytes that hold every window of the anchor, document, position), once for each
   context of a text, so text that repeats itself fills no anchor's group.
2. ``classify``: one shuffle by anchor, sorted. A row whose whole context already
   occurs in a smaller document is done at once. Of the rest only the first of each
   context needs its bytes, and only if another context of the group agrees with it on
   the SIDE bytes before or behind the anchor, as contexts that share a window must.
3. ``repeat_masks``: these contexts are sorted into a suffix array; adjacent LCPs and
   the previous and next smaller positions (by document id) give the longest
   previous factor of every window; 50 or more marks the window.
4. ``remove_repeats``: the marked windows of a document become spans to cut.

Exact copies of whole texts are settled beforehand by their digest, so a group of
copies costs one text. An anchor with more than ``WIDE`` contexts goes through a
join on single windows instead of one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import materialise, maybe_in, mix, partitions, seeded, utf8

WINDOW = 50                 # bytes of a repeated string
GRAM = 20                   # bytes of an anchor
SLOTS = WINDOW - GRAM + 1   # windows that can share an anchor
LEFT = SLOTS - 1            # bytes of context before an anchor
CONTEXT = LEFT + WINDOW     # bytes that hold all windows of an anchor
FULL = (1 << SLOTS) - 1
SIDE = (WINDOW - GRAM) // 2 # bytes that two contexts share on one side of the anchor if they share a window
WIDE = 4096                 # contexts of one anchor that one task sorts; more go by window
SEGMENT = 1 << 18           # bytes hashed at once
PAD = 0xFF                  # occurs in no UTF-8 text
POS_BITS = 40               # low bits of ``at``: position and REPEATED; high bits: tag of the text
REPEATED = 1 << 39          # the anchor's context occurs again in its text

_TABLE = seeded(256, 1)
_MUL = seeded(8, 2)


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of ``width`` values (length shrinks by width - 1)."""
    have, out = 1, x
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return op(out[:len(out) - rest], out[rest:]) if rest else out


def _anchors_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, anchor hashes and context hashes in a buffer whose texts are
    parted, led and followed by CONTEXT bytes of PAD."""
    h = _TABLE[buf]
    h2 = h[:-1] * _MUL[0] + h[1:]
    h4 = h2[:-2] * _MUL[1] + h2[2:]
    h8 = h4[:-4] * _MUL[2] + h4[4:]
    h16 = h8[:-8] * _MUL[3] + h8[8:]
    g = h16[:-4] * _MUL[4] + h4[16:]
    order = ((g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
    low = _slide(order, SLOTS, np.minimum)                       # of the window starting here
    pads = np.concatenate([[0], np.cumsum(buf == PAD, dtype=np.int64)])
    low[pads[WINDOW:] - pads[:-WINDOW] > 0] = 0                  # windows that leave their text choose nothing
    pos = np.flatnonzero((_slide(low, SLOTS, np.maximum) == order[LEFT:len(low)]) & (order[LEFT:len(low)] > 0)) + LEFT
    at = pos - LEFT
    c = h16[at]
    for step in range(16, CONTEXT, 16):
        c = mix(c) * _MUL[5] + h16[at + step]
    # the hash of an anchor carries 8 bits of what is on either side of it
    left, right = (mix(h8[a] * _MUL[6] + h8[a + SIDE - 8]) & np.uint64(255) for a in (pos - SIDE, pos + GRAM))
    g = mix(g[pos]) & ~np.uint64(0xFFFF) | left << np.uint64(8) | right
    return pos, g.view(np.int64), mix(c).view(np.int64)


def _pieces(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about SEGMENT bytes: (buffer, row of each part, start of each part
    in the buffer, position of that start in its text). Texts longer than SEGMENT
    come in parts that overlap by what an anchor's windows need."""
    todo: list[tuple[int, int, int]] = []
    size = 0

    def build():
        buf = np.full(sum(b - a for _, a, b in todo) + CONTEXT * (len(todo) + 1), PAD, np.uint8)
        starts, at = [], CONTEXT
        for row, a, b in todo:
            buf[at:at + b - a] = data[off[row] + a:off[row] + b]
            starts.append(at)
            at += b - a + CONTEXT
        return buf, np.array([r for r, _, _ in todo]), np.array(starts), np.array([a for _, a, _ in todo])

    for row in range(len(off) - 1):
        n = int(off[row + 1] - off[row])
        if n < WINDOW:
            continue
        for a in range(0, n, SEGMENT):
            todo.append((row, max(0, a - 2 * CONTEXT), min(n, a + SEGMENT + 2 * CONTEXT)))
            size += min(n - a, SEGMENT)
            if size >= SEGMENT:
                yield build()
                todo, size = [], 0
    if todo:
        yield build()


def _anchors(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, position, anchor hash, context hash) of the anchors of texts, each once."""
    for buf, rows, starts, base in _pieces(data, off):
        pos, g, c = _anchors_of(buf)
        part = np.searchsorted(starts, pos, "right") - 1
        at = pos - starts[part] + base[part]
        # an overlap is left to the part that owns the position
        first = base[part] + 2 * CONTEXT * (base[part] > 0)
        own = at // SEGMENT == first // SEGMENT
        yield rows[part][own], at[own], g[own], c[own]


def _key(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(c.view(np.uint64)) ^ g.view(np.uint64)


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of whole texts. A context that occurs many times in a text is sent once:
    all its occurrences share their answer."""
    for b in batches:
        ids = b.column("doc").to_numpy(zero_copy_only=False)
        tags = b.column("tag").to_numpy(zero_copy_only=False)
        salt = mix(b.column("salt").to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64)
        for row, at, g, c in _anchors(*utf8(b.column("text"))):
            _, one, times = np.unique(_key(g, c) + mix(row.astype(np.uint64)), return_index=True, return_counts=True)
            row, at, g, c = row[one], at[one], g[one], c[one]
            g, c = g ^ salt[row] & ~0xFFFF, c ^ salt[row]
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), pa.array(ids[row]), pa.array(at | (times > 1) * np.int64(REPEATED) | (tags[row] << POS_BITS))], ["g", "c", "doc", "at"])


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (g, c, doc) -> rows that a smaller document settles (g null) and
    rows whose bytes are needed (g kept). Holds the first rows of one anchor's contexts,
    and of no more than WIDE: a larger group passes as it comes."""
    last_g = last_c = low = None
    held = np.zeros((0, 4), np.int64)        # (g, c, doc, at) of the anchor that is still open
    passing = False                          # the open anchor is past WIDE

    def partners(x: np.ndarray) -> np.ndarray:
        """Rows of whole groups that share a side with another context of the group."""
        new = np.concatenate([[True], (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])]) if len(x) else np.zeros(0, bool)
        keep = np.zeros(len(x), bool)
        for side in (8, 0):
            key = (x[:, 0] >> 16 << 8) | (x[:, 0] >> side & 255)
            _, inv = np.unique(key, return_inverse=True)
            keep |= np.bincount(inv, new, minlength=1)[inv] > 1
        return x[keep]

    for b in batches:
        g, c, doc, at = (b.column(i).to_numpy() for i in range(4))
        if not len(g):
            continue
        new = np.empty(len(g), bool)
        new[0], new[1:] = (g[0], c[0]) != (last_g, last_c), (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
        least = np.where(head >= 0, doc[head], 0 if low is None else low)
        later = doc > least
        yield _rows(None, doc[later], at[later])
        last_g, last_c, low = g[-1], c[-1], least[-1]
        x = np.concatenate([held, np.stack([g, c, doc, at], 1)[~later]])
        group = x[:, 0] >> 16
        split = np.searchsorted(group, last_g >> 16)                 # sorted, as g is
        if passing:                                                   # the group at the front has passed in part
            first = np.searchsorted(group, group[0], "right") if len(x) and group[0] == open_group else 0
            yield _rows(x[:first, 0], x[:first, 2], x[:first, 3])
            x, split = x[first:], max(0, split - first)
            passing = bool(last_g >> 16 == open_group)
        out = partners(x[:split])
        yield _rows(out[:, 0], out[:, 2], out[:, 3])
        held, open_group = x[split:], last_g >> 16
        if len(held) > WIDE:
            yield _rows(held[:, 0], held[:, 2], held[:, 3])
            held, passing = held[:0], True
    out = partners(held)
    yield _rows(out[:, 0], out[:, 2], out[:, 3])


def _rows(g, doc, at) -> pa.RecordBatch:
    gs = pa.nulls(len(doc), pa.int64()) if g is None else pa.array(g)
    return pa.RecordBatch.from_arrays([gs, pa.array(doc), pa.array(at)], ["g", "doc", "at"])


def suffix_order(part: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the rows of ``part`` (bytes on one side of the anchor, outwards)
    within each group, and the LCP of each entry with the one before (-1 between groups)."""
    n, width = part.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = part
    keys = words.view(">u8").astype(np.uint64)
    order = np.lexsort([*keys.T[::-1], group])
    keys, lead = keys[order], group[order]
    differ = keys[1:] != keys[:-1]
    last = keys.shape[1] - 1
    word = np.where(differ.any(1), differ.argmax(1), last)
    x = keys[1:][np.arange(n - 1), word] ^ keys[:-1][np.arange(n - 1), word]
    same = np.zeros(n - 1, np.int64)
    for k in range(8):                                            # leading equal bytes of the first word that differs
        same += (x >> np.uint64(56 - 8 * k)) == 0
    lcp = np.where(differ.any(1), np.minimum(word * 8 + same, width), width)
    return order, np.concatenate([[-1], np.where(lead[1:] == lead[:-1], lcp, -1)])[:n]


def _classes(order: np.ndarray, lcp: np.ndarray, length: int) -> np.ndarray:
    """Of each row the class of those that agree with it on the first ``length`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < length)
    return out


def window_masks(group: np.ndarray, doc: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Per context the bits of its windows that start in a smaller document of the group.

    Windows of one slot lie alike around the anchor: some bytes before it, the anchor,
    the rest behind. The suffix arrays of the parts behind and of the parts before
    (outwards) rank both; pairs of ranks order the windows of the slot, neighbours in
    that order have an LCP of WINDOW if both ranks agree and less otherwise, and the
    longest previous factor follows from the previous and next smaller document.
    """
    n = len(ctx)
    behind, before = ctx[:, LEFT + GRAM:], ctx[:, LEFT - 1::-1] if LEFT else ctx[:, :0]
    (ro, rl), (lo, ll) = suffix_order(behind, group), suffix_order(before, group)
    room = [np.where(x == PAD, 0, 1).cumprod(1).sum(1) for x in (before, behind)]      # bytes up to the text's ends
    out = np.zeros(n, np.int64)
    for slot in range(SLOTS):
        key = _classes(lo, ll, LEFT - slot) * (n + 1) + _classes(ro, rl, slot)
        order = np.argsort(key, kind="stable")
        key = key[order]
        lcp = np.concatenate([[0], np.where(key[1:] == key[:-1], WINDOW, 0)])
        got = np.zeros(n, bool)
        got[order] = longest_previous(doc[order], lcp, WINDOW) >= WINDOW
        out |= (got & (room[0] >= LEFT - slot) & (room[1] >= slot)).astype(np.int64) << slot
    return out


def longest_previous(doc: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factor in suffix order: LCP with the previous or the next
    entry of a smaller document, whichever is longer; 0 where that is under ``least``.

    Pointers start at the neighbour and jump along the neighbour's own pointer until
    they reach a smaller document; the LCP of a jump is the least on its way.
    """
    best = np.zeros(len(doc), np.int64)
    for back in (True, False):
        d = doc if back else doc[::-1]
        near = lcp if back else np.concatenate([lcp[1:], [0]])[::-1]
        to, have = np.arange(-1, len(d) - 1), near.copy()
        have[0] = 0
        while True:
            on = np.flatnonzero((have >= least) & (to >= 0))
            on = on[d[to[on]] >= d[on]]
            if not len(on):
                break
            t = to[on]
            have[on], to[on] = np.minimum(have[on], have[t]), to[t]
        best = np.maximum(best, np.where(have >= least, have, 0) if back else np.where(have >= least, have, 0)[::-1])
    return best


def _lpf_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor -> per context the bits of windows that start in a smaller document."""
    def run(g, doc, at, ctx):
        mask = window_masks(g, doc, ctx)
        on = mask > 0
        return pa.RecordBatch.from_arrays([pa.array(doc[on]), pa.array(at[on]), pa.array(mask[on])], ["doc", "at", "mask"])

    held: list[tuple] = []
    size = 0
    for b in batches:
        n = len(b)
        if not n:
            continue
        data, off = utf8(b.column("ctx"))
        g = b.column("g").to_numpy()
        new = (g, b.column("doc").to_numpy(), b.column("at").to_numpy(), data[off[0]:off[-1]].reshape(n, CONTEXT).copy())
        held.append(new)
        size += n
        if size >= 4000:
            g, doc, at, ctx = (np.concatenate(x) for x in zip(*held))
            other = np.flatnonzero(g != g[-1])
            last = int(other[-1] + 1) if len(other) else 0       # the open group waits; it has WIDE contexts at most
            if last:
                yield run(g[:last], doc[:last], at[:last], ctx[:last])
                held, size = [(g[last:], doc[last:], at[last:], ctx[last:])], len(g) - last
            else:
                held = [(g, doc, at, ctx)]
    if size:
        yield run(*(np.concatenate(x) for x in zip(*held)))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, doc, tag, needs of (g, at, wide)) -> the bytes around each needed anchor."""
    for b in batches:
        data, off = utf8(b.column("text"))
        for i, (doc, tag, needs) in enumerate(zip(b.column("doc").to_pylist(), b.column("tag").to_pylist(), b.column("needs"))):
            v = needs.values
            text = np.concatenate([np.full(CONTEXT, PAD, np.uint8), data[off[i]:off[i + 1]], np.full(CONTEXT, PAD, np.uint8)])
            at = v.field("at").to_numpy()
            p = (at & (REPEATED - 1)) + CONTEXT - LEFT
            ctx = np.lib.stride_tricks.sliding_window_view(text, CONTEXT)[p]
            # beyond the nearest end of the text there are only PAD bytes
            yield pa.RecordBatch.from_arrays([v.field("g"), pa.array(np.full(len(at), doc)), pa.array(at),
                                              pa.FixedSizeBinaryArray.from_buffers(pa.binary(CONTEXT), len(at), [None, pa.py_buffer(np.ascontiguousarray(ctx))]).cast(pa.binary()),
                                              v.field("wide")], ["g", "doc", "at", "ctx", "wide"])


def covered(masks: pa.StructArray, text: np.ndarray) -> np.ndarray:
    """Which bytes of a text the marked windows of its (at, mask) rows cover."""
    n = len(text)
    at = masks.field("at").to_numpy()
    p, m = at & (REPEATED - 1), masks.field("mask").to_numpy()
    again = at & REPEATED > 0
    if again.any():                      # a context that occurs again marks all its places
        found = [(x, _key(g, c)) for _, x, g, c in _anchors(text, np.array([0, n]))]
        pos, key = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(pos)
        pos, key = pos[order], key[order]
        marked, inv = np.unique(key[np.searchsorted(pos, p[again])], return_inverse=True)
        mask = np.zeros(len(marked), np.int64)
        np.bitwise_or.at(mask, inv, m[again])
        which = np.minimum(np.searchsorted(marked, key), len(marked) - 1)
        hit = marked[which] == key
        p, m = np.concatenate([p, pos[hit]]), np.concatenate([m, mask[which[hit]]])
    start = (p[:, None] - LEFT + np.arange(SLOTS))[(m[:, None] >> np.arange(SLOTS)) & 1 == 1]
    start = start[(start >= 0) & (start + WINDOW <= n)]
    step = np.bincount(start, minlength=n + 1) - np.bincount(start + WINDOW, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def _cut(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """(row, later, masks) -> kept bytes and the removed spans of each row's text."""
    for b in batches:
        data, off = utf8(b.column("row").field(column))
        kept, spans = [], []
        for i, (later, masks) in enumerate(zip(b.column("later").to_pylist(), b.column("masks"))):
            text = data[off[i]:off[i + 1]]
            n = len(text)
            out = np.zeros(n, bool)
            if later:
                out[:] = n >= WINDOW
            elif masks.is_valid and len(masks.values):
                out = covered(masks.values, text)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
            kept.append(text[~out].tobytes())
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(kept, pa.binary()), pa.array(spans, SPANS_ARROW)], ["row", "kept", "spans"])


SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SPANS = "array<struct<start:bigint,end:bigint>>"


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """All rows as (row, doc, text, tag, sha); the tag tells apart rows that share an id."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc"), t.alias("text"),
                       F.shiftright(F.xxhash64(t), 41).alias("tag"), F.sha2(t.cast("binary"), 256).alias("sha"))


def repeat_masks(rows: DataFrame) -> DataFrame:
    """(doc, text, tag, salt) -> (doc, at, mask): per anchor the windows that also start in
    a smaller document of the same salt. ``at`` holds the anchor's position under the
    text's tag."""
    spark, n = rows.sparkSession, partitions(rows.sparkSession)
    found = (rows.select("doc", "text", "tag", "salt").mapInArrow(_anchor_batches, "g long, c long, doc long, at long")
             .repartition(n, F.shiftright("g", 16)).sortWithinPartitions("g", "c", "doc")
             .mapInArrow(_classify, "g long, doc long, at long"))
    found = materialise(found, "anchors")
    need = found.where("g is not null").withColumn("g", F.shiftright("g", 16))
    wide = need.groupBy("g").count().where(F.col("count") > WIDE).select(F.col("g").alias("wg"))
    needs = (need.join(wide, need.g == wide.wg, "left")
             .groupBy("doc", F.shiftright("at", POS_BITS).alias("tag"))
             .agg(F.collect_list(F.struct("g", "at", F.col("wg").isNotNull().alias("wide"))).alias("needs")))
    hit = maybe_in(rows.select("doc", "text", "tag"), F.col("doc"), needs, "doc").where("__hit").drop("__hit")
    contexts = hit.join(needs, ["doc", "tag"]).select("doc", "tag", "text", "needs").mapInArrow(
        _contexts, "g long, doc long, at long, ctx binary, wide boolean")
    contexts = materialise(contexts, "contexts")
    narrow = (contexts.where("not wide").drop("wide").repartition(n, "g").sortWithinPartitions("g")
              .mapInArrow(_lpf_batches, "doc long, at long, mask long"))
    # PAD bytes only lead or follow a text, and the anchor holds none, so a window with one begins or ends with one
    pad = F.lit(bytes([PAD]))
    win = (contexts.where("wide").select("g", "doc", "at", "ctx", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
           .select("g", "doc", "at", "slot", F.substring("ctx", F.col("slot") + 1, F.lit(WINDOW)).alias("w"))
           .where((F.substring("w", F.lit(1), F.lit(1)) != pad) & (F.substring("w", F.lit(WINDOW), F.lit(1)) != pad)))
    # stored first, so that AQE can split the join where very many contexts share a window
    low = materialise(win.groupBy("g", "w").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").drop("high"), "windows")
    broad = (win.join(low, ["g", "w"]).where("doc > low")
             .groupBy("doc", "at").agg(F.expr("bit_or(shiftleft(1L, slot))").alias("mask")))
    full = found.where("g is null").select("doc", "at", F.lit(FULL).cast("long").alias("mask"))
    return full.unionByName(narrow).unionByName(broad)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` as ``row`` (all its columns), with ``kept`` (the remaining
    bytes, binary) and ``spans`` (maximal removed runs as byte offsets).

    Null texts count as empty and keep nothing; texts under WINDOW bytes are whole. A
    row without an id neither removes nor loses anything. Rows that share an id never
    remove from one another; of equal texts the smallest id stays (all rows that have
    it). An empty table gives an empty table. Other columns ride along in ``row``.
    """
    rows = _keyed(docs, text, doc_id)
    thin = rows.where("doc is not null").select("doc", "tag", "sha")
    first = thin.groupBy("sha").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    # stored first, so that AQE can split the join where one text is very frequent
    copies = materialise(thin.join(materialise(first, "first"), "sha").where("doc > low").select("doc", "tag", "sha"), "copies")
    known = rows.where("doc is not null")
    # copies never enter the anchor shuffle: most rows pass by the bitmap, the rest by an exact anti join
    sift = maybe_in(known.select("doc", "text", "tag", "sha"), F.col("doc"), copies, "doc")
    own = sift.where("not __hit").drop("__hit", "sha").unionByName(
        sift.where("__hit").join(copies, ["doc", "sha"], "left_anti").drop("__hit", "sha"))
    masks = repeat_masks(own.withColumn("salt", F.lit(0).cast("long"))).select("doc", F.shiftright("at", POS_BITS).alias("tag"), F.struct("at", "mask").alias("m"))
    later = copies.select("doc", "tag", F.lit(None).cast("struct<at:bigint,mask:bigint>").alias("m"))
    found = (masks.unionByName(later).groupBy("doc", "tag")
             .agg(F.collect_list("m").alias("masks"), F.bool_or(F.col("m").isNull()).alias("later")))
    found = materialise(found, "masks")
    sift = maybe_in(rows.select("row", "doc", "tag"), F.col("doc"), found, "doc")
    own_text = F.coalesce(F.col("row").getField(text), F.lit(""))
    whole = sift.where("not __hit").select("row", own_text.cast("binary").alias("kept"), F.array().cast(SPANS).alias("spans"))
    cut = sift.where("__hit").drop("__hit").join(found, ["doc", "tag"], "left").select("row", "later", "masks")
    row_type = rows.schema["row"].dataType.simpleString()
    return whole.unionByName(cut.mapInArrow(lambda batches: _cut(batches, text), f"row {row_type}, kept binary, spans {SPANS}"))
