"""Near-duplicate groups: Fast Similarity Sketches, banding, exact verification.

1. ``sketches``: one pass gives each text its set size, a 128-bit name of its set and
   a sketch. Texts with equal sets collapse to the smallest id.
2. Texts that agree in one band of coordinates share a bucket. Every member of a
   bucket is compared with one hub, the member with most bucket mates; a group of
   copies so costs one comparison a text.
3. Members of a bucket that still lie in different components meet in blocks of
   BLOCK x BLOCK rows. A pair is looked at in the first band whose exact key it shares; below ``floor``
   agreements (6.5 standard deviations under the threshold) it is left out, else its
   whole sets decide, unless a link of the block has joined its components already.
   Only links leave the block.
4. Links are verified on whole sets, made anew from the texts; components are the
   closure of verified links.
A pair at the threshold misses every band with a chance under 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import materialise, maybe_in, mix, partitions, seeded, utf8
from riskflow.llm.graph import components
from riskflow.llm.shingles import Sketcher, set_key, sets

BLOCK = 128
HUB_SHARE = 256      # members that one task's copy of a hub is compared with


@dataclass(frozen=True)
class Plan:
    """``width`` words a shingle; link where 100 * intersection >= percent * union."""
    width: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        return 5 if self.percent >= 85 else 4 if self.percent >= 80 else 3

    @property
    def bands(self) -> int:
        return {5: 25, 4: 32, 3: 42}[self.rows]

    @property
    def size(self) -> int:
        return self.rows * self.bands

    @property
    def floor(self) -> int:
        j = self.percent / 100
        return int(self.size * j - 6.5 * sqrt(self.size * j * (1 - j)))


def _sketch_batches(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, mul = Sketcher(plan.size), seeded(plan.size, 6)
        for b in batches:
            n, k1, k2, bands, sig = [], [], [], [], []
            for _, h in sets(*utf8(b.column("text")), plan.width):
                n.append(len(h))
                one, two = set_key(h)
                k1.append(one)
                k2.append(two)
                if len(h):
                    s = sketch(h)
                    keys = (mix(s) * mul).reshape(plan.bands, plan.rows).sum(1, dtype=np.uint64)
                    bands.append(mix(keys).view(np.int64))
                    sig.append((mix(s) & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    bands.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                                              pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc", "n", "k1", "k2", "bands", "sig"])
    return run


def _block(plan: Plan):
    """The rows (side, band, doc, n, label, sig, before, text) of one block -> links between
    different components, enough of them to join what belongs together. ``before`` has the
    exact keys of the bands before the block's own; the bytes of ``sig`` agree by chance too
    often to tell where a pair met before."""
    def run(table: pa.Table) -> pa.Table:
        doc, n, label, side = (table.column(c).to_numpy() for c in ("doc", "n", "label", "side"))
        buf, off = utf8(table.column("sig"))
        sig = buf[off[0]:off[-1]].reshape(len(doc), plan.bands, plan.rows)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right) and table.column("i")[0] == table.column("j")[0]:
            right = left
        own = table.column("band")[0].as_py()
        before = table.column("before").combine_chunks().flatten().to_numpy().reshape(len(doc), own)
        agree = np.zeros((len(left), len(right)), np.int32)
        first = np.ones(agree.shape, bool)
        for band in range(plan.bands):
            for k in range(plan.rows):
                agree += sig[left, band, k][:, None] == sig[right, band, k][None, :]
            if band < own:
                first &= before[left, band][:, None] != before[right, band][None, :]
        ok = first & (agree >= plan.floor) & (label[left][:, None] != label[right][None, :])
        ok &= 100 * np.minimum(n[left][:, None], n[right][None, :]) >= plan.percent * np.maximum(n[left][:, None], n[right][None, :])
        if right is left:
            ok &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        x, y = np.nonzero(ok)
        order = np.argsort(-agree[x, y], kind="stable")
        x, y = left[x[order]], right[y[order]]
        need = np.union1d(x, y)
        text = table.column("text").combine_chunks().take(pa.array(need, pa.int64()))
        whole = {int(need[i]): h for i, h in sets(*utf8(text), plan.width)}
        up: dict[int, int] = {}

        def root(k):
            while k in up:
                k = up[k]
            return k

        links = []
        for i, j in zip(x.tolist(), y.tolist()):
            a, b = root(label[i]), root(label[j])
            if a != b:
                both = len(np.intersect1d(whole[i], whole[j], assume_unique=True))
                if 100 * both >= plan.percent * (len(whole[i]) + len(whole[j]) - both):
                    up[a] = b
                    links.append((doc[i], doc[j]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})
    return run


def _verify_batches(plan: Plan):
    """Rows (hub, share, doc, text) sorted with the hub's own row first -> links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for b in batches:
            a, c = [], []
            at = list(zip(b.column("hub").to_pylist(), b.column("share").to_pylist()))
            lead = b.column("lead").to_pylist()
            doc = b.column("doc").to_pylist()
            for i, h in sets(*utf8(b.column("text")), plan.width):
                if lead[i]:
                    now, own = at[i], h
                elif now == at[i]:
                    both = len(np.intersect1d(own, h, assume_unique=True))
                    if 100 * both >= plan.percent * (len(own) + len(h) - both):
                        a.append(doc[i])
                        c.append(at[i][0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])
    return run


def _verified(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b = hub) that are links. A hub with many pairs is dealt out in
    shares, each with its own copy of the hub's text."""
    pairs = materialise(pairs.distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    near = maybe_in(texts, F.col("doc"), ends, "doc").where("__hit").drop("__hit")
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_SHARE).cast("int").alias("shares"))
    members = (pairs.join(hubs, "b").withColumn("share", F.pmod(F.xxhash64("a"), "shares").cast("int"))
               .join(near, F.col("a") == near.doc).select(F.col("b").alias("hub"), "share", F.lit(False).alias("lead"), "doc", "text"))
    leads = (hubs.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
             .join(near, F.col("b") == near.doc).select(F.col("b").alias("hub"), "share", F.lit(True).alias("lead"), "doc", "text"))
    both = members.unionByName(leads).repartition(partitions(texts.sparkSession), "hub", "share")
    return both.sortWithinPartitions("hub", "share", F.desc("lead")).mapInArrow(_verify_batches(plan), "a long, b long")


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, n_shingles, component) for every row of ``docs``, in any order.

    Null and empty texts have no shingles and stand alone. Repeated rows and rows that
    share an id appear as often as in ``docs``; rows that share an id but not a text
    count as one document for links (their texts are all compared). A null id stands
    alone with a null component. An empty table gives an empty table.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sk = materialise(rows.mapInArrow(_sketch_batches(plan), "doc long, n long, k1 long, k2 long, bands array<long>, sig binary"), "sketches")
    full = sk.where("doc is not null and n > 0")
    reps = full.groupBy("k1", "k2", "n").agg(F.min("doc").alias("rep"), F.max("doc").alias("last"))
    # members of equal sets point to the smallest id; only those sets need a join back. They
    # are stored first, so that AQE can split the join where one set is very frequent
    same = materialise(reps.where("rep < last").select("k1", "k2", "n", "rep"), "same")
    equal = materialise(full.join(same, ["k1", "k2", "n"]).where("doc > rep").select("doc", "rep", "k1", "k2"), "equal")
    lone = full.join(equal, ["doc", "k1", "k2"], "left_anti").dropDuplicates(["doc", "k1", "k2"])
    buckets = materialise(lone.select("doc", F.posexplode("bands").alias("band", "key")).distinct(), "buckets")
    sizes = materialise(buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    members = materialise(buckets.join(sizes, "key"), "members")
    weight = members.groupBy("doc").agg(F.sum("m").alias("mates"))
    hub = (members.join(weight, "doc").groupBy("key")
           .agg(F.max_by("doc", F.struct("mates", -F.col("doc"))).alias("hub")))
    sig = lone.select("doc", "n", "sig")
    near = (members.join(hub, "key").where("doc != hub").select("doc", "hub").distinct()
            .join(sig, "doc").join(sig.select(F.col("doc").alias("hub"), F.col("n").alias("hn"), F.col("sig").alias("hsig")), "hub"))
    near = (near.where(F.least("n", "hn") * 100 >= F.greatest("n", "hn") * plan.percent)
            .mapInArrow(_agree(plan), "a long, b long"))
    texts = rows.where("doc is not null")
    first = materialise(_verified(near, texts, plan), "verified")
    labels = components(first)
    # the rest: bucket mates in different components, compared in blocks
    tagged = members.join(labels, members.doc == labels.id, "left").select("key", "band", "doc", F.coalesce("label", "doc").alias("label"))
    open_ = (tagged.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"))
             .where("low < high and m > 2").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    dealt = materialise(tagged.join(open_, "key"), "open")
    near = maybe_in(texts, F.col("doc"), dealt, "doc").where("__hit").drop("__hit")
    near = near.withColumn("t", F.xxhash64("text")).dropDuplicates(["doc", "t"]).drop("t")
    blocks = (dealt.join(lone.select("doc", "n", "sig", "bands"), "doc").join(near, "doc")
              .withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "band", "doc", "n", "label", "sig",
                      F.slice("bands", F.lit(1), F.col("band")).alias("before"), "text"))
    links = first.unionByName(blocks.groupBy("key", "i", "j").applyInArrow(_block(plan), "a long, b long"))
    labels = components(links.unionByName(equal.select(F.col("doc").alias("a"), F.col("rep").alias("b"))))
    return (sk.select("doc", F.col("n").alias("n_shingles")).join(labels, sk.doc == labels.id, "left")
            .select("doc", "n_shingles", F.coalesce("label", "doc").alias("component")))


def _agree(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = ((lambda d, o: d[o[0]:o[-1]].reshape(-1, plan.size))(*utf8(b.column(c))) for c in ("sig", "hsig"))
                on = np.flatnonzero((x == y).sum(1) >= plan.floor)
                yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(on)), b.column("hub").take(pa.array(on))], ["a", "b"])
    return run
