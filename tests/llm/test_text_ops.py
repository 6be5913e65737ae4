"""Suffix dedup, MinHash, decontamination and SpotSigs against brute force."""

import re

import numpy as np
import pyarrow as pa
from conftest import DOCS, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskflow.llm import decontam, minhash, shingles, spotsigs, suffix
from riskflow.llm.common import maybe_in
from riskflow.llm.graph import components
from riskflow.llm.suffix import WINDOW


def brute_repeats(rows):
    """(doc, text) -> removed bytes by the definition."""
    low = {}
    for doc, t in rows:
        b = (t or "").encode()
        if doc is not None:
            for k in range(len(b) - WINDOW + 1):
                w = b[k:k + WINDOW]
                low[w] = min(low.get(w, doc), doc)
    out = []
    for doc, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - WINDOW + 1 if doc is not None else 0):
            if low[b[k:k + WINDOW]] < doc:
                gone[k:k + WINDOW] = [True] * WINDOW
        out.append((doc, b, bytes(c for c, g in zip(b, gone) if not g), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))))
    return out


def check_repeats(df, rows):
    got = [(r.row.doc_id, (r.row.text or "").encode(), bytes(r.kept), len(r.spans)) for r in suffix.remove_repeats(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_repeats(rows)))


def test_suffix_dedup(spark, docs, corpus, no_docs):
    check_repeats(docs, [(i, t) for i, t, _ in corpus])
    assert suffix.remove_repeats(no_docs).count() == 0


def test_suffix_dedup_of_texts_that_repeat_themselves(spark):
    line = prose(3, 14) + "\n"
    rows = [(1, "tick tock " * 60), (2, "x" + "tick tock " * 40 + "end"), (3, line * 8 + prose(4, 20)), (5, prose(6, 9) + line * 3 + prose(7, 30) + line), (6, "tick " * 50 + line)]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_suffix_dedup_wide_anchor_and_long_texts(spark, monkeypatch):
    # in local mode the workers import the module anew, so the limits are tested in process
    r = np.random.default_rng(1)
    line = prose(1, 12)
    rows = [(int(i), "".join(r.choice(list("abcdefgh "), 40)) + line + "".join(r.choice(list("abcdefgh "), 40))) for i in r.permutation(60)]
    monkeypatch.setattr(suffix, "WIDE", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_repeats(df, rows)


def test_suffix_dedup_wide_anchor_before_four_byte_characters(spark, monkeypatch):
    """Bytes that end in F before a lead byte F0 are no PAD byte."""
    r = np.random.default_rng(2)
    line = "o\U0001f600 go\ufe0f\U0001f680 to?\U0001f600 /\U00020000 "
    line = line + line[::-1]
    rows = [(int(i), "".join(r.choice(list("abcdefgh "), 40)) + line + "".join(r.choice(list("abcdefgh "), 40))) for i in r.permutation(60)]
    rows.append((60, line))
    monkeypatch.setattr(suffix, "WIDE", 20)
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string"), rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=0, max_size=160), min_size=1, max_size=6), st.integers(60, 400))
def test_anchors_of_equal_windows_are_equal(texts, segment):
    """Whatever the segment size, anchors and context hashes are the same."""
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])

    def run(size):
        kept, suffix.SEGMENT = suffix.SEGMENT, size
        try:
            batch = pa.RecordBatch.from_pydict({"doc": list(range(len(raw))), "text": pa.array(texts), "tag": [0] * len(raw), "salt": [0] * len(raw)})
            got = [(int(r), int(a), int(g), int(c)) for rows in suffix._anchors(data, off) for r, a, g, c in zip(*rows)]
            sent = {(x["doc"], x["g"], x["c"]) for b in suffix._anchor_batches(iter([batch])) for x in b.to_pylist()}
            assert len(sent) == len({(r, g, c) for r, _, g, c in got})
            return sorted(got)
        finally:
            suffix.SEGMENT = kept

    assert run(segment) == run(1 << 20)
    assert len(off) == len(texts) + 1 and len(data) == off[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=30))
def test_longest_previous_matches_the_definition(rows):
    doc, lcp = np.array([d for d, _ in rows]), np.array([0, *[x for _, x in rows][1:]])
    got = suffix.longest_previous(doc, lcp, 3)
    for i in range(len(doc)):
        best = max([int(min(lcp[min(i, j) + 1:max(i, j) + 1])) for j in range(len(doc)) if doc[j] < doc[i]], default=0)
        assert got[i] >= 3 if best >= 3 else got[i] == 0
        if best >= 3:
            assert got[i] == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 3), st.integers(0, 4)), max_size=60), st.integers(1, 9), st.sampled_from([3, 4096]))
def test_classify_in_any_batches(rows, size, wide):
    """Settled rows are those with a smaller document in their context; the others pass if
    a partner shares a side, whatever the batches are. A group past WIDE passes whole."""
    g = [((a << 16) | (s << 8) | s, c, d, k) for k, (a, c, d, s) in enumerate(sorted((a, c, d, c % 2) for a, c, d, _ in rows))]
    kept, suffix.WIDE = suffix.WIDE, wide
    try:
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in g[k:k + size]], pa.int64()) for i in range(4)], ["g", "c", "doc", "at"]) for k in range(0, len(g), size)]
        got = [x for b in suffix._classify(iter(batches)) for x in b.to_pylist()]
    finally:
        suffix.WIDE = kept
    low = {}
    for key, c, d, _ in g:
        low[key, c] = min(low.get((key, c), d), d)
    settled = sorted(at for key, c, d, at in g if d > low[key, c])
    firsts = [(key, c, at) for key, c, d, at in g if d == low[key, c]]
    need = sorted(at for key, c, at in firsts if any(k2 >> 16 == key >> 16 and (k2, c2) != (key, c) and (k2 & 255 == key & 255 or k2 >> 8 & 255 == key >> 8 & 255) for k2, c2, _ in firsts))
    assert sorted(x["at"] for x in got if x["g"] is None) == settled
    passed = sorted(x["at"] for x in got if x["g"] is not None)
    assert set(need) <= set(passed) and len(passed) == len(set(passed))
    if wide > 100:
        assert passed == need


def word_sets(t, width):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_groups(rows, width, percent):
    s = [(i, word_sets(t, width)) for i, t in rows if i is not None]
    up = {i: i for i, _ in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            both = len(s[a][1] & s[b][1])
            if both and 100 * both >= percent * len(s[a][1] | s[b][1]):
                x, y = root(s[a][0]), root(s[b][0])
                up[max(x, y)] = min(x, y)
    return sorted((i, len(x), root(i)) for i, x in s)


def test_minhash(spark, docs, corpus, no_docs):
    for width, percent in ((3, 85), (5, 80)):
        got = minhash.near_duplicates(docs, minhash.Plan(width, percent)).collect()
        assert sorted(tuple(r) for r in got if r.doc is not None) == brute_groups([(i, t) for i, t, _ in corpus], width, percent)
        assert sorted(r.component is None for r in got if r.doc is None) == [True, True]
    assert minhash.near_duplicates(no_docs).count() == 0


def test_minhash_chains_of_near_copies(spark):
    """Copies of copies: the hub does not link to all, so blocks have work to do."""
    rows, words = [], prose(1, 200).split()
    for k in range(60):
        words = list(words)
        words[(k * 37) % 200] = f"new{k}"
        rows.append((k * 3 % 61, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Plan(3, 85)).collect()
    assert sorted(map(tuple, got)) == brute_groups(rows, 3, 85)


def test_block_looks_at_every_pair_in_its_first_shared_band():
    """Pairs that only a block can link: an earlier band that agrees on the bytes of ``sig`` by chance is no band they share."""
    plan, r = minhash.Plan(3, 85), np.random.default_rng(5)
    texts = []
    for k in range(4000):
        words = [f"w{k}x{i}" for i in range(80)]
        other = list(words)
        other[int(r.integers(10, 40))] = "new"
        other[int(r.integers(40, 70))] = "more"
        texts += [" ".join(words), " ".join(other)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc", "text"])
    sk = pa.Table.from_batches(minhash._sketch_batches(plan)(iter([batch])))
    bands = np.array(sk.column("bands").to_pylist())
    run, n, found = minhash._block(plan), 0, 0
    for x in range(0, len(texts), 2):
        shared = np.flatnonzero(bands[x] == bands[x + 1])
        if not len(shared):
            continue
        own, rows = int(shared[0]), sk.slice(x, 2)
        block = pa.table({"i": [0, 0], "j": [0, 0], "side": [0, 0], "band": [own, own], "doc": rows.column("doc"), "n": rows.column("n"), "label": rows.column("doc"),
                          "sig": rows.column("sig"), "before": pa.array([b[:own].tolist() for b in bands[x:x + 2]], pa.list_(pa.int64())), "text": texts[x:x + 2]})
        n += 1
        found += run(block).num_rows
    assert n > 3900 and found == n


def test_sketch_fills_and_estimates():
    sk = shingles.Sketcher(256)
    r = np.random.default_rng(3)
    for n in (1, 2, 10, 1000):
        h = r.integers(0, 2**63, n).astype(np.uint64)
        assert (sk(h) < np.iinfo(np.uint64).max).all() and (sk(h) == sk(h[::-1])).all()
    both, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    got = (sk(np.concatenate([both, a])) == sk(np.concatenate([both, b]))).mean()
    assert abs(got - 0.8) < 0.1


def test_long_text_in_segments(monkeypatch):
    t = prose(1, 500).encode()
    want = next(shingles.sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 3))[1]
    monkeypatch.setattr(shingles, "SEGMENT", 97)
    assert (next(shingles.sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 3))[1] == want).all()
    assert len(want) == len(word_sets(t.decode(), 3))


def test_prefilter_loses_no_row(spark):
    keys = spark.range(0, 6000, 3).withColumnRenamed("id", "k")
    rows = spark.range(6000).withColumnRenamed("id", "doc").unionByName(spark.createDataFrame([(None,)], "doc long"))
    got = {r.doc: r["__hit"] for r in maybe_in(rows, F.col("doc"), keys, "k").collect()}
    assert len(got) == 6001 and got[None] is False
    assert all(got[k] for k in range(0, 6000, 3)) and sum(got[k] for k in range(6000)) < 2010
    assert not any(r["__hit"] for r in maybe_in(rows, F.col("doc"), keys.limit(0), "k").collect())


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 105), (7, 7), (3, 1)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99, 105: 99}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEM = "Yesterday a trader named Alice bought 12 apples for 3.50 dollars and Alice sold 12 pears to Bob in Paris today."


def test_decontamination(spark, docs, no_docs):
    other = ITEM.replace("Alice", "Carol").replace("12", "99").replace("3.50", "7.25").replace("Bob", "Dan").replace("Paris", "Rome")
    mixed = other.replace("Carol sold 99", "Zed sold 5")
    rows = [(1, "So they say. " + ITEM + " Thanks."), (2, other), (3, mixed), (4, None), (5, ""), (6, prose(1, 50)), (6, ITEM), (None, ITEM), (8, "one two"), (9, "one two three")]
    bench = [(7, ITEM), (8, None), (9, "one two"), (None, ITEM), (10, prose(2, 30)), (10, prose(2, 30))]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = decontam.leaks(d, b).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 7), (2, 7), (6, 7), (8, 9)]
    assert {r.doc_id: r.n_slots for r in got}[2] == 6
    assert decontam.leaks(no_docs, b).count() == 0 and decontam.leaks(d, b.limit(0)).count() == 0


def test_decontamination_of_names_anywhere_and_in_any_case(spark):
    items = ["Alice has 12 apples. Alice gives 5 of them to Bob. How many apples does Alice have left?",
             "The guard asked: \"Alice, who let you in?\"\nBob (the cook) answered  O'Brien did, and ALICE thanked McDonald for 3 keys.",
             "One day a tall man called Peter met Susan near the old bridge and Peter gave Susan 4 letters for Martin."]
    swap = {"Alice": "Carol", "ALICE": "CAROL", "12": "31", "5": "7", "Bob": "Dan", "O'Brien": "O'Neill", "McDonald": "MacLeod", "3": "8", "Peter": "Frank", "Susan": "Julia", "4": "6", "Martin": "Oscar"}
    other = [re.sub("|".join(sorted(swap, key=len, reverse=True)), lambda m: swap[m[0]], t) for t in items]
    clash = other[0].replace("Carol gives", "Zed gives").replace("does Carol", "does Eve")
    rows = [(j * 10 + k, t) for j, item in enumerate(items) for k, t in enumerate((item, other[j], "Listen: " + other[j] + " Done.", item.lower(), item.upper()))] + [(90, clash), (91, prose(6, 60))]
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(j * 10 + k, j) for j in range(3) for k in range(5)]


def brute_leaks(rows, bench):
    """Without numbers or names: at least 80 % of an item's windows of 5 words."""
    def windows(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    return sorted((i, j) for i, t in rows for j, b in bench if windows(b) and 100 * len(windows(t) & windows(b)) >= 80 * len(windows(b)))


def test_decontamination_against_brute_force(spark):
    bench = [(j, " ".join(re.sub(r"\d", "", prose(500 + j, 25)).split())) for j in range(6)]
    rows = [(j, prose(600 + j, 30).translate({ord(c): None for c in "0123456789"})) for j in range(10)]
    rows += [(20 + j, rows[j][1] + " " + b) for j, b in bench] + [(40 + j, " ".join(b.split()[:15])) for j, b in bench] + [(60 + j, " ".join(b.split()[:23])) for j, b in bench]
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == brute_leaks(rows, bench)


def signatures(t):
    w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    common = set(spotsigs._ALL)
    return {(x, *[y for y in w[i + 1:i + 1 + spotsigs.REACH] if y not in common][:spotsigs.CHAIN]) for i, x in enumerate(w) if x in common} or {t or ""}


def test_spotsigs(spark, docs, corpus, no_docs):
    got = spotsigs.with_signatures(docs, "text", "sigs").select("text", "sigs", spotsigs.as_text("sigs").alias("f")).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert len(r.sigs) == len(signatures(r.text)) and len(r.f) == 8 * len(r.sigs) and r.sigs == sorted(r.sigs)
    assert spotsigs.with_signatures(no_docs, "text", "sigs").count() == 0
    ids = [(i, signatures(t)) for i, t, _ in corpus if i is not None]
    rep = {}
    for i, s in ids:
        rep.setdefault(frozenset(s), i)
    want = {(min(rep[a], rep[b]), max(rep[a], rep[b])) for a in rep for b in rep if a != b and len(a & b) / len(a | b) >= 0.8}
    found = spotsigs.matches(spotsigs.with_signatures(docs.where("doc_id is not null"), "text", "sigs"), "doc_id", "sigs", 80)
    assert {(r.a, r.b) for r in found.collect()} == want


def test_next_rows(spark, no_docs):
    rows = [(5, "e"), (1, "a"), (3, "c"), (3, "b"), (None, "z"), (9, "f"), (9, "f")]
    got = spotsigs.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = [(*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order)]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    one = spotsigs.with_next(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text").collect()
    assert [tuple(r) for r in one] == [(1, "a", "a")]
    assert spotsigs.with_next(no_docs.select("doc_id", "text"), "doc_id", "text").count() == 0


def test_schema_of_fixture():
    assert "row" in DOCS.fieldNames()
