"""Ranked search and collocations against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import DOCS, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from riskflow.llm import phrases, retrieval
from riskflow.llm.common import segments

ITEMS = "item_id long, text string, term string, at int"
UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def low(text):
    return (text or "").translate(UPPER)


# ------------------------------------------------------------------ ranked search

def brute_search(docs, items, k=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    seen = [(d, find(t)) for d, t in docs]
    seen = [(d, w) for d, w in seen if w]
    n_docs, n_terms = len(seen), sum(len(w) for _, w in seen)
    df = Counter(t for _, w in seen for t in set(w))
    asked = {}
    for item, t in items:
        if item is not None:
            asked.setdefault(item, set()).update(find(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for d, w in seen:
            if d is None:
                continue
            c, m = Counter(w), 100 - 90 + (90 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def check_search(spark, docs, items, parts=3, **kw):
    df = spark.createDataFrame([(i, t, "en", "s", 1, "d", "r", 1, "t") for i, t in docs], DOCS).repartition(parts)
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    got = sorted(map(tuple, retrieval.search(df, asked, **kw).collect()))
    assert got == brute_search(docs, items, kw.get("k", 10))
    return got


def test_search(spark, corpus):
    docs = [(i, t) for i, t, _ in corpus]
    items = [(1, prose(1, 40)), (2, prose(2, 8) + " Été ÉTÉ ñ42 the THE"), (3, ""), (4, None), (None, "the"), (5, "!!! --"), (2, "of and river"), (6, prose(77, 200, "de"))]
    got = check_search(spark, docs, items)
    assert {i for i, *_ in got} <= {1, 2, 6} and got
    # the same in blocks of few terms and with another k
    assert check_search(spark, docs, items, block_terms=30, k=3)


def test_search_ties_copies_and_rare_terms(spark):
    same = prose(5, 60)
    docs = [(i, same) for i in range(40)] + [(i, prose(i, 50)) for i in range(100, 160)] + [(300, "zebra " + same), (7, same)]
    got = check_search(spark, docs, [(1, same), (2, "zebra the of"), (3, "nothing here zzz")], parts=5)
    assert [d for i, _, d, _ in got if i == 2][0] == 300


def test_search_empty_tables(spark):
    assert check_search(spark, [], [(1, "the")]) == []
    assert check_search(spark, [(1, "the of"), (2, None), (3, "")], []) == []
    assert check_search(spark, [(2, None), (3, " ,")], [(1, "the")]) == []


def test_accumulators_stop_and_results_stay_exact():
    r = np.random.default_rng(3)
    n = 4000
    lens = r.integers(5, 60, n)
    doc_of = np.repeat(np.arange(n), 6)
    term = np.concatenate([[0 if r.random() < .003 else 1, 2, 3, 4, 5, 6] for _ in range(n)]).astype(np.int64)
    tf = r.integers(1, 4, len(term))
    weights = np.array([9000, 3000, 40, 30, 20, 10, 1], np.int64)
    score = retrieval.Scorer([np.array([0, 1, 2, 3, 4, 5, 6])], weights, n, int(lens.sum()), 10)
    for a in range(0, n, 1000):
        on = (doc_of >= a) & (doc_of < a + 1000)
        score.add(pa.array(range(a, a + 1000)), lens[a:a + 1000], doc_of[on] - a, term[on], tf[on])
    m = 10 + (90 * lens * n) // lens.sum()
    full = np.bincount(doc_of, weights=weights[term] * ((10**9 * tf) // (1000 * tf + 8 * m[doc_of])), minlength=n).astype(np.int64)
    want = sorted((-int(s), d) for d, s in enumerate(full))[:10]
    assert score.best[0] == want
    assert score.created < n and score.postings > 0        # accumulators were refused, postings all seen


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_segments_hold_whole_terms(raw, size):
    parts = list(segments(raw, retrieval.NO_TERM, size))
    assert b"".join(parts) == raw
    assert [w for p in parts for w in retrieval.TERM.findall(p)] == retrieval.TERM.findall(raw)


# ------------------------------------------------------------------ collocations

def brute_phrases(docs, least, top):
    f, n = Counter(), Counter()
    for lang, t in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cand.items():
        inside = any(q[0] == lang and len(q[1]) > len(p) and 100 * b >= 80 * a and any(q[1][i:i + len(p)] == p for i in range(len(q[1])))
                     for q, b in cand.items())
        if not inside:
            s, k, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -s, -a, " ".join(p).encode(), left, right))
    rows, rank = [], Counter()
    for lang, s, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -s))
    return sorted(rows)


def phrase_docs():
    r = random.Random(8)
    stock = ["New York City hall", "new york", "in spite of", "über den Wolken", "a a a a a a", "the end", "e\tf  g", "x\x1fy z w"]
    docs = []
    for i in range(150):
        words = [r.choice(stock + ["the", "of", "end", "city", "word%d" % r.randrange(400)]) for _ in range(r.randrange(30))]
        text = "".join(w + r.choice([" ", " ", " ", ", ", ". ", "\n", "\t"]) for w in words)
        docs.append((r.choice(["en", "de", None]), text))
    docs += [("fr", None), ("fr", ""), ("en", docs[3][1]), ("en", docs[3][1]), ("es", "..,;!"), ("en", "the end " * 900)]
    return docs


def check_phrases(spark, docs, least, top=2000, **kw):
    df = spark.createDataFrame([(i, t, lang, "s", 1, "d", "r", 1, "t") for i, (lang, t) in enumerate(docs)], DOCS).repartition(3)
    got = sorted(map(tuple, phrases.collocations(df, least=least, top=top, **kw).collect()))
    assert got == brute_phrases(docs, least, top)
    return got


def test_collocations(spark):
    docs = phrase_docs()
    got = check_phrases(spark, docs, 5)
    assert {g[0] for g in got} >= {"en", "de", "und"}
    # groups of few suffixes: many words are over budget and go by their extensions
    assert check_phrases(spark, docs, 5, budget=40) == got
    assert check_phrases(spark, docs, 12, top=4, budget=300)


def test_collocations_without_candidates(spark):
    assert check_phrases(spark, [], 5) == []
    assert check_phrases(spark, [("en", "one two"), (None, None)], 5) == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=8))
def test_subtree_counts(pieces):
    words = ["a", "b", "c"]
    stream = np.array([x for p in pieces for x in [*map(words.index, p), -1]], np.int32)
    ids, counts = phrases._merged(stream)
    text = "".join(" ".join(words[i] for i in row if i >= 0) + "\n" for row in ids).encode()
    got = Counter()
    if len(ids):
        for depth, names, nodes, total in phrases.subtree(text, counts):
            for node, a in zip(nodes, total):
                got[tuple(names[i].decode() for i in node)] += int(a)
    want = Counter(tuple(p[i:i + m]) for p in pieces for m in (2, 3, 4) for i in range(len(p) - m + 1))
    assert got == want
