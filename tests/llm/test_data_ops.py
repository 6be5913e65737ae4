"""Packing, token files, WARC, sharding, page text and language ID; the pipeline and the queries."""

import gzip
import io
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import WORDS, prose, sha
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskflow.llm import boilerplate, hilbert, langid, packing, tokenfile, tokens, warc
from riskflow.llm.common import scratch

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


ENCODERS = {(p, c): (tokens.Encoder(p, c), library(p)) for p, c in ((BYTE, tokens.SPACE_LED), (WORD, tokens.WORDS), (BYTE, None))}
LETTERS = st.lists(st.sampled_from([*"aB1é .,'\n\t\r\x1c\x85\u200b\xa0ß中😀İ\u0301", "'s", "<|endoftext|>", " the", "ﬁ", "  "]), max_size=40).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(LETTERS, max_size=5))
def test_cached_encoding_is_the_library_s(texts):
    for enc, want in ENCODERS.values():
        ids, off = enc(texts)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [want(t) for t in texts]


def test_encoding_of_long_texts_and_full_caches(monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 50)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 10)
    monkeypatch.setattr(tokens, "JOINED", 3)
    for path, cut in ((BYTE, tokens.SPACE_LED), (WORD, tokens.WORDS)):
        enc, want = tokens.Encoder(path, cut), library(path)
        for seed in range(5):
            t = prose(seed, 60) + " don't, x\n\n" + prose(seed, 5)
            assert enc([t])[0].tolist() == want(t)


def check_packed(rows, texts, length, path):
    want = library(path)
    at, seqs = {}, {}
    for r in rows:
        at.setdefault(r.doc, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in seqs.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= length
    assert set(at) == set(texts)
    for doc, v in at.items():
        pieces, copies = {}, 0
        for s, ids, total, n in v:
            assert n == len(ids)
            pieces[s] = ids
            copies = max(copies, sum(x[0] == s for x in v))
        whole = [x for s in sorted(pieces) for x in pieces[s]]
        assert whole == want(texts[doc]) + [1] and all(x[2] == len(whole) for x in v)
        assert len(v) == copies * len(pieces)
    return len(seqs)


def test_packing(spark, docs, corpus, no_docs, monkeypatch):
    named = docs.where("doc_id is not null")
    texts = {i: t for i, t, _ in corpus if i is not None}
    rows = packing.pack(named, WORD, tokens.WORDS, 1, 64).collect()
    total = sum(r.length for r in rows)
    assert check_packed(rows, texts, 64, WORD) <= 1.1 * total / 64 + 2
    assert packing.pack(docs, WORD, tokens.WORDS).where("doc is null").count() == 2
    assert packing.pack(no_docs, WORD, tokens.WORDS).count() == 0
    monkeypatch.setattr(packing, "FAN", 2)                 # several levels of leftovers
    rows = packing.pack(named.repartition(9), WORD, tokens.WORDS, 1, 64).collect()
    check_packed(rows, texts, 64, WORD)
    assert len({r.sequence_id >> packing.LEVEL_BIT for r in rows}) > 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 6))
def test_windows_hold_what_they_got(sizes, most):
    w = packing.Windows(50, most)
    out = [x for k, s in enumerate(sizes) for x in w.put(s, (k, s))]
    assert len(w.free) <= most
    out += w.rest()
    got = sorted(item for _, items in out for _, item in items)
    assert got == list(enumerate(sizes)) and len({n for n, _ in out}) == len(out)
    for _, items in out:
        end = 0
        for offset, (_, s) in items:
            assert offset == end
            end += s
        assert end <= 50


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-2**40, 2**50), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    e, end = tokenfile.EliasFano.from_bytes(b"xx" + tokenfile.EliasFano.encode(np.array(values, np.int64)).to_bytes(), 2)
    assert e.values().tolist() == values and [e.select(i) for i in range(0, len(values), 7)] == values[::7]
    with pytest.raises(IndexError):
        e.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(tokenfile.EliasFano.encode(ends).to_bytes()) < 100_000 * 13 / 8 + 2000


def test_token_files(spark, docs, corpus, no_docs):
    want, uri = library(BYTE), scratch(spark, "test-tokens")
    manifest = tokenfile.write_tokens(docs, uri, BYTE, tokens.SPACE_LED)
    got = tokenfile.read_tokens(manifest, uri).collect()
    start, expected = 0, []
    for i, t, _ in sorted((r for r in corpus if r[0] is not None), key=lambda r: r[0]):
        ids = np.array(want(t or "") + [0], "<u4")
        expected.append((i, start, len(ids), ids.tobytes()))
        start += len(ids)
    assert sorted((r.doc, r.start, r.n_tokens, bytes(r.ids)) for r in got) == sorted(expected)
    shard = manifest.where("n_docs > 1").orderBy("part").first()
    docs_of = tokenfile.read_index(uri, shard.shard)[1]
    by_start = {(d, s): x for d, s, _, x in expected}
    offset = 0
    for k in range(shard.n_docs):
        ids = tokenfile.read_document(uri, shard.shard, k)
        assert by_start[docs_of.select(k), shard.base + offset] == ids.astype("<u4").tobytes()
        offset += len(ids)
    empty = scratch(spark, "test-tokens")
    assert tokenfile.read_tokens(tokenfile.write_tokens(no_docs, empty, BYTE, tokens.SPACE_LED), empty).count() == 0


PAGES = [(0, "<p>" + "x" * 200), (1, "<p>" + "x" * 200), (2, "short"), (3, "short"), (4, None), (5, ""), (6, "é" * 60 + "\r\n\r\nWARC/1.1\r\n"), (7, "é" * 60 + "\r\n\r\nWARC/1.1\r\n"),
         (8, "z" * 100), (9, "z" * 99), (9, "z" * 99), (1, "<p>" + "x" * 200), (None, "<p>" + "x" * 200), (10, "w" * 300_000)]


def test_token_width_follows_the_vocabulary(spark, docs):
    wide = scratch(spark, "test-wide")
    end = 70_000                                              # beyond 2 bytes
    got = tokenfile.read_tokens(tokenfile.write_tokens(docs, wide, BYTE, tokens.SPACE_LED, end=end), wide).collect()
    assert got and all(np.frombuffer(r.ids, "<u4")[-1] == end for r in got)
    assert tokenfile.read_index(wide, "shard-000000")[0] == 4
    with pytest.raises(Exception, match="do not fit in 2 bytes"):
        tokenfile.write_tokens(docs, scratch(spark, "test-narrow"), BYTE, tokens.SPACE_LED, end=end, width=2).count()


def test_whole_windows_leave_open_ones_alone():
    w = packing.Windows(10, 2)
    assert w.put(4, "a") == [] and w.put(7, "b") == []
    assert w.put(10, "c") == [(2, [(0, "c")])]
    assert sorted(x for _, items in w.rest() for _, x in items) == ["a", "b"]


def test_language_sample_of_one_id_is_bounded(spark):
    rows = [(7, f"{p} number {i}", lang) for i in range(400) for p, lang in (("the river and the stone", "en"), ("der Fluss und der Stein", "de"))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict(langid.features(np.frombuffer(b"the stone and the river", np.uint8)))[0] == "en"


def test_warc(spark):
    pages = spark.createDataFrame([(i, "u", h, 1) for i, h in PAGES], "page_id long, url string, html string, page long").repartition(3)
    uri = scratch(spark, "test-warc")
    index = warc.archive(pages, uri)
    got = warc.read(index, uri).collect()
    assert sorted(map(repr, ((r.page, r.payload_bytes, r.payload_digest) for r in got))) == sorted(
        map(repr, ((i, len((h or "").encode()), sha((h or "").encode())) for i, h in PAGES)))
    by = {}
    for r in got:
        by.setdefault(r.page, []).append((r.record_type, r.refers_to))
    assert by[0] == [("response", None)] and by[1] == [("revisit", 0)] * 2 and by[None] == [("revisit", 0)] and by[7] == [("revisit", 6)]
    assert all(by[k] == [("response", None)] for k in (2, 3, 4, 5, 6, 8, 10)) and by[9] == [("response", None)] * 2
    assert warc.read(warc.archive(pages.limit(0), scratch(spark, "test-warc")), uri).count() == 0
    # every member stands alone, and the file as a whole is one gzip stream
    row = index.orderBy(F.desc("length")).first()
    raw = open(f"{uri}/{row.file}", "rb").read()
    assert zlib.decompress(raw[row.offset:row.offset + row.length], 31).startswith(b"WARC/1.1\r\n")
    assert len(list(warc.records(io.BytesIO(raw)))) == index.where(F.col("file") == row.file).count()


def test_warc_files_are_dealt_over_tasks_and_read_by_their_sidecars(spark):
    from riskflow.llm.tokenfile import _fs
    pages = spark.range(0, 64, 1, 16).select(F.when(F.col("id") != 9, F.col("id") - 1).alias("page_id"), F.repeat(F.lit("<p>text</p>"), F.col("id").cast("int")).alias("html"))
    raw, uri = scratch(spark, "test-dump"), scratch(spark, "test-warc")
    said = warc.dump(pages, raw)
    index = warc.normalise(said, warc.revisits(said), raw, uri)
    assert said.select("file").distinct().count() == 16
    # one file of index rows a task that had archives: more than one has
    assert len(index.inputFiles()) > 1 and index.select("file").distinct().count() == 16
    fs, root = _fs(uri)
    for name, rows in {r.file: r.rows for r in index.groupBy("file").agg(F.collect_list(F.struct("page", "offset", "length")).alias("rows")).collect()}.items():
        assert sorted(map(repr, warc.read_index(fs, f"{root}/{name}"))) == sorted(repr(tuple(r)) for r in rows)
    got = {r.page: r.payload_bytes for r in warc.read(index, uri).collect()}
    assert got == {None if i == 9 else i - 1: 11 * i for i in range(64)} and -1 in got


def test_warc_reader_takes_monolithic_and_broken_files():
    rec = [warc.record("response", str(k), b"p" * k, sha(b"p" * k), k) for k in range(0, 2000, 111)]
    for raw in (gzip.compress(b"".join(rec)), b"".join(map(gzip.compress, rec))):
        got = list(warc.records(io.BytesIO(raw)))
        assert [p for _, p in got] == [b"p" * k for k in range(0, 2000, 111)]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(b"".join(rec)[:-40]))))


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        at = hilbert.curve_index(cells, bits)
        walk = cells[np.argsort(at)]
        assert sorted(at) == list(range(len(cells))) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_hilbert_shards(spark, docs, no_docs):
    rows = docs.select("doc_id", "lang", "source", "n_chars", F.coalesce(F.length("text"), F.lit(0)).alias("size"), "tag")
    n = rows.count()
    for size in (None, "size"):
        got = hilbert.shards(rows, ["lang", "source", "n_chars"], "doc_id", size=size, count=4).collect()
        assert len(got) == n
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        if not size:
            assert set(slots) == set(range(4)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert hilbert.shards(no_docs.select("doc_id", "lang"), ["lang"], "doc_id").count() == 0
    two = spark.createDataFrame([(1, None), (1, None)], "doc_id long, lang string")
    assert sorted((r.shard, r.slot) for r in hilbert.shards(two, ["lang"], "doc_id", count=4).collect()) == [(0, 0), (2, 0)]
    # pruning: with 4 equally frequent values, a shard of 8 sees few of them
    many = spark.range(4000).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id") % 4).alias("v"), (F.col("id") * 7919 % 4000).alias("x"))
    seen = hilbert.shards(many, ["v", "x"], "k", count=8).groupBy("shard").agg(F.count_distinct("v").alias("v"), F.max("x").alias("b"), F.min("x").alias("a")).collect()
    assert sum(r.v * (r.b - r.a) for r in seen) < 0.35 * 8 * 4 * 4000


def test_hilbert_strings_by_whole_values(spark, monkeypatch):
    # long common starts, a value with a third of the rows, supplementary characters, empty and null
    values = [f"https://example.org/a/{i:03d}" for i in range(90)] + ["https://example.org/a/045"] * 60 + ["", "\U0001F600", "\ufffd", None, "x" * 5000]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v string").repartition(5)
    cuts = hilbert.string_cuts(rows, "v")
    line = sorted((v for v in values if v is not None), key=lambda v: v.encode())
    runs = {}
    for at, v in enumerate(line):
        runs.setdefault(line.index(v) * 32 // len(line), v)
    assert sorted(cuts, key=lambda v: v.encode()) == [runs[r] for r in sorted(runs)]
    got = {r.v: r.x for r in rows.select("v", hilbert.as_number(rows, "v", "string").alias("x")).collect()}
    assert got[None] == -1 and all(got[v] == sum(c.encode() <= v.encode() for c in cuts) for v in line)
    # a reader of one value finds it in few shards although all values start alike
    seen = hilbert.shards(rows.withColumn("x", F.col("k") * 37 % 155), ["v"], "k", count=8).groupBy("v").agg(F.count_distinct("shard").alias("s")).collect()
    assert sum(r.s for r in seen if r.v != "https://example.org/a/045") <= len(seen) + 8
    with pytest.raises(ValueError):
        hilbert.shards(rows.withColumn("_at", F.lit(1)), ["v"], "k")


def test_page_text():
    page = """<!DOCTYPE html><head><title>T &amp; x</title><style>p{}</style><script>var a = "</p><p>no";</script></head>
      <body class="has-sidebar"><nav><ul><li><a href="/">Home</a></ul></nav><header>Site</header><div id="cookie-notice">Cookies</div>
      <article><header><h1>Head&shy;line</h1></header><p><b>One</b> two<br>three&nbsp; four &lt;x&gt; &amp;amp;<p>Five<!-- six --> seven
      <div class="ad">Buy</div><ul><li>a<li>b</ul><aside>side</aside><form>f<input></form><section class="comments"><p>me too</section><p hidden>h</p></article>
      <footer>&copy;</footer>"""
    got = [t for t, main, no in boilerplate.blocks(page) if main and not no]
    assert got == ["Head­line", "One two three four <x> &amp;", "Five seven", "a", "b"]
    assert [t for t, main, no in boilerplate.blocks(page) if not main and not no] == []
    assert boilerplate.blocks("") == [] and boilerplate.blocks("plain < text") == [("plain < text", False, False)]
    assert boilerplate.blocks("<article>cut <p>of") == [("cut", True, False), ("of", True, False)]


def test_page_labels_are_judged_whole():
    def main(page):
        return [t for t, inside, no in boilerplate.blocks(page) if inside and not no]
    kept = ["<section id=discussion><p>x</p></section>", "<div class='legal-analysis'>x</div>", "<p title=it's>x</p>", '<p data-id="banner">x</p>',
            '<p title="class=ad">x</p>', "<div class='no-sidebar has-comments'>x</div>", "<div class='article-header'>x</div>", "<p title='a > b' class=lead>x",
            '<p title=a"b>x</p>', "<p a==b'>x</p>", "<div class='menuet socialism'>x</div>"]
    gone = ["<div class=ad>x</div>", "<div class='ad-1'>x</div>", "<div id='related-posts'>x</div>", "<div class='wide comments'>x</div>", "<div class=\"mw-sidebar2\">x</div>",
            "<article class='comment'>x</article>", "<article id='comment-17'>x</article>", "<p hidden>x</p>", "<div class='legal-notice'>x</div>", "<div CLASS=Cookie-Banner>x</div>",
            "<div class='post-footer'>x</div>", "<ul class=share-buttons><li>x</ul>"]
    for part in kept:
        assert main(f"<article><p>a</p>{part}<p>b</p></article>") == ["a", "x", "b"], part
    for part in gone:
        assert main(f"<article><p>a</p>{part}<p>b</p></article>") == ["a", "b"], part
    # around an article: a page's layout does not drop it, a comment of its own does
    assert main("<div class='layout has-sidebar'><article class='post category-social'>x</article></div><article class=comment>y</article>") == ["x"]
    assert main("<aside><article>y</article></aside><main class='header'>x</main>") == ["x"]
    assert main("<article>a<p title='open>b</article>") == ["a"]           # never closed: the rest of the page is its value
    assert boilerplate.blocks("<p " + "a=b' " * 20000 + ">x") == [("x", False, False)]


def test_main_text(spark):
    note = "Our cookie note repeats on every single page of this host, please do accept it now."
    rows = [(i, f"http://h.com/{i}", f"<div><p>{note}</p><p>{prose(i, 20)}</p></div>") for i in range(4)]
    rows += [(20, "http://other.com/", f"<div><p>{note}</p></div>"), (21, "http://h.com/a", f"<article><p>{note}</p><p>x</p></article><p>outside</p>"),
             (22, None, None), (23, "%%", ""), (None, "http://h.com/n", f"<p>{note}</p>"), (0, "http://h.com/0", f"<div><p>{note}</p><p>{prose(0, 20)}</p></div>")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, k string").repartition(3)
    got = sorted(((r.row.page_id, r.text) for r in boilerplate.extract(pages).collect()), key=repr)
    want = [(i, prose(i, 20)) for i in (0, 0, 1, 2, 3)] + [(20, note), (21, note + "\nx"), (22, ""), (23, ""), (None, note)]
    assert got == sorted(want, key=repr)
    assert boilerplate.extract(pages.limit(0)).count() == 0


def test_main_text_of_copied_and_quoting_pages(spark):
    note = "Our cookie note repeats on every single page of this host, please do accept it now."
    story, long = prose(70, 40), prose(71, 60)
    rows = [(1, "http://h.com/a", f"<div><p>{story}</p></div>"), (2, "http://h.com/b", f"<div><p>{story}</p></div>"), (3, "http://h.com/c", f"<div><p>{note}</p><p>{prose(72, 20)}</p></div>"),
            (4, "http://h.com/d", f"<div><p>{note} Über eleven.</p><p>{prose(73, 20)}</p></div>"), (5, "http://h.com/e", f"<p>{long}</p>"), (6, "http://h.com/f", f"<p>Seldom {long} said"),
            (7, "http://g.com/a", f"<p>{note}</p><p>{story}</p>"), (8, "http://g.com/b", f"<p>{note}</p><p>{story}</p>"), (9, "http://g.com/c", f"<p>{note}</p><p>z</p>")]
    got = {r.row.page_id: r.text for r in boilerplate.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {1: story, 2: story, 3: prose(72, 20), 4: "Über eleven.\n" + prose(73, 20), 5: "", 6: "Seldom said", 7: story, 8: story, 9: "z"}


def test_language_id(spark, docs, no_docs):
    rows = [(k, prose(k, 8 + k % 30, lang), lang) for k in range(400) for lang in [list(WORDS)[k % 4]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where(~langid.held_out()))
    got = langid.predict(df.where(langid.held_out()), model).select("row.lang", "lang_pred", "score").collect()
    assert len(got) > 50 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 — !?"), (4, "und"), (4, "日本")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.predict(odd, model).orderBy("row.doc_id").collect()] == [True, True, True, False, False]
    assert langid.train(no_docs) is None and langid.predict(no_docs, None).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    one = langid.train(df.where("lang = 'fr'"))
    assert {r.lang_pred for r in langid.predict(df.limit(5), one).collect()} == {"fr"}
    assert model.families == ["germanic", "romance"] and set(model.pairs) == {("de", "en"), ("es", "fr")}


def test_pipeline_without_labels_drops_only_texts_without_letters(spark, docs):
    import corpus_pipeline as cp
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    got = [r.text for r in cp.language_id(spark, bare, "").collect()]
    assert sorted(got) == sorted(r.text for r in docs.collect() if any(map(str.isalpha, r.text or ""))) and len(got) > 40


def test_pipeline_writes_languages_where_no_label_was(spark):
    import corpus_pipeline as cp
    rows = [(i, prose(i, 30), "en" if i % 4 else None, i) for i in range(1, 41)] + [(50, "12", None, 5), (None, prose(9, 30), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred long")
    got = {r.doc_id: r for r in cp.language_id(spark, df, "").collect()}
    assert set(got) == {i for i, *_ in rows} - {50} and {r.lang for r in got.values()} == {"en"}
    assert all(r.lang_pred == r.doc_id for r in got.values()) and list(got[1].asDict()) == df.columns


def test_pipeline_stages_on_empty_tables_and_clashing_columns(spark, docs, tmp_path):
    import corpus_pipeline as cp
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    here = docs.select(*cols)
    twice = here.unionByName(here.where("doc_id = 3"))
    wide = twice.withColumns({"_t": F.col("text"), "row": F.lit(1), "text_": F.lit("x"), "doc": F.col("doc_id"), "count": F.lit(2)})
    state = wide
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, here.limit(0), str(tmp_path)).count() == 0
        state = stage(spark, state, str(tmp_path))
        assert state.columns == wide.columns
        if name == "near_dedup":
            assert state.where("doc_id = 3").count() <= 1
    assert state.where("not (doc <=> doc_id)").count() == 0 and state.count() > 20
    assert cp.pack(spark, here.limit(0), str(tmp_path)).count() == 0


def test_pipeline(spark, docs, corpus, tmp_path):
    import corpus_pipeline as cp
    from test_text_ops import brute_groups, brute_repeats
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    item = " ".join(w for w in prose(777, 40).split() if w.isalpha())
    extra = spark.createDataFrame([(300, prose(70, 20) + " " + item, "en", "s", 1)], docs.select(*cols).schema)
    here = docs.select(*cols).unionByName(extra)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    here.write.parquet(str(tmp_path / "documents.parquet"))
    state = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontaminate", "pack"]
    before = [(r.doc_id, r.text) for r in state.collect()]
    for name, stage in cp.STAGES:
        out = stage(spark, state, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        state = spark.read.parquet(str(tmp_path / name))
        after = [(r.doc_id, getattr(r, "text", None)) for r in state.collect()]
        if name != "pack":
            assert sorted(state.columns) == sorted(cols)
        if name == "language_id":
            assert sorted(map(repr, after)) == sorted(map(repr, (x for x in before if x[1] and any(c.isalpha() for c in x[1]))))
        if name == "near_dedup":
            stay = {i for i, _, c in brute_groups(before, 5, 80) if i == c}
            assert sorted(i for i, _ in after if i is not None) == sorted(stay)
            assert sum(i is None for i, _ in after) == sum(i is None for i, _ in before)
        if name == "suffix_dedup":
            want = [(i, kept.decode("utf-8", "ignore")) for i, _, kept, _ in brute_repeats(before)]
            assert sorted(map(repr, after)) == sorted(map(repr, want))
            assert all(r.n_chars == len(r.text) for r in state.where("doc_id < 300").collect())
        if name == "decontaminate":
            assert {i for i, _ in before} - {i for i, _ in after} == {300}
        if name == "pack":
            texts = dict(before)
            check_packed(state.withColumnRenamed("doc_id", "doc").collect(), texts, 2048, WORD)
        before = after
    whole = cp.run(spark, str(tmp_path))
    assert whole.count() == state.count() and whole.columns == state.columns


def test_queries_are_registered():
    import __spark_entry__ as e
    names = e.queries()
    for n in range(1, 11):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and "op9_warc" in e.oracle_sql()
