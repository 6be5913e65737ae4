"""Main text of web pages by structure and by what a host repeats.

A page becomes blocks of text in page order. Blocks inside elements that are never main
text (navigation, footers, forms, adverts, comments and so on) are boilerplate by name;
class and id names are judged whole.
A page with an ``article`` or ``main`` element keeps what stands in it, also where other
pages quote it, and nothing outside. For the others names do not suffice: the blocks
outside such elements form a page's token stream, the streams of a host's pages are
compared through the sparse suffix array of ``suffix.py``, and the words that strings of
50 bytes or more from distinct pages cover are boilerplate. Unique runs stay. Pages of a
host with equal streams are copies and count as one page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm import suffix
from riskflow.llm.common import materialise, maybe_in

COVERED = 0.8            # share of a block's bytes from which repeats shorter than a window are cut too

# Element names of HTML and the words that name boilerplate parts.
SILENT = set("script style noscript template svg math iframe object canvas video audio head title textarea select option datalist".split())
NEVER = set("nav header footer aside form menu dialog button input label fieldset optgroup".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
MAIN = {"article", "main"}
NAMES = set("ad ads advert advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot "
            "sidebar side aside widget related share sharing social cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription "
            "signup login comment comments discussion replies disqus pager pagination toolbar copyright legal".split())
TOPICS = set("header discussion legal copyright".split())          # headings and subjects, where they stand within an article
LAYOUT = set("list item items box area block section links link bar wrap wrapper container inner outer group body text content title heading form button buttons icon icons "
             "top bottom left right main site page global primary secondary sticky fixed mobile desktop post posts article articles stories entry row col column panel "
             "region slot unit zone thread message overlay".split())
STATES = set("no not non has is in with without on off".split())   # "no-sidebar" is no sidebar
REPLIES = set("comment comments replies disqus".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar", "toolbar"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s/=][^\s/=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'][^\s]*)))?")
_RAW = {name: re.compile(rf"</{name}\b", re.I) for name in ("script", "style", "noscript", "template", "textarea", "title", "iframe")}
_SPACE = re.compile(r"\s+")


def _label(name: str, within: bool) -> bool:
    """Whether one class or id names boilerplate: each of its parts is such a word, a word of layout, a number or a short
    prefix. So "site-nav-2" and "mw-footer" do, "legal-analysis" and "no-sidebar" do not. Within an article, words that may
    be its subject or heading are none."""
    parts = [x.rstrip("0123456789") for x in re.split(r"[-_]+", name.lower())]
    if any(x in STATES for x in parts) or not all(len(x) < 4 or x in NAMES or x in LAYOUT for x in parts):
        return False
    return any(x in NAMES and not (within and x in TOPICS) for x in parts)


def _named(tag: str, attrs: str, within: bool = False) -> bool:
    """Whether an element's name or labels say that it is never main text; the header
    within an article is its heading. An article is boilerplate where its label says
    that it is a reader's comment, or where it stands in another and has any such label."""
    if tag in NEVER and not (within and tag == "header"):
        return True
    for key, a, b, c in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id") and tag not in ("main", "html", "body"):
            found = [x for x in value.split() if _label(x, within)]
            if found and (tag != "article" or within or any(set(re.split(r"[-_]+", x.lower())) & REPLIES for x in found)):
                return True
    return False


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside an article or main element, boilerplate by name) in page order.

    Text between two block-level tags is a block; inline tags and line breaks do not
    end it. Unclosed and crossing tags are read as browsers do for p, li and table
    cells; an end tag that opens nothing is skipped. References are decoded once.
    """
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []         # (tag, within main, named)
    held: list[str] = []
    at = 0

    def flush():
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                main, named = stack[-1][1:] if stack else (False, False)
                out.append((text, main, named))

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            held.append(page[at:m.start()])
        at, tag = m.end(), m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                held.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag == "br" or tag == "img":
            held.append(" ")
            continue
        if tag in INLINE and not (not m[1] and _named(tag, m[3])) and not (m[1] and any(t == tag for t, _, _ in stack)):
            continue
        flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in MAIN and tag not in MAIN and tag not in ("body", "html"):
                    break                            # an end tag reaches no further than its article
            continue
        if tag in SILENT:
            end = _RAW[tag].search(page, at) if tag in _RAW else None
            if tag in _RAW:
                at = end.start() if end else len(page)
            if tag in VOID or m[3].rstrip().endswith("/") or tag in _RAW:
                continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in CLOSES.get(tag, ()) or tag in ENDS_P and stack[k][0] == "p":
                del stack[k:]
                break
            if stack[k][0] not in INLINE and stack[k][0] != "p":
                break
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        main, named = stack[-1][1:] if stack else (False, False)
        stack.append((tag, main or tag in MAIN, named or tag in SILENT or _named(tag, m[3], main)))
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


def _thin_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, k, host, html) -> whether the page has a main part, and the blocks outside."""
    for b in batches:
        got = [blocks(page) for page in b.column("html").to_pylist()]
        has_main = pa.array([any(main and not no for _, main, no in x) for x in got], pa.bool_())
        outside = pa.array([[t for t, main, _ in x if not main] for x in got], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("k"), b.column("host"), has_main, outside], ["doc", "k", "host", "has_main", "outside"])


def _uncovered(text: bytes, covered: np.ndarray) -> str:
    """The words of a block with a byte that no repeat covers. Where repeats cover little of
    the block, what of them reaches into it for less than a window may be chance and stays."""
    if covered.sum() < COVERED * len(covered):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
        covered = covered.copy()
        for s, e in zip(edge[::2], edge[1::2]):
            covered[s:e] = e - s >= suffix.WINDOW
    ends = np.flatnonzero(np.frombuffer(text + b" ", np.uint8) == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    total = np.concatenate([[0], np.cumsum(covered)])
    stay = total[ends] - total[starts] < ends - starts
    return b" ".join(text[s:e] for s, e in zip(starts[stay], ends[stay])).decode()


def _cover_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, outside, masks of both directions) -> the blocks that repeats touch, by place,
    and what stays of them."""
    for b in batches:
        place = []
        for outside, masks in zip(b.column("outside").to_pylist(), b.column("masks")):
            raw = [t.encode() for t in outside]
            ends = np.cumsum([len(t) + 1 for t in raw]) - 1
            hit = suffix.covered(masks.values, np.frombuffer(b"\n".join(raw), np.uint8))
            left = [(i, t, _uncovered(r, hit[e - len(r):e])) for i, (t, r, e) in enumerate(zip(outside, raw, ends))]
            place.append([{"at": i, "kept": kept} for i, t, kept in left if kept != t])
        yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(place, pa.list_(pa.struct([("at", pa.int64()), ("kept", pa.string())])))], ["k", "drops"])


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, html, drops) -> the text of each page."""
    for b in batches:
        out = []
        for page, drops in zip(b.column("html").to_pylist(), b.column("drops").to_pylist()):
            got, left = blocks(page), {x["at"]: x["kept"] for x in drops or ()}
            inside = [t for t, main, no in got if main and not no]
            outside = [(t, no) for t, main, no in got if not main]
            rest = [left.get(i, t) for i, (t, no) in enumerate(outside) if not no]
            out.append("\n".join(inside or [t for t in rest if t]))
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], ["row", "text"])


def repeats(thin: DataFrame) -> DataFrame:
    """(k, drops): the blocks outside of main elements that strings of distinct pages of the
    host touch, in whichever order the pages come, with the words that stay; of the pages
    without a main part. Of equal streams of a host only the page with the smallest id is
    compared; what it finds holds for all."""
    stream = (thin.where("doc is not null and size(outside) > 0").withColumn("text", F.array_join("outside", "\n"))
              .withColumn("tag", F.shiftright(F.xxhash64("text"), 41)).withColumn("salt", F.xxhash64("host"))
              .withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)))
    digests = stream.select("doc", "salt", "sha")
    # stored first, so that AQE can split the join where one stream is very frequent
    first = materialise(digests.groupBy("salt", "sha").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high"), "first")
    copies = materialise(digests.join(first, ["salt", "sha"]).where("doc > low").select("doc", "salt", "sha", "low").distinct(), "copies")
    sift = maybe_in(stream, F.col("doc"), copies, "doc")
    stream = (sift.where("not __hit").drop("__hit").withColumn("low", F.col("doc"))
              .unionByName(sift.where("__hit").drop("__hit").join(copies, ["doc", "salt", "sha"], "left").withColumn("low", F.coalesce("low", "doc"))))
    own = stream.where("doc = low").select("doc", "text", "tag", "salt")
    ahead = suffix.repeat_masks(own)
    back = suffix.repeat_masks(own.withColumn("doc", -F.col("doc"))).withColumn("doc", -F.col("doc"))
    masks = (ahead.unionByName(back).groupBy(F.col("doc").alias("low"), F.shiftright("at", suffix.POS_BITS).alias("tag"))
             .agg(F.collect_list(F.struct("at", "mask")).alias("masks")))
    return (stream.where("not has_main").join(materialise(masks, "masks"), ["low", "tag"]).select("k", "outside", "masks")
            .mapInArrow(_cover_batches, "k long, drops array<struct<at:bigint,kept:string>>"))


def extract(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Every row of ``pages`` as ``row`` (its columns but the markup) with ``text``.

    Null and empty pages give an empty text; pages without a url form one host. Repeated
    rows keep what they say, as only distinct pages (by id) make a repeat. A null id is
    compared with nothing. An empty table gives an empty table.
    """
    rest = [F.col(c) for c in pages.columns if c != html]
    text = F.coalesce(F.col(html), F.lit(""))
    host = F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))
    key = F.xxhash64(F.col(page_id), F.col(url), text)
    thin = materialise(pages.select(F.col(page_id).cast("long").alias("doc"), key.alias("k"), host.alias("host"), text.alias("html")).mapInArrow(
        _thin_batches, "doc long, k long, host string, has_main boolean, outside array<string>"), "blocks")
    drops = materialise(repeats(thin).dropDuplicates(["k"]), "repeats")
    src = maybe_in(pages.select(F.struct(*rest).alias("row"), text.alias("html"), key.alias("k")), F.col("k"), drops, "k")
    direct = src.where("not __hit").select("row", "html", F.lit(None).cast("array<struct<at:bigint,kept:string>>").alias("drops"))
    joined = src.where("__hit").join(drops, "k", "left").select("row", "html", "drops")
    row_type = src.schema["row"].dataType.simpleString()
    return direct.unionByName(joined).mapInArrow(_text_batches, f"row {row_type}, text string")
