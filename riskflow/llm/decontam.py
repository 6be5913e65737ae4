"""Benchmark decontamination by template windows (DataFrame functions only).

Texts become templates: numbers, names and units behind numbers turn into typed
placeholders, the rest into lower-case words. A title-case word inside a sentence is a
name; any other word that begins with a capital may be one. Windows of WIDTH template
words are hashed in all forms, each capitalised word as a name and as a plain word, and
joined with those of the benchmark: two windows agree if any of their forms do, so copies
in another case agree by their plain forms. A window counts once, as the form with names
where they are certain. A document
leaks an item if it holds at least PERCENT of the item's distinct windows. Where the
item has placeholders, the windows must also agree on how the item's values map to the
document's: an item value that maps to several document values, or the other way round,
is a coincidence of forms, and the windows with such a value do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import materialise, maybe_in

WIDTH = 5
PERCENT = 80
BROADCAST_WINDOWS = 1_000_000     # benchmark windows (16 bytes each) up to which they are broadcast

MARK = "\u0001"
# Unit words that turn into a placeholder behind a number.
UNITS = ("mm cm m km in ft yd mi mg g kg t lb oz ml l ms s sec min h hr d wk yr "
         "second seconds minute minutes hour hours day days week weeks month months year years "
         "meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet "
         "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres "
         "dollar dollars euro euros cent cents percent degree degrees").split()


SUBSETS = [[m for m in range(1 << WIDTH) if m & ~caps == 0] for caps in range(1 << WIDTH)]
#: Bits of the filter of the benchmark's words; a plain value of 32 KB in the plan however many there are.
WORD_BITS = 1 << 18


def marked(text: Column) -> Column:
    """The text in lower case with MARK and a type letter before names (n), words that may be
    one (c), numbers (d) and units (u). A letter and an apostrophe before a word (O'Brien)
    belong to it."""
    t = F.translate(F.coalesce(text, F.lit("")), MARK, " ")
    t = F.regexp_replace(t, r"['\u2019](?=\p{L})(?<=(?<![\p{L}\p{N}])\p{L}.)", "")
    t = F.regexp_replace(t, r"\p{Lu}(?<=[\p{L}\p{N},;][ \t].)\p{Ll}+", MARK + "n$0")
    t = F.regexp_replace(t, rf"[\p{{Lu}}\p{{Lt}}](?<![\p{{L}}\p{{N}}{MARK}].)", MARK + "c$0")
    t = F.regexp_replace(t, r"([0-9]+)(?:[.,:]([0-9]+))?(?:[.,:]([0-9]+))?", f" {MARK}d$1x$2x$3 ")
    t = F.regexp_replace(t, f"({MARK}d[^ ]* )[ \\t]*(?:{MARK}[nc])?((?i:{'|'.join(sorted(UNITS, key=len, reverse=True))}))(?![\\p{{L}}\\p{{N}}])", f"$1{MARK}u$2 ")
    return F.lower(t)


def _split(t: Column) -> Column:
    return F.array_remove(F.split(t, rf"[^\p{{L}}\p{{N}}{MARK}]+"), "")


def words(text: Column) -> Column:
    """Template words with their values: MARK, a type letter and the value, or a plain word."""
    return _split(marked(text))


def _kind(w: Column) -> Column:
    """2 for a certain name, 1 for a word that may be one, else 0."""
    return F.when(w.startswith(MARK + "n"), 2).when(w.startswith(MARK + "c"), 1).otherwise(0)


def _parsed(rows: DataFrame, m: str) -> DataFrame:
    """``rows`` with a marked text ``m`` -> with ``ws``, its words, ``p``, the template without
    names, and ``c``, the kinds of its words. Marks begin a word, so all are of one length.
    They are columns of their own beneath, so that the lambdas do not make the words anew
    for every window; callers explode with explode_outer, as explode would infer a filter
    that is pushed below them."""
    plain = F.regexp_replace(F.regexp_replace(F.col(m), MARK + "[nc]", ""), f"({MARK}[du])[^ ]*", "$1")
    return rows.withColumn("ws", _split(F.col(m))).withColumn("p", _split(plain)).withColumn("c", F.transform("ws", _kind))


def _word_bit(w: Column) -> Column:
    return F.xxhash64(w).bitwiseAND(WORD_BITS - 1)


def _vocabulary(items: DataFrame) -> Column:
    """The words of parsed ``items`` as bits of longs; what a document shares with an item can
    have no other plain word."""
    bit = items.select(F.explode("p").alias("w")).select(_word_bit(F.col("w")).alias("x"))
    at = {r["at"]: r["bits"] for r in bit.groupBy(F.shiftright("x", 6).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(63).cast("int"))).alias("bits")).collect()}
    return F.split(F.lit(",".join(str(at.get(i, 0)) for i in range(WORD_BITS // 64))), ",").cast("array<bigint>")


def _windows(parsed: DataFrame, *key: str, vocabulary: Column | None = None, values: bool = False) -> DataFrame:
    """(*key, i, short, p, c, ok[, ws]) of each window of parsed rows: WIDTH words from ``i``, or a
    whole shorter template. With a vocabulary, windows with a word that is no name candidate
    and is not in it are left out; ``ok`` tells which words are in it."""
    if vocabulary is None:
        rows = parsed.withColumn("ok", F.transform("p", lambda w: F.lit(True)))
    else:
        rows = parsed.withColumn("x", F.transform("p", _word_bit)).withColumn("ok", F.transform("x", lambda x: F.bit_get(
            F.get(vocabulary, F.shiftright(x, 6).cast("int")), x.bitwiseAND(63).cast("int")) == 1))
    at = F.when(F.size("p") > 0, F.sequence(F.lit(0), F.greatest(F.size("p") - WIDTH, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def alive(i):
        out = F.lit(True)
        for k in range(WIDTH):
            out = out & (F.coalesce(F.get("ok", i + k), F.lit(True)) | (F.get("c", i + k) > 0))
        return out

    keep = ["p", "c", "ok", *(["ws"] if values else [])]
    at = at if vocabulary is None else F.filter(at, alive)
    win = F.transform(at, lambda i: F.struct(i.alias("i"), *[F.slice(F.col(x), i + 1, WIDTH).alias(x) for x in keep]))
    return (rows.select(*key, (F.size("p") < WIDTH).alias("short"), F.explode_outer(win).alias("w")).where("w is not null")
            .select(*key, "short", "w.*"))


def _hash(m: Column) -> Column:
    """Hash of a window with the words of the bit mask ``m`` as names; of the whole template
    where it is shorter than WIDTH."""
    word = [F.when(m.bitwiseAND(1 << k) != 0, MARK + "n").otherwise(F.get("p", F.lit(k))) for k in range(WIDTH)]
    return F.when(~F.col("short"), F.xxhash64(*word)).otherwise(F.xxhash64(F.concat(F.lit(MARK), F.concat_ws(" ", *[
        F.when(F.size("p") > k, word[k]) for k in range(WIDTH)]))))


def _mask(test) -> Column:
    bit = [F.when(F.coalesce(test(k), F.lit(False)), 1 << k).otherwise(0) for k in range(WIDTH)]
    return sum(bit[1:], bit[0])


def _forms(windows: DataFrame) -> DataFrame:
    """Windows in all their forms: ``m``, which words are names, and ``h``. A name candidate
    outside of the vocabulary is a name in any form that can be shared."""
    cand = lambda k: F.get("c", F.lit(k)) > 0
    ok = lambda k: F.get("ok", F.lit(k))
    out = windows.withColumn("always", _mask(lambda k: cand(k) & ~ok(k))).withColumn("free", _mask(lambda k: cand(k) & ok(k)))
    out = out.withColumn("m", F.explode(F.get(F.lit(SUBSETS), F.col("free")))).withColumn("m", F.col("m").bitwiseOR(F.col("always")))
    return out.withColumn("h", _hash(F.col("m"))).drop("always", "free")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
          item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, n_slots) for each document that leaks an item.

    Null, empty and wordless texts leak nothing and are leaked by nothing; rows without
    an id are left out; an item shorter than WIDTH words needs the whole template to be
    the document's. Repeated documents are reported once an id (any of its texts counts),
    repeated items by their id. Empty tables give an empty table.
    """
    items = materialise(_parsed(benchmark.select(F.col(item_id).alias("item"), marked(F.col(item_text)).alias("m")), "m")
                        .where("item is not null and size(p) > 0").select("item", "ws", "p", "c"), "items")
    windows = _windows(items.withColumn("row", F.xxhash64("ws")), "item", "row").withColumn("w", _hash(_mask(lambda k: F.get("c", F.lit(k)) == 2)))
    sizes = windows.groupBy("item", "row").agg(F.count_distinct("w").alias("n")).groupBy("item").agg(F.max("n").cast("long").alias("n_windows"))
    keys = materialise(_forms(windows).select("item", "w", "h").distinct(), "keys")
    only = keys.select("h").distinct()
    some = F.broadcast if keys.count() <= BROADCAST_WINDOWS else (lambda df: df)
    vocabulary = _vocabulary(items)
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    forms = _forms(_windows(_parsed(rows.select("doc", marked(F.col("text")).alias("m")), "m"), "doc", vocabulary=vocabulary))
    seen = materialise(forms.select("doc", "h").join(some(only), "h", "left_semi").distinct(), "windows")
    hits = (seen.join(some(keys), "h").groupBy("doc", "item").agg(F.count_distinct("w").alias("n_matched"))
            .join(F.broadcast(sizes) if some is F.broadcast else sizes, "item")
            .where(F.col("n_matched") * 100 >= F.col("n_windows") * PERCENT))
    hits = materialise(hits, "hits")
    # words that may be names make slots too, as forms with them count
    slotted = items.where(F.exists("ws", lambda w: w.startswith(MARK)))
    checked = _consistent(hits.join(slotted.select("item").distinct(), "item", "left_semi"), rows, slotted, vocabulary, some(only))
    plain = hits.join(slotted.select("item").distinct(), "item", "left_anti").withColumn("n_slots", F.lit(0).cast("long"))
    return plain.unionByName(checked).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_matched", "n_windows", "n_slots")


def _value(w: Column) -> Column:
    """The value of a marked word behind its type letter; words that may be names are names here."""
    return F.when(w.startswith(MARK + "c"), F.concat(F.lit("n"), F.substring(w, F.lit(3), F.length(w)))).otherwise(F.substring(w, F.lit(2), F.length(w)))


def _slots(windows: DataFrame, *keep: str) -> DataFrame:
    """(*keep, h, values): the forms of windows with the values of their placeholders in order."""
    slot = [F.when((F.col("m").bitwiseAND(1 << k) != 0) | F.get("p", F.lit(k)).startswith(MARK), _value(F.get("ws", F.lit(k)))) for k in range(WIDTH)]
    return _forms(windows).select(*keep, "h", F.array_compact(F.array(*slot)).alias("values"))


def _consistent(pairs: DataFrame, rows: DataFrame, slotted: DataFrame, vocabulary: Column, only: DataFrame) -> DataFrame:
    """Candidates with slots, counted without the windows whose values contradict the
    rest of the pair's mapping. The mapping of a value is the one that most windows show
    (ties: the smaller text)."""
    ends = pairs.select("doc").distinct()
    near = maybe_in(rows, F.col("doc"), ends, "doc").where("__hit").drop("__hit").join(ends, "doc", "left_semi")
    near = materialise(_parsed(near.select("doc", marked(F.col("text")).alias("m")), "m").select("doc", "ws", "p", "c"), "words")
    left = (_slots(_windows(near, "doc", vocabulary=vocabulary, values=True), "doc").join(only, "h", "left_semi").distinct()
            .withColumnRenamed("values", "dv"))
    named = _windows(slotted, "item", values=True).withColumn("w", _hash(_mask(lambda k: F.get("c", F.lit(k)) == 2)))
    right = _slots(named, "item", "w").withColumnRenamed("values", "iv")
    both = (pairs.select("doc", "item", "n_windows").join(right, "item").join(left, ["doc", "h"])
            .groupBy("doc", "item", "n_windows", "w", "h", "iv").agg(F.collect_set("dv").alias("dvs")))
    both = both.withColumn("dv", F.explode("dvs")).drop("dvs")
    both = materialise(both.withColumn("zip", F.arrays_zip(F.col("iv").alias("a"), F.col("dv").alias("b"))), "slots")
    votes = (both.select("doc", "item", "w", F.explode("zip").alias("z")).groupBy("doc", "item", F.col("z.a").alias("a"), F.col("z.b").alias("b"))
             .agg(F.count_distinct("w").alias("n")))
    there = votes.groupBy("doc", "item", "a").agg(F.max_by("b", F.struct("n", F.hex("b"))).alias("b"))
    back = votes.groupBy("doc", "item", "b").agg(F.max_by("a", F.struct("n", F.hex("a"))).alias("a"))
    agreed = there.join(back, ["doc", "item", "a", "b"]).groupBy("doc", "item").agg(F.collect_set(F.struct("a", "b")).alias("agreed"))
    ok = (both.join(agreed, ["doc", "item"], "left")
          .where((F.size("zip") == 0) | F.forall("zip", lambda z: F.coalesce(F.array_contains("agreed", F.struct(z["a"].alias("a"), z["b"].alias("b"))), F.lit(False)))))
    out = ok.groupBy("doc", "item", "n_windows").agg(F.count_distinct("w").alias("n_matched"))
    # a word that may be a name and stays the same is no slot
    sure = slotted.groupBy("item").agg(F.flatten(F.collect_list(F.transform(F.filter("ws", lambda w: w.startswith(MARK) & ~w.startswith(MARK + "c")), _value))).alias("sure"))
    slots = agreed.join(sure, "item").select("doc", "item", F.size(F.filter("agreed", lambda x: (x["a"] != x["b"]) | F.array_contains("sure", x["a"]))).cast("long").alias("n_slots"))
    return (out.where(F.col("n_matched") * 100 >= F.col("n_windows") * PERCENT).join(slots, ["doc", "item"], "left")
            .select("item", "doc", "n_matched", "n_windows", F.coalesce("n_slots", F.lit(0).cast("long")).alias("n_slots")))
