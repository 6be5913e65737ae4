import hashlib
import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     # names that the operators use inside
                     T.StructField("doc", T.StringType()), T.StructField("row", T.StringType()), T.StructField("g", T.LongType()), T.StructField("tag", T.StringType())])

WORDS = {
    "en": "the of and to in is that for with was on are this from they have not which river stone market garden window letter engine morning paper bridge".split(),
    "de": "der die und das nicht mit von ist auf für eine werden sich auch Straße Garten Fenster Brücke Morgen Wasser schreiben zwischen heute Schule".split(),
    "fr": "le la les des et une est dans pour que qui sur avec pas plus fenêtre jardin rivière maison lettre toujours école pierre marché".split(),
    "es": "el los las una que con por para del más pero como ventana jardín piedra mañana carta siempre escuela río mercado niño señor".split(),
}


def prose(seed: int, words: int, lang: str = "en") -> str:
    r = random.Random(seed)
    out = [r.choice(WORDS[lang]) + (str(r.randrange(1000)) if r.random() < 0.3 else "") for _ in range(words)]
    return " ".join(out)


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang) with nulls, empty texts, copies, near copies, shared passages,
    repeated rows, a long text, multi-byte letters and rows without an id."""
    shared = prose(900, 30)
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(0, base, "en"), (1, base, "en"), (2, " ".join(near), "en"), (3, None, "en"), (4, "", "en"), (5, " \n\t", None),
            (6, prose(2, 40) + " " + shared + " " + prose(3, 40), "en"), (7, prose(4, 30) + " " + shared + " " + prose(5, 30), "en"),
            (7, prose(4, 30) + " " + shared + " " + prose(5, 30), "en"), (8, "a" * 400, "en"), (9, "a" * 300 + "b", None), (10, "ñandú 日本 " * 40, "es"),
            (11, "x ñandú 日本 " * 20, "es"), (12, "two words", "en"), (13, "TWO words", "en"), (14, "12 34 . 5", "en"), (None, base, "en"), (None, None, None),
            (15, prose(6, 4000, "de"), "de"), (16, prose(7, 60, "de") + " " + shared, "de"), (17, prose(8, 50, "fr"), "fr"), (18, prose(9, 50, "es"), "es")]
    rows += [(100 + i, prose(50 + i, 60, lang), lang) for i in range(24) for lang in [list(WORDS)[i % 4]]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, lang, "s", len(t or ""), "d", "r", 1, "t") for i, t, lang in corpus]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
