"""Hierarchical language identification.

The language family is predicted first, by one-versus-rest linear support vector
machines; within the family one-versus-one machines separate the related languages by
votes, ties going to the larger sum of margins. Features are hashed byte 2-, 3- and
4-grams of the whole text, A-Z lower-cased, with log counts scaled to unit length.

The classifier is fitted on a bounded sample: TRAIN_PER_LANG labelled rows a language,
TRAIN_ROWS in all, chosen by the hash of the id. Everything else sees all rows.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import seeded, utf8

TRAIN_PER_LANG = 250
TRAIN_ROWS = 4000
DIM = 4096
SEGMENT = 1 << 21
UNKNOWN = "und"

# Language families by ISO 639-1 code. Other codes are families of their own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "turkic": "az kk ky tk tr tt ug uz".split(),
    "indic": "bn gu hi mr ne or pa si ur".split(),
    "semitic": "am ar he mt".split(),
    "uralic": "et fi hu".split(),
    "celtic": "br cy ga gd".split(),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = seeded(256, 7)[_LOWER]
_MUL = seeded(4, 8)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"={lang}")


def features(text: np.ndarray) -> np.ndarray:
    """Unit vector of hashed n-gram log counts of a whole text given as bytes."""
    counts = np.zeros(DIM, np.int64)
    for a in range(0, len(text), SEGMENT):
        h1 = _BYTE[text[a:a + SEGMENT + 3]]
        h2 = h1[:-1] * _MUL[0] + h1[1:]
        h3 = h2[:-1] * _MUL[1] + h1[2:]
        h4 = h2[:-2] * _MUL[2] + h2[2:]
        for h in (h2, h3, h4):
            counts += np.bincount((h * _MUL[3] >> np.uint64(52)).astype(np.int64), minlength=DIM)
    v = np.log1p(counts).astype(np.float32)
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def has_letter(text: np.ndarray) -> bool:
    if _ASCII_LETTER[text].any():
        return True
    return any(map(str.isalpha, text.tobytes().decode("utf-8", "ignore"))) if len(text) else False


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights (bias last) of an L2-regularised squared-hinge machine, by dual
    coordinate descent over the Gram matrix; y is +1 or -1."""
    q = (x @ x.T).astype(np.float64)
    q += 1.0
    q *= y[:, None]
    q *= y
    q[np.diag_indices(len(y))] += 0.5 / c
    alpha, grad = np.zeros(len(y)), -np.ones(len(y))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            step = max(0.0, alpha[i] - grad[i] / q[i, i]) - alpha[i]
            if step:
                alpha[i] += step
                grad += step * q[:, i]
    a = alpha * y
    return np.append(a.astype(np.float32) @ x, np.float32(a.sum()))


@dataclass(frozen=True)
class Model:
    """families: one row of weights a family (none for a single one); pairs: (a, b) -> weights, positive for a."""
    families: list[str]
    family_w: np.ndarray
    members: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        x = np.append(v, np.float32(1))
        margin = self.family_w @ x if len(self.families) > 1 else np.ones(1)
        name = self.families[int(margin.argmax())]
        least = float(margin.max() - np.partition(margin, -2)[-2]) / 2 if len(margin) > 1 else 1.0
        langs = self.members[name]
        if len(langs) == 1:
            return langs[0], _share(least)
        votes = {lang: [0, 0.0] for lang in langs}
        seen = {}
        for (a, b), w in self.pairs.items():
            if a in votes and b in votes:
                m = float(w @ x)
                seen[a, b] = m
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
        best = max(langs, key=lambda k: (votes[k], k))
        inner = min(m if a == best else -m for (a, b), m in seen.items() if best in (a, b))
        return best, _share(min(least, inner))


def _share(margin: float) -> float:
    return float(1 / (1 + np.exp(-3 * margin)))


def fit(vectors: np.ndarray, langs: list[str]) -> Model | None:
    """Fit on one row of features a sampled document; None without rows."""
    if not langs:
        return None
    lang = np.array(langs)
    fam = np.array([family(x) for x in langs])
    names = sorted(set(fam))
    one = [fit_svm(vectors, np.where(fam == f, 1.0, -1.0)) for f in names[:1 if len(names) == 2 else None]] if len(names) > 1 else []
    family_w = np.stack(one if len(names) != 2 else [one[0], -one[0]]) if one else np.zeros((0, DIM + 1), np.float32)
    members = {f: sorted(set(lang[fam == f])) for f in names}
    pairs = {}
    for f in names:
        for a, b in itertools.combinations(members[f], 2):
            on = (lang == a) | (lang == b)
            pairs[a, b] = fit_svm(vectors[on], np.where(lang[on] == a, 1.0, -1.0))
    return Model(names, family_w, members, pairs)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = utf8(b.column("text"))
        texts = [data[off[i]:off[i + 1]] for i in range(len(b))]
        on = [i for i, t in enumerate(texts) if has_letter(t)]
        yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(on, pa.int64())), pa.array([features(texts[i]).tobytes() for i in on], pa.binary())], ["lang", "v"])


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All sampled (lang, vector) rows -> the model; the order of rows never matters."""
    pairs = sorted((lang, v) for b in batches for lang, v in zip(b.column("lang").to_pylist(), b.column("v").to_pylist()))
    if pairs:
        model = fit(np.stack([np.frombuffer(v, np.float32) for _, v in pairs]), [lang for lang, _ in pairs])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """Fit on the sample of ``labelled`` described above (rows with null text or label are left out)."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(key).bitwiseAND(2**63 - 1).alias("k")).where("text is not null and lang is not null")
    known = rows.groupBy("lang").count().orderBy("lang").limit(TRAIN_ROWS + 1).collect()
    if len(known) > TRAIN_ROWS:
        raise ValueError(f"more than {TRAIN_ROWS} languages")
    each = min(TRAIN_PER_LANG, max(1, TRAIN_ROWS // max(1, len(known))))
    # the threshold on the hash keeps about twice the rows needed of each language, so only they are ranked
    share = {r["lang"]: min(1.0, 2 * each / r["count"] + 20 / r["count"]) for r in known}
    low = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(min(int(v * 2.0**63), 2**63 - 1)))]) if share else F.lit(None)
    if not share:
        return None
    some = rows.where(F.col("k") <= low[F.col("lang")])
    # rows of one id have one hash; the text's settles which of them are taken
    order = Window.partitionBy("lang").orderBy("k", F.xxhash64("text"))
    chosen = some.withColumn("at", F.row_number().over(order)).where(F.col("at") <= each).select("text", "lang")
    # one task fits the machines on the bounded sample, so the vectors never reach the driver
    made = chosen.mapInArrow(_features_of, "lang string, v binary").repartition(1).mapInArrow(_fit_batches, "model binary").first()
    return pickle.loads(made["model"]) if made is not None else None


def predict(rows: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All rows as ``row`` (a struct of their columns) with ``lang_pred`` and ``score``.

    Texts of any length are read whole, in segments; repeated rows are answered alike. An
    empty table gives an empty table. ``und`` with score 0 where the text is null, empty or without a letter, or where no
    label was there to learn from. Only the text is looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("row").field(text))
            out = []
            for i in range(len(b)):
                t = data[off[i]:off[i + 1]]
                out.append(model.predict(features(t)) if model is not None and has_letter(t) else (UNKNOWN, 0.0))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["row", "lang_pred", "score"])

    src = rows.select(F.struct("*").alias("row"))
    return src.mapInArrow(run, f"row {src.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
