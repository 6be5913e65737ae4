"""Isolation forest on Spark.

Training
    1. one pass draws a candidate pool of about ``pool_factor·trees·ψ`` rows
       with a keyed hash (a uniform, reproducible Bernoulli sample whose size
       does not grow with the table);
    2. the pool is exploded over the trees and each tree keeps the ψ rows
       with the smallest per-tree hash (a window over ≈1.5·ψ rows per tree);
    3. ``groupBy("tree").applyInPandas`` grows one isolation tree per group
       (random feature, uniform split inside the node's range, height limit
       ceil(log2 ψ)), seeded by (seed, tree). Each group holds ψ rows.
    The result is a node table (tree, node, feature, threshold, left, right,
    size, depth): at most trees·(2ψ-1) rows, independent of the data size.

Scoring
    The node table is collected once (bounded as above) and broadcast; an
    Arrow ``pandas_udf`` walks all trees level by level with numpy, so the
    per-row work is vectorised. decision = 0.5 - 2^(-E[h(x)]/c(ψ)) where
    h adds c(size) at the leaf (Liu, Ting & Zhou 2008); negative means
    anomalous, like the ``contamination='auto'`` convention.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow import constants as C

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),      # -1 = leaf
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("size", T.LongType()),
    T.StructField("depth", T.IntegerType()),
])


#: Rows that walk the trees together.
SCORE_ROWS = 256


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + C.EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _uniform(key: Column, *salt) -> Column:
    """A reproducible uniform [0, 1) value per (key, salt)."""
    h = F.xxhash64(key, *[F.lit(s) if not isinstance(s, Column) else s for s in salt])
    return F.pmod(h, F.lit(1 << 52)).cast("double") / float(1 << 52)


def tree_samples(df: DataFrame, features: list[str], key: str = "transaction_id",
                 n_trees: int = C.N_TREES, psi: int = C.MAX_SAMPLES, seed: int = C.FOREST_SEED,
                 oversample: float = 1.5, n: int | None = None) -> DataFrame:
    """Per-tree training samples: (tree, features...) with ψ rows per tree (all rows
    where there are fewer).

    Every tree draws from all rows: a row enters a tree if its hash with the tree is
    under 1.5 ψ / n, and the ψ smallest hashes stay. So a row is exploded into the few
    trees it enters, and a tree's window sees about 1.5 ψ rows, whatever n is.
    """
    n = df.count() if n is None else n
    psi = int(min(psi, n))
    p = oversample * psi / max(n, 1) + 40 / max(n, 1)
    base = df.select(F.col(key).alias("_key"), *[F.col(f).cast("double").alias(f) for f in features])
    # rows and trees meet in generated code and are filtered there; a filter of an array is interpreted
    t = (base.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
             .withColumn("_h", _uniform(F.col("_key"), seed, F.col("tree"))).where(F.col("_h") < F.lit(p)))
    w = Window.partitionBy("tree").orderBy("_h", "_key")
    return (t.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= psi)
             .select(F.col("tree").cast("int"), *features))


def _grow(pdf: pd.DataFrame, features: list[str], seed: int, psi: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    X = pdf[features].to_numpy(dtype=float)
    rng = np.random.default_rng([seed, tree])
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    rows = []

    def grow(idx: np.ndarray, depth: int) -> int:
        node = len(rows)
        rows.append(None)
        sub = X[idx]
        if depth >= max_depth or len(idx) <= 1:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] <= thr
        left = grow(idx[go_left], depth + 1)
        right = grow(idx[~go_left], depth + 1)
        rows[node] = (tree, node, f, thr, left, right, len(idx), depth)
        return node

    grow(np.arange(len(X)), 0)
    return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])


def train(df: DataFrame, features: list[str], key: str = "transaction_id", n_trees: int = C.N_TREES,
          psi: int = C.MAX_SAMPLES, seed: int = C.FOREST_SEED, n: int | None = None) -> DataFrame:
    """M1: the node table of an isolation forest over ``features`` (``n``: rows, if known)."""
    n = df.count() if n is None else n
    samples = tree_samples(df, features, key, n_trees, psi, seed, n=n)
    psi_eff = int(min(psi, n))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < psi_eff:               # 8 standard deviations off; repeated keys draw alike
            raise ValueError(f"tree {pdf['tree'].iloc[0]} drew {len(pdf)} of {psi_eff} rows")
        return _grow(pdf, features, seed, psi_eff)

    return samples.groupBy("tree").applyInPandas(build, schema=NODE_SCHEMA)


class Forest:
    """A trained forest: node arrays + the features and ψ it was built with."""

    def __init__(self, nodes: pd.DataFrame, features: list[str], psi: int):
        self.features = list(features)
        self.psi = int(psi)
        nodes = nodes.sort_values(["tree", "node"])
        trees = sorted(nodes["tree"].unique())
        width = int(nodes.groupby("tree")["node"].max().max()) + 1
        shape = (len(trees), width)
        self.feature = np.full(shape, -1, dtype=np.int64)
        self.threshold = np.zeros(shape)
        self.left = np.zeros(shape, dtype=np.int64)
        self.right = np.zeros(shape, dtype=np.int64)
        self.leaf_len = np.zeros(shape)
        for i, t in enumerate(trees):
            g = nodes[nodes["tree"] == t]
            n = g["node"].to_numpy()
            self.feature[i, n] = g["feature"].to_numpy()
            self.threshold[i, n] = g["threshold"].to_numpy()
            self.left[i, n] = np.maximum(g["left"].to_numpy(), 0)
            self.right[i, n] = np.maximum(g["right"].to_numpy(), 0)
            self.leaf_len[i, n] = g["depth"].to_numpy() + c_factor(g["size"].to_numpy())
        self.max_depth = int(nodes["depth"].max())
        self._nodes = None

    @classmethod
    def from_nodes(cls, nodes: DataFrame, features: list[str], psi: int) -> "Forest":
        # bounded: trees * (2 * psi - 1) rows at most
        return cls(nodes.toPandas(), features, psi)

    def decision(self, X: np.ndarray) -> np.ndarray:
        """0.5 - 2^(-E[h]/c(ψ)) for every row of X (n, n_features)."""
        n = X.shape[0]
        out = np.empty(n)
        for a in range(0, n, SCORE_ROWS):
            out[a:a + SCORE_ROWS] = self._depth(X[a:a + SCORE_ROWS])
        cpsi = float(c_factor([self.psi])[0]) or 1.0
        return 0.5 - np.power(2.0, -out / cpsi)

    def _depth(self, X: np.ndarray) -> np.ndarray:
        """E[h] of a few rows, whose state in all trees fits a core's cache. Leaves lead to themselves."""
        n, k = X.shape
        feature, threshold, child, leaf_len = self._flat()
        x = np.ascontiguousarray(X).ravel()
        rows = np.arange(n, dtype=np.intp) * k
        at = np.repeat(np.arange(self.feature.shape[0], dtype=np.intp)[:, None] * self.feature.shape[1], n, axis=1)
        for _ in range(self.max_depth):
            left = x.take(feature.take(at) + rows) <= threshold.take(at)
            at *= 2
            at += left
            at = child.take(at)
        return leaf_len.take(at).mean(axis=0)

    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Feature, threshold, children (right, left) and leaf length of all trees' nodes in one row."""
        if self._nodes is None:
            trees, width = self.feature.shape
            here = np.arange(trees * width, dtype=np.intp).reshape(trees, width)
            first, leaf = here[:, :1], self.feature < 0
            child = np.stack([np.where(leaf, here, first + self.right), np.where(leaf, here, first + self.left)], axis=-1)
            self._nodes = (np.where(leaf, 0, self.feature).astype(np.intp).ravel(), self.threshold.ravel(), child.astype(np.intp).ravel(), self.leaf_len.ravel())
        return self._nodes

    def score_column(self, spark) -> Column:
        """The decision score as a column: an Arrow pandas_udf over a struct
        of the model's features (NULL where a feature is missing / not finite)."""
        bc = spark.sparkContext.broadcast(self)

        @F.pandas_udf(T.DoubleType())
        def _score(feats: pd.DataFrame) -> pd.Series:
            X = feats.to_numpy(dtype=float)
            ok = np.isfinite(X).all(axis=1)
            out = np.full(len(X), np.nan)
            if ok.any():
                out[ok] = bc.value.decision(X[ok])
            return pd.Series(out)

        return _score(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features]))


def mini_forest_nodes() -> pd.DataFrame:
    """A fixed three-tree forest over (amount, account_avg_amount,
    deviation_from_avg), ψ = 256: the SQL-checkable case for the scorer."""
    rows = [
        # tree, node, feature, threshold, left, right, size, depth
        (0, 0, 0, 2000.0, 1, 4, 256, 0), (0, 1, 2, 2.0, 2, 3, 170, 1),
        (0, 2, -1, 0.0, -1, -1, 150, 2), (0, 3, -1, 0.0, -1, -1, 20, 2), (0, 4, -1, 0.0, -1, -1, 5, 1),
        (1, 0, 2, 5.0, 1, 4, 256, 0), (1, 1, 1, 800.0, 2, 3, 160, 1),
        (1, 2, -1, 0.0, -1, -1, 100, 2), (1, 3, -1, 0.0, -1, -1, 60, 2),
        (1, 4, 0, 6000.0, 5, 6, 4, 1), (1, 5, -1, 0.0, -1, -1, 3, 2), (1, 6, -1, 0.0, -1, -1, 1, 2),
        (2, 0, 1, 300.0, 1, 2, 256, 0), (2, 1, -1, 0.0, -1, -1, 40, 1),
        (2, 2, 0, 1500.0, 3, 4, 210, 1), (2, 3, -1, 0.0, -1, -1, 180, 2), (2, 4, -1, 0.0, -1, -1, 30, 2),
    ]
    return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])


def score_bounds(scored: DataFrame, raw: str = "raw_score") -> tuple[float, float]:
    """Min / max decision score (model metadata, two numbers)."""
    r = scored.agg(F.min(raw), F.max(raw)).first()
    return float(r[0]), float(r[1])


META = T.StructType([T.StructField("features", T.ArrayType(T.StringType())), T.StructField("psi", T.IntegerType()),
                     T.StructField("min_decision_score", T.DoubleType()), T.StructField("max_decision_score", T.DoubleType())])


def model_path(root: str, model: str, version: int) -> str:
    return f"{root.rstrip('/')}/{model}/version={int(version)}"


def save(nodes: DataFrame, root: str, model: str, version: int, features: list[str], psi: int, bounds: tuple[float, float]) -> str:
    """Store a model: node table, feature list, ψ and score bounds under (model, version).
    Writing a version again replaces it."""
    path = model_path(root, model, version)
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    meta = nodes.sparkSession.createDataFrame([(list(features), int(psi), float(bounds[0]), float(bounds[1]))], META)
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return path


def load(spark, root: str, model: str, version: int) -> tuple[Forest, float, float]:
    """(forest, min score, max score) of a stored model; the node table is bounded."""
    path = model_path(root, model, version)
    meta = spark.read.schema(META).parquet(f"{path}/meta").first()
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes")
    return Forest.from_nodes(nodes, list(meta["features"]), meta["psi"]), meta["min_decision_score"], meta["max_decision_score"]
