"""Connected components of a link table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (id, label): label is the smallest id of the component.

    Every larger end hooks onto its smallest neighbour, pointers jump once, and links
    between the new labels go on to the next round until none is left. Rounds grow
    with the logarithm of the longest chain; only a flag per round reaches the driver.
    """
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = materialise(links.select(*pair).where("a < b").distinct(), "links")
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id"))
    while not edges.isEmpty():
        up = edges.groupBy("b").agg(F.min("a").alias("p"))
        jump = up.alias("x").join(up.select(F.col("b").alias("q"), F.col("p").alias("pp")), F.col("p") == F.col("q"), "left")
        up = materialise(jump.select("b", F.coalesce("pp", "p").alias("p")), "hooks")
        labels = materialise(labels.join(up, labels.label == up.b, "left").select("id", F.coalesce("p", "label").alias("label")), "labels")
        for end in ("a", "b"):
            h = up.select(F.col("b").alias("_k"), "p")
            edges = edges.join(h, F.col(end) == F.col("_k"), "left").withColumn(end, F.coalesce("p", end)).drop("_k", "p")
        edges = materialise(edges.select(*pair).where("a < b").distinct(), "links")
    return labels
