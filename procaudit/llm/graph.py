"""Connected components as Spark jobs: nodes hook to their least neighbour and the graph of the roots is next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procaudit.llm.common import saved


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200) -> DataFrame:
    """(node, label): for each node of a link the least node that links reach from it; no rows without links.

    A round joins each link twice and leaves those between different roots, once each, so the work falls from round
    to round; a hub costs its links, not their square.
    """
    edges = saved(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "links")
    labels: DataFrame | None = None
    for _ in range(most_rounds):
        ends = edges.select(F.col("b").alias("node"), F.col("a").alias("other")).union(edges.select(F.col("a"), F.col("a")))
        hooked = ends.groupBy("node").agg(F.min("other").alias("up"))
        hooked = saved(hooked, "roots")
        for _ in range(2):  # two steps further up the chain
            above = hooked.select(F.col("node").alias("up"), F.col("up").alias("above"))
            hooked = hooked.join(above, "up").select("node", F.col("above").alias("up"))
        hooked = saved(hooked, "roots")
        labels = hooked.withColumnRenamed("up", "label") if labels is None else labels.join(hooked.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        labels = saved(labels, "labels")
        left, right = hooked.select(F.col("node").alias("a"), F.col("up").alias("ra")), hooked.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        met = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = saved(met.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return labels
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")
