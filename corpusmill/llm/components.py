"""Connected components by hooking and contraction, as joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import stored


def components(links: DataFrame) -> DataFrame | None:
    """``node`` and ``root`` (the smallest node it reaches) for every node of ``links`` (a, b); None without links.

    Each round hooks every node to its smallest neighbour, follows two such steps, and contracts the links to the
    nodes that are left. No neighbour list is gathered: a node with very many links costs a grouped minimum.
    """
    ends = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live, labels = stored(ends.distinct(), "links"), None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "hooks")
        for _ in range(2):
            over = hook.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
            hook = hook.join(over, F.col("up") == F.col("_n"), "left").select("node", F.coalesce("_u", "up").alias("up"))
        hook = stored(hook, "hooks")
        step = hook.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        if labels is None:
            labels = hook.withColumnRenamed("up", "root")
        else:
            labels = labels.join(step, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_u", "root").alias("root"))
        labels = stored(labels, "labels")
        live = live.join(step, F.col("a") == F.col("_n")).select(F.col("_u").alias("a"), "b")
        live = live.join(step, F.col("b") == F.col("_n")).select("a", F.col("_u").alias("b")).where("a <> b")
        live = stored(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return labels
