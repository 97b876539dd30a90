"""Connected components of a link table by hooking and contraction.

Each round every vertex with a smaller neighbour hooks onto its smallest, pointer jumping takes the hooks to their roots, and the links are
rewritten to the roots. A root that no neighbour hooks onto gets a smaller neighbour, so within two rounds every root hooks or absorbs one, and
the number of vertices that still have links halves: rounds grow with the logarithm of a component's size, and the jumps of a round with the
logarithm of its longest chain. Nothing is collected; each step ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.shared import cut


def rooted(hook: DataFrame) -> DataFrame:
    """``(hi, low)`` with low < hi -> the same with low the end of its chain; each step takes two jumps, so a chain is a quarter as long after it."""
    while True:
        nxt = hook.select(F.col("hi").alias("mid"), F.col("low").alias("far"))
        for k in range(2):
            hook = hook.join(nxt, hook.low == nxt.mid, "left").select("hi", F.coalesce("far", "low").alias("low"), F.col("far").isNotNull().alias("moved"))
            if not k:
                twice = hook.select(F.col("hi").alias("mid"), F.col("low").alias("far"))
                nxt = twice
        hook = cut(hook, "hooks")
        if hook.where("moved").isEmpty():
            return hook.drop("moved")
        hook = hook.drop("moved")


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` with long vertices -> ``(vertex, component_id)``, one row per vertex that has a link.

    component_id is the smallest vertex reachable. Nulls and self-links are ignored, repeated links count once; an empty
    table gives an empty one.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    labels = edges.select(F.explode(F.array("hi", "lo")).alias("vertex")).distinct().withColumn("component_id", F.col("vertex"))
    while not edges.isEmpty():
        hook = rooted(cut(edges.groupBy("hi").agg(F.min("lo").alias("low")), "hooks"))
        labels = cut(labels.join(hook, labels.component_id == hook.hi, "left").select("vertex", F.coalesce("low", "component_id").alias("component_id")), "labels")
        one = hook.select(F.col("hi").alias("h1"), F.col("low").alias("t1"))
        two = hook.select(F.col("hi").alias("h2"), F.col("low").alias("t2"))
        moved = edges.join(one, edges.hi == one.h1, "left").join(two, edges.lo == two.h2, "left").select(F.coalesce("t1", "hi").alias("x"), F.coalesce("t2", "lo").alias("y"))
        edges = cut(moved.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "links")
    return labels
