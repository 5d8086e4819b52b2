"""Connected components of a table of links, by joins and map-side combined minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node reachable.

    Each round gives a node the least root among its neighbours and then the
    root of that root, so chains shorten geometrically.  A round's result is
    written to the shared folder: lineage stays one round long.  Nothing but a
    count of changes reaches the driver.  The joins are plain equi-joins on a
    key that is unique on one side, which adaptive execution splits where a
    node has very many links.
    """
    both = links.where("a <> b").select("a", "b")
    both = saved(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        near = both.join(roots, both.b == roots.node).groupBy("a").agg(F.min("root").alias("m"))
        step = roots.join(near, roots.node == near.a).select("node", F.col("root").alias("was"), F.least("root", "m").alias("mid"))
        # A root is a node too: follow it once.
        jump = roots.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        new = saved(step.join(jump, "mid", "left").select("node", "was", F.least("mid", F.coalesce("top", "mid")).alias("root")), "roots")
        changed = new.where("root <> was").limit(1).count()
        roots = new.select("node", "root")
        if not changed:
            return roots
