"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Edges of a round for each file of the next.  On a local file system a file costs its executor three processes.
EDGES = 1 << 18


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v; longs): the smallest node reachable.

    Alternating large-star and small-star steps: each joins the edges with every node's least neighbour, found by an
    aggregate with map-side combining, so a node with very many edges is never gathered in one task.  Every round is
    stored in the shared folder, in files by the number of edges before it, which a round doubles at most.  No edges
    give no rows.
    """
    e = C.stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), name)
    sums = lambda x: x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    now = sums(e)
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # now u > v: the small star of u is its neighbours v, and their least takes them all
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        new = C.stored(small.coalesce(-(-now.n // EDGES) or 1), name)
        e, before = new, now
        now = sums(e)
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
