"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, scratch: common.Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp (the least node of its component) of every node of an edge.

    Alternates large and small stars: each node's neighbours are tied to the least of them, until nothing changes. Minima are
    taken within tasks before the shuffle, and every round is written to the shared folder.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = scratch.keep(e, "edges")
    size = e.count()
    while size:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = large.join(down, "u").select(tied.alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        new = scratch.keep(small, "edges")
        left, size = size, new.count()
        changed = size != left or new.join(e, ["u", "v"], "left_anti").limit(1).count() > 0
        e = new
        if not changed:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
