"""Connected components of an edge table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.session import cut_lineage, release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every endpoint.

    Large-star and small-star rounds until nothing changes: each node's larger
    neighbours are tied to its smallest one, then its smaller ones.  A round is
    two aggregates and two joins; a hub is one key of a map-side combined
    minimum and of a join whose other side has one row per node.  Every round
    is written to the checkpoint folder, and the round before it deleted.
    """
    e = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where("u <> v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u <> v").distinct())
        new = cut_lineage(small)
        same = (new.join(e, ["u", "v"], "left_anti").isEmpty()
                and e.join(new, ["u", "v"], "left_anti").isEmpty())
        release(e)
        if same:
            roots = new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        e = new
