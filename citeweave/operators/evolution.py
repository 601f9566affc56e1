"""Cluster-evolution graph and its layout.

Nodes are the selected clusters keyed ``"bin-cluster"``; edges are the
weighted links between them.  The drawing itself is not built: the layout
and display values are tables a plotting client reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.schema import LAYOUT_Y_SPACING, PALETTE_SLOTS


def ordinal(values: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """0-based position of each distinct ``column`` value in sorted order, by a
    distributed sort and partition offsets."""
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    from citeweave.operators.community.framework import dense_rank_ids
    return dense_rank_ids(distinct, [column], name)


def node_key(bin_col: str = "bin", cluster_col: str = "cluster"):
    """the ``"bin-cluster"`` key used at the JSON boundary."""
    return F.concat_ws("-", F.col(bin_col).cast("string"), F.col(cluster_col).cast("string"))


def field_ranks(dist: DataFrame) -> DataFrame:
    """A16 + W2: every field seen in any field distribution, its sorted
    position and palette slot (position mod 20)."""
    ranks = ordinal(dist.where(F.col("kind") == "field").select(F.col("value").alias("field")),
                    "field", "field_rank")
    return ranks.withColumn("palette_slot", F.col("field_rank") % PALETTE_SLOTS)


def dominant_fields(dom: DataFrame) -> DataFrame:
    """The set of fields that dominate at least one cluster."""
    return dom.select(F.col("dominant_field").alias("field")).distinct()


def layout(clusters: DataFrame, dom: DataFrame, ranks: DataFrame) -> DataFrame:
    """W1 + F15 + F16: per bin, clusters ordered by (rank of dominant field,
    size desc, cluster id); x = bin, y = position x 1.4.  A cluster with
    no or an unknown dominant field ranks after all fields and is grey."""
    n_fields = ranks.count()
    nodes = (clusters.join(dom.select("bin", "cluster", "dominant_field"),
                           ["bin", "cluster"], "left")
             .join(ranks.withColumnRenamed("field", "dominant_field"), "dominant_field", "left")
             .withColumn("sort_rank", F.coalesce(F.col("field_rank"), F.lit(n_fields + 1))))
    w = Window.partitionBy("bin").orderBy("sort_rank", F.desc("elements"), "cluster")
    return nodes.select(
        node_key().alias("node_id"), "bin", "cluster", "elements", "dominant_field",
        F.col("sort_rank").cast("bigint").alias("sort_rank"),
        F.col("bin").cast("double").alias("x"),
        F.round((F.row_number().over(w) - 1) * F.lit(LAYOUT_Y_SPACING), 9).alias("y"),
        F.round(100 * F.log(F.greatest(F.col("elements") * 35, F.lit(1))), 9).alias("display_size"),
        F.col("palette_slot").cast("bigint").alias("palette_slot"),
        F.col("palette_slot").isNull().alias("grey"),
        F.col("cluster").cast("string").alias("label"),
    )


def evolution_edges(links: DataFrame) -> DataFrame:
    """G11 edges: citing cluster -> cited cluster with weight and width."""
    return links.select(
        node_key().alias("src"), node_key("dst_bin", "dst_cluster").alias("dst"),
        "weight", F.round(100 * F.col("weight"), 9).alias("width"))
