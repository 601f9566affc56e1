"""Community detection on citation graphs keyed by bin.

``detect(edges, method)`` takes (bin, src, dst[, weight]) rows - one graph
per bin, all solved in the same Spark jobs - and returns (bin, node,
cluster) with cluster ids 0..k-1 per bin by size.  Parallel edges add
weight; self-loops are kept.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators.community import framework as fw
from citeweave.session import shuffles_for


class Method(Enum):
    LEIDEN = "leiden"
    INFOMAP = "infomap"
    SBM = "sbm"


def detect(edges: DataFrame, method: str, weight: str | None = None,
           seed: int = 0, log: list | None = None, directed: bool = True) -> DataFrame:
    """Dispatch on a case-insensitive method name; unknown -> ValueError.

    With ``directed=False`` every edge counts in both directions: modularity is
    then the undirected one, and the walk of the map equation follows edges
    either way without teleportation.  The block model counts directed edges
    only; it takes neither ``directed=False`` nor real ``weight``s.
    """
    try:
        m = Method(str(method).lower())
    except ValueError:
        raise ValueError(f"Unsupported clustering method: {method}") from None
    if m is Method.SBM and (weight or not directed):
        raise ValueError("the block model needs directed edges without weights")
    graph = fw.weighted_edges(edges, weight)
    if not directed:
        graph = fw.weighted_edges(graph.unionByName(graph.select(
            "bin", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "w")
    ids, e = fw.index_nodes(graph)
    with shuffles_for(e.sparkSession, e.count()):
        if m is Method.LEIDEN:
            from citeweave.operators.community.modularity import optimise
            member, _ = optimise(e, seed=seed, log=log)
        elif m is Method.INFOMAP:
            from citeweave.operators.community.mapeq import optimise as infomap
            member = infomap(e, seed=seed, log=log, directed=directed)
        else:
            from citeweave.operators.community.sbm import optimise as sbm
            member = sbm(e, seed=seed, log=log)
    return fw.relabel(ids, member)


def _in_id_space(edges: DataFrame, membership: DataFrame, weight: str | None):
    ids, e = fw.index_nodes(fw.weighted_edges(edges, weight))
    if "bin" not in membership.columns:
        membership = membership.withColumn("bin", F.lit(0).cast("bigint"))
    m = membership.join(ids, ["bin", "node"]).select("bin", "nid", F.col("cluster").alias("comm"))
    return ids, e, m


def partition_modularity(edges: DataFrame, membership: DataFrame,
                         weight: str | None = None) -> DataFrame:
    """Directed modularity of a given partition (bin, node, cluster) per bin."""
    from citeweave.operators.community.modularity import modularity
    _, e, m = _in_id_space(edges, membership, weight)
    return modularity(e, m).select("bin", F.round("obj", 9).alias("modularity"))


def partition_codelength(edges: DataFrame, membership: DataFrame,
                         weight: str | None = None) -> DataFrame:
    """Two-level map-equation codelength (bits) of a given partition."""
    from citeweave.operators.community import mapeq
    _, e, m = _in_id_space(edges, membership, weight)
    p = mapeq.pagerank(e)
    return (mapeq.codelength(mapeq.link_flow(e, p), p, m)
            .select("bin", F.round("L", 9).alias("codelength")))


def partition_description_length(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Degree-corrected SBM description length (nats) of a given partition."""
    from citeweave.operators.community.sbm import description_length
    _, e, m = _in_id_space(edges, membership, None)
    return description_length(e, m).select("bin", F.round("dl", 9).alias("description_length"))
