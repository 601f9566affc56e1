"""Cluster report on a membership (G9, G10; A5-A11, W3, P12, J5-J8).

Input: ``works`` (oa_id, topic, field, domain, referenced_works, ...) and a
membership ``(bin, oa_id, cluster)`` from community detection.  Output:
long tables keyed by (bin, cluster) - the JSON report is only built at the
sink.  Every step is a join or aggregation keyed by bin/cluster/node with
partial aggregation; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.schema import CLUSTER_SIZE_CUTOFF, TOP_N_CLUSTERS

ATTRS = ("field", "domain", "topic")


def cluster_sizes(membership: DataFrame) -> DataFrame:
    """(bin, cluster, elements)."""
    return (membership.groupBy("bin", "cluster")
            .agg(F.count(F.lit(1)).alias("elements")))


def select_clusters(membership: DataFrame, top_n: int | None = TOP_N_CLUSTERS,
                    cutoff: int = CLUSTER_SIZE_CUTOFF) -> DataFrame:
    """W3 + P12: the top-n clusters of each bin by size (ties by cluster id;
    falsy n keeps all), then only those with strictly more than ``cutoff``
    works.  The cutoff applies after the top-n cut."""
    sizes = cluster_sizes(membership)
    if top_n:
        w = Window.partitionBy("bin").orderBy(F.desc("elements"), F.asc("cluster"))
        sizes = (sizes.withColumn("_r", F.row_number().over(w))
                 .where(F.col("_r") <= top_n).drop("_r"))
    return sizes.where(F.col("elements") > cutoff)


def kept_members(membership: DataFrame, clusters: DataFrame) -> DataFrame:
    """Members of the selected clusters: (bin, cluster, oa_id)."""
    return membership.join(clusters.select("bin", "cluster"), ["bin", "cluster"], "left_semi")


def distributions(members: DataFrame, works: DataFrame,
                  attrs: tuple[str, ...] = ATTRS) -> DataFrame:
    """A5 + A6: per cluster and attribute, each value's share of the members
    whose value is not NULL.  A cluster whose values are all NULL has no rows
    (an empty distribution).  Shares are rounded to 9 decimals."""
    stacked = (members.join(works.select("oa_id", *attrs), "oa_id")
               .select("bin", "cluster", F.explode(F.array(*[
                   F.struct(F.lit(a).alias("kind"), F.col(a).alias("value")) for a in attrs
               ])).alias("_a"))
               .select("bin", "cluster", "_a.kind", "_a.value")
               .where(F.col("value").isNotNull()))
    counts = stacked.groupBy("bin", "cluster", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("bin", "cluster", "kind"))
    return counts.withColumn("share", F.round(F.col("n") / total, 9))


def dominant_field(dist: DataFrame, kind: str = "field") -> DataFrame:
    """The value with the largest share per cluster; ties by value.
    A cluster with an empty distribution gets no row (its dominant is NULL)."""
    w = Window.partitionBy("bin", "cluster").orderBy(F.desc("share"), F.asc("value"))
    return (dist.where(F.col("kind") == kind)
            .withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select("bin", "cluster", F.col("value").alias("dominant_field"),
                    F.col("share").alias("dominant_share")))


def citation_counts(members: DataFrame, works: DataFrame) -> DataFrame:
    """Occurrences of every referenced id per cluster, in corpus or not."""
    return (members.join(works.select("oa_id", "referenced_works"), "oa_id")
            .select("bin", "cluster", F.explode("referenced_works").alias("ref"))
            .groupBy("bin", "cluster", "ref").agg(F.count(F.lit(1)).alias("n")))


def _cited_cluster(counts: DataFrame, members: DataFrame) -> DataFrame:
    """Each counted reference with the selected cluster of its target
    (NULL when the target is in no selected cluster)."""
    target = members.select(F.col("oa_id").alias("ref"), F.col("bin").alias("dst_bin"),
                            F.col("cluster").alias("dst_cluster"))
    return counts.join(target, "ref", "left")


def link_counts(counts: DataFrame, members: DataFrame) -> DataFrame:
    """Citations from each cluster to every *other* selected cluster,
    across all bins (key ``intracluster_links`` in the report)."""
    hits = _cited_cluster(counts, members).where(F.col("dst_cluster").isNotNull())
    other = ~((F.col("dst_bin") == F.col("bin")) & (F.col("dst_cluster") == F.col("cluster")))
    return (hits.where(other)
            .groupBy("bin", "cluster", "dst_bin", "dst_cluster")
            .agg(F.sum("n").alias("links")))


def link_weights(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """A9 + J7: links / (size of citing cluster x size of cited cluster)."""
    src = clusters.select("bin", "cluster", F.col("elements").alias("src_elements"))
    dst = clusters.select(F.col("bin").alias("dst_bin"), F.col("cluster").alias("dst_cluster"),
                          F.col("elements").alias("dst_elements"))
    return (links.join(src, ["bin", "cluster"]).join(dst, ["dst_bin", "dst_cluster"])
            .withColumn("weight", F.round(F.col("links") /
                                          (F.col("src_elements") * F.col("dst_elements")), 9)))


def self_citation_share(counts: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """A10: share of a cluster's references (all of them, in corpus or not)
    that point into the cluster itself; 0 when it cites nothing."""
    c = _cited_cluster(counts, members)
    same = (F.col("dst_bin") == F.col("bin")) & (F.col("dst_cluster") == F.col("cluster"))
    per = (c.groupBy("bin", "cluster")
           .agg(F.sum(F.when(same, F.col("n")).otherwise(0)).alias("intra"),
                F.sum("n").alias("total")))
    return (clusters.select("bin", "cluster").join(per, ["bin", "cluster"], "left")
            .select("bin", "cluster",
                    F.coalesce("intra", F.lit(0)).cast("bigint").alias("intra_citations"),
                    F.coalesce("total", F.lit(0)).cast("bigint").alias("total_citations"),
                    F.when(F.coalesce("total", F.lit(0)) > 0,
                           F.round(F.col("intra") / F.col("total"), 9))
                     .otherwise(F.lit(0.0)).alias("intracluster_link_ratio")))


def bin_network(works: DataFrame, bins: DataFrame, members: DataFrame) -> DataFrame:
    """G9 nodes: every work of a bin with its attributes ('' for NULL) and
    its selected cluster, -1 when unassigned (J8)."""
    from citeweave.operators.decades import decade_col
    nodes = (works.select("oa_id", "topic", "field", "domain",
                          decade_col("publication_year").alias("decade"))
             .join(F.broadcast(bins), "decade"))
    return (nodes.join(members.select("bin", "oa_id", "cluster"), ["bin", "oa_id"], "left")
            .select("bin", F.col("oa_id").alias("id"),
                    F.coalesce("topic", F.lit("")).alias("topic"),
                    F.coalesce("field", F.lit("")).alias("field"),
                    F.coalesce("domain", F.lit("")).alias("domain"),
                    F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster")))


def bin_network_edges(works_with_refs: DataFrame, bins: DataFrame) -> DataFrame:
    """G9 edges: distinct in-bin citation edges (a DiGraph collapses repeats).

    In-decade references never cross decades, so each bin's graph is the
    disjoint union of its decades' graphs."""
    from citeweave.operators.decades import decade_col
    return (works_with_refs.select(decade_col("publication_year").alias("decade"),
                                   F.col("oa_id").alias("src"),
                                   F.explode("in_decade_references").alias("dst"))
            .join(F.broadcast(bins), "decade")
            .select("bin", "src", "dst").distinct())


def cluster_report(works: DataFrame, membership: DataFrame, top_n: int | None = TOP_N_CLUSTERS,
                   cutoff: int = CLUSTER_SIZE_CUTOFF) -> dict[str, DataFrame]:
    """G10 on a given membership: all report tables, lazily."""
    clusters = select_clusters(membership, top_n, cutoff)
    members = kept_members(membership, clusters)
    dist = distributions(members, works)
    counts = citation_counts(members, works)
    links = link_counts(counts, members)
    return {
        "clusters": clusters,
        "members": members,
        "distributions": dist,
        "dominant_field": dominant_field(dist),
        "citation_counts": counts,
        "links": link_weights(links, clusters),
        "self_share": self_citation_share(counts, members, clusters),
    }
