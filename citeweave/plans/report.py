"""The clustering report job (G10 + G11), composed from the operators.

works -> in-decade references -> one citation graph per bin -> community
detection (all bins in the same jobs) -> top-n clusters per bin with more
than ``cutoff`` works -> distributions, links, self-citation shares ->
evolution layout, and optionally the per-bin networks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators import clusters as cl
from citeweave.operators import decades as dec
from citeweave.operators import evolution as ev
from citeweave.operators.community import detect
from citeweave.schema import CLUSTER_SIZE_CUTOFF, DEFAULT_BINS, TOP_N_CLUSTERS
from citeweave.session import cut_lineage
from citeweave.sources.reports import read_report, report_tables


def bin_edges(works_with_refs: DataFrame, bins: DataFrame) -> DataFrame:
    """G3 + U1: (bin, src, dst) citation edges of every bin; repeated
    references stay as parallel edges."""
    return (works_with_refs.select(dec.decade_col("publication_year").alias("decade"), "oa_id",
                                   "in_decade_references")
            .join(F.broadcast(bins), "decade")
            .select("bin", F.col("oa_id").alias("src"),
                    F.explode("in_decade_references").alias("dst")))


def cluster_report_by_bins(works: DataFrame, bins: list[list[int]] = DEFAULT_BINS,
                           method: str = "leiden", cutoff: int = CLUSTER_SIZE_CUTOFF,
                           top_n: int | None = TOP_N_CLUSTERS,
                           network: bool = False) -> dict[str, DataFrame]:
    """Every report table for ``works`` (one row per work)."""
    spark = works.sparkSession
    b = dec.bins_table(spark, bins)
    with_refs = cut_lineage(dec.with_in_decade_references(works))
    membership = cut_lineage(detect(bin_edges(with_refs, b), method)
                             .withColumnRenamed("node", "oa_id"))
    report = cl.cluster_report(with_refs, membership, top_n, cutoff)
    ranks = ev.field_ranks(report["distributions"])
    report["field_ranks"] = ranks
    report["layout"] = ev.layout(report["clusters"], report["dominant_field"], ranks)
    report["evolution_edges"] = ev.evolution_edges(report["links"])
    report["membership"] = membership
    if network:
        report["network_nodes"] = cl.bin_network(with_refs, b, report["members"])
        report["network_edges"] = cl.bin_network_edges(with_refs, b)
    return report


def evolution_from_report(spark, path: str) -> dict[str, DataFrame]:
    """G11 from a saved report: ``layout`` and ``evolution_edges`` of the documents at
    ``path``, as the clustering job gives them from its own tables."""
    tables = report_tables(cut_lineage(read_report(spark, path)))
    dominant = cl.dominant_field(tables["distributions"])
    ranks = ev.field_ranks(tables["distributions"])
    return {"layout": ev.layout(tables["clusters"], dominant, ranks),
            "evolution_edges": ev.evolution_edges(tables["links"])}
