"""Corpus growth: phrase search (P7), thresholds (P5, P6), citing works of
a frontier (J4, P8, P9), the seed set (G1) and k-hop expansion (G2).

The record source is any DataFrame of normalised works (a catalogue of raw
records after ``normalize_works``).  Expansion is a short driver loop over
hops; each hop is a semi join through exploded references, an anti join
against the keys of everything kept so far, and one dedupe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.operators.dedupe import greedy_dedupe, key_table
from citeweave.session import cut_lineage

def phrase_match(phrase: str, title: str = "title", abstract: str = "abstract") -> Column:
    """Case-insensitive containment of a phrase in title or abstract."""
    p = F.lit(phrase.lower())
    return ((F.instr(F.lower(F.col(title)), p) > 0) |
            (F.instr(F.lower(F.col(abstract)), p) > 0)).eqNullSafe(True)


def above(column: str, threshold: int | None, falsy_means_none: bool = True) -> Column:
    """Strict ``column > threshold``; a falsy threshold means no filter
    (expansion) unless ``falsy_means_none`` is False (seeding filters ``> 0``)."""
    if not threshold and falsy_means_none:
        return F.lit(True)
    return F.col(column) > F.lit(int(threshold or 0))


def has_doi(doi: str = "doi") -> Column:
    """P10: the work has an identifier."""
    return F.col(doi).isNotNull()


def fetch_by_ids(works: DataFrame, ids: DataFrame, select: list[str] | None = None) -> DataFrame:
    """Records whose id is in ``ids`` (column ``oa_id``), URL ids
    reduced to their last path part; optional field projection (P2)."""
    from citeweave.functions.normalize import oa_id
    wanted = ids.select(oa_id("oa_id").alias("oa_id")).distinct()
    out = works.join(wanted, "oa_id", "left_semi")
    return out.select(*select) if select else out


def reference_pairs(works: DataFrame) -> DataFrame:
    """(oa_id, ref) for every reference of every work."""
    return works.select("oa_id", F.explode("referenced_works").alias("ref"))


def citing_works(works: DataFrame, frontier: DataFrame, min_citations: int | None = 0,
                 year_gt: int | None = None, refs: DataFrame | None = None) -> DataFrame:
    """Works citing any id of ``frontier`` (column ``oa_id``), passing the
    thresholds; a work citing several frontier ids appears once.

    Whether the frontier is broadcast is left to its measured size (AQE).
    ``refs`` may pass a materialised ``reference_pairs(works)``.
    """
    refs = refs if refs is not None else reference_pairs(works)
    f = frontier.select(F.col("oa_id").alias("ref")).distinct()
    citing = refs.join(f, "ref", "left_semi").select("oa_id").distinct()
    return (works.where(above("cited_by_count", min_citations) &
                        above("publication_year", year_gt))
            .join(citing, "oa_id", "left_semi"))


def build_seed(works: DataFrame, search_term: str, min_citations: int,
               min_year_exclusive: int, order_by: list[str] | None = None,
               select: list[str] | None = None) -> DataFrame:
    """G1: works matching the search with more than ``min_citations``
    citations and a year after ``min_year_exclusive``, deduplicated."""
    hits = works.where(phrase_match(search_term) &
                       above("cited_by_count", min_citations, falsy_means_none=False) &
                       above("publication_year", min_year_exclusive, falsy_means_none=False))
    kept = greedy_dedupe(hits, order_by or ["oa_id"])
    return kept.select(*select) if select else kept


def cited_works(works: DataFrame, frontier: DataFrame, min_citations: int | None = 0,
                year_gt: int | None = None, refs: DataFrame | None = None) -> DataFrame:
    """Works *cited by* any id of ``frontier``, passing the thresholds."""
    refs = refs if refs is not None else reference_pairs(works)
    f = frontier.select("oa_id").distinct()
    cited = refs.join(f, "oa_id", "left_semi").select(F.col("ref").alias("oa_id")).distinct()
    return (works.where(above("cited_by_count", min_citations) &
                        above("publication_year", year_gt))
            .join(cited, "oa_id", "left_semi"))


def expand(seed: DataFrame, works: DataFrame, hops: int = 1, min_citations: int = 20,
           year_gt: int = 1920, order_by: list[str] | None = None,
           direction: str = "citing") -> DataFrame:
    """K-hop expansion along citing links; returns kept works with ``layer``.

    Seeds are layer 0 (deduplicated, not re-filtered).  Hop h collects the
    works citing the frontier that pass the thresholds, rejects those
    sharing a key with any work kept so far, dedupes the rest and tags them
    layer h.  The next frontier is what hop h kept; the loop stops early
    when it is empty.  By default works *cited by* the frontier are not
    collected; ``direction="both"`` adds them to each hop's candidates.
    """
    if direction not in ("citing", "both"):
        raise ValueError("direction must be 'citing' or 'both'")
    order_by = order_by or ["oa_id"]
    cols = works.columns
    kept = cut_lineage(greedy_dedupe(seed.select(*cols), order_by)
                       .withColumn("layer", F.lit(0).cast("bigint")))
    frontier = kept.select("oa_id")
    n_frontier = frontier.count()
    refs = cut_lineage(reference_pairs(works)) if hops > 0 else None
    for hop in range(1, hops + 1):
        if n_frontier == 0:
            break
        cands = citing_works(works, frontier, min_citations, year_gt, refs)
        if direction == "both":
            cands = cands.unionByName(cited_works(works, frontier, min_citations, year_gt,
                                                  refs)).distinct()
        cands = cut_lineage(cands)
        new = greedy_dedupe(cands, order_by, blocked_keys=key_table(kept))
        new = cut_lineage(new.withColumn("layer", F.lit(hop).cast("bigint")))
        kept = cut_lineage(kept.unionByName(new))
        frontier = new.select("oa_id")
        n_frontier = frontier.count()
    return kept


def layers_consistent(expanded: DataFrame) -> DataFrame:
    """Test helper: works of layer h>0 that cite no work of layer h-1
    (empty when every layer cites the previous one)."""
    refs = expanded.where("layer > 0").select(
        "oa_id", "layer", F.explode("referenced_works").alias("ref"))
    prev = expanded.select(F.col("oa_id").alias("ref"), (F.col("layer") + 1).alias("layer"))
    ok = refs.join(prev, ["ref", "layer"], "left_semi").select("oa_id").distinct()
    return expanded.where("layer > 0").join(ok, "oa_id", "left_anti")
