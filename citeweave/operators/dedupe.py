"""Three-key greedy dedupe (D1) as parallel rounds.

The rule: walk the works in a given order and reject a work when its DOI,
id or normalised title equals that of an already *kept* work (NULL and
empty keys never match; rejected works block nothing).  The kept set is
the lexicographically-first maximal independent set of the conflict graph
(works sharing any key), which is computed in rounds (Blelloch, Fineman
and Shun, 2012) without ever walking the works one by one:

* every undecided work that holds the smallest order value for *each* of
  its keys among undecided works is kept (no earlier undecided work can
  block it any more);
* every undecided work sharing a key with a work kept this round is
  rejected;
* repeat on the rest.

A key held by a third of all works is resolved in one round: its first
holder wins (or loses to an earlier conflict) and the rest are rejected.
All steps are joins and aggregations keyed by key or by work, with
partial aggregation before the shuffle; state is checkpointed each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.normalize import normalize_doi, normalize_title
from citeweave.session import cut_lineage, release


def dedupe_keys(doi: str = "doi", oid: str = "oa_id", title: str = "title") -> list[tuple[str, Column]]:
    """The three identity keys of a work, normalised (idempotent on clean input)."""
    return [("doi", normalize_doi(doi)),
            ("id", F.nullif(F.col(oid), F.lit(""))),
            ("title", F.nullif(normalize_title(title), F.lit("")))]


def _order_key(order_by: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order_by])


def greedy_dedupe(works: DataFrame, order_by: list[str],
                  keys: list[tuple[str, Column]] | None = None,
                  blocked_keys: DataFrame | None = None) -> DataFrame:
    """Keep the works the sequential three-key rule keeps, in ``order_by`` order.

    ``order_by`` must identify a work uniquely.  ``blocked_keys`` (kind,
    value) are keys of works kept earlier (e.g. previous expansion hops):
    any work holding one is rejected up front.  Returns the kept rows of
    ``works`` with their columns unchanged.
    """
    keys = keys or dedupe_keys()
    seq = _order_key(order_by)
    tagged = works.withColumn("_seq", seq)
    exploded = (tagged.select("_seq", F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in keys
    ])).alias("_k"))
        .where(F.col("_k.value").isNotNull())
        .select("_seq", F.col("_k.kind").alias("kind"), F.col("_k.value").alias("value")))

    if blocked_keys is not None:
        blocked = (exploded.join(blocked_keys.select("kind", "value").distinct(),
                                 ["kind", "value"], "left_semi")
                   .select("_seq").distinct())
        tagged = tagged.join(blocked, "_seq", "left_anti")
        exploded = exploded.join(blocked, "_seq", "left_anti")

    # a work none of whose keys is shared (or that has no key) conflicts with
    # nothing: it is kept and blocks no one, so only works holding a shared
    # key enter the rounds
    shared = (exploded.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") > 1).drop("_n"))
    conflicted = cut_lineage(exploded.join(shared, ["kind", "value"], "left_semi")
                             .select("_seq").distinct())
    free = tagged.select("_seq").join(conflicted, "_seq", "left_anti")

    undecided = cut_lineage(exploded.join(conflicted, "_seq", "left_semi"))
    kept_parts = [free]
    per_work = Window.partitionBy("_seq")   # at most one row per key kind
    # the first undecided work holds all its keys first, so every round settles one at least
    while not undecided.isEmpty():
        first = undecided.groupBy("kind", "value").agg(F.min("_seq").alias("_first"))
        marked = cut_lineage(
            undecided.join(first, ["kind", "value"])
            .withColumn("_win", F.bool_and(F.col("_seq") == F.col("_first")).over(per_work)))
        claimed = (marked.where(F.col("_win") & (F.col("_seq") == F.col("_first")))
                   .select("kind", "value", F.lit(True).alias("_claimed")))
        # one table per round: every key row with its work's fate
        state = cut_lineage(
            marked.join(claimed, ["kind", "value"], "left")
            .withColumn("_lost", F.bool_or(F.coalesce("_claimed", F.lit(False))).over(per_work))
            .select("_seq", "kind", "value",
                    F.when(F.col("_win"), F.lit("kept"))
                     .when(F.col("_lost"), F.lit("lost"))
                     .otherwise(F.lit("open")).alias("_state")))
        release(marked)
        kept_parts.append(state.where(F.col("_state") == "kept").select("_seq").distinct())
        undecided = state.where(F.col("_state") == "open").drop("_state")

    kept = kept_parts[0]
    for part in kept_parts[1:]:
        kept = kept.union(part)
    return tagged.join(kept, "_seq", "left_semi").drop("_seq")


def key_table(works: DataFrame, keys: list[tuple[str, Column]] | None = None) -> DataFrame:
    """(kind, value) identity keys held by ``works`` (for ``blocked_keys``)."""
    keys = keys or dedupe_keys()
    return (works.select(F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in keys
    ])).alias("_k")).where(F.col("_k.value").isNotNull())
        .select(F.col("_k.kind").alias("kind"), F.col("_k.value").alias("value")))


def drop_repeated_ids(works: DataFrame) -> DataFrame:
    """One row per ``oa_id`` when repeated records are identical copies."""
    return works.dropDuplicates(["oa_id"])
