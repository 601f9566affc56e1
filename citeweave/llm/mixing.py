"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a word budget: ``share`` of all words, split by weight,
stopped at ``cap`` times the source's own words, the excess reshared by
weight among the others.  A source takes each document floor(budget /
source words) times and, for the rest of the budget, the documents whose
hash lies under a threshold.  The threshold comes from histograms of words by
(source, hash bucket): the bucket in which the running sum crosses the budget
is refined by the next ``BITS`` of the hash, and only that bucket.  Nothing
is sorted by document and thresholds are nested: a larger budget takes a
superset.

Rows: null text has size 0; a null source is a source of its own, weighed
last.  Rows with equal doc_id and text share one hash and are one unit: when
the threshold falls on a single row it is taken if that comes nearer to the
budget, when it falls on a unit of several equal rows each takes an equal part
of the remaining words.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.frames import fresh, quoted
from citeweave.operators.community.framework import dense_rank_ids
from citeweave.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BITS = 12
LEVELS = 5


def unit_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of md5 over doc_id and the text's md5."""
    whole = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")),
                              F.coalesce(F.md5(text), F.lit("null"))))
    return F.conv(F.substring(whole, 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float,
                   cap: float) -> DataFrame:
    """(source, source_size) -> also ``weight`` and ``target``.

    The level (words per unit of weight) is raised until no uncapped source
    passes its cap; each round is one aggregate to a single row, so sources
    may be many.  It ends when no further source reaches its cap.
    """
    spark = sources.sparkSession
    # null last: rank (is null, source) in code point order
    keyed = sources.select(F.col("source").isNull().alias("none"), "source", "source_size")
    ranked = dense_rank_ids(keyed, ["none", "source"], "place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = cut_lineage(ranked.select(
        "source", "source_size",
        F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")).alias("weight")))
    top = s.agg((F.lit(float(share)) * F.sum("source_size")).alias("budget"),
                F.sum("weight").alias("w")).first()
    budget, level = float(top["budget"] or 0.0), 0.0
    if top["w"]:
        level, capped = budget / top["w"], -1
        while True:
            full = F.col("source_size") * F.lit(float(cap)) <= F.col("weight") * F.lit(level)
            r = s.agg(F.count_if(full).alias("n"),
                      F.sum(F.when(full, F.col("source_size") * F.lit(float(cap)))).alias("fixed"),
                      F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
            if r["n"] == capped or not r["w"]:
                break
            capped = r["n"]
            level = (budget - (r["fixed"] or 0.0)) / r["w"]
    return s.withColumn("target", F.least(F.col("source_size") * F.lit(float(cap)),
                                          F.col("weight") * F.lit(level)))


def _boundary(units: DataFrame, budgets: DataFrame, level: int) -> DataFrame:
    """The bucket of ``level`` in which each open source's running sum crosses
    its remaining words: (source_key, prefix, left, n, words)."""
    shift = 60 - BITS * (level + 1)
    hist = (units.select("source_key", "size", F.shiftright("h", shift).alias("bucket"))
            .groupBy("source_key", "bucket")
            .agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    # a source has at most 2**BITS buckets under its prefix
    w = Window.partitionBy("source_key").orderBy("bucket")
    run = (hist.join(budgets.select("source_key", "left"), "source_key")
           .withColumn("upto", F.sum("words").over(w)))
    return (run.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
            .select("source_key", F.col("bucket").alias("prefix"),
                    (F.col("left") - F.col("upto") + F.col("words")).alias("left"), "n", "words"))


def mix(documents: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5,
        cap: float = 2.0) -> DataFrame:
    """doc_id, text_md5, source, size, source_size, target, copies, taken.

    ``taken`` is the words the mix takes of the row (repeats counted) and
    ``copies`` how often the row is taken, a partly taken row counting as one.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    docs = cut_lineage(documents.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.md5("text").alias("text_md5"),
        size.alias("size"), unit_hash().alias("h"))
        .withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    sums = docs.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = cut_lineage(targets.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("source_key"),
        "source_size", "target", whole.cast("long").alias("whole"),
        (F.col("target") - whole * F.col("source_size")).alias("left")))

    # threshold of each source: rows with h below it are taken once more
    open_, units, done = plan.where("left > 0"), docs, None
    for level in range(LEVELS):
        b = cut_lineage(_boundary(units, open_, level))
        shift = 60 - BITS * (level + 1)
        last = level == LEVELS - 1
        ends = (F.col("n") == 1) | F.lit(last)
        done_now = b.where(ends).select(
            "source_key", F.shiftleft("prefix", shift).alias("low"),
            F.shiftleft(F.col("prefix") + 1, shift).alias("high"), "left", "n", "words")
        done = done_now if done is None else done.unionByName(done_now)
        if last:
            break
        open_ = b.where(~ends)
        if open_.isEmpty():
            break
        units = (docs.join(open_.select("source_key", "prefix"), "source_key")
                 .where(F.shiftright("h", shift) == F.col("prefix")).drop("prefix"))
    edge = cut_lineage(done)
    rows = docs.join(plan.drop("left").join(edge, "source_key", "left"), "source_key")
    inside = (F.col("h") >= F.col("low")) & (F.col("h") < F.col("high"))
    part = (F.when(F.col("low").isNull() | (F.col("h") < F.col("low")), 0)
            .when(~inside, 0)
            .when(F.col("n") == 1, F.when(2 * F.col("left") >= F.col("words"), F.col("size")).otherwise(0))
            .otherwise(F.least(F.col("size"), F.floor(F.col("left") / F.col("n")))))
    more = F.when(F.col("low").isNotNull() & (F.col("h") < F.col("low")), F.col("size")).otherwise(part)
    return (rows.withColumn("more", F.coalesce(more, F.lit(0)).cast("long"))
            .select("doc_id", "text_md5", "source", "size", "source_size", "target",
                    (F.col("whole") + F.when(F.col("more") > 0, 1).otherwise(0)).cast("long").alias("copies"),
                    (F.col("whole") * F.col("size") + F.col("more")).alias("taken")))


def mixed(documents: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5,
          cap: float = 2.0) -> DataFrame:
    """The mix itself: each row of ``documents`` as often as it is taken (a partly
    taken row once)."""
    columns = documents.columns
    md5, times, at = (fresh(n, columns) for n in ("_md5", "_times", "_at"))
    own = {"doc_id": fresh("_mix_id", columns), "source": fresh("_mix_source", columns),
           "text_md5": fresh("_mix_md5", columns), "copies": times}
    taken = (mix(documents, weights, share, cap).where("copies > 0")
             .select(*own).distinct().withColumnsRenamed(own))
    rows = documents.withColumn(md5, F.md5("text"))
    same = (rows["doc_id"].eqNullSafe(taken[own["doc_id"]]) & rows[md5].eqNullSafe(taken[own["text_md5"]])
            & rows["source"].eqNullSafe(taken[own["source"]]))
    return (rows.join(taken, same)
            .withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
            .select(*map(quoted, columns)))
