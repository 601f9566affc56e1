"""Source divergence audit on collapsed texts.

1. *Collapse.*  Rows of one lang with identical text become one row with the number of
   copies in each source, so a text is tokenised once however often it was
   copied.  Copies are combined before they are shuffled.
2. *Counts.*  Every text adds its term counts times the copies to (lang, source, term),
   and the copies themselves to the document frequency; a task sums these in a
   table of bounded size before they are shuffled.
3. *Kept terms* of a lang occur in ``least_docs`` of its documents or more.  A
   group's or lang's smoothed share of a term, in units of 1e-9, is
   p = 1 + floor(1e9 * (count + 2) / (N + 2 V)) with N its count over the V kept
   terms of the lang, and two shares differ by f = floor((p - q)^2 / (p + q)).
4. *Sparse pairs.*  The difference of two sources sums f over all kept terms, those that
   neither has included.  With p0, q0 the shares of absent terms,
   sum f(p, q) = V f(p0, q0) + sum over terms of the first [f(p, q0) - f(p0, q0)]
   + the same of the second + sum over terms of both
   [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)].  The one-sided sums need only the histogram of each
   source's counts; only terms of both meet in a join.

Rows: null text, lang and source are read as ''.  Every (lang, source) that
occurs is a group, texts without terms included; a lang of one source has
no pairs, one without kept terms has pairs of value 0.  Repeated rows count
each.  Ties of value are ranked by item in UTF-8 order.  Very long texts are read whole, one at a time.  An
empty table gives no rows.  Other columns are ignored, whatever their names.
All arithmetic is in whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.session import cut_lineage, release, ship_package

# bytes of UTF-8: every byte beyond ASCII belongs to a term
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: entries a task sums up before it sends them on
HELD = 500_000


def collapsed(documents: DataFrame) -> DataFrame:
    """(lang, text, copies): one row per distinct text of a lang, with the array of
    (source, n) of its copies."""
    rows = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                              for c in ("lang", "source", "text")])
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = (rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
              .groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies")))
    texts = rows.where("text <> ''").groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "digest"]).select("lang", "text", "copies")


def _count_terms(batches):
    """lang, text, copies -> lang, source, term, count, docs, summed per task."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = 0

    def flush():
        for (lang, source), terms in held.items():
            counts = list(zip(*terms.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(list(terms), pa.binary()),
                 pa.array(counts[0], pa.int64()), pa.array(counts[1], pa.int64())],
                names=["lang", "source", "term", "count", "docs"])
        held.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for i in range(batch.num_rows):
            # only ASCII letters are changed by lower() on bytes
            terms = Counter(TERM.findall(texts[i].as_py().lower()))
            if not terms:
                continue
            lang = batch.column("lang")[i].as_py()
            for copy in batch.column("copies")[i].as_py():
                own = held.setdefault((lang, copy["source"]), {})
                n, before = copy["n"], len(own)
                for term, c in terms.items():
                    entry = own.get(term)
                    if entry is None:
                        own[term] = [c * n, n]
                    else:
                        entry[0] += c * n
                        entry[1] += n
                size += len(own) - before
                if size > HELD:
                    yield from flush()
                    size = 0
    yield from flush()


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences and documents of every term."""
    ship_package(documents.sparkSession)
    return (collapsed(documents)
            .mapInArrow(_count_terms, "lang string, source string, term binary, count long, docs long")
            .groupBy("lang", "source", F.col("term").cast("string").alias("term"))
            .agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a term with ``count`` among ``total`` occurrences of ``kept`` terms."""
    part = ((count + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"))
    whole = F.greatest(total + 2 * kept, F.lit(1)).cast("decimal(20,0)")
    return F.call_function("div", part, whole).cast("long") + 1


def gap(p: Column, q: Column) -> Column:
    """f of two shares; both are at most 1e9 + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(documents: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the lang by falling difference.  Part
    ``term``: the ``top`` kept terms that the source has in a greater share
    than its lang, by falling difference from the lang.
    """
    counts = cut_lineage(term_counts(documents))
    per_term = Window.partitionBy("lang", "term")     # a term has one row per source
    cells = cut_lineage(counts.withColumn("lang_docs", F.sum("docs").over(per_term))
                        .withColumn("lang_count", F.sum("count").over(per_term))
                        .where(F.col("lang_docs") >= least_docs)
                        .select("lang", "source", "term", "count", "lang_count"))
    names = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                               for c in ("lang", "source")]).distinct()
    per_lang = (cells.groupBy("lang", "term").agg(F.sum("count").alias("c"))
                .groupBy("lang").agg(F.count("*").alias("kept"), F.sum("c").alias("lang_total")))
    groups = (names.join(cells.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left")
              .join(per_lang, "lang", "left").na.fill(0, ["total", "kept", "lang_total"]))
    groups = cut_lineage(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))))

    held = cut_lineage(cells.join(groups, ["lang", "source"])
                       .withColumn("p", share(F.col("count"), F.col("total"), F.col("kept"))))
    q = share(F.col("lang_count"), F.col("lang_total"), F.col("kept"))
    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (held.withColumn("q", q).where("p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     gap(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top))

    side = lambda s: groups.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "p0")], "kept")
    pairs = side("a").join(side("b").drop("kept"), "lang").where("source_a <> source_b")
    pair = ["lang", "source_a", "source_b"]
    f00 = gap(F.col("p0_a"), F.col("p0_b"))
    # what the terms of a alone add, by the histogram of its counts
    hist = held.groupBy("lang", F.col("source").alias("source_a"), F.col("p").alias("p_a")).agg(
        F.count("*").alias("k"))
    alone = (hist.join(pairs, ["lang", "source_a"])
             .groupBy(*pair).agg(F.sum(F.col("k") * (gap(F.col("p_a"), F.col("p0_b")) - f00)).alias("alone")))
    alone = cut_lineage(alone)
    mirror = alone.select("lang", F.col("source_a").alias("source_b"), F.col("source_b").alias("source_a"),
                          F.col("alone").alias("alone_b"))
    cell = lambda s: held.select("lang", "term", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "p", "p0")])
    both = (cell("a").join(cell("b"), ["lang", "term"]).where("source_a < source_b")
            .groupBy(*pair).agg(F.sum(gap(F.col("p_a"), F.col("p_b")) - gap(F.col("p_a"), F.col("p0_b"))
                                      - gap(F.col("p0_a"), F.col("p_b")) + f00).alias("both")))
    both = cut_lineage(both)
    both = both.unionByName(both.select("lang", F.col("source_a").alias("source_b"),
                                        F.col("source_b").alias("source_a"), "both"))
    value = F.when(F.col("kept") > 0, F.col("kept") * f00 + F.coalesce("alone", F.lit(0))
                   + F.coalesce("alone_b", F.lit(0)) + F.coalesce("both", F.lit(0))).otherwise(0)
    found = (pairs.join(alone, pair, "left").join(mirror, pair, "left").join(both, pair, "left")
             .select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"),
                     F.col("source_b").alias("item"), value.cast("long").alias("value"))
             .withColumn("rank", F.row_number().over(rank)))
    release(counts, cells)
    return found.unionByName(terms)
