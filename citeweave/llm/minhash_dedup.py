"""Near-duplicate groups from bottom-k sketches under one hash function.

1. Each text's set of word-shingle hashes gives a digest and a sketch, its
   ``SKETCH`` smallest hashes.  Equal sets form one class; from here on a class
   is one node, so exact copies cost nothing more.
2. Every two neighbours among the first ``KEYED`` values of a sketch are a key.
   Two sets of likeness 0.8 that fit into these values must share a key (the shared
   elements of their union fall into runs, one of them of two at least); for
   larger sets the chance that none of the 31 pairs is shared is under 1e-9.
3. Inverted lists of the keys.  A list of up to ``COLD`` nodes gives all its
   pairs (a bounded number); a longer one ties each node to the node of the list
   whose own lists are longest together: in a group of near copies, the text
   they were made from.
4. Pairs are filtered by the estimate on the union of the two sketches
   (a pair of likeness 0.8 falls below it with odds under 1e-6) and the rest is
   confirmed on the full sets.  Confirmed links give components.
5. The nodes of long lists that lie in different components meet each other
   through the rarest elements of their full sets, of which sets of likeness 0.8
   always share one; where that element's list is long too, through the elements in
   which they deviate from a centre of the list.
   Only nodes with more than a quarter of their keys in long lists take part: the
   others share, with any partner of likeness 0.8, keys of short lists.

Rows: null or word-free text has an empty set and is linked with nothing.
Null doc_ids take part; a group of them alone has component_id null and
all its rows kept.  Repeated rows are exact copies of each other.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.components import components
from citeweave.llm.frames import fresh
from citeweave.llm.ngram_join import _Product
from citeweave.llm.words import Words, slices
from citeweave.session import cut_lineage, release, ship_package

SKETCH = 64
KEYED = 32
COLD = 16
HOT_SHARE = 0.25
# Binomial(64, 0.8) is 34 or less with odds under 1e-6
LEAST_SHARED = 35


def _sets(batch: pa.RecordBatch, k: int, column: str = "text"):
    for part in slices(batch, column):
        w = Words.of(part.column(column))
        hashes, offs = w.shingles(k)
        yield part, [np.unique(hashes[offs[d]:offs[d + 1]]) for d in range(part.num_rows)]


def _sketcher(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            for part, sets in _sets(batch, k):
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_md5"),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digests, pa.binary()),
                     pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "text_md5", "n_shingles", "digest", "sketch"])
    return run


def _confirmer(k: int, percent: int):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            at = 0
            for part in slices(batch, "text_a", 2 << 20):
                a, offs_a = Words.of(part.column("text_a")).shingles(k)
                b, offs_b = Words.of(part.column("text_b")).shingles(k)
                for d in range(part.num_rows):
                    x = np.unique(a[offs_a[d]:offs_a[d + 1]])
                    y = np.unique(b[offs_b[d]:offs_b[d + 1]])
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep[at + d] = 100 * both >= percent * (len(x) + len(y) - both)
                at += part.num_rows
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])
    return run


def _shared(a: Column, b: Column) -> Column:
    """Elements of the union sketch that lie in both sketches.  Hashes are
    unsigned; flipping the top bit makes the signed order theirs."""
    flip = lambda s: F.transform(s, lambda x: x.bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    union = F.slice(F.array_sort(flip(F.array_union(a, b))), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(union, flip(a)), flip(b)))


class _Verifier:
    """Confirms candidate pairs of nodes: sketch estimate, then full sets."""

    def __init__(self, documents: DataFrame, classes: DataFrame, k: int, percent: int):
        self.docs, self.classes, self.k, self.percent = documents, classes, k, percent

    def links(self, pairs: DataFrame) -> DataFrame:
        side = lambda s: self.classes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"),
                                             F.col("sketch").alias(f"sk_{s}"), F.col("min_doc").alias(f"doc_{s}"))
        near = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)
        # an estimate on min(SKETCH, union) elements
        width = F.least(F.lit(SKETCH), F.size(F.array_union("sk_a", "sk_b")))
        whole = F.greatest("n_a", "n_b") <= SKETCH
        both = F.size(F.array_intersect("sk_a", "sk_b"))
        exact = both * 100 >= (F.col("n_a") + F.col("n_b") - both) * self.percent
        passed = F.when(whole, exact).otherwise(
            (width < SKETCH) | (_shared(F.col("sk_a"), F.col("sk_b")) >= LEAST_SHARED))
        found = cut_lineage(pairs.join(side("a"), "a").join(side("b"), "b").where(near & passed)
                            .select("a", "b", "doc_a", "doc_b", whole.alias("whole")))
        sure = found.where("whole").select("a", "b")
        open_ = found.where("NOT whole")
        if open_.isEmpty():
            return found.select("a", "b")
        # texts of the nodes still in question, one row per node
        wanted = cut_lineage(
            open_.select(F.col("a").alias("node"), F.col("doc_a").alias("doc"))
            .unionByName(open_.select(F.col("b").alias("node"), F.col("doc_b").alias("doc"))).distinct())
        texts = cut_lineage(self._texts(wanted))
        pair = (open_.select("a", "b")
                .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
                .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))
        links = cut_lineage(sure.unionByName(pair.mapInArrow(_confirmer(self.k, self.percent), "a long, b long")))
        release(found, wanted, texts)
        return links

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """(node, text).  A node is a class of equal shingle sets; any text of
        the class does.  Rows of the wanted doc_ids are sketched again to
        tell which of them (a doc_id may repeat with other texts) is meant."""
        ids = wanted.select("doc").distinct()
        rows = (self.docs.select("doc_id", "text").where(F.col("text").isNotNull())
                .join(ids, F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi")
                .dropDuplicates(["doc_id", "text"]))
        k = self.k

        def with_digest(batches):
            for batch in batches:
                for part, sets in _sets(batch, k):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                                  pa.binary()), part.column("text")], names=["digest", "text"])
        digests = self.classes.select("node", "digest").join(wanted.select("node"), "node", "left_semi")
        return (rows.mapInArrow(with_digest, "digest binary, text string")
                .join(digests, "digest").dropDuplicates(["node"]).select("node", "text"))


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_md5, n_shingles, component_id, kept: one row per row of ``documents``.

    Two documents are linked when 100 * intersection >= ``percent`` * union of
    their shingle sets (ASCII case folded); component_id is the smallest doc_id
    reachable over links.  The sketch bounds above hold for ``percent`` >= 80.
    """
    if percent < 80:
        raise ValueError("sketch sizes are laid out for a likeness of 0.8 or more")
    ship_package(documents.sparkSession)
    rows = cut_lineage(documents.select("doc_id", "text", F.md5("text").alias("text_md5")).mapInArrow(
        _sketcher(shingle),
        "doc_id long, text_md5 string, n_shingles long, digest binary, sketch array<long>"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sketch"))
    # a class without any doc_id gets a node number below all usual ids
    spare = F.lit(-(1 << 62)).cast("long") - F.shiftrightunsigned(F.xxhash64("digest"), 3)
    classes = cut_lineage(rows.where("n_shingles > 0").groupBy("digest", "n_shingles").agg(best.alias("m"))
                          .select("digest", "n_shingles", F.col("m.doc_id").alias("min_doc"),
                                  F.col("m.sketch").alias("sketch"),
                                  F.coalesce("m.doc_id", spare).alias("own")))
    # a doc_id that repeats with different texts names several classes
    made = classes
    twice = classes.groupBy("own").agg(F.count("*").alias("c")).where("c > 1").select("own")
    classes = cut_lineage(classes.join(twice.withColumn("again", F.lit(True)), "own", "left")
                          .withColumn("node", F.when(F.col("again"), spare).otherwise(F.col("own")))
                          .drop("own", "again"))
    release(made)

    keys = _keys(classes.where("n_shingles > 3"), 2, KEYED)
    counts = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    lists = keys.join(counts, "key")
    # the node that lies in the longest lists stands nearest to the rest of its group
    bare = cut_lineage(lists)
    lists = cut_lineage(bare.join(bare.groupBy("node").agg(F.sum("c").alias("heat")), "node"))
    release(bare)
    centre = (lists.where(F.col("c") > COLD).groupBy("key")
              .agg(F.max(F.struct("heat", "node")).alias("m")).select("key", F.col("m.node").alias("first")))
    short = _pairs(lists.where(F.col("c") <= COLD), percent)
    star = (lists.where(F.col("c") > COLD).join(centre, "key").where("node <> first")
            .select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b")))
    verifier = _Verifier(documents, classes, shingle, percent)
    links = verifier.links(short.unionByName(star).distinct())
    roots = cut_lineage(components(links))

    mostly = _mostly_hot(lists)
    roots = _last_links(documents, classes, mostly, links, roots, shingle, percent)
    release(lists, mostly)

    member = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = member.groupBy("root").agg(F.min("min_doc").alias("component_id"))
    group = cut_lineage(member.join(lowest, "root").select("digest", "component_id"))
    release(classes, roots)
    # classes' group ids; a hot digest is hot on the rows' side only
    out = rows.drop("sketch").join(group, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_md5", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one document of each group, that of smallest doc_id; rows
    that repeat a kept document's doc_id and text go as well."""
    columns = documents.columns
    kept_id, kept_md5, md5 = (fresh(n, columns) for n in ("_kept_id", "_kept_md5", "_md5"))
    kept = (near_duplicates(documents, shingle, percent).where("kept")
            .select(F.col("doc_id").alias(kept_id), F.col("text_md5").alias(kept_md5)).distinct())
    # repeated rows are combined before they are shuffled
    rows = documents.withColumn(md5, F.md5("text")).dropDuplicates(["doc_id", md5])
    same = rows["doc_id"].eqNullSafe(kept[kept_id]) & rows[md5].eqNullSafe(kept[kept_md5])
    return rows.join(kept, same, "left_semi").drop(md5)


def _keys(nodes: DataFrame, run: int, width: int) -> DataFrame:
    """(node, n_shingles, key): hashes of every ``run`` neighbours among the first
    ``width`` values of each sketch."""
    ends = F.least(F.size("sketch"), F.lit(width)) - run
    runs = F.transform(F.sequence(F.lit(0), ends),
                       lambda i: F.xxhash64(*[F.get("sketch", i + j) for j in range(run)]))
    return (nodes.where(F.size("sketch") >= run)
            .select("node", "n_shingles", F.explode(runs).alias("key")))


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of nodes of one key whose set sizes allow a link."""
    left = rows.select("key", F.col("node").alias("a"), F.col("n_shingles").alias("n_a"))
    right = rows.select("key", F.col("node").alias("b"), F.col("n_shingles").alias("n_b"))
    fits = ((F.col("a") < F.col("b")) & (F.col("n_a") * 100 >= F.col("n_b") * percent)
            & (F.col("n_b") * 100 >= F.col("n_a") * percent))
    return left.join(right, "key").where(fits).select("a", "b").distinct()


def _mostly_hot(lists: DataFrame) -> DataFrame:
    """Nodes with more than HOT_SHARE of their keys in long lists."""
    n_keys = F.least(F.lit(KEYED), F.col("n_shingles")) - 1
    return cut_lineage(lists.groupBy("node", "n_shingles").agg(F.count_if(F.col("c") > COLD).alias("h"))
                       .where(F.col("h") > HOT_SHARE * n_keys).select("node"))


def _last_links(documents: DataFrame, classes: DataFrame, mostly: DataFrame, links: DataFrame,
                roots: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) after the links between nodes of long lists in different components.

    A text that misses its group's common elements by too much to be linked with
    their centre has as many elements of its own; these come first in its prefix,
    lie in short lists and are multiplied out.  Of a list that is still long each
    node is tied to a centre, and two nodes not connected with it meet by the elements in
    which both deviate from the centre, never all by all.
    """
    rows = cut_lineage(classes.select("node", F.col("n_shingles").alias("n"),
                                      F.col("min_doc").alias("doc"), "digest"))
    product = _Product(documents, rows, k, percent)
    product.links, product.roots = links, roots
    product.fetch(mostly)
    counts = cut_lineage(product.sets.select(F.explode("grams").alias("g")).groupBy("g")
                         .agg(F.count("*").alias("c")).where(F.col("c") > COLD))
    heads = cut_lineage(product.turned(mostly, counts))
    entries = cut_lineage(product.apart(product.entries_of(heads.where("pos < short"))))
    # lists whose nodes are connected already have nothing to add
    long = cut_lineage(product.with_root(heads.where("pos >= short"), "node", "root"))
    open_ = (long.groupBy("g").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
             .where("r0 <> r1").select("g"))
    own = F.floor(F.log("n") / math.log(100.1 / percent))
    # sizes that allow a link lie in one class or in neighbouring ones
    classed = (long.join(open_, "g", "left_semi")
               .withColumn("class", F.explode(F.array(own, own + 1)))
               .select(F.xxhash64("g", "class").alias("g"), "node", "n", "share"))
    star = product.centred(classed)
    rays = cut_lineage(product.apart(product.rays(star)))
    product.best_first(entries, also=rays)
    product.by_centres(star)
    release(rows, counts, heads, entries, long, rays, product.links, *product.fetched)
    return product.roots
