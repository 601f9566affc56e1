"""N-gram Jaccard join as a blocked sparse product of the document by n-gram matrix.

A row of the matrix is a distinct set of word n-grams (documents with equal sets
are one row), a column an n-gram.  The product of the matrix with its transpose
holds the overlap of every two sets; only entries that can reach the bound
o = percent * (n + m) / (100 + percent) are ever accumulated.

1. *Prefix block.*  Under one order of the columns, sets of n and m elements with
   overlap o or more share a column among the first n - ceil(percent * n / 100) + 1
   of each.  Only these columns open entries.  The order is: columns of short lists
   by hash, then columns of long lists (over ``COLD`` rows).  Lists are counted on the
   prefixes under the plain hash order, a few columns longer than needed; a row drops its
   long columns from that and is left with enough short ones.  A frequent line or
   passage thus leaves the prefix of every text that has enough else.  Rows with
   more long columns than spare ones, such as those of large groups of near copies, are
   *dense*: their full sets are read.  They meet the other rows under the same order,
   and each other under an order whose lists are counted on the dense rows' full sets.
2. *Short columns* are multiplied out.  An entry (a, b) accumulates its overlap and
   the last positions i, j that were shared; it is dropped when overlap +
   min(n - i, m - j) is below o.
3. *Suffix block.*  What is left is accumulated to the end on the full sets; first
   the entry of largest overlap of every row, then only the entries
   whose rows are not connected yet.
4. *Long columns* are left in the prefix only of dense rows that consist of them almost
   wholly.  Each long column is multiplied by one
   of its rows, its centre z (the row with the greatest share of long columns).  Rows
   linked with z are connected.  A row d not linked with z can only be linked
   with a row e of the column when both deviate from z in a common
   element: if the differences of d and e with z were disjoint, d and e would differ
   by |d - z| + |e - z| elements, more than a link allows.  So (z, deviating element) are the columns of a further, much sparser
   matrix that is multiplied in the same way, short lists in full, long ones by a centre of theirs.
   Lists whose rows are connected already are skipped.  After ``ROUNDS`` such rounds,
   lists still long give all entries between unconnected rows; nothing is dropped.

Rows: null or word-free text has an empty set and is linked with nothing.
Null doc_ids take part; a group of them alone has component_id null.  Repeated
rows are exact copies of each other; a doc_id with several texts stands for
each of them.  An n-gram that a text repeats counts once.  A likeness of exactly
``percent`` is a link.  Very long texts are read whole, slice by slice.  An
empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.components import components
from citeweave.llm.words import Words, slices
from citeweave.session import cut_lineage, release, ship_package

COLD = 16
#: the same for columns of deviations, whose entries are cheap to follow up
DEVIANT = 128
ROUNDS = 3
#: rows of one or two numbers that may be broadcast; larger sides are shuffled
SMALL = 500_000


def _sets(batch: pa.RecordBatch, k: int):
    """Slices of the batch with the sorted n-gram hashes and the digest of every text."""
    for part in slices(batch, max_bytes=1 << 20):
        hashes, offs = Words.of(part.column("text")).shingles(k)
        found = [np.unique(hashes[offs[d]:offs[d + 1]]) for d in range(part.num_rows)]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
        yield part, found, pa.array(digests, pa.binary())


def _width(n: int, percent: int) -> int:
    """Length of the prefix of n columns."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _spare(width: int) -> int:
    """Columns kept beyond the prefix, in place of long ones."""
    return width // 8 + 4


def _prefixes(k: int, percent: int):
    """doc_id, text -> doc_id, n, digest and the first columns in hash order."""
    def run(batches):
        for batch in batches:
            for part, found, digests in _sets(batch, k):
                width = [_width(len(s), percent) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), digests,
                     pa.array([s[:w + _spare(w)].view(np.int64) for s, w in zip(found, width)],
                              pa.list_(pa.int64()))],
                    names=["doc_id", "n", "digest", "head"])
    return run


def _whole_sets(k: int):
    def run(batches):
        for batch in batches:
            for _, found, digests in _sets(batch, k):
                yield pa.RecordBatch.from_arrays(
                    [digests, pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
                    names=["digest", "grams"])
    return run


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is small; ``df`` is read from a written table."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _matrix_rows(rows: DataFrame) -> DataFrame:
    """(digest, n, head, doc, node): one row per distinct set.  ``node`` is its
    smallest doc_id, or a number below all usual ids where that is null or
    names several sets."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "head"))
    spare = F.lit(-(1 << 62)).cast("long") - F.shiftrightunsigned(F.xxhash64("digest"), 3)
    twice = cut_lineage(rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "digest").distinct()
                        .groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
                        .select(F.col("doc_id").alias("doc"), F.lit(True).alias("again")))
    made = (rows.where("n > 0").groupBy("digest", "n").agg(first.alias("m"))
            .select("digest", "n", F.col("m.head").alias("head"), F.col("m.doc_id").alias("doc"))
            .join(_small(twice), "doc", "left")
            .withColumn("node", F.when(F.col("again") | F.col("doc").isNull(), spare).otherwise(F.col("doc")))
            .drop("again"))
    out = cut_lineage(made)
    release(twice)
    return out


class _Product:
    def __init__(self, documents: DataFrame, rows: DataFrame, k: int, percent: int):
        self.docs = documents.select("doc_id", "text").where("text IS NOT NULL")
        self.rows, self.k, self.percent = rows, k, percent
        self.fetched: list[DataFrame] = []
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None

    # --- bounds

    def least(self, n: str, m: str) -> Column:
        """The overlap that links sets of n and m elements."""
        return F.expr(f"({self.percent} * ({n} + {m}) + {99 + self.percent}) div {100 + self.percent}")

    def fits(self, n: str, m: str) -> Column:
        return ((F.col(n) * 100 >= F.col(m) * self.percent)
                & (F.col(m) * 100 >= F.col(n) * self.percent))

    # --- full sets

    @property
    def sets(self) -> DataFrame:
        """(node, n, grams) of the rows asked for so far."""
        return reduce(DataFrame.unionByName, self.fetched)

    def fetch(self, nodes: DataFrame) -> None:
        """Adds the full sets of ``nodes`` to ``sets``.  A doc_id may stand for
        several texts; the digest tells which is meant."""
        wanted = self.rows.join(nodes, "node", "left_semi")
        if self.fetched:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        wanted = cut_lineage(wanted.select("node", "n", "doc", "digest"))
        if self.fetched and wanted.isEmpty():
            release(wanted)
            return
        ids = _small(wanted.select("doc").distinct())
        texts = (self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi")
                 .mapInArrow(_whole_sets(self.k), "digest binary, grams array<long>")
                 .dropDuplicates(["digest"]))
        self.fetched.append(cut_lineage(texts.join(wanted.select("digest", "node", "n"), "digest")
                                        .select("node", "n", "grams")))
        release(wanted)

    def accumulate(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links: overlap over all columns."""
        self.fetch(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        side = lambda s: self.sets.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"),
                                          F.col("grams").alias(f"g_{s}"))
        both = F.size(F.array_intersect("g_a", "g_b"))
        return cut_lineage(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
                           .where(both >= self.least("n_a", "n_b")).select("a", "b"))

    def connect(self, links: DataFrame) -> None:
        """Adds links and computes (node, root) of all links so far."""
        if self.links is not None and links.isEmpty():
            return
        before = self.links
        self.links = links if before is None else cut_lineage(before.unionByName(links))
        old, self.roots = self.roots, cut_lineage(components(self.links))
        if before is not None:
            release(before, links)
        if old is not None:
            release(old)

    def with_root(self, df: DataFrame, node: str, name: str) -> DataFrame:
        roots = self.roots.select(F.col("node").alias(node), F.col("root").alias(name))
        return df.join(roots, node, "left").withColumn(name, F.coalesce(name, node))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose rows are not connected yet."""
        return (self.with_root(self.with_root(pairs, "a", "root_a"), "b", "root_b")
                .where("root_a <> root_b").drop("root_a", "root_b"))

    def best_first(self, entries: DataFrame, also: DataFrame | None = None) -> None:
        """Links among ``entries`` (a, b, c): every row's entry of largest c (and the
        pairs ``also``) first, then those that are still apart."""
        ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")),
                                 F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")
        top = (entries.select("c", ends).groupBy("e.x").agg(F.max(F.struct("c", "e.y")).alias("m"))
               .select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b")))
        top = cut_lineage((top if also is None else top.unionByName(also)).distinct())
        self.connect(self.accumulate(top))
        rest = cut_lineage(self.apart(entries.join(top, ["a", "b"], "left_anti")))
        if not rest.isEmpty():
            self.connect(self.accumulate(rest))
        release(top, rest)

    # --- short columns

    def entries_of(self, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
        """(a, b, c): the product of columns (g, node, n, pos) with those of ``right``, or
        with themselves, without entries that cannot reach their bound."""
        side = lambda df, s: df.select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "pos")])
        wanted = self.fits("n_a", "n_b")
        if right is None:
            right, wanted = left, wanted & (F.col("node_a") < F.col("node_b"))
        more = F.least(F.col("n_a") - 1 - F.max("pos_a"), F.col("n_b") - 1 - F.max("pos_b"))
        return (side(left, "a").join(side(right, "b"), "g").where(wanted)
                .groupBy("node_a", "node_b", "n_a", "n_b").agg(F.count("*").alias("c"), more.alias("more"))
                .where(F.col("c") + F.col("more") >= self.least("n_a", "n_b"))
                .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), "c"))

    def width(self) -> Column:
        """Length of the prefix of n columns."""
        return F.col("n") - F.expr(f"({self.percent} * n + 99) div 100") + 1

    def turned(self, nodes: DataFrame, long: DataFrame) -> DataFrame:
        """(g, node, n, pos, short, share): the prefixes of ``nodes`` when the columns of
        ``long`` (g, c) come last, by c; ``short`` is the number of others."""
        sets = self.sets.join(nodes, "node", "left_semi")
        hot = (sets.select("node", F.explode("grams").alias("g")).join(long, "g").groupBy("node")
               .agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("h")))
        last = F.coalesce(F.col("h.g"), F.array().cast("array<long>"))
        first = (sets.join(hot, "node", "left").withColumn("last", last)
                 .withColumn("first", F.array_except("grams", "last")))
        # sizes are computed before the rows are multiplied
        ready = first.select("node", "n", F.size("first").alias("short"), (F.size("last") / F.col("n")).alias("share"),
                             F.slice(F.concat("first", "last"), F.lit(1), self.width().cast("int")).alias("head"))
        return ready.select("node", "n", "short", "share", F.posexplode("head").alias("pos", "g"))

    def product(self) -> tuple[DataFrame, DataFrame]:
        """The entries (a, b, c) of the short columns, and the long columns (g, node, n,
        share) of the dense rows."""
        every = self.rows.select("node", "n", F.posexplode("head").alias("pos", "g"))
        lists = every.groupBy("g").agg(F.count("*").alias("c")).where("c > 1")
        shared = cut_lineage(every.join(lists, "g"))
        long = cut_lineage(shared.where(F.col("c") > COLD).select("g", "c").distinct())
        at = cut_lineage(shared.where(F.col("c") > COLD).groupBy("node", "n")
                         .agg(F.collect_list("pos").alias("at")))
        width = self.width()
        spare = F.least(F.col("n") - width, F.expr("(n - (%d * n + 99) div 100 + 1) div 8 + 4" % self.percent))
        dense = cut_lineage(at.where(F.size("at") > spare).select("node"))
        # columns of the other rows move up by the long ones before them
        light = at.join(dense, "node", "left_anti").select("node", "at")
        before = F.size(F.filter(F.coalesce("at", F.array().cast("array<int>")), lambda x: x < F.col("pos")))

        def placed(columns):
            return (columns.join(dense, "node", "left_anti").join(light, "node", "left")
                    .withColumn("pos", F.col("pos") - before).where(F.col("pos") < width)
                    .select("g", "node", "n", "pos"))

        found = self.entries_of(placed(shared.where(F.col("c") <= COLD)))
        if dense.isEmpty():
            entries = cut_lineage(found)
            release(shared, long, at, dense)
            return entries, self.none()
        self.fetch(dense)
        own = self.sets.join(dense, "node", "left_semi").select(F.explode("grams").alias("g"))
        mixed = cut_lineage(self.turned(dense, long).where("pos < short").select("g", "node", "n", "pos"))
        # a column of one light row alone may be in dense rows beyond what was counted
        names = cut_lineage(mixed.select("g").distinct())
        met = placed(every.join(_small(names), "g"))
        own_long = cut_lineage(own.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > COLD))
        heads = cut_lineage(self.turned(dense, own_long))
        entries = cut_lineage(found.unionByName(self.entries_of(met, mixed))
                              .unionByName(self.entries_of(heads.where("pos < short"))))
        long_heads = cut_lineage(heads.where("pos >= short").select("g", "node", "n", "share"))
        release(shared, long, at, dense, mixed, names, own_long, heads)
        return entries, long_heads

    def none(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame([], "g long, node long, n long, share double")

    # --- long columns

    def centred(self, lists: DataFrame) -> DataFrame:
        """(z, n_z, node, n): every list's centre with the rows of the list."""
        centre = (lists.groupBy("g").agg(F.max(F.struct("share", "node", "n")).alias("m"))
                  .select("g", F.col("m.node").alias("z"), F.col("m.n").alias("n_z")))
        return cut_lineage(lists.join(centre, "g").where("node <> z").select("z", "n_z", "node", "n").distinct())

    def rays(self, star: DataFrame) -> DataFrame:
        """The pairs (centre, row) of sizes that fit."""
        return star.where(self.fits("n", "n_z")).select(F.least("z", "node").alias("a"),
                                                        F.greatest("z", "node").alias("b"))

    def by_centres(self, star: DataFrame) -> None:
        """Links among the rows of each centre of ``star``, whose rays have been
        accumulated, up to connection."""
        lists = None
        for _ in range(ROUNDS):
            apart = self.with_root(self.with_root(star, "node", "root"), "z", "root_z")
            open_ = apart.groupBy("z").agg(F.count_if(F.col("root") != F.col("root_z")).alias("u")).where("u > 0")
            star_open = cut_lineage(star.join(open_.select("z"), "z", "left_semi"))
            release(star)
            if star_open.isEmpty():
                release(star_open)
                return
            lists = self.deviations(star_open)
            release(star_open)
            if lists.isEmpty():
                return
            star = self.centred(lists)
            self.connect(self.accumulate(self.apart(self.rays(star).distinct())))
        left = lists.select("g", F.col("node").alias("a"), F.col("n").alias("n_a"))
        right = lists.select("g", F.col("node").alias("b"), F.col("n").alias("n_b"))
        pairs = (left.join(right, "g").where((F.col("a") < F.col("b")) & self.fits("n_a", "n_b"))
                 .select("a", "b").distinct())
        self.connect(self.accumulate(cut_lineage(self.apart(pairs))))

    def deviations(self, star: DataFrame) -> DataFrame:
        """Columns (centre, element in which a row differs from it) of the rows of
        ``star``; short ones are multiplied out, the long ones (g, node, n, share) returned.

        Sets of n and m elements that are to be linked differ in r * (n + m) at most,
        r = (100 - percent) / (100 + percent), so rows x and y that differ from z
        in d_x and d_y elements share q = (d_x + d_y - r * (n_x + n_y)) / 2 of them.  One, say y, is
        not linked with z: d_y > r * (n_y + n_z), hence q > (d_x + r * (n_z - n_x)) / 2,
        and x can only meet y by its rarest d_x - q + 1 deviations.  y itself knows
        that of a partner that is not linked with z either; of one that is it
        knows q >= d_y - (100 - percent) / percent * n_y.
        """
        p = self.percent
        self.fetch(star.select("node").unionByName(star.select(F.col("z").alias("node"))).distinct())
        own = self.sets.select("node", "grams")
        base = self.sets.select(F.col("node").alias("z"), F.col("grams").alias("grams_z"))
        rows = (star.join(own, "node").join(base, "z")
                .withColumn("dev", F.concat(F.array_except("grams", "grams_z"), F.array_except("grams_z", "grams")))
                .withColumn("d", F.size("dev").cast("long"))
                .withColumn("linked", F.col("d") * (100 + p) <= (F.col("n") + F.col("n_z")) * (100 - p))
                .select("z", "n_z", "node", "n", "d", "linked", F.explode("dev").alias("e"))
                .withColumn("g", F.xxhash64("z", "e")).drop("e"))
        rows = cut_lineage(rows)
        lists = rows.groupBy("g").agg(F.count("*").alias("c"))
        order = Window.partitionBy("z", "node").orderBy("c", "g")
        q_open = F.floor((F.col("d") * (100 + p) + (F.col("n_z") - F.col("n")) * (100 - p)) / (2 * (100 + p))) + 1
        q_linked = F.col("d") - F.expr(f"(n * {100 - p}) div {p}")
        by_half = F.col("pos") <= F.col("d") - F.greatest(q_open, F.lit(1)) + 1
        by_far = F.col("pos") <= F.col("d") - F.greatest(q_linked, F.lit(1)) + 1
        # lists of kind 0: two rows not linked with z; of kind 1: one that is and one that is not
        kinds = F.filter(F.array(F.when(~F.col("linked") & by_half, 0),
                                 F.when(F.when(F.col("linked"), by_half).otherwise(by_far), 1)),
                         lambda x: x.isNotNull())
        share = F.avg((F.col("c") > DEVIANT).cast("double")).over(Window.partitionBy("z", "node"))
        head = (rows.join(lists, "g").withColumn("pos", F.row_number().over(order)).where("c > 1")
                .withColumn("kind", F.explode(kinds)).withColumn("share", share)
                .select(F.xxhash64("g", "kind").alias("g"), "z", "kind", "node", "n", "d", "linked", "share"))
        head = cut_lineage(self.with_root(head, "node", "root"))
        alive = (head.groupBy("g").agg(F.count("*").alias("len"), F.min("root").alias("r0"), F.max("root").alias("r1"),
                                       F.min("kind").alias("kind"), F.count_if("linked").alias("near"))
                 .where("r0 <> r1 AND (kind = 0 OR (near > 0 AND near < len))").select("g", "len"))
        alive = cut_lineage(head.join(alive, "g"))
        side = lambda s: alive.where(F.col("len") <= DEVIANT).select(
            "g", "z", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "d", "linked", "kind", "root")])
        meets = ~F.col("linked_a") & (F.col("linked_b") | ((F.col("kind_a") == 0) & (F.col("node_a") < F.col("node_b"))))
        most = (F.col("n_a") + F.col("n_b")) * (100 - p)
        close = F.abs(F.col("d_a") - F.col("d_b")) * (100 + p) <= most
        pair = ["z", "node_a", "node_b", "n_a", "n_b", "d_a", "d_b"]
        met = (side("a").join(side("b").drop("z"), "g")
               .where(meets & close & (F.col("root_a") != F.col("root_b")) & self.fits("n_a", "n_b"))
               .select(*pair).distinct())
        # |a - b| by the deviations that two rows of the centre may have in common
        held = lambda s: (rows.join(lists.where("c > 1"), "g").groupBy("z", F.col("node").alias(f"node_{s}"))
                          .agg(F.collect_list("g").alias(f"dev_{s}")))
        both = F.size(F.array_intersect("dev_a", "dev_b"))
        found = (met.join(held("a"), ["z", "node_a"]).join(held("b"), ["z", "node_b"])
                 .where((F.col("d_a") + F.col("d_b") - 2 * both) * (100 + p) <= most)
                 .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))
        self.connect(cut_lineage(found.distinct()))
        long = self.with_root(alive.where(F.col("len") > DEVIANT).drop("root"), "node", "root")
        still = (long.groupBy("g").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
                 .where("r0 <> r1").select("g"))
        out = cut_lineage(long.join(still, "g", "left_semi").select("g", "node", "n", "share"))
        release(rows, head, alive)
        return out


def ngram_join(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``documents``.

    Two documents are linked when 100 * intersection >= ``percent`` * union of
    their sets of ``shingle``-word n-grams (ASCII case folded); component_id is the
    smallest doc_id reachable over links, the row's own id included.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent is above 50 and at most 100")
    ship_package(documents.sparkSession)
    wide = cut_lineage(documents.select("doc_id", "text").mapInArrow(
        _prefixes(shingle, percent), "doc_id long, n long, digest binary, head array<long>"))
    matrix = _matrix_rows(wide)
    rows = cut_lineage(wide.drop("head"))
    release(wide)
    product = _Product(documents, matrix, shingle, percent)
    entries, long = product.product()
    # the columns are not read again
    product.rows = cut_lineage(matrix.drop("head"))
    release(matrix)
    # a list is split by size classes just over a link's width apart; a row is in its
    # own class and the next, so that rows of sizes that fit meet in one of them
    own = F.floor(F.log("n") / math.log(100.1 / percent))
    classed = long.withColumn("class", F.explode(F.array(own, own + 1)))
    star = product.centred(classed.withColumn("g", F.xxhash64("g", "class")))
    product.best_first(entries, also=product.rays(star))
    product.by_centres(star)
    release(entries, long)

    member = product.rows.join(product.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = member.groupBy("root").agg(F.min("doc").alias("component_id"))
    group = cut_lineage(member.join(lowest, "root").select("digest", "component_id"))
    release(*product.fetched, product.links, product.roots, product.rows)
    # a digest with many rows is hot on the rows' side only
    out = rows.join(group, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
