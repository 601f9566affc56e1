"""Scoring texts by prediction by partial matching, beside a word unigram base.

The model is a byte-context trie of order ``ORDER``: counts of every symbol after
every context of 0 to ORDER bytes, learnt from the training texts (ASCII case
folded; a zero byte ends a text and stands before its start).  A symbol is
predicted from the longest known context; escape estimation is method C
(distinct symbols / (total + distinct)), and a shorter context leaves out the
symbols of the longer one it escaped from.  Below order 0 the bytes not yet left
out are equally likely.

All pairs count, however rare.  Tasks receive a fast path of bounded size: the
most frequent order-``ORDER`` pairs (at most ``PAIRS``) with their exact weights.
All other grams of the scored texts meet the full table of counts in one shuffle
by their last ``LOW`` context bytes: the pairs of the longer orders that a gram can
need lie beside it there, and the counts of orders 0 to LOW - 1 are kept whole (LOW
bytes of text, so bounded by the alphabet).  Their weights are joined back to the
texts by gram.

Word counts for the base score are kept exactly for all words: words seen at least
N / ``FREQUENT`` times (at most FREQUENT words) are looked up in the task, the
others' counts are joined by word hash.

Rows: a null text counts as empty (one end token); a null doc_id trains; repeated
rows count each; without training texts counts are 0.  An empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.words import LOWER, HashIndex, Words, slices, text_bytes
from citeweave.session import cut_lineage, ship_package

ORDER = 5
LOW = 3
PAIRS = 1 << 19
FREQUENT = 1 << 20
END = 0x7FFFFFFFFFFFFFFF  # the end token's place among word hashes
_HELD = 1_000_000


def held_out(doc_id: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds)) == fold, F.lit(False))


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ORDER + 1 bytes ending at each byte and at each text's end, packed, and
    their n+1 offsets.  The upper bytes are the context."""
    n_docs = len(offsets) - 1
    wide = offsets + np.arange(n_docs + 1) * (ORDER + 1)
    seq = np.zeros(len(data) + n_docs * (ORDER + 1), dtype=np.uint8)
    size = np.diff(offsets)
    at = np.arange(len(data)) + np.repeat(np.arange(n_docs) * (ORDER + 1) + ORDER, size)
    seq[at] = LOWER[data]
    key = np.zeros(max(0, len(seq) - ORDER), dtype=np.uint64)
    for j in range(ORDER + 1):
        key = (key << np.uint64(8)) | seq[j:len(seq) - ORDER + j]
    # grams that begin in a text's last ORDER places run into the next text
    keep = np.ones(len(key), dtype=bool)
    for j in range(1, ORDER + 1):
        past = wide[1:] - j
        keep[past[past < len(keep)]] = False
    return key[keep], offsets + np.arange(n_docs + 1)


class _Counter:
    """Counts of 64-bit keys; hands out what it holds when that gets large."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.n = kind, [], 0

    def add(self, keys: np.ndarray):
        k, c = np.unique(keys, return_counts=True)
        self.parts.append((k, c))
        self.n += len(k)
        if self.n > _HELD:
            self._merge()
            if self.n > _HELD // 2:
                yield from self.out()

    def _merge(self):
        k = np.concatenate([p[0] for p in self.parts])
        keys, back = np.unique(k, return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([p[1] for p in self.parts])).astype(np.int64)
        self.parts, self.n = [(keys, counts)], len(keys)

    def out(self):
        if not self.parts:
            return
        self._merge()
        keys, counts = self.parts[0]
        self.parts, self.n = [], 0
        for at in range(0, len(keys), 100_000):
            k, c = keys[at:at + 100_000], counts[at:at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), self.kind, np.int32)), pa.array(k.view(np.int64)),
                 pa.array(c.astype(np.int64))], names=["kind", "key", "n"])


def _word_keys(w: Words) -> np.ndarray:
    """Word hashes with the end token's value kept free."""
    h = w.hash.copy()
    h[h == np.uint64(END)] = 0
    return h


def _count(batches):
    words, grams = _Counter(0), _Counter(1)
    for batch in batches:
        for part in slices(batch, max_bytes=1 << 20):
            data, offsets = text_bytes(part.column("text"))
            yield from words.add(np.concatenate([_word_keys(Words(data, offsets)),
                                                 np.full(part.num_rows, END, np.uint64)]))
            yield from grams.add(_grams(data, offsets)[0])
    yield from words.out()
    yield from grams.out()


class Trie:
    """Counts of all orders as hash tables with their log10 weights, above the
    levels of another trie if given."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]], under: "Trie | None" = None):
        self.levels = list(under.levels) if under else []
        below = self.levels[-1] if under else None
        for order, (keys, counts) in enumerate(orders, len(self.levels)):
            sort = np.argsort(keys)
            keys, counts = keys[sort], counts[sort].astype(np.float64)
            ctx, back = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.bincount(back, weights=counts, minlength=len(ctx))
            kinds = np.bincount(back, minlength=len(ctx)).astype(np.float64)
            level = {"keys": keys, "counts": counts, "ctx": ctx, "total": total, "kinds": kinds,
                     "own": np.log10(counts / (total + kinds)[back]) if len(keys) else counts}
            if below is not None:
                # what the next shorter context has beside this one's symbols
                mask = np.uint64((1 << 8 * order) - 1)
                at = np.searchsorted(below["keys"], keys & mask)
                seen = np.bincount(back, weights=below["counts"][at], minlength=len(ctx))
                low = np.searchsorted(below["ctx"], ctx & (mask >> np.uint64(8)))
                level["rest_total"], level["rest_kinds"] = below["total"][low] - seen, below["kinds"][low] - kinds
            level["grams"], level["contexts"] = HashIndex(keys), HashIndex(ctx)
            self.levels.append(level)
            below = level
        self.floor = -np.log10(256.0 - len(self.levels[0]["keys"])) if len(self.levels[0]["keys"]) < 256 else 0.0

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each packed gram after the others."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        total, kinds = np.full(len(keys), -1.0), np.zeros(len(keys))  # total -1: nothing left out yet
        for order in range(len(self.levels) - 1, -1, -1):
            level = self.levels[order]
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            key = keys[left] & mask
            at = level["grams"].find(key)
            hit = at >= 0
            fresh = hit & (total < 0)
            out[left[fresh]] += level["own"][at[fresh]]
            cut = hit & ~fresh
            out[left[cut]] += np.log10(level["counts"][at[cut]] / (total[cut] + kinds[cut]))
            left, total, kinds, key = left[~hit], total[~hit], kinds[~hit], key[~hit]
            if not len(left):
                return out
            c = level["contexts"].find(key >> np.uint64(8))
            known = c >= 0
            fresh = known & (total < 0)
            total[fresh], kinds[fresh] = level["total"][c[fresh]], level["kinds"][c[fresh]]
            escape = known & (kinds > 0)
            out[left[escape]] += np.log10(kinds[escape] / (total[escape] + kinds[escape]))
            if order:
                total[known], kinds[known] = level["rest_total"][c[known]], level["rest_kinds"][c[known]]
        out[left] += self.floor
        return out


def _summed(keys: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the pairs of an order from those of longer grams."""
    out, back = np.unique(keys & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
    return out, np.bincount(back, weights=counts, minlength=len(out)).astype(np.int64)


def _context() -> Column:
    """The last LOW context bytes of a gram."""
    return F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * LOW) - 1))


def _learn(documents: DataFrame):
    """Word counts (table), gram counts (table), N, V, the frequent words, the
    weights of frequent grams and the counts of the orders under LOW."""
    counts = cut_lineage(documents.where(~held_out()).select("text")
                         .mapInArrow(_count, "kind int, key long, n long")
                         .groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words, grams = counts.where("kind = 0").select("key", "n"), counts.where("kind = 1").select("key", "n")
    w = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = int(w["n"] or 0), int(w["v"])
    frequent = words.where(F.col("n") * FREQUENT >= n).toPandas() if n else None  # at most FREQUENT rows
    # the least count that at most PAIRS grams reach, to an eighth of a power of two
    step = F.floor(F.log2("n") * 8).cast("int")
    many, least = 0, None
    for r in sorted(grams.groupBy(step.alias("step")).count().collect(), reverse=True):  # at most 512 rows
        many += r["count"]
        if many > PAIRS:
            break
        least = r["step"]
    contexts = grams.groupBy(F.shiftright("key", 8).alias("ctx")).agg((F.sum("n") + F.count("*")).alias("whole"))
    top = (grams.where(step >= (least if least is not None else 1 << 20))
           .join(contexts, F.shiftright("key", 8) == F.col("ctx"))
           .select("key", F.log10(F.col("n") / F.col("whole")).alias("own"))).toPandas()  # at most PAIRS rows
    low = (grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * LOW) - 1)).alias("key"))
           .agg(F.sum("n").alias("n"))).toPandas()  # pairs of LOW bytes
    key, count = low.key.to_numpy(np.int64).view(np.uint64), low.n.to_numpy(np.int64)
    orders = [_summed(key, count, o) for o in range(LOW)]
    known = ((frequent.key.to_numpy(np.int64).view(np.uint64), frequent.n.to_numpy()) if n
             else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return (words, grams, n, v, known,
            (top.key.to_numpy(np.int64).view(np.uint64), top.own.to_numpy(np.float64)), orders)


def _weights(low: Trie, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Weights of the grams asked for (count 0) beside all counted grams of their contexts."""
    known = counts > 0
    asked = np.unique(keys[~known])
    trie = Trie([_summed(keys[known], counts[known], o) for o in range(LOW, ORDER + 1)], low)
    return pa.RecordBatch.from_arrays([pa.array(asked.view(np.int64)), pa.array(trie.log10(asked))],
                                      names=["key", "weight"])


def _gram_weights(shared, tag: str):
    def run(batches):
        low = _tables(tag + "low", lambda: Trie(shared.value))
        held, size = [], 0
        for batch in batches:  # in order of context
            held.append((batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()))
            size += batch.num_rows
            if size >= 100_000:
                keys, counts = (np.concatenate(x) for x in zip(*held))
                ctx = (keys >> np.uint64(8)) & np.uint64((1 << 8 * LOW) - 1)
                cut = int(np.searchsorted(ctx, ctx[-1]))  # the last context may go on
                if cut:
                    yield _weights(low, keys[:cut], counts[:cut])
                held, size = [(keys[cut:], counts[cut:])], len(keys) - cut
        if size:
            yield _weights(low, *(np.concatenate(x) for x in zip(*held)))
    return run


_built: dict = {}


def _tables(key: str, build):
    """Tables of the broadcast counts, built once per Python worker."""
    if key not in _built:
        _built.clear()
        _built[key] = build()
    return _built[key]


def score_documents(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    ship_package(spark)
    docs = documents.select("doc_id", "text")
    words, grams, n, v, known, top, orders = _learn(docs)
    shared, low = spark.sparkContext.broadcast((known, top)), spark.sparkContext.broadcast(orders)
    tag, norm = uuid.uuid4().hex, float(n + v + 1)

    def run(batches):
        def build():
            (word, often), (gram, own) = shared.value
            return HashIndex(word), often.astype(np.float64), HashIndex(gram), own
        index, count, gram_index, own = _tables(tag, build)
        for batch in batches:
            for part in slices(batch, max_bytes=1 << 20):
                data, offsets = text_bytes(part.column("text"))
                w = Words(data, offsets)
                n_docs = part.num_rows
                many = np.diff(w.first) + 1
                doc = np.concatenate([np.repeat(np.arange(n_docs), many - 1), np.arange(n_docs)])
                token = np.concatenate([_word_keys(w), np.full(n_docs, END, np.uint64)])
                at = index.find(token)
                hit = at >= 0
                got = np.bincount(doc[hit], weights=np.log10((count[at[hit]] + 1) / norm), minlength=n_docs)
                known_here = np.bincount(doc[hit], minlength=n_docs)
                rare_doc, rare = doc[~hit], token[~hit]
                sort = np.argsort(rare_doc, kind="stable")
                cuts = np.concatenate([[0], np.cumsum(np.bincount(rare_doc, minlength=n_docs))])
                keys, spans = _grams(data, offsets)
                place = np.repeat(np.arange(n_docs), np.diff(spans))
                at = gram_index.find(keys)
                hit = at >= 0
                score = np.bincount(place[hit], weights=own[at[hit]], minlength=n_docs).astype(np.float64)
                # the others, each once per text with its number
                other, times = keys[~hit], place[~hit]
                by = np.lexsort((other, times))
                other, times = other[by], times[by]
                head = np.ones(len(other), dtype=bool)
                head[1:] = (other[1:] != other[:-1]) | (times[1:] != times[:-1])
                head = np.flatnonzero(head)
                repeats = np.diff(np.append(head, len(other)))
                ends = np.concatenate([[0], np.cumsum(np.bincount(times[head], minlength=n_docs))])
                others = pa.StructArray.from_arrays([pa.array(other[head].view(np.int64)),
                                                     pa.array(repeats.astype(np.int32))], names=["key", "times"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(many.astype(np.int64)),
                     pa.array(known_here.astype(np.int64)), pa.array(got.astype(np.float64)), pa.array(score),
                     pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)),
                                              pa.array(rare[sort].view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), others)],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "grams"])

    rows = cut_lineage(docs.withColumn("held_out", held_out()).mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, "
        "rare array<long>, grams array<struct<key: long, times: int>>")
        .withColumn("row", F.monotonically_increasing_id()))
    # the others' counts: map-side combined per row and word before the join
    rare = (rows.select("row", F.explode("rare").alias("key"))
            .join(words.where(F.col("n") * FREQUENT < n), "key", "left")
            .groupBy("row").agg(F.count("n").alias("more_known"),
                                F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(norm))).alias("more")))
    asked = rows.select("row", F.explode("grams").alias("g")).select("row", "g.key", "g.times")
    parts = _context()
    weights = (grams.unionByName(asked.select("key").distinct().withColumn("n", F.lit(0).cast("long")))
               .repartition(parts).sortWithinPartitions(parts)
               .mapInArrow(_gram_weights(low, tag), "key long, weight double"))
    more_score = (asked.join(weights, "key").groupBy("row")
                  .agg(F.sum(F.col("weight") * F.col("times")).alias("more_score")))
    return (rows.drop("rare", "grams").join(rare, "row", "left").join(more_score, "row", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                    F.lit(n).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
                    (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score")))
