"""Hashed text features, and linear models on them fitted in numpy.

A text's features are the presence of its words (ASCII case folded, punctuation
cut off) and of their first ``STEM`` bytes in ``WORD_SLOTS`` hashed slots, and the shares of its raw words by their
edges (a capital or digit at the start, the last two bytes) in ``EDGE_SLOTS`` slots.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.llm.frames import quoted, schema_with
from citeweave.llm.words import LOWER, Words, mix, slices, span_hash, text_bytes
from citeweave.session import cut_lineage, release, ship_package

WORD_SLOTS = 1 << 18
EDGE_SLOTS = 1 << 12
SLOTS = WORD_SLOTS + EDGE_SLOTS
EDGE_SCALE = 8.0
STEM = 5

_NOT_ALNUM = np.ones(256, dtype=bool)
_NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FIRST = np.zeros(256, dtype=np.uint64)
_FIRST[65:91], _FIRST[97:123], _FIRST[48:58], _FIRST[128:] = 1, 2, 3, 4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, slots, values) of each text, slots ascending."""
    n_docs = len(offsets) - 1
    words = Words(data, offsets, lower=True, space=_NOT_ALNUM)
    slot = (words.hash >> np.uint64(64 - 18)).astype(np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(words.first))
    long = np.flatnonzero(words.end - words.start > STEM)
    stem = mix(span_hash(words.data, words.start[long], words.start[long] + STEM)) >> np.uint64(64 - 18)
    present = np.unique(np.concatenate([doc * SLOTS + slot, doc[long] * SLOTS + stem.astype(np.int64)]))
    raw = Words(data, offsets, lower=False)
    n_words = np.diff(raw.first)
    doc = np.repeat(np.arange(n_docs), n_words)
    last = LOWER[data[raw.end - 1]].astype(np.uint64) if len(raw.end) else np.zeros(0, np.uint64)
    before = LOWER[data[np.maximum(raw.end - 2, raw.start)]].astype(np.uint64) if len(raw.end) else last
    kind = _FIRST[data[raw.start]] + np.uint64(5) * _FIRST[data[np.maximum(raw.end - 1, raw.start)]]
    edge = mix(last | before << np.uint64(8) | kind << np.uint64(16)) >> np.uint64(64 - 12)
    edges, count = np.unique(doc * SLOTS + WORD_SLOTS + edge.astype(np.int64), return_counts=True)
    keys = np.concatenate([present, edges])
    values = np.concatenate([np.ones(len(present)),
                             EDGE_SCALE * count / np.maximum(n_words, 1)[edges // SLOTS]])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    offs = np.searchsorted(keys, np.arange(n_docs + 1) * SLOTS)
    return offs, keys % SLOTS, values[order]


class Rows:
    """A sparse matrix by rows."""

    def __init__(self, offsets: np.ndarray, slots: np.ndarray, values: np.ndarray):
        self.offsets, self.slots, self.values = offsets, slots, values
        self.n = len(offsets) - 1
        self.row = np.repeat(np.arange(self.n), np.diff(offsets))

    def related(self, target: np.ndarray, least_z: float = 4.0, least_rows: int = 4) -> "Rows":
        """The slots whose sum with the centred target is ``least_z`` standard
        deviations or more from 0; other slots tell noise from noise."""
        seen = np.bincount(self.slots, minlength=SLOTS)
        spread = np.bincount(self.slots, weights=self.values ** 2, minlength=SLOTS) * target.var()
        ok = (seen >= least_rows) & (np.abs(self.back(target - target.mean())) >= least_z * np.sqrt(spread))
        keep = ok[self.slots]
        offs = np.concatenate([[0], np.cumsum(np.bincount(self.row[keep], minlength=self.n))])
        return Rows(offs, self.slots[keep], self.values[keep])

    def take(self, rows: np.ndarray) -> "Rows":
        keep = np.zeros(self.n, dtype=bool)
        keep[rows] = True
        inside = keep[self.row]
        offs = np.concatenate([[0], np.cumsum(np.diff(self.offsets)[keep])])
        return Rows(offs, self.slots[inside], self.values[inside])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.values * weights[self.slots], minlength=self.n)

    def back(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.slots, weights=self.values * errors[self.row], minlength=SLOTS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def descend(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 100,
            rate: float = 0.1) -> np.ndarray:
    """Adam on full gradients with a rate falling to zero; deterministic."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    return w


def related_slots(table: DataFrame, names: list[str], folds: int, least_z: float = 4.0,
                  least_rows: int = 4) -> np.ndarray:
    """The slots that ``Rows.related`` keeps for any of the labels ``names`` on all
    rows of ``table`` (fold, labels, slots, vals) or on all but one fold's.

    One aggregate of sums per slot; at most ``SLOTS`` slot numbers reach the driver.
    """
    def sums(v) -> list:
        return [F.sum(F.when((F.col("fold") == f) & F.col(n).isNotNull(), x)).alias(f"{n}_{f}_{s}")
                for n in names for f in range(folds) for s, x in v(n).items()]
    each = table.select("fold", *names, F.lit(1.0).alias("one"))
    total = each.agg(*sums(lambda n: {"n": F.col("one"), "y": F.col(n), "yy": F.col(n) ** 2})).first()
    slot = (table.select("fold", *names, F.explode(F.arrays_zip("slots", "vals")).alias("e"))
            .select("fold", *names, F.col("e.slots").alias("slot"), F.col("e.vals").cast("double").alias("v"))
            .groupBy("slot").agg(*sums(lambda n: {"n": F.lit(1.0), "v": F.col("v"), "vv": F.col("v") ** 2,
                                                  "vy": F.col("v") * F.col(n)})))
    kept = F.lit(False)
    for n in names:
        for left_out in {None, *range(folds)} if folds > 1 else {None}:
            used = [f for f in range(folds) if f != left_out]
            rows, y, yy = (sum(total[f"{n}_{f}_{s}"] or 0.0 for f in used) for s in ("n", "y", "yy"))
            if not rows:
                continue
            seen, v, vv, vy = (sum((F.coalesce(f"{n}_{f}_{s}", F.lit(0.0)) for f in used), F.lit(0.0))
                               for s in ("n", "v", "vv", "vy"))
            z = least_z * (1 - 1e-6) * F.sqrt(vv * max(yy / rows - (y / rows) ** 2, 0.0))  # a hair below, for rounding
            kept = kept | ((seen >= least_rows) & (F.abs(vy - v * (y / rows)) >= z))
    return np.sort(slot.where(kept).select("slot").toArrow().column("slot").to_numpy())


def labelled_sample(documents: DataFrame, labels: DataFrame, names: list[str], rows: int, folds: int = 1):
    """Features, labels and folds of at most ``rows`` labelled documents, those of least
    hash of doc_id: (Rows, array of labels with nan for null, doc_ids, folds).

    The features are computed on whole texts and kept in a table; the driver gets those
    in ``related_slots`` only, so what it holds is bounded by ``rows`` times these, however
    long the texts.  The fold is a hash of doc_id.  A doc_id labelled more than once takes
    its largest labels; one that repeats in ``documents`` counts once, by its text of least hash.
    """
    spark = documents.sparkSession
    ship_package(spark)
    chosen = (labels.where("doc_id IS NOT NULL").groupBy("doc_id")
              .agg(*[F.max(F.col(n).cast("double")).alias(f"_y{i}") for i, n in enumerate(names)])
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    ys = [f"_y{i}" for i in range(len(names))]
    lists = "slots array<int>, vals array<float>"

    def as_lists(offs: np.ndarray, slots: np.ndarray, values: np.ndarray) -> list[pa.Array]:
        offs = pa.array(offs.astype(np.int32))
        return [pa.ListArray.from_arrays(offs, pa.array(slots.astype(np.int32))),
                pa.ListArray.from_arrays(offs, pa.array(values.astype(np.float32)))]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                got = features(*text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "text_hash", *ys)], *as_lists(*got)],
                                                 names=["doc_id", "text_hash", *ys, "slots", "vals"])

    texts = (documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
             .join(F.broadcast(chosen), "doc_id"))  # ``rows`` rows
    y_schema = ", ".join(f"{y} double" for y in ys)
    table = cut_lineage(
        texts.mapInArrow(run, f"doc_id long, text_hash long, {y_schema}, {lists}")
        .groupBy("doc_id").agg(F.min_by(F.struct(*ys, "slots", "vals"), "text_hash").alias("r")).select("doc_id", "r.*")
        .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int")))
    wanted = np.zeros(SLOTS, dtype=bool)
    wanted[related_slots(table, ys, folds)] = True
    shared = spark.sparkContext.broadcast(wanted)  # SLOTS bytes

    def pick(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            slots, values = batch.column("slots"), batch.column("vals").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), slots.value_lengths().to_numpy())
            slots = slots.flatten().to_numpy()
            keep = shared.value[slots]
            offs = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "fold", *ys)],
                                              *as_lists(offs, slots[keep], values[keep])],
                                             names=["doc_id", "fold", *ys, "slots", "vals"])
    got = (table.select("doc_id", "fold", *ys, "slots", "vals")
           .mapInArrow(pick, f"doc_id long, fold int, {y_schema}, {lists}").toArrow())
    release(table)
    got = got.sort_by("doc_id").combine_chunks()
    if got.num_rows == 0:
        return Rows(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0)), np.zeros((0, len(names))), [], np.zeros(0, int)
    slots = got.column("slots").combine_chunks()
    x = Rows(np.concatenate([[0], np.cumsum(slots.value_lengths().to_numpy())]), slots.flatten().to_numpy(),
             got.column("vals").combine_chunks().flatten().to_numpy().astype(np.float64))
    y = np.stack([got.column(c).to_numpy().astype(np.float64) for c in ys], axis=1)
    return x, y, got.column("doc_id").to_pylist(), got.column("fold").to_numpy()


def scored(documents: DataFrame, score: Callable[[Rows], dict[str, np.ndarray]], names: list[str],
           columns: list[str], keep: Callable[[dict[str, np.ndarray]], np.ndarray] | None = None) -> DataFrame:
    """Columns ``columns`` of every row with the double columns ``names`` that
    ``score`` gives; only the rows ``keep`` names, where given."""
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                got = score(Rows(*features(*text_bytes(part.column("text")))))
                out = pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns], *[pa.array(got[n]) for n in names]],
                    names=[*columns, *names])
                yield out if keep is None else out.filter(pa.array(keep(got)))
    schema = schema_with(documents, columns, **{n: T.DoubleType() for n in names})
    return documents.select(*map(quoted, dict.fromkeys([*columns, "text"]))).mapInArrow(run, schema)
