"""Nearest neighbours by an inverted file of coarse cells (M5, T4), for query
sets that grow like the vectors.

``build`` cuts the vectors into cells by k-means centres (fitted on a bounded
sample; every vector is then put into the cell of its nearest centre).  ``search``
scores each query against the vectors of its nearest ``probes`` cells, one matrix
product per (block of a cell, block of its queries).  With ``exact`` it goes on to
every other cell that may hold a better neighbour: a vector's angle to the query
is at least the angle of the cell's centre less the cell's radius.

Queries and vectors meet by a shuffle on (cell, blocks), so neither side passes through the
driver, and blocks of at most about ``BLOCK`` rows bound a task however full a
cell is.  Only the centres are broadcast: at most ``MAX_CELLS`` of them.

Rows: vectors and queries without direction (null or all zeros) are left out.
Similarities are rounded to 9 decimals, ties break by id; a vector table with a repeated id
ranks each of its rows.  Query ids are distinct.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.operators.vectors import TOP_K, norm
from citeweave.session import cut_lineage, ship_package

MAX_CELLS = 4096
SAMPLE = 100_000
BLOCK = 2_000
ANGLES = 1 << 20  # that a task holds at a time: 8 MB
COPIES = 10_000   # rows of a query with a cell that it sends at a time
PROBES = 8
SLACK = 1e-6  # of an angle, for rounding


@dataclass
class CellIndex:
    """``members`` (id, unit, cell, block) and, by cell number, unit centres,
    radii (largest angle of a member, -1 for an empty cell) and block counts."""

    members: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    blocks: np.ndarray


def _unit(df: DataFrame, id_col: str, vec: str, name: str) -> DataFrame:
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    return (df.select(F.col(id_col).alias(name), v.alias("v")).withColumn("n", norm("v")).where("n > 0")
            .select(name, F.transform("v", lambda x: x / F.col("n")).alias("unit")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def _slices(batches: Iterable[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows, so many at a time that they have at most ``ANGLES`` angles to the cells."""
    rows = max(1, ANGLES // max(cells, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _placed(batches: Iterable[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The vectors with the cell of their nearest centre and the angle to it."""
    for part in _slices(batches, len(centres)):
        angle = _angles(_matrix(part.column("unit")), centres)
        cell = angle.argmin(axis=1)
        yield pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])],
            names=[*part.schema.names, "cell", "angle"])


def fit_centres(units: DataFrame, id_col: str, cells: int | None = None, sample: int = SAMPLE,
                seed: int = 1) -> np.ndarray:
    """Unit centres of k-means on the ``sample`` vectors of least hash of id; about
    the square root of the number of vectors, at most ``MAX_CELLS``."""
    cells = cells or int(np.sqrt(units.count()))
    part = units.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(sample)
    part = cut_lineage(part.select(array_to_vector("unit").alias("features")))
    if part.isEmpty():
        return np.zeros((0, 0))
    model = KMeans(k=max(2, min(cells, MAX_CELLS)), seed=seed, maxIter=10).fit(part)
    centres = np.array(model.clusterCenters())
    size = np.linalg.norm(centres, axis=1)
    return centres[size > 1e-9] / size[size > 1e-9, None]


def build(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", cells: int | None = None,
          sample: int = SAMPLE, block: int = BLOCK, seed: int = 1) -> CellIndex:
    """Every vector of ``vectors`` in the cell of its nearest centre."""
    spark = vectors.sparkSession
    ship_package(spark)
    units = _unit(vectors, id_col, vec, id_col)
    centres = fit_centres(units, id_col, cells, sample, seed)
    shared = spark.sparkContext.broadcast(centres)  # at most MAX_CELLS vectors

    kind = vectors.schema[id_col].dataType.simpleString()
    placed = cut_lineage(units.mapInArrow(lambda b: _placed(b, shared.value),
                                          f"`{id_col}` {kind}, unit array<double>, cell int, angle double"))
    radii, blocks = np.full(len(centres), -1.0), np.zeros(len(centres), dtype=np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # cells
        radii[r.cell], blocks[r.cell] = r.radius, -(-r.n // block)
    counts = _per_cell(spark, blocks)
    members = (placed.join(F.broadcast(counts), "cell")
               .select(id_col, "unit", "cell", F.pmod(F.xxhash64(id_col, "unit"), "n").cast("int").alias("block")))
    return CellIndex(members, centres, radii, blocks)


def _per_cell(spark: SparkSession, n: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(n), dtype=np.int32), "n": n}), "cell int, n long")


def _score(index: CellIndex, pairs: DataFrame, k: int, id_col: str, qid: str, exclude_self: bool,
           block: int) -> DataFrame:
    """(query, id, similarity): the k best of every pair (query, cell) and block; ``pairs``
    has (query, unit, cell)."""
    spark = pairs.sparkSession
    sizes = F.broadcast(pairs.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("nq")))  # at most MAX_CELLS rows
    members = (index.members.join(sizes, "cell")
               .withColumn("qblock", F.explode(F.sequence(F.lit(0), F.col("nq").cast("int") - 1))).drop("nq"))
    queries = (pairs.join(sizes, "cell")
               .withColumn("qblock", F.pmod(F.xxhash64(qid, F.lit("q")), "nq").cast("int")).drop("nq")
               .join(F.broadcast(_per_cell(spark, index.blocks)), "cell")  # at most MAX_CELLS rows
               .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).drop("n"))

    def best(m: pa.Table, q: pa.Table) -> pa.Table:
        if m.num_rows and q.num_rows:
            m = m.sort_by(id_col)
            sims = np.round(_matrix(q.column("unit").combine_chunks()) @ _matrix(m.column("unit").combine_chunks()).T, 9)
            ids, asked = m.column(id_col), q.column(qid)
            if exclude_self:
                sims[asked.to_numpy()[:, None] == ids.to_numpy()[None, :]] = -np.inf
            top = np.argsort(-sims, axis=1, kind="stable")[:, :k]  # ids ascend, so ties break by id
            row = np.repeat(np.arange(len(sims)), top.shape[1])
            top = top.ravel()
            found = np.isfinite(sims[row, top])
            row, top = row[found], top[found]
            return pa.table([asked.take(pa.array(row)), ids.take(pa.array(top)), pa.array(sims[row, top])],
                            names=[qid, id_col, "similarity"])
        return pa.table([q.column(qid).slice(0, 0), m.column(id_col).slice(0, 0), pa.array([], pa.float64())],
                        names=[qid, id_col, "similarity"])
    keys = ["cell", "block", "qblock"]
    schema = (f"`{qid}` {pairs.schema[qid].dataType.simpleString()}, "
              f"`{id_col}` {index.members.schema[id_col].dataType.simpleString()}, similarity double")
    return members.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(best, schema)


def search(index: CellIndex, queries: DataFrame, k: int = TOP_K, id_col: str = "vec_id", qid: str = "query",
           qvec: str = "query_vec", probes: int = PROBES, exact: bool = False, exclude_self: bool = False,
           block: int = BLOCK) -> DataFrame:
    """(query, id, similarity, rank) of the k most similar vectors per query, among
    the ``probes`` nearest cells, or among all (``exact``)."""
    spark = queries.sparkSession
    units = _unit(queries, qid, qvec, qid)
    kind = queries.schema[qid].dataType.simpleString()
    filled = np.flatnonzero(index.radii >= 0)
    shared = spark.sparkContext.broadcast((index.centres[filled], index.radii[filled], filled.astype(np.int32)))

    def cells(batches: Iterator[pa.RecordBatch], further: bool) -> Iterator[pa.RecordBatch]:
        centres, radii, number = shared.value
        if not len(number):
            return
        for part in _slices(batches, len(number)):
            angle = _angles(_matrix(part.column("unit")), centres)
            rank = angle.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            if further:
                worst = part.column("worst").to_numpy(zero_copy_only=False)  # nan: fewer than k found
                reach = np.where(np.isnan(worst), np.inf, np.arccos(np.clip(worst, -1.0, 1.0)))
                row, cell = np.nonzero((rank >= probes) & (angle - radii <= reach[:, None] + SLACK))
            else:
                row, cell = np.nonzero(rank < probes)
            for at in range(0, len(row), COPIES):
                taken = part.take(pa.array(row[at:at + COPIES]))
                yield pa.RecordBatch.from_arrays(
                    [taken.column(qid), taken.column("unit"), pa.array(number[cell[at:at + COPIES]])],
                    names=[qid, "unit", "cell"])
    schema = f"`{qid}` {kind}, unit array<double>, cell int"

    def ranked(found: DataFrame) -> DataFrame:
        w = Window.partitionBy(qid).orderBy(F.desc("similarity"), F.asc(id_col))
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    near = cut_lineage(units.mapInArrow(lambda b: cells(b, False), schema))
    top = ranked(_score(index, near, k, id_col, qid, exclude_self, block))
    if not exact:
        return top
    top = cut_lineage(top)
    worst = top.where(F.col("rank") == k).select(qid, F.col("similarity").alias("worst"))
    rest = cut_lineage(units.join(worst, qid, "left").mapInArrow(lambda b: cells(b, True), schema))
    more = _score(index, rest, k, id_col, qid, exclude_self, block)
    return ranked(top.drop("rank").unionByName(more))
