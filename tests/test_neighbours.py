"""The inverted file of cells against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.operators import neighbours as nb
from citeweave.operators import vectors as vx

SCHEMA = "vec_id long, embedding array<float>"


def _rows(n=1500, dim=16, groups=30, seed=3):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(groups, dim))
    at = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, groups, n))  # one cell holds a third
    v = (mid[at] + 0.35 * rng.normal(size=(n, dim))).astype(np.float32)
    v[10] = v[11] = v[12]
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


def _brute(rows, asked, k):
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in asked:
        s = np.round(m @ m[q], 9)
        s[q] = -np.inf
        out[q] = np.argsort(-s, kind="stable")[:k].tolist()
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows() + [(5000, [0.0] * 16), (5001, None)], SCHEMA)


@pytest.fixture(scope="module")
def index(table):
    return nb.build(table, block=100)


def _asked(table):
    return table.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_vec"))


def _found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query, []).append(r.vec_id)
    return out


def test_every_vector_is_indexed(index):
    assert sorted(r.vec_id for r in index.members.select("vec_id").collect()) == list(range(1500))
    assert index.members.groupBy("cell", "block").count().agg(F.max("count")).first()[0] < 200
    assert index.blocks.max() > 3


def test_exact_search_equals_brute_force(table, index):
    got = _found(nb.search(index, _asked(table), k=20, probes=2, exact=True, exclude_self=True, block=30))
    assert got == _brute(_rows(), range(0, 1500, 10), 20)


def test_probing_reaches_the_recall(table, index):
    """recall@20 against the exact form of at least 0.95 with the default probes."""
    got = _found(nb.search(index, _asked(table), k=20, exclude_self=True))
    want = _brute(_rows(), range(0, 1500, 10), 20)
    recall = np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want])
    assert recall >= 0.95, recall


def test_words_and_small_tables(spark):
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "word string, vector array<double>")
    index = nb.build(words, "word", "vector")
    asked = words.select(F.col("word").alias("query"), F.col("vector").alias("query_vec"))
    got = nb.search(index, asked, k=5, id_col="word", exact=True, exclude_self=True).collect()
    assert [r.word for r in sorted((r for r in got if r.query == "a"), key=lambda r: r["rank"])] == ["b", "c"]
    assert len(got) == 6
    none = nb.build(words.limit(0), "word", "vector")
    assert nb.search(none, asked, id_col="word", exact=True).count() == 0
    assert nb.search(index, asked.limit(0), id_col="word", exact=True).count() == 0


def test_a_task_holds_few_angles_at_a_time():
    """10,000 vectors against 4,096 cells are 330 MB of angles."""
    import tracemalloc
    import pyarrow as pa
    rng = np.random.default_rng(5)
    units, centres = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(10_000, 8)), rng.normal(size=(4096, 8))))
    batch = pa.record_batch([pa.array(range(10_000)), pa.array(list(units), pa.list_(pa.float64()))], names=["vec_id", "unit"])
    tracemalloc.start()
    placed = list(nb._placed([batch], centres))
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert np.array_equal(np.concatenate([p.column("cell").to_numpy() for p in placed]), (units @ centres.T).argmax(axis=1))
