"""The labelled sample against its brute-force version on whole texts."""
import numpy as np
import pytest

from citeweave.llm.hashed_text import SLOTS, Rows, features, labelled_sample
from citeweave.llm.words import text_bytes


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, marks = [], []
    for i in range(300):
        bad = int(rng.random() < 0.3)
        words = list(rng.choice(vocabulary, 12)) + (["rotten", "vile"] if bad else ["plain"])
        rows.append((i, " ".join(words)))
        marks.append((i, 1 - int(rng.random() < 0.2), bad if i % 17 else None))
    rows += [(5, rows[5][1]), (7, "another text"), (None, "no id"), (400, None), (401, ""), (402, "plain " * 300_000)]
    marks += [(5, 0, 1), (400, 1, 0), (401, 0, 1), (402, 1, 0), (None, 1, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(marks, "doc_id long, quality long, toxic long"))


def test_sample_holds_exactly_the_related_slots(tables):
    documents, labels = tables
    x, y, ids, fold = labelled_sample(documents, labels, ["quality", "toxic"], 1000, 3)
    assert ids == [*range(300), 400, 401, 402] and set(fold) == {0, 1, 2}
    assert y[5].tolist() == [max(1.0, y[5, 0]), 1.0] and np.isnan(y[17, 1])
    texts = {}
    for r in documents.where("doc_id <> 7").collect():
        texts[r.doc_id] = r.text
    texts[7] = documents.where("doc_id = 7").selectExpr("min_by(text, xxhash64(text)) AS t").first().t
    import pyarrow as pa
    whole = Rows(*features(*text_bytes(pa.array([texts[i] for i in ids], pa.string()))))
    wanted = np.zeros(SLOTS, dtype=bool)
    for c in range(2):
        for left_out in (None, 0, 1, 2):
            rows = np.flatnonzero(~np.isnan(y[:, c]) & ((fold != left_out) if left_out is not None else True))
            wanted[np.unique(whole.take(rows).related(y[rows, c]).slots)] = True
    keep = wanted[whole.slots]
    assert keep.any() and np.array_equal(x.slots, whole.slots[keep])
    assert np.allclose(x.values, whole.values[keep], rtol=1e-6)
    assert np.array_equal(np.diff(x.offsets), np.bincount(whole.row[keep], minlength=whole.n))


def test_sample_is_bounded_and_repeats(tables):
    documents, labels = tables
    first, again = (labelled_sample(documents, labels, ["toxic"], 40, 2) for _ in range(2))
    assert len(first[2]) <= 40 and first[2] == again[2]
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in ((first[1], again[1]), (first[0].slots, again[0].slots)))


def test_sample_of_nothing(tables):
    documents, labels = tables
    x, y, ids, fold = labelled_sample(documents.limit(0), labels, ["toxic"], 10, 3)
    assert x.n == 0 and y.shape == (0, 1) and ids == [] and len(fold) == 0
