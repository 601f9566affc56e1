import random
import tempfile

import pytest

from citeweave.operators import phrase_index as pi

SCHEMA = "oa_id string, title string, abstract string"


@pytest.fixture(scope="module")
def works(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdÉ") for _ in range(rng.choice([1, 2, 4]))) for _ in range(n))
    rows = [(f"W{i}", text(5) if i % 9 else None, text(25) if i % 4 else None) for i in range(300)]
    rows += [("W900", "Vector Space models", ""), ("W901", "", "of VECTOR spaces"), ("W902", None, None),
             ("W903", "vector", "space"), ("W904", "ve", "e"), ("W905", "x" * 100_000 + " vector space", None)]
    return rows


@pytest.fixture(scope="module")
def index(spark, works):
    path = tempfile.mkdtemp(prefix="cw-index-")
    pi.write_index(spark.createDataFrame(works, SCHEMA), path, parts=8)
    return path


PHRASES = ["vector space", "VECTOR", "ab", "a", "é", "ab c", "abc", "dddd", "zzz", "ve", "or s", "space", "vector", None, ""]


def test_equal_to_containment(spark, works, index):
    found = pi.search(spark, index, spark.createDataFrame([(p,) for p in PHRASES], "phrase string"), parts=8).collect()
    expected = {(p.lower(), w) for p in PHRASES if p for w, t, a in works
                if any(x is not None and p.lower() in x.lower() for x in (t, a))}
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == expected
    assert {w for p, w in expected if p == "vector space"} == {"W900", "W901", "W905"}


def test_other_texts_are_not_candidates(spark, works, index):
    asked = spark.createDataFrame([("vector space",), ("qqq",)], "phrase string")
    assert {r.oa_id for r in pi.candidates(spark, index, asked, parts=8).collect()} == {"W900", "W901", "W905"}


def test_empty_index(spark):
    path = tempfile.mkdtemp(prefix="cw-index-")
    pi.write_index(spark.createDataFrame([("W1", "abc", None)], SCHEMA), path, parts=2)
    none = spark.createDataFrame([], "phrase string")
    assert pi.search(spark, path, none, parts=2).collect() == []


def test_a_long_text_is_cut_in_one_pass_and_a_repeated_id_once(spark, tmp_path):
    import time
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400_000)) + "é漢😀!"
    works = spark.createDataFrame([("W1", long, "ab"), ("W2", None, "abcd"), ("W2", None, "bcde"), ("W3", "", None)],
                                  "oa_id string, title string, abstract string")
    began = time.time()
    pi.write_index(works, str(tmp_path), parts=4)
    assert time.time() - began < 30  # by SQL substrings: 80 billion steps over characters
    got = sorted((r.oa_id, r.field, r.gram) for r in spark.read.parquet(f"{tmp_path}/postings").collect())
    cut = lambda t: {(t + pi.END)[i:i + 3] for i in range(len(t))}
    want = [("W1", 0, g) for g in cut(long)] + [("W1", 1, g) for g in cut("ab")] + [("W2", 1, g) for g in cut("abcd") | cut("bcde")]
    assert got == sorted(want)
