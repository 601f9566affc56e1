import pytest
from pyspark.sql import functions as F

from citeweave.operators import decades as dec


def _works(spark):
    rows = [
        ("A", 1971, ["B", "B", "A", "C", "X", "D"]),   # repeated ref, self ref, outside corpus
        ("B", 1975, ["A"]),
        ("C", 1969, ["A"]),                            # other decade
        ("D", None, ["A"]),                            # null year
        ("E", 1910, ["E"]),                            # before 1920
    ]
    return spark.createDataFrame(rows, "oa_id string, publication_year bigint, "
                                       "referenced_works array<string>")


def test_in_decade_references(spark):
    got = {r.oa_id: r.in_decade_references
           for r in dec.in_decade_references(_works(spark)).collect()}
    assert got == {"A": ["B", "B", "A"], "B": ["A"], "C": [], "D": [], "E": []}


def test_decade_scan_properties(spark):
    works = dec.with_in_decade_references(_works(spark))
    rows = dec.fetch_per_decade_data(works, 1970, ["publication_year", "referenced_works"]).collect()
    ids = {r.oa_id for r in rows}
    assert ids == {"A", "B"}
    for r in rows:
        assert set(r.in_decade_references) <= ids
        assert set(r.referenced_works) & ids <= set(r.in_decade_references)
        assert 1970 <= r.publication_year <= 1979
    with pytest.raises(ValueError):
        dec.fetch_per_decade_data(works, 1975)


def test_bins_reject_overlap(spark):
    with pytest.raises(ValueError):
        dec.bins_table(spark, [[1920, 1930], [1930]])


def test_histogram(spark):
    w = _works(spark).withColumn("layer", F.lit(0))
    got = {r.decade: (r.n_works, r.decade_label) for r in dec.works_per_decade(w).collect()}
    assert got == {1970: (2, "1970-1979"), 1960: (1, "1960-1969"), 1910: (1, "1910-1919")}
    assert dec.missing_year_report(w).first().asDict() == {"n_total": 5, "n_missing_year": 1}
