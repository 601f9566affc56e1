import json
import os
import tempfile

import pytest

from citeweave.plans.report import evolution_from_report
from citeweave.sources.reports import read_report, report_tables

DOC = {"1950": {"0": {"elements": 9, "field_distribution": {"Art": 0.25, "Law": 0.75}, "extra": [1],
                      "intracluster_links": {"1960-2": 0.5, "1950-1": 0.125}, "intracluster_link_ratio": 0.5},
                "1": {"elements": 12, "field_distribution": {}}},
       "1960": {"2": {"elements": 7, "field_distribution": {"Art": 0.5, "Law": 0.5}, "topic_distribution": {"x y": 1}},
                "3": {}}}


@pytest.fixture
def saved():
    folder = tempfile.mkdtemp(prefix="cw-saved-")
    with open(os.path.join(folder, "report.json"), "w") as f:
        json.dump(DOC, f, indent=1)
    return folder


def test_tables_of_a_saved_report(spark, saved):
    t = report_tables(read_report(spark, saved))
    rows = {k: sorted(map(tuple, v.collect())) for k, v in t.items() if k != "clusters"}
    sizes = {(r.bin, r.cluster): r.elements for r in t["clusters"].collect()}
    assert sizes == {(1950, 0): 9, (1950, 1): 12, (1960, 2): 7, (1960, 3): None}
    assert rows["distributions"] == [(1950, 0, "field", "Art", 0.25), (1950, 0, "field", "Law", 0.75),
                                     (1960, 2, "field", "Art", 0.5), (1960, 2, "field", "Law", 0.5),
                                     (1960, 2, "topic", "x y", 1.0)]
    assert rows["links"] == [(1950, 0, 1950, 1, 0.125), (1950, 0, 1960, 2, 0.5)]
    assert {r.cluster: r.intracluster_link_ratio for r in t["self_share"].collect()}[0] == 0.5


def test_graph_from_a_saved_report(spark, saved):
    graph = evolution_from_report(spark, saved)
    place = {r.node_id: (r.dominant_field, r.sort_rank, r.y, r.grey) for r in graph["layout"].collect()}
    # Law (rank 1) leads; a cluster without fields ranks after all and is grey; a tie goes to the first name
    assert place["1950-0"] == ("Law", 1, 0.0, False) and place["1950-1"] == (None, 3, 1.4, True)
    assert place["1960-2"] == ("Art", 0, 0.0, False)
    edges = sorted((r.src, r.dst, r.weight, r.width) for r in graph["evolution_edges"].collect())
    assert edges == [("1950-0", "1950-1", 0.125, 12.5), ("1950-0", "1960-2", 0.5, 50.0)]


def test_empty_document(spark):
    folder = tempfile.mkdtemp(prefix="cw-saved-")
    with open(os.path.join(folder, "report.json"), "w") as f:
        f.write("{}")
    assert read_report(spark, folder).collect() == []
