from citeweave.plans.report import cluster_report_by_bins

#: two groups of works that cite each other, one work of the second citing into the first, one outside
CITES = {"p1": ["p2", "p3", "p4"], "p2": ["p1", "p3", "p4"], "p3": ["p1", "p2", "p4"], "p4": ["p1", "p2", "p3"],
         "q1": ["q2", "q3"], "q2": ["q1", "q3"], "q3": ["q1", "q2", "p1", "gone"]}
FIELD = {"p": "Physics", "q": "Law"}


def test_report_job_end_to_end(spark):
    rows = [(n, 1960, refs, FIELD[n[0]], "Any", f"topic {n}") for n, refs in CITES.items()]
    works = spark.createDataFrame(rows, "oa_id string, publication_year long, "
                                        "referenced_works array<string>, field string, "
                                        "domain string, topic string")
    rep = cluster_report_by_bins(works, bins=[[1960]], method="leiden", cutoff=1, top_n=5,
                                 network=True)
    size = {g: sum(n[0] == g for n in CITES) for g in "pq"}
    assert sorted((r.cluster, r.elements) for r in rep["clusters"].collect()) == [(0, size["p"]), (1, size["q"])]
    assert sorted(r.dominant_field for r in rep["dominant_field"].collect()) == sorted(FIELD.values())
    inside = {g: [r[0] == g for n, refs in CITES.items() if n[0] == g for r in refs] for g in "pq"}
    share = {r.cluster: r.intracluster_link_ratio for r in rep["self_share"].collect()}
    assert share == {i: round(sum(inside[g]) / len(inside[g]), 9) for i, g in enumerate("pq")}
    assert rep["layout"].count() == 2
    known = sum(r in CITES for refs in CITES.values() for r in refs)
    assert rep["network_nodes"].count() == len(CITES) and rep["network_edges"].count() == known
