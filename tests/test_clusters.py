from citeweave.operators import clusters as cl
from citeweave.operators import evolution as ev


def _setup(spark):
    works = spark.createDataFrame([
        # cluster 0: 6 works, fields tied Physics / Math
        ("a1", "Physics", "Sci", "t1", ["a2", "b1", "x9"]),
        ("a2", "Physics", "Sci", "t1", ["a1"]),
        ("a3", "Physics", None, "t2", []),
        ("a4", "Math", "Sci", None, ["b2"]),
        ("a5", "Math", "Sci", "t2", []),
        ("a6", "Math", "Sci", "t2", []),
        # cluster 1: 6 works, every field NULL
        ("b1", None, None, None, ["a1"]), ("b2", None, None, None, []),
        ("b3", None, None, None, []), ("b4", None, None, None, []),
        ("b5", None, None, None, []), ("b6", None, None, None, []),
        # cluster 2: exactly 5 works -> dropped by the > 5 cutoff
        ("c1", "Bio", "Life", "t3", ["a1"]), ("c2", "Bio", "Life", "t3", []),
        ("c3", "Bio", "Life", "t3", []), ("c4", "Bio", "Life", "t3", []),
        ("c5", "Bio", "Life", "t3", []),
    ], "oa_id string, field string, domain string, topic string, referenced_works array<string>")
    member = spark.createDataFrame(
        [(1950, r.oa_id, {"a": 0, "b": 1, "c": 2}[r.oa_id[0]]) for r in works.collect()],
        "bin long, oa_id string, cluster long")
    return works, member


def test_report_tables(spark):
    works, member = _setup(spark)
    rep = cl.cluster_report(works, member, top_n=10, cutoff=5)
    assert sorted((r.cluster, r.elements) for r in rep["clusters"].collect()) == [(0, 6), (1, 6)]
    dist = {(r.cluster, r.kind, r.value): r.share for r in rep["distributions"].collect()}
    assert dist[(0, "field", "Physics")] == 0.5 and dist[(0, "field", "Math")] == 0.5
    assert dist[(0, "domain", "Sci")] == 1.0          # NULL left out of the denominator
    assert not [k for k in dist if k[0] == 1]          # all-NULL cluster: empty distributions
    dom = {r.cluster: r.dominant_field for r in rep["dominant_field"].collect()}
    assert dom == {0: "Math"}                           # tie broken by value
    links = {(r.cluster, r.dst_cluster): (r.links, r.weight) for r in rep["links"].collect()}
    assert links == {(0, 1): (2, round(2 / 36, 9)), (1, 0): (1, round(1 / 36, 9))}
    share = {r.cluster: (r.intra_citations, r.total_citations, r.intracluster_link_ratio)
             for r in rep["self_share"].collect()}
    assert share[0] == (2, 5, 0.4) and share[1] == (0, 1, 0.0)
    ranks = ev.field_ranks(rep["distributions"])
    lay = {r.cluster: (r.y, r.grey) for r in ev.layout(rep["clusters"], rep["dominant_field"],
                                                         ranks).collect()}
    assert lay == {0: (0.0, False), 1: (1.4, True)}
