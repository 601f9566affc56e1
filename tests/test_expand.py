from pyspark.sql import functions as F

from citeweave.operators import expand as ex
from citeweave.sources.tables import load_works

from .conftest import SF_SMALL


def test_seed_and_hops(spark):
    works = load_works(spark, SF_SMALL).drop("layer")
    seeds = ex.build_seed(works, "the", 20, 1930)
    seed_rows = seeds.collect()
    assert seed_rows and all(r.cited_by_count > 20 and r.publication_year > 1930 for r in seed_rows)
    assert all("the" in ((r.title or "") + " " + (r.abstract or "")).lower() for r in seed_rows)
    out = ex.expand(seeds, works, hops=2, min_citations=10, year_gt=1925)
    rows = out.collect()
    by_layer = {}
    for r in rows:
        by_layer.setdefault(r.layer, []).append(r)
    # every kept work once; seeds are layer 0
    assert len({r.oa_id for r in rows}) == len(rows)
    assert len(by_layer[0]) == len(seed_rows)
    # later layers pass the thresholds and cite the previous layer
    for layer in (1, 2):
        for r in by_layer.get(layer, []):
            assert r.cited_by_count > 10 and r.publication_year > 1925
    assert ex.layers_consistent(out).count() == 0
    # one hop is a prefix of two hops
    one = {r.oa_id for r in ex.expand(seeds, works, hops=1, min_citations=10, year_gt=1925)
           .collect()}
    assert one == {r.oa_id for r in rows if r.layer <= 1}


def test_both_directions_links_to_seeds(spark):
    works = load_works(spark, SF_SMALL).drop("layer")
    seeds = ex.build_seed(works, "the", 20, 1930)
    seed_rows = {r.oa_id: set(r.referenced_works) for r in seeds.collect()}
    both = ex.expand(seeds, works, hops=1, direction="both").where("layer = 1").collect()
    assert both
    for r in both:
        cites_seed = bool(set(r.referenced_works) & set(seed_rows))
        cited_by_seed = any(r.oa_id in refs for refs in seed_rows.values())
        assert cites_seed or cited_by_seed
