import random

from pyspark.sql import functions as F

from citeweave.operators.dedupe import greedy_dedupe


def sequential_rule(rows):
    """The dedupe rule as stated: reject a work whose DOI, id or title equals
    that of an already kept work; empty/NULL keys never match."""
    seen = {"doi": set(), "id": set(), "title": set()}
    kept = []
    for r in rows:
        ks = {"doi": r["doi"], "id": r["oa_id"], "title": r["title"]}
        if any(v and v in seen[k] for k, v in ks.items()):
            continue
        for k, v in ks.items():
            if v:
                seen[k].add(v)
        kept.append(r["oa_id"] or f"#{r['seq']}")
    return kept


def test_hand_made_chain(spark):
    rows = [(1, "A", "1", "x"), (2, "B", "2", "x"), (3, "C", "2", "z"),
            (4, "D", None, None), (5, "E", "", "  "), (6, "F", "", "  ")]
    df = spark.createDataFrame(rows, "seq long, oa_id string, doi string, title string")
    kept = sorted(r.oa_id for r in greedy_dedupe(df, ["seq"]).collect())
    # B loses to A on the title, so its DOI blocks nothing and C is kept;
    # empty DOIs and blank titles never match
    assert kept == ["A", "C", "D", "E", "F"]


def test_matches_sequential_rule_random(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        rows.append({
            "seq": i,
            "oa_id": rng.choice([f"W{rng.randint(0, 500)}", "", None]) if rng.random() < 0.3
            else f"W{i + 1000}",
            "doi": rng.choice([None, "", f"10.1/{rng.randint(0, 120)}"]),
            "title": rng.choice([None, "", f"t{rng.randint(0, 150)}"]),
        })
    df = spark.createDataFrame(rows, "seq long, oa_id string, doi string, title string")
    got = sorted((r.oa_id or f"#{r.seq}") for r in greedy_dedupe(df, ["seq"]).collect())
    assert got == sorted(sequential_rule(sorted(rows, key=lambda r: r["seq"])))


def test_blocked_keys(spark):
    df = spark.createDataFrame([(1, "A", "d1", "x"), (2, "B", "d2", "y")],
                               "seq long, oa_id string, doi string, title string")
    blocked = spark.createDataFrame([("doi", "d1")], "kind string, value string")
    kept = [r.oa_id for r in greedy_dedupe(df, ["seq"], blocked_keys=blocked).collect()]
    assert kept == ["B"]
