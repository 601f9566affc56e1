import random

from pyspark.sql import functions as F

from citeweave.functions import normalize as nz
from citeweave.functions import text as tx


def rebuild_rule(inv):
    """The abstract rule stated plainly: slots 0..max, later words win a slot,
    empty slots stay empty, ends stripped, empty -> None."""
    if not inv:
        return None
    positions = [p for ps in inv.values() for p in ps]
    if not positions:
        return None
    words = [""] * (max(positions) + 1)
    for w, ps in inv.items():
        for p in ps:
            words[p] = w
    return " ".join(words).strip() or None


def test_inverted_index_gap(spark):
    df = spark.createDataFrame([({"b": [1], "a": [0, 4], "c": [3]},)],
                               "inv map<string,array<int>>")
    got = df.select(nz.abstract_from_inverted_index("inv").alias("a")).first()["a"]
    assert got == "a b  c a"


def test_inverted_index_random(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(150):
        inv = {}
        for _ in range(rng.randint(0, 6)):
            inv[rng.choice(["x", "y", "z", "w", " ", "q"]) + str(rng.randint(0, 3))] = \
                [rng.randint(0, 12) for _ in range(rng.randint(0, 3))]
        rows.append((inv,))
    # build maps from ordered entries: a Python dict handed to createDataFrame
    # does not keep its insertion order, a map built by Spark does
    df = spark.createDataFrame([(i, list(r[0].items())) for i, r in enumerate(rows)],
                               "i int, e array<struct<k:string,v:array<int>>>")
    df = df.select("i", F.map_from_entries("e").alias("inv")).orderBy("i")
    got = [r["a"] for r in df.select(nz.abstract_from_inverted_index("inv").alias("a")).collect()]
    assert got == [rebuild_rule(r[0]) for r in rows]


def test_scalars(spark):
    df = spark.createDataFrame(
        [("https://works.example.org/W12", "  HTTPS://DOI.ORG/10.1/X  ", "  Hello \n  World  "),
         ("W5", "   ", "   "), (None, None, ""), ("a/b/", "x", None)],
        "id string, doi string, title string")
    got = df.select(nz.oa_id("id").alias("i"), nz.normalize_doi("doi").alias("d"),
                    nz.normalize_title("title").alias("t")).collect()
    assert [tuple(r) for r in got] == [
        ("W12", "https://doi.org/10.1/x", "hello world"),
        ("W5", None, ""),
        ("", None, None),
        ("", "x", None),
    ]


def test_references_and_topic(spark):
    df = spark.createDataFrame(
        [(["https://works.example.org/W1", "", None, "W2"], None),
         (None, {"display_name": "T", "domain": None, "field": {"display_name": "F"},
                 "subfield": None})],
        "refs array<string>, pt struct<display_name:string,domain:struct<display_name:string>,"
        "field:struct<display_name:string>,subfield:struct<display_name:string>>")
    got = df.select(nz.normalize_references("refs").alias("r"), *nz.topic_fields("pt")).collect()
    assert got[0]["r"] == ["W1", "W2"] and got[0]["topic"] is None
    assert got[1]["r"] == [] and got[1]["field"] == "F" and got[1]["domain"] is None


def test_clean_text(spark):
    df = spark.createDataFrame([("ﬁne $x^2$ \\alpha{b} a≤b -- x__y Ünïcode!​  end",)], "t string")
    got = df.select(tx.clean_text(F.lower("t")).alias("c")).first()["c"]
    assert got == "fine a b x y ünïcode end"


def test_merge_text(spark):
    df = spark.createDataFrame([("t", "a"), (None, "a"), ("t", None), (None, None)],
                               "title string, abstract string")
    got = [r[0] for r in df.select(tx.merge_title_abstract()).collect()]
    assert got == ["t\na", "a", "t", None]


def test_raw_records_shuffle_texts_not_words(spark):
    """The inverted index of each text, of both texts of a repeated id, and none of null ones."""
    from citeweave.sources.tables import raw_works_from_documents
    rows = [(1, "b a  b", "en", "s", 6), (2, None, "en", "s", 0), (3, "", "en", "s", 0),
            (4, "x y", "en", "s", 3), (4, "y z", "en", "s", 3), (None, "q", "en", "s", 1)]
    raw = raw_works_from_documents(spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"))
    got = sorted((r[0] or "", {k: sorted(v) for k, v in r[1].items()} if r[1] is not None else None)
                 for r in raw.select("id", "abstract_inverted_index").collect())
    url = "https://works.example.org/W"
    both = {"x": [0], "y": [0, 1], "z": [1]}
    assert got == [("", None), (f"{url}1", {"b": [0, 3], "a": [1], "": [2]}), (f"{url}2", None),
                   (f"{url}3", {"": [0]}), (f"{url}4", both), (f"{url}4", both)]
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "Generate" not in plan and "word#" not in "".join(
        line for line in plan.splitlines() if "hashpartitioning" in line)
