import os
import tempfile

import pytest
from pyspark.sql import functions as F

from citeweave.sinks import tables as sk
from citeweave.sources import files as fs


def test_keyed_table_with_array_and_json(spark):
    sk.drop_table(spark, "stock")
    sk.create_table(spark, "stock", {"shelf": "INT", "code": "TEXT", "tags": "TEXT[]", "extra": "JSONB"},
                    pk=["shelf", "code"])
    assert sk.table_ddl(spark, "stock").splitlines()[-2:] == ["  PRIMARY KEY (shelf, code)", ")"]
    nullable = {r.column_name: r.is_nullable for r in sk.describe_table(spark, "stock").collect()}
    assert nullable == {"shelf": False, "code": False, "tags": True, "extra": True}
    schema = "shelf int, code string, tags array<string>, extra int"
    sk.upload(spark, "stock", spark.createDataFrame([(7, "nut", ["m4"], 5), (7, "bolt", None, None)], schema))
    sk.upload(spark, "stock", spark.sql("SELECT 8 AS shelf, 'cog' AS code, named_struct('a', 1) AS extra"))
    rows = {(r.shelf, r.code): (r.tags, r.extra) for r in spark.table("stock").collect()}
    assert rows == {(7, "nut"): (["m4"], '{"value":5}'), (7, "bolt"): ([], None), (8, "cog"): ([], '{"a":1}')}
    for bad in ([(7, "nut", [], 1)], [(9, "a", [], 1), (9, "a", [], 2)], [(None, "b", [], 1)]):
        with pytest.raises(ValueError):
            sk.upload(spark, "stock", spark.createDataFrame(bad, schema))
    batch = spark.createDataFrame([(7, "nut", 0), (9, "pin", 2), (9, "pin", 1)], "shelf int, code string, ord int")
    sk.upload_new_only(spark, "stock", batch, ["ord"])
    assert spark.table("stock").count() == 4
    spark.range(1).createOrReplaceTempView("passing")
    assert "stock" in sk.list_tables(spark) and "passing" not in sk.list_tables(spark)
    sk.drop_table(spark, "stock")
    assert "stock" not in sk.list_tables(spark)


def test_declared_key(spark):
    sk.drop_table(spark, "t_serial")
    sk.create_table(spark, "t_serial", {"id": "SERIAL PRIMARY KEY", "name": "TEXT"})
    assert sk.primary_key(spark, "t_serial") == ["id"]
    sk.drop_table(spark, "t_serial")


def test_csv_round_trip_cells(spark):
    rows = [("a", 'say "hi"', ["x", "y"]), ("b", "two\nlines \\ back", None),
            ("c", "", []), ("d", None, ["z"])]
    df = spark.createDataFrame(rows, "id string, txt string, refs array<string>")
    path = os.path.join(tempfile.mkdtemp(prefix="cw-csv-"), "t.csv.gz")
    sk.export_csv(df, path)
    back = {r.id: r for r in fs.load_csv(spark, path, df.schema).collect()}
    assert back["a"].txt == 'say "hi"' and back["a"].refs == ["x", "y"]
    assert back["b"].txt == "two\nlines \\ back" and back["b"].refs == []
    assert back["c"].txt is None and back["d"].txt is None


def test_csv_header_contract(spark):
    folder = tempfile.mkdtemp(prefix="cw-csv-")
    schema = spark.createDataFrame([], "code string, amount long").schema

    def load(name, text, **options):
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
        return fs.load_csv(spark, os.path.join(folder, name), schema, **options)
    with pytest.raises(ValueError, match="unknown"):
        load("headerless.csv", "k1,5\nk2,6\n")
    with pytest.raises(ValueError, match="missing"):
        load("short.csv", "code\nk1\n")
    assert [tuple(r) for r in load("short.csv", "code\nk1\n", may_be_absent=("amount",)).collect()] == [("k1", None)]


def test_report_round_trip(spark):
    clusters = spark.createDataFrame([(1950, 0, 6), (1950, 1, 7)],
                                     "bin bigint, cluster bigint, elements bigint")
    dist = spark.createDataFrame([(1950, 0, "field", "Physics", 3, 0.5),
                                  (1950, 0, "field", "Math", 3, 0.5)],
                                 "bin bigint, cluster bigint, kind string, value string, "
                                 "n bigint, share double")
    links = spark.createDataFrame([(1950, 0, 1950, 1, 2, 0.047619048)],
                                  "bin bigint, cluster bigint, dst_bin bigint, dst_cluster bigint, "
                                  "links bigint, weight double")
    share = spark.createDataFrame([(1950, 0, 1, 4, 0.25), (1950, 1, 0, 0, 0.0)],
                                  "bin bigint, cluster bigint, intra_citations bigint, "
                                  "total_citations bigint, intracluster_link_ratio double")
    path = tempfile.mkdtemp(prefix="cw-rep-")
    sk.write_cluster_report(sk.cluster_report_json(clusters, dist, links, share), path + "/doc")
    back = {(r.bin, r.cluster): r for r in fs.read_cluster_report(spark, path + "/doc").collect()}
    assert back[(1950, 0)].elements == 6
    assert back[(1950, 0)].field_distribution == {"Physics": 0.5, "Math": 0.5}
    assert back[(1950, 0)].intracluster_links == {"1950-1": 0.047619048}
    assert back[(1950, 1)].field_distribution == {} and back[(1950, 1)].intracluster_link_ratio == 0.0
    sk.cluster_records(clusters, dist, links, share).write.mode("overwrite").text(path + "/lines")
    lines = {(r.bin, r.cluster): r for r in fs.read_cluster_records(spark, path + "/lines").collect()}
    assert lines[(1950, 1)].elements == 7


def test_network_round_trip(spark):
    nodes = spark.createDataFrame([(1950, "A", "t", "f", "d", 0), (1950, "B", "", "", "", -1)],
                                  "bin bigint, id string, topic string, field string, "
                                  "domain string, cluster bigint")
    edges = spark.createDataFrame([(1950, "A", "B"), (1950, "A", "B"), (1950, "B", "C")],
                                  "bin bigint, src string, dst string")
    path = tempfile.mkdtemp(prefix="cw-net-")
    sk.write_network(nodes, edges, path)
    n, e = fs.read_network(spark, path)
    got = {r.id: r.cluster for r in n.collect()}
    assert got == {"A": 0, "B": -1, "C": None}       # endpoint C gets no attributes
    assert sorted((r.src, r.dst) for r in e.collect()) == [("A", "B"), ("B", "C")]


def test_corpus_round_trip(spark):
    from citeweave.operators.phrases import read_corpus, write_corpus
    corpus = spark.createDataFrame([("a", ["x", "y_z"]), ("b", []), ("c", ["w"])],
                                   "oa_id string, tokens array<string>")
    path = tempfile.mkdtemp(prefix="cw-corpus-") + "/c"
    write_corpus(corpus, path)
    assert sorted(r.tokens for r in read_corpus(spark, path).collect()) == [["w"], ["x", "y_z"]]


def test_serial_numbers_and_defaults(spark):
    """Left-out columns: gapless numbers over two inserts, DEFAULTs; the printed table shows both."""
    sk.drop_table(spark, "t_numbered")
    sk.create_table(spark, "t_numbered", {"id": "SERIAL PRIMARY KEY", "name": "TEXT", "state": "TEXT DEFAULT 'it''s new'",
                                          "tries": "INT NOT NULL DEFAULT 0", "extra": "JSONB DEFAULT '{}'::jsonb"})
    sk.insert_rows(spark, "t_numbered", [{"name": n} for n in "abcde"])
    sk.insert_rows(spark, "t_numbered", [{"name": "f", "tries": 4, "state": None}, {"name": "g", "tries": 5, "state": "x"}])
    rows = sorted(spark.table("t_numbered").collect())
    assert [(r.id, r.name) for r in rows] == list(zip(range(1, 8), "abcdefg"))
    assert [(r.state, r.tries, r.extra) for r in rows[4:]] == [("it's new", 0, "{}"), (None, 4, "{}"), ("x", 5, "{}")]
    sk.upload(spark, "t_numbered", spark.range(1000).selectExpr("CAST(id AS STRING) AS name"))
    ids = [r.id for r in spark.table("t_numbered").select("id").collect()]
    assert sorted(ids) == list(range(1, 1008))
    text = sk.table_ddl(spark, "t_numbered")
    assert "id serial NOT NULL" in text and "state text DEFAULT 'it''s new'" in text.replace("TEXT", "text")
    assert "extra jsonb DEFAULT '{}'" in text and "DEFAULT 0" in text
    sk.drop_table(spark, "t_numbered")
