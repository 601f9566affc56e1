import os
import tempfile

from pyspark.sql import functions as F

from citeweave.operators import merge as mg
from citeweave.operators.dedupe import drop_repeated_ids
from citeweave.sinks import tables as sk


def test_export_all_describe_and_column_insert(spark):
    sk.drop_table(spark, "t_misc")
    sk.create_table(spark, "t_misc", {"id": "TEXT", "refs": "TEXT[]", "n": "BIGINT"})
    sk.upload(spark, "t_misc", spark.createDataFrame([("a", "x", 1)], "id string, refs string, n long"))
    row = spark.table("t_misc").first()
    assert row.refs == ["x"]                                  # K4: scalar -> one-element array
    desc = {r.column_name: r.data_type for r in sk.describe_table(spark, "t_misc").collect()}
    assert desc == {"id": "string", "refs": "array<string>", "n": "bigint"}
    out = tempfile.mkdtemp(prefix="cw-exp-")
    sk.export_all(spark, out)
    assert os.path.isdir(os.path.join(out, "t_misc.csv.gz"))
    ddl = "".join(r.value + "\n" for r in spark.read.text(os.path.join(out, "schema.sql")).collect())
    assert "CREATE TABLE t_misc (" in ddl and "refs text[]" in ddl
    df = spark.table("t_misc")
    moved = sk.insert_column_after(df, "sub", "id", F.lit("s"))
    assert moved.columns == ["id", "sub", "refs", "n"]
    assert sk.insert_column_after(moved, "sub", "id", F.lit("t")).columns == moved.columns
    sk.drop_table(spark, "t_misc")


def test_small_helpers(spark):
    df = spark.createDataFrame([("W1", 1), ("W1", 1), ("W2", 2)], "oa_id string, v int")
    assert drop_repeated_ids(df).count() == 2                                   # D2
    assert mg.add_column_if_absent(df, "v", F.lit(0)).columns == ["oa_id", "v"]  # P14
    assert mg.add_column_if_absent(df, "w", F.lit(0)).columns == ["oa_id", "v", "w"]
    seen = spark.createDataFrame([("W1",)], "oa_id string")
    new = mg.exclude_seen(df, seen)                                             # U2
    assert sorted(r.oa_id for r in new.collect()) == ["W2"]
    assert sorted(r.oa_id for r in mg.accumulate_seen(seen, new).collect()) == ["W1", "W2"]
    assert df.orderBy("oa_id").limit(1).count() == 1                            # T2
    ok = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    bad = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "id string, v int")
    sk.assert_unique(ok, ["id"])
    try:
        sk.assert_unique(bad, ["id"])
        raise AssertionError("duplicate keys not detected")
    except ValueError:
        pass
