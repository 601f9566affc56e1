import json
import os
import tempfile

from citeweave.streaming.ingest import ingest_raw_works


def _dump(path, records):
    with open(path, "w") as f:
        for r in records:
            f.write(json.dumps(r) + "\n")


def test_ingest_appends_new_ids_once(spark):
    src = tempfile.mkdtemp(prefix="cw-src-")
    out = os.path.join(tempfile.mkdtemp(prefix="cw-out-"), "works")
    ckpt = tempfile.mkdtemp(prefix="cw-ckpt-")
    _dump(os.path.join(src, "p1.json"), [
        {"id": "https://works.example.org/W1", "title": " A  Title ", "doi": " X ",
         "referenced_works": ["https://works.example.org/W2", ""],
         "abstract_inverted_index": {"hello": [0], "world": [1]}},
        {"id": "https://works.example.org/W2", "title": "B"},
        {"id": "https://works.example.org/W1", "title": "duplicate later in page"},
    ])
    ingest_raw_works(spark, src, out, ckpt).awaitTermination()
    _dump(os.path.join(src, "p2.json"), [
        {"id": "https://works.example.org/W2", "title": "again"},
        {"id": "https://works.example.org/W3", "title": "C"},
    ])
    ingest_raw_works(spark, src, out, ckpt).awaitTermination()
    rows = {r.oa_id: r for r in spark.read.parquet(out).collect()}
    assert sorted(rows) == ["W1", "W2", "W3"]
    assert rows["W1"].title == "a title" and rows["W1"].doi == "x"
    assert rows["W1"].abstract == "hello world" and rows["W1"].referenced_works == ["W2"]
    assert rows["W2"].title == "b"
