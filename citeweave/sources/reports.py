"""Saved cluster reports as tables (S8), read with VARIANT.

A report is a JSON document ``{bin: {cluster: record}}`` per file: two levels of keys that no
schema can name, and records whose distributions have keys of their own.  The
document is parsed once into a VARIANT; every level of keys is exploded by
``variant_explode``, so no map type and no key list is needed, and records may miss
parts or hold further ones.

Rows: a record without a part has no rows of it; a null size is null; an empty
document or folder gives no rows; keys that are not numbers raise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("field", "domain", "topic")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(bin, cluster, record VARIANT): one row per cluster of the documents at ``path``."""
    docs = spark.read.text(path, wholetext=True).where("value <> ''")
    return spark.sql("""
        SELECT CAST(b.key AS BIGINT) AS bin, CAST(c.key AS BIGINT) AS cluster, c.value AS record
        FROM (SELECT parse_json(value) AS doc FROM {docs}),
             LATERAL variant_explode(doc) AS b, LATERAL variant_explode(b.value) AS c""", docs=docs)


def _part(records: DataFrame, name: str) -> DataFrame:
    """(bin, cluster, key, value): the entries of one part of every record."""
    return records.sparkSession.sql(f"""
        SELECT bin, cluster, e.key, CAST(e.value AS DOUBLE) AS value
        FROM {{records}}, LATERAL variant_explode(try_variant_get(record, '$.{name}', 'variant')) AS e""",
                                    records=records)


def report_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report: ``clusters``, ``distributions``, ``links``, ``self_share``,
    with the columns that ``cluster_report`` gives them."""
    clusters = records.select("bin", "cluster", F.try_variant_get("record", "$.elements", "bigint").alias("elements"))
    dist = None
    for kind in KINDS:
        rows = _part(records, f"{kind}_distribution").select(
            "bin", "cluster", F.lit(kind).alias("kind"), F.col("key").alias("value"), F.col("value").alias("share"))
        dist = rows if dist is None else dist.unionByName(rows)
    # a target is keyed "bin-cluster"
    target = lambda i: F.split("key", "-(?=[^-]*$)")[i].cast("bigint")
    links = _part(records, "intracluster_links").select(
        "bin", "cluster", target(0).alias("dst_bin"), target(1).alias("dst_cluster"), F.col("value").alias("weight"))
    share = records.select("bin", "cluster", F.try_variant_get("record", "$.intracluster_link_ratio", "double")
                           .alias("intracluster_link_ratio"))
    return {"clusters": clusters, "distributions": dist, "links": links, "self_share": share}
