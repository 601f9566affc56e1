"""Driver tables and the stand-in corpus built from them.

The driver ships TPC-H-like tables plus ``documents``; none of them holds
citations.  These helpers only shape rows into the schemas the operators
expect (``WORK``, ``RAW_WORK``, a given cluster membership).  They do none
of the operators' work: no in-decade references, no normalisation, no
dedupe, no clustering happens here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  A scan that yields fewer partitions than the
    cluster's parallelism (a small file of one row group) is spread
    round-robin so per-row work uses every core; large inputs already split
    into many partitions and are left alone."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    target = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        df = df.repartition(target)
    return df


def _reference_ids(doc_id: Column) -> Column:
    """Cited document ids of the stand-in corpus (negative ones dropped)."""
    cands = F.array(doc_id - 1, doc_id - 2,
                    F.when(doc_id % 7 == 0, doc_id - 105),
                    doc_id - 37, doc_id + 10000000)
    return F.filter(cands, lambda x: x >= 0)


def _doi(d: Column, source: Column, n_chars: Column) -> Column:
    return F.when(d % 10 == 3, F.lit(None)).otherwise(
        F.concat(F.lit("10.1000/"), F.lower(source), F.lit("."), (n_chars % 997).cast("string")))


def works_from_documents(documents: DataFrame) -> DataFrame:
    """``documents`` shaped as the ``WORK`` table (without in-decade refs)."""
    d = F.col("doc_id")
    return documents.select(
        F.concat(F.lit("W"), d.cast("string")).alias("oa_id"),
        _doi(d, F.col("source"), F.col("n_chars")).alias("doi"),
        F.substring_index("text", "\n", 1).alias("title"),
        (F.lit(1920) + d % 105).cast("bigint").alias("publication_year"),
        (F.col("n_chars") % 200).cast("bigint").alias("cited_by_count"),
        F.col("text").alias("abstract"),
        F.transform(_reference_ids(d), lambda x: F.concat(F.lit("W"), x.cast("string")))
         .alias("referenced_works"),
        F.col("lang").alias("domain"),
        F.col("source").alias("field"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("subfield"),
        F.concat(F.col("source"), F.lit("-"), F.col("lang")).alias("topic"),
        (d % 3).cast("bigint").alias("layer"),
    )


def load_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works_from_documents(read_table(spark, sf_dir, "documents"))


def _spots(texts: str) -> Column:
    """(word, pos) of all words of ``texts``, in order."""
    words = F.transform(texts, lambda t: F.transform(
        F.split(t, " "), lambda w, i: F.struct(w.alias("word"), i.cast("int").alias("pos"))))
    return F.sort_array(F.flatten(words))


def _heads(spots: str) -> Column:
    """Where the spots of each word begin, and where the last word's end."""
    places = F.transform(spots, lambda s, i: F.struct(s["word"].alias("word"), i.alias("i")))
    before = F.concat(F.array(F.lit(None).cast("struct<word:string,i:int>")), places)
    firsts = F.filter(F.zip_with(places, before, lambda s, b: F.when(b.isNull() | (s["word"] != b["word"]), s["i"])),
                      lambda i: i.isNotNull())
    return F.concat(firsts, F.array(F.size(spots)))


def _index(spots: str, heads: str) -> Column:
    """The inverted index word -> positions."""
    entry = lambda at, end: F.struct(F.col(spots)[at]["word"].alias("word"), F.transform(
        F.slice(spots, at + 1, end - at), lambda s: s["pos"]).alias("positions"))
    ends = F.slice(heads, F.lit(2), F.size(heads) - 1)
    entries = F.zip_with(F.slice(heads, F.lit(1), F.size(heads) - 1), ends, entry)
    return F.map_from_entries(entries)


def raw_works_from_documents(documents: DataFrame) -> DataFrame:
    """``documents`` shaped as raw API records (``RAW_WORK``).

    Ids and references are full URLs, DOIs carry a resolver prefix, odd
    case and padding, the abstract is given as an inverted index word ->
    positions over the whole text split on single spaces.
    """
    d = F.col("doc_id")
    # whole texts are shuffled, not their words; a repeated id has several texts
    words = (documents.where("doc_id IS NOT NULL AND text IS NOT NULL")
             .groupBy("doc_id").agg(F.collect_list("text").alias("_texts"))
             .withColumn("_spots", _spots("_texts")).withColumn("_heads", _heads("_spots"))
             .select("doc_id", _index("_spots", "_heads").alias("abstract_inverted_index")))
    topic = F.struct(
        F.concat(F.col("source"), F.lit("-"), F.col("lang")).alias("display_name"),
        F.struct(F.col("lang").alias("display_name")).alias("domain"),
        F.struct(F.col("source").alias("display_name")).alias("field"),
        F.struct(F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("display_name"))
         .alias("subfield"),
    )
    base = documents.select(
        "doc_id",
        F.concat(F.lit("https://works.example.org/W"), d.cast("string")).alias("id"),
        F.when(d % 10 == 3, F.lit(None))
         .when(d % 10 == 7, F.lit("   "))
         .otherwise(F.concat(F.lit("  HTTPS://DOI.ORG/10.1000/"), F.upper("source"), F.lit("."),
                             (F.col("n_chars") % 997).cast("string"), F.lit(" ")))
         .alias("doi"),
        F.when(d % 13 == 0, F.lit(None)).otherwise(F.substring_index("text", "\n", 1)).alias("title"),
        (F.lit(1920) + d % 105).cast("bigint").alias("publication_year"),
        (F.col("n_chars") % 200).cast("bigint").alias("cited_by_count"),
        F.concat(
            F.transform(_reference_ids(d),
                        lambda x: F.concat(F.lit("https://works.example.org/W"), x.cast("string"))),
            F.when(d % 11 == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
        ).alias("referenced_works"),
        F.when(d % 17 == 0, F.lit(None)).otherwise(topic).alias("primary_topic"),
    )
    return (base.join(words, "doc_id", "left")
            .select("id", "doi", "title", "publication_year", "cited_by_count",
                    "abstract_inverted_index", "referenced_works", "primary_topic"))


def planted_membership(works: DataFrame, bins: list[list[int]]) -> DataFrame:
    """A given cluster membership (bin, oa_id, cluster) for the stand-in corpus.

    Works are grouped by the block of 105 consecutive document ids they fall
    in and by their decade; the cluster id combines both.  It stands in for a
    community detection result so every cluster analytic has an oracle.
    """
    from citeweave.operators.decades import bins_table, decade_col
    b = bins_table(works.sparkSession, bins)
    doc = F.expr("substring(oa_id, 2)").cast("bigint")
    w = works.select("oa_id", decade_col("publication_year").alias("decade"), doc.alias("doc"))
    return (w.join(F.broadcast(b), "decade")
            .select("bin", "oa_id",
                    (F.floor(F.col("doc") / 105) * 10 + (F.col("decade") - F.col("bin")) / 10)
                    .cast("bigint").alias("cluster")))
