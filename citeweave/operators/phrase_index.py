"""Phrase search by posting lists of character trigrams.

``write_index`` keeps, for works in any number,

* ``postings`` (gram, oa_id, field): the distinct trigrams of every lower-cased title
  (field 0) and abstract (field 1), in ``parts`` folders by the gram's hash;
* ``grams`` (gram, n): the length of every list;
* ``texts`` (oa_id, field, body): the texts themselves, in ``parts`` folders by the id's hash.

``search`` looks up the trigrams of each phrase, drops a phrase of which one is in no
text, intersects the ``RAREST`` shortest lists and checks containment on the
texts of what is left.  Folders without a wanted gram or candidate are not read.

Texts are followed by two end marks, so a phrase of one or two characters is in a text
exactly when a trigram of it begins with the phrase.  Null texts have no trigrams;
null and empty phrases find nothing; phrases are compared lower-cased, repeated ones
count once.  A work matches once, whichever of its texts does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.session import cut_lineage, ship_package

GRAM = 3
RAREST = 4
PARTS = 64
ROWS = 1 << 18  # entries that a task builds at a time
END = "\u0000" * (GRAM - 1)


def _part(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int").alias("part")


def _grams(text: Column) -> Column:
    """The distinct trigrams of ``text`` (a phrase)."""
    at = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM))))


def _strings(codes: np.ndarray) -> pa.Array:
    """Strings of the rows of code points."""
    flat = codes.ravel()
    size = (1 + (flat > 0x7F) + (flat > 0x7FF) + (flat > 0xFFFF)).reshape(codes.shape).sum(axis=1)
    data = flat.astype("<u4").tobytes().decode("utf-32-le").encode()
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(ends), pa.py_buffer(data))


def _postings(batches):
    """(oa_id, field, grams): the distinct trigrams of the texts of each row, end marks added.

    A trigram is one number of three code points, so a text's are sorted at once; in
    SQL the n-th character of a string is only found by counting from its start."""
    for batch in batches:
        found, size, first = [], 0, 0
        for at, bodies in enumerate(batch.column("bodies")):
            grams = []
            for body in bodies.as_py():
                c = np.frombuffer((body + END).encode("utf-32-le"), "<u4").astype(np.int64)
                grams.append((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])
            found.append(np.unique(np.concatenate(grams)))
            size += len(found[-1])
            if size > ROWS or at + 1 == batch.num_rows:
                every = np.concatenate(found)
                codes = np.stack([every >> 42, (every >> 21) & 0x1FFFFF, every & 0x1FFFFF], axis=1)
                ends = np.concatenate([[0], np.cumsum([len(g) for g in found])]).astype(np.int32)
                part = batch.slice(first, len(found))
                yield pa.RecordBatch.from_arrays(
                    [part.column("oa_id"), part.column("field"), pa.ListArray.from_arrays(pa.array(ends), _strings(codes))],
                    names=["oa_id", "field", "grams"])
                found, size, first = [], 0, at + 1


def write_index(works: DataFrame, path: str, parts: int = PARTS, title: str = "title",
                abstract: str = "abstract") -> None:
    """Writes the index of ``works`` (oa_id, title, abstract) to ``path``."""
    body = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.lower(F.col(c)).alias("body"))
                               for i, c in enumerate((title, abstract))])).alias("t")
    texts = works.select("oa_id", body).select("oa_id", "t.field", "t.body").where("body IS NOT NULL")
    (texts.withColumn("part", _part("oa_id", parts)).repartition("part")
     .write.mode("overwrite").partitionBy("part").parquet(f"{path}/texts"))
    ship_package(works.sparkSession)
    # the texts of a repeated id meet, so that no entry is written twice
    bodies = (works.sparkSession.read.parquet(f"{path}/texts").groupBy("oa_id", "field")
              .agg(F.collect_list("body").alias("bodies")))
    kind = works.schema["oa_id"].dataType.simpleString()
    postings = (bodies.mapInArrow(_postings, f"oa_id {kind}, field int, grams array<string>")
                .select("oa_id", "field", F.explode("grams").alias("gram")))
    # a list of many entries may take several files of its folder
    (postings.withColumn("part", _part("gram", parts)).repartition("part", F.pmod(F.xxhash64("oa_id"), F.lit(8)))
     .sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings"))
    stored = works.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/grams")


def candidates(spark: SparkSession, path: str, phrases: DataFrame, parts: int = PARTS) -> DataFrame:
    """(phrase, oa_id, field): texts that hold the rarest trigrams of a phrase."""
    grams, postings = (spark.read.parquet(f"{path}/{t}") for t in ("grams", "postings"))
    wanted = phrases.select(F.lower("phrase").alias("phrase")).where("phrase IS NOT NULL").distinct()
    long = wanted.where(F.length("phrase") >= GRAM)
    asked = long.select("phrase", F.explode(_grams(F.col("phrase"))).alias("gram"))
    order = Window.partitionBy("phrase").orderBy("n", "gram")       # a phrase's own trigrams
    # written first, so that a short table of wanted lists is known as such and picks the
    # folders and rows of ``postings``, which are then not shuffled
    rare = cut_lineage(asked.join(grams, "gram", "left").withColumn("i", F.row_number().over(order))
            .withColumn("missing", F.max(F.col("n").isNull()).over(Window.partitionBy("phrase")))
            .where(~F.col("missing") & (F.col("i") <= RAREST))
            .withColumn("part", _part("gram", parts)).select("phrase", "gram", "part"))
    used = rare.groupBy("phrase").agg(F.count("*").alias("used"))
    met = (postings.join(rare, ["part", "gram"]).groupBy("phrase", "oa_id", "field").agg(F.count("*").alias("c"))
           .join(used, "phrase").where("c = used").select("phrase", "oa_id", "field"))
    # phrases below a trigram's length: the lists of the trigrams they begin
    short = wanted.where((F.length("phrase") > 0) & (F.length("phrase") < GRAM))
    heads = F.explode(F.array(*[F.substring("gram", 1, k) for k in range(1, GRAM)])).alias("phrase")
    begun = cut_lineage(grams.select("gram", heads).distinct().join(short, "phrase")
             .withColumn("part", _part("gram", parts)).select("phrase", "gram", "part"))
    return met.unionByName(postings.join(begun, ["part", "gram"]).select("phrase", "oa_id", "field").distinct())


def search(spark: SparkSession, path: str, phrases: DataFrame, parts: int = PARTS) -> DataFrame:
    """(phrase, oa_id): the works of the index at ``path`` whose title or abstract holds
    a phrase of ``phrases`` (phrase)."""
    texts = spark.read.parquet(f"{path}/texts")
    found = cut_lineage(candidates(spark, path, phrases, parts).withColumn("part", _part("oa_id", parts)))
    held = (texts.join(found, ["part", "oa_id", "field"]).where(F.instr("body", F.col("phrase")) > 0)
            .select("phrase", "oa_id"))
    return held.distinct()
