"""Incremental ingest of raw work records (S6 + F7 + K3 as a stream).

The reference pulls raw records page by page and appends them with ON
CONFLICT DO NOTHING.  Here new JSON-lines dumps landing in a folder are the
pages: each micro-batch is normalised and only works whose id is not yet
stored are appended (first record per id within the batch wins).

Each batch is written to its own ``_epoch`` partition with dynamic
partition overwrite, so a retried batch replaces its own earlier attempt
instead of appending twice; the stream's checkpoint lives under the shared
checkpoint folder.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeweave.functions.normalize import normalize_works
from citeweave.schema import RAW_WORK
from citeweave.session import ensure_checkpoint_dir
from citeweave.sinks.tables import new_rows_only


def _stored_ids(spark: SparkSession, table_path: str, epoch: int) -> DataFrame:
    try:
        stored = spark.read.parquet(table_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], "oa_id string")
    return stored.where(F.col("_epoch") != epoch).select("oa_id")


def ingest_raw_works(spark: SparkSession, source_dir: str, table_path: str,
                     checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the stream; returns the running query."""
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/ingest-{sha256(table_path.encode()).hexdigest()}"
    raw = spark.readStream.schema(RAW_WORK).json(source_dir)

    def write_batch(batch: DataFrame, epoch: int) -> None:
        works = (normalize_works(batch.withColumn("_file", F.input_file_name())
                                 .withColumn("_row", F.monotonically_increasing_id()))
                 .where(F.col("oa_id") != ""))
        fresh = new_rows_only(_stored_ids(spark, table_path, epoch), works, ["oa_id"],
                              ["_file", "_row"]).drop("_file", "_row")
        (fresh.withColumn("_epoch", F.lit(epoch).cast("bigint"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_epoch").parquet(table_path))

    w = raw.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
