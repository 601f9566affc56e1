"""Updates and lookups between tables.

Row-wise ``UPDATE ... FROM`` and dictionary enrichment become joins; only
keys and the changed column travel through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update_from(target: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Matched rows take the update's value - even a NULL one - and
    unmatched rows keep theirs (not ``coalesce(new, old)``).  The update
    side must hold one row per key."""
    u = updates.select(F.col(key), F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    return (target.join(u, key, "left")
            .withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column)))
            .drop("_new", "_hit"))


def last_per_key(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """One row per key: the last in ``order_by`` order (a dict built in that
    order keeps the last write), combined map-side with ``max_by``."""
    cols = df.columns
    return (df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order_by)).alias("_r"))
            .select("_r.*"))


def enrich(target: DataFrame, lookup: DataFrame, key: str, column: str,
           order_by: list[str] | None = None) -> DataFrame:
    """Add ``column`` from ``lookup`` by key; missing -> NULL."""
    lk = last_per_key(lookup, key, order_by) if order_by else lookup
    return target.join(lk.select(key, column), key, "left")


def add_column_if_absent(df: DataFrame, column: str, default: Column) -> DataFrame:
    """Add a column with a default only when it is not there yet."""
    return df if column in df.columns else df.withColumn(column, default)


def exclude_seen(new: DataFrame, seen: DataFrame, key: str = "oa_id") -> DataFrame:
    """Rows of ``new`` whose key is not in ``seen``."""
    return new.join(seen.select(key).distinct(), key, "left_anti")


def accumulate_seen(seen: DataFrame, new: DataFrame, key: str = "oa_id") -> DataFrame:
    """The union of seen ids."""
    return seen.select(key).union(new.select(key)).distinct()


def batch_numbers(df: DataFrame, size: int, order_by: list[str]) -> DataFrame:
    """Fixed-size batches in ``order_by`` order (the last may be short),
    numbered by a distributed dense index (no single-partition window)."""
    from citeweave.operators.community.framework import dense_rank_ids
    return (dense_rank_ids(df, order_by, "_i")
            .withColumn("batch", F.floor(F.col("_i") / size).cast("bigint")).drop("_i"))
