"""Decades: in-decade references (J1/A4), citation edges, decade scans (S1),
decade histograms (A1, A2, A19) and decade bins (U1).

Plan shape of the in-decade reference job, for all decades in one pass::

    works(oa_id, decade, referenced_works)
      -> posexplode references                              (narrow)
      -> JOIN works(oa_id AS ref, decade) on (ref, decade)  (one shuffle per side)
      -> GROUP BY oa_id, hits ordered by position           (one shuffle)
      -> LEFT JOIN back to works on oa_id, [] when no hit   (one shuffle per side)

A famous work cited by a third of the corpus makes one ``ref`` key hot on
the probe side only; the build side holds one row per key, so AQE's skew
join splits that partition and replicates the single build row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.schema import DECADES, FIRST_DECADE, LAST_DECADE
from citeweave.session import small_table


def decade_col(year: str | Column) -> Column:
    """Year floored to its decade (NULL stays NULL)."""
    y = F.col(year) if isinstance(year, str) else year
    return (F.floor(y / 10) * 10).cast("bigint")


def check_decade(decade_start: int) -> int:
    """Reject a decade start that is not a multiple of ten."""
    if int(decade_start) % 10 != 0:
        raise ValueError(f"{decade_start} is not the first year of a decade")
    return int(decade_start)


def decade_label(decade: Column) -> Column:
    """``1950`` -> ``'1950-1959'`` (F8)."""
    return F.concat_ws("-", decade.cast("string"), (decade + 9).cast("string"))


def bins_table(spark: SparkSession, bins: list[list[int]]) -> DataFrame:
    """(bin, decade) rows for a list of decade bins named by their first decade.

    Overlapping bins or two bins with the same start would overwrite each
    other's results, so they are rejected.
    """
    seen: dict[int, int] = {}
    rows = []
    for decades in bins:
        if not decades:
            raise ValueError("empty bin")
        start = check_decade(decades[0])
        for d in decades:
            d = check_decade(d)
            if d in seen:
                raise ValueError(f"decade {d} appears in more than one bin")
            seen[d] = start
            rows.append((start, d))
    return small_table(spark, rows, "bin bigint, decade bigint")


def in_decade_hits(works: DataFrame, decades: list[int] = DECADES) -> DataFrame:
    """(oa_id, decade, pos, ref) for every reference whose target lies in the
    citing work's own decade.  Duplicate references and self-references stay."""
    lo, hi = min(decades), max(decades) + 9
    citing = (works
              .where(F.col("publication_year").between(lo, hi))
              .select("oa_id", decade_col("publication_year").alias("decade"),
                      F.posexplode("referenced_works").alias("pos", "ref")))
    targets = (works
               .where(F.col("publication_year").between(lo, hi))
               .select(F.col("oa_id").alias("ref"),
                       decade_col("publication_year").alias("decade")))
    if sorted(decades) != list(range(lo, hi, 10)):
        allowed = F.col("decade").isin([int(d) for d in decades])
        citing, targets = citing.where(allowed), targets.where(allowed)
    return citing.join(targets, ["ref", "decade"], "inner")


def _hit_lists(works: DataFrame, decades: list[int]) -> DataFrame:
    return (in_decade_hits(works, decades)
            .groupBy("oa_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "ref"))).alias("_h")))


def _as_refs(col: str = "_h") -> Column:
    return F.coalesce(F.transform(col, lambda x: x["ref"]),
                      F.array().cast("array<string>")).alias("in_decade_references")


def in_decade_references(works: DataFrame, decades: list[int] = DECADES) -> DataFrame:
    """(oa_id, decade, in_decade_references) for every work.

    Works with no hit, a NULL year or a year outside the covered decades get
    an empty array; references keep their order in ``referenced_works``.
    """
    return (works.select("oa_id", decade_col("publication_year").alias("decade"))
            .join(_hit_lists(works, decades), "oa_id", "left")
            .select("oa_id", "decade", _as_refs()))


def with_in_decade_references(works: DataFrame, decades: list[int] = DECADES) -> DataFrame:
    """The works table with its ``in_decade_references`` column (re)computed."""
    base = works.drop("in_decade_references")
    return (base.join(_hit_lists(works, decades), "oa_id", "left")
            .select(*base.columns, _as_refs()))


def citation_edges(works: DataFrame, decades: list[int] = DECADES) -> DataFrame:
    """The per-decade citation edge table ``EDGE(from_id, to_id, decade_start)``.

    Parallel references collapse: the table's key is (from_id, to_id)."""
    return (in_decade_hits(works, decades)
            .select(F.col("oa_id").alias("from_id"), F.col("ref").alias("to_id"),
                    F.col("decade").alias("decade_start"))
            .dropDuplicates(["from_id", "to_id"]))


def fetch_per_decade_data(works: DataFrame, decade_start: int,
                          additional_fields: list[str] | None = None) -> DataFrame:
    """Works of one decade: ``oa_id, in_decade_references`` plus named fields.

    Reads a works table that carries ``in_decade_references``; when the
    table is stored partitioned by ``decade`` the year filter prunes files.
    """
    d = check_decade(decade_start)
    cols = ["oa_id", "in_decade_references"] + list(additional_fields or [])
    return works.where(F.col("publication_year").between(d, d + 9)).select(*cols)


def works_per_decade(works: DataFrame, layer: int | None = 0) -> DataFrame:
    """Works per decade, optionally for one BFS layer (A1), with a label (F8)."""
    w = works if layer is None else works.where(F.col("layer") == layer)
    return (w.select(decade_col("publication_year").alias("decade"))
            .where(F.col("decade").isNotNull())
            .groupBy("decade").agg(F.count(F.lit(1)).alias("n_works"))
            .select("decade", "n_works", decade_label(F.col("decade")).alias("decade_label"),
                    F.format_number("n_works", 0).alias("n_works_fmt")))


def missing_year_report(works: DataFrame, layer: int | None = 0) -> DataFrame:
    """Total works and works without a year, optionally for one layer (A2, A3)."""
    w = works if layer is None else works.where(F.col("layer") == layer)
    return w.agg(F.count(F.lit(1)).alias("n_total"),
                 F.count_if(F.col("publication_year").isNull()).alias("n_missing_year"))


def decades_in_range(works: DataFrame) -> DataFrame:
    """Works restricted to the covered decades, with a decade column."""
    return (works.where(F.col("publication_year").between(FIRST_DECADE, LAST_DECADE + 9))
            .withColumn("decade", decade_col("publication_year")))


def write_works_by_decade(works: DataFrame, path: str) -> None:
    """Store the works table partitioned by decade (NULL-year works land in
    the NULL partition), so decade scans read only their own folder."""
    (works.withColumn("decade", decade_col("publication_year"))
     .write.mode("overwrite").partitionBy("decade").parquet(path))


def scan_decade(spark: SparkSession, path: str, decade_start: int,
                additional_fields: list[str] | None = None) -> DataFrame:
    """S1 on a decade-partitioned works table: the decade predicate prunes
    partitions and the year range is pushed into the Parquet scan."""
    d = check_decade(decade_start)
    works = spark.read.parquet(path).where(F.col("decade") == d)
    return fetch_per_decade_data(works, d, additional_fields)
