"""File and SQL sources.

CSV: headered files, columns mapped by header name, nested columns given as
JSON text, quotes doubled, fields may span lines; ``.gz`` is read
transparently (a gzip file is not splittable: convert it to Parquet once
and scan that).  Raw API records: JSON lines read with a fixed schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.schema import RAW_WORK, WORK


def execute_sql(spark: SparkSession, query: str, params: dict | list | None = None) -> DataFrame:
    """SQL over registered views with bound parameters (named ``:x`` or ``?``)."""
    return spark.sql(query, args=params) if params else spark.sql(query)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Stage a DataFrame as a temporary view for later statements."""
    df.createOrReplaceTempView(name)
    return df


def load_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             has_header: bool = True, columns: list[str] | None = None,
             may_be_absent: tuple[str, ...] = ()) -> DataFrame:
    """Read headered CSV(.gz); map columns by header name onto
    ``schema``.  A header name outside the schema is an error, and so is a
    column without one, but for those of ``may_be_absent``, which are NULL
    then; a file without a header thus never loses rows.  Array/map/struct columns are parsed from
    JSON text; '' and unquoted empty both read as NULL.  ``columns`` keeps a
    subset (S5)."""
    if not has_header:
        raise ValueError("CSV input must have a header row")
    raw = (spark.read.option("header", True).option("multiLine", True)
           .option("escape", '"').option("mode", "FAILFAST")
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
           .csv(path))
    if schema is None:
        out = raw
    else:
        names = {f.name for f in schema.fields}
        unknown = [c for c in raw.columns if c not in names]
        missing = sorted(names - set(raw.columns) - set(may_be_absent))
        if unknown or missing:
            raise ValueError(f"CSV header of {path}: unknown columns {unknown}, missing columns {missing}")
        cols = []
        for f in schema.fields:
            if f.name not in raw.columns:
                cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
                cols.append(F.from_json(F.col(f.name), f.dataType).alias(f.name))
            else:
                cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        out = raw.select(*cols)
    if columns:
        out = out.select(*columns)
    return out.select(*[F.nullif(F.col(c), F.lit("")).alias(c)
                        if isinstance(out.schema[c].dataType, T.StringType) else F.col(c)
                        for c in out.columns])


def load_works_csv(spark: SparkSession, path: str) -> DataFrame:
    """The works table from a CSV(.gz) export."""
    return load_csv(spark, path, WORK)


def read_raw_works(spark: SparkSession, path: str, select: list[str] | None = None) -> DataFrame:
    """Raw work records (JSON lines) with the fixed raw schema; an
    optional field list is pushed into the scan by nested column pruning."""
    df = spark.read.schema(RAW_WORK).json(path)
    return df.select(*select) if select else df


_RECORD = ("struct<elements:bigint,field_distribution:map<string,double>,"
           "domain_distribution:map<string,double>,topic_distribution:map<string,double>,"
           "intracluster_links:map<string,double>,intracluster_link_ratio:double>")


def read_cluster_report(spark: SparkSession, path: str) -> DataFrame:
    """A cluster report document ``{bin: {cluster: record}}`` as
    (bin, cluster, record fields...) rows."""
    doc = spark.read.text(path, wholetext=True)
    parsed = doc.select(F.from_json("value", f"map<string,map<string,{_RECORD}>>").alias("m"))
    per_bin = parsed.select(F.explode("m").alias("bin", "clusters"))
    return (per_bin.select(F.col("bin").cast("bigint").alias("bin"),
                           F.explode("clusters").alias("cluster", "r"))
            .select("bin", F.col("cluster").cast("bigint").alias("cluster"), "r.*"))


def read_cluster_records(spark: SparkSession, path: str) -> DataFrame:
    """S8, line form: records written one per (bin, cluster)."""
    line = "struct<bin:bigint,cluster:bigint," + _RECORD[len("struct<"):]
    return spark.read.text(path).select(F.from_json("value", line).alias("r")).select("r.*")


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Per-bin networks -> (nodes, edges).  Nodes keep id, topic and
    cluster; edge endpoints that are not listed become attribute-less
    nodes; repeated edges collapse (a simple directed graph per bin)."""
    nodes = spark.read.json(f"{path}/nodes").select("bin", "id", "topic", "cluster")
    edges = (spark.read.json(f"{path}/edges")
             .select("bin", F.col("edge")[0].alias("src"), F.col("edge")[1].alias("dst"))
             .distinct())
    ends = (edges.select("bin", F.col("src").alias("id"))
            .union(edges.select("bin", F.col("dst").alias("id"))).distinct())
    extra = ends.join(nodes.select("bin", "id"), ["bin", "id"], "left_anti").select(
        "bin", "id", F.lit(None).cast("string").alias("topic"),
        F.lit(None).cast("bigint").alias("cluster"))
    return nodes.unionByName(extra), edges
