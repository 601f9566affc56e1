"""Tables, catalog and file sinks.

Tables are Spark catalog tables stored as Parquet.  A primary key is kept as
a table property and checked as a uniqueness assertion (Spark does not
enforce keys).  CSV exports write JSON text for nested columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.operators.community.framework import dense_rank_ids
from citeweave.schema import SQL_TYPES

PK_PROPERTY = "citeweave.primary_key"
JSON_PROPERTY = "citeweave.json_columns"
SERIAL_PROPERTY = "citeweave.serial"
DEFAULT_PROPERTY = "citeweave.default."

# SQL type names used when printing a table definition.
_DDL_NAMES = {
    "string": "text", "int": "integer", "bigint": "bigint", "double": "double precision",
    "float": "real", "boolean": "boolean", "array<string>": "text[]",
}


_KEY = re.compile(r"\s+PRIMARY\s+KEY\b", re.I)
_DEFAULT = re.compile(r"\s+DEFAULT\s+('(?:[^']|'')*'|[^\s']+)(?:::\w+)?", re.I)
_NOT_NULL = re.compile(r"\s+NOT\s+NULL\b", re.I)


def _spark_type(sql_type: str) -> T.DataType:
    base = _NOT_NULL.sub("", _DEFAULT.sub("", _KEY.sub("", sql_type))).strip().upper()
    if base not in SQL_TYPES:
        raise ValueError(f"unsupported column type: {sql_type}")
    return SQL_TYPES[base]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_table(spark: SparkSession, name: str, fields: dict[str, str],
                 pk: str | list[str] | None = "id", location: str | None = None) -> None:
    """K1: CREATE TABLE IF NOT EXISTS from ``{column: SQL type}``.

    A column declared ``... PRIMARY KEY`` is the key and no key clause is
    added; otherwise ``pk`` (one or several columns) is the key.  A column left out of
    an insert takes its ``DEFAULT`` (a literal or expression), a ``SERIAL`` one the
    next numbers."""
    declared = [c for c, t in fields.items() if _KEY.search(t)]
    keys = declared or ([pk] if isinstance(pk, str) else list(pk or []))
    cols = ", ".join(f"`{c}` {_spark_type(t).simpleString()}" for c, t in fields.items())
    json = [c for c, t in fields.items() if t.strip().upper().startswith("JSON")]
    serial = [c for c, t in fields.items() if re.match(r"\s*(BIG)?SERIAL\b", t, re.I)]
    held = {PK_PROPERTY: ",".join(keys), JSON_PROPERTY: ",".join(json), SERIAL_PROPERTY: ",".join(serial)}
    held |= {DEFAULT_PROPERTY + c: m[1] for c, t in fields.items() if (m := _DEFAULT.search(t))}
    held = ", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in held.items() if v)
    props = f" TBLPROPERTIES ({held})" if held else ""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet{loc}{props}")


def _column_property(spark: SparkSession, name: str, key: str) -> list[str]:
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").collect()
    for r in rows:
        if r["key"] == key:
            return [k for k in r["value"].split(",") if k]
    return []


def primary_key(spark: SparkSession, name: str) -> list[str]:
    return _column_property(spark, name, PK_PROPERTY)


def json_columns(spark: SparkSession, name: str) -> list[str]:
    """Columns declared JSON or JSONB, stored as JSON text."""
    return _column_property(spark, name, JSON_PROPERTY)


def column_defaults(spark: SparkSession, name: str) -> dict[str, str]:
    """The DEFAULT of every column that has one, as declared."""
    return {r["key"].removeprefix(DEFAULT_PROPERTY): r["value"]
            for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect() if r["key"].startswith(DEFAULT_PROPERTY)}


def with_defaults(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    """K5: ``rows`` with the columns of table ``name`` that they lack and that have a
    DEFAULT or are SERIAL.  Serial numbers go on from the table's largest (from 1 in
    an empty table) without gaps, in the rows' order."""
    for c, text in column_defaults(spark, name).items():
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(text[1:-1].replace("''", "'")) if text.startswith("'") else F.expr(text))
    for c in _column_property(spark, name, SERIAL_PROPERTY):
        if c not in rows.columns:
            last = spark.table(name).agg(F.max(c)).first()[0] or 0
            rows = rows.withColumn("_at", F.monotonically_increasing_id())
            rows = dense_rank_ids(rows, ["_at"], c).withColumn(c, F.col(c) + F.lit(last + 1)).drop("_at")
    return rows


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row, or NULL keys (empty when the key holds)."""
    nulls = df.where(F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1
                     else F.col(keys[0]).isNull()).select(*keys).limit(1)
    dups = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1").select(*keys))
    return dups.unionByName(nulls)


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    if keys and not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"primary key {keys} violated")


def conform(df: DataFrame, schema: T.StructType, json: list[str] | None = None) -> DataFrame:
    """Columns in table order; missing ones NULL; NULL arrays become []; a
    scalar given for an array column becomes a one-element array; in a JSON
    column nested values become JSON text, text stays as it is and other scalars
    become ``{"value": x}`` (K2, K4)."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name)
            src = df.schema[f.name].dataType
            if isinstance(f.dataType, T.ArrayType) and not isinstance(src, T.ArrayType):
                c = F.when(c.isNull(), F.lit(None)).otherwise(F.array(c.cast(f.dataType.elementType)))
            if f.name in (json or []):
                if isinstance(src, (T.ArrayType, T.MapType, T.StructType)):
                    c = F.to_json(c)
                elif not isinstance(src, T.StringType):
                    c = F.when(c.isNotNull(), as_json_value(f.name))
            c = c.cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def as_json_value(col: str) -> F.Column:
    """K4: a scalar stored in a JSON column becomes ``{"value": x}``."""
    return F.to_json(F.struct(F.col(col).alias("value")))


def upload(spark: SparkSession, name: str, df: DataFrame) -> None:
    """K2: append rows in the table's column order (empty input: no-op), columns left
    out by ``with_defaults``.  A NULL key, or one that the batch or the table has
    already, raises."""
    table = spark.table(name)
    rows = conform(with_defaults(spark, name, df), table.schema, json_columns(spark, name))
    pk = primary_key(spark, name)
    if pk:
        assert_unique(rows, pk)
        if not rows.select(*pk).join(table.select(*pk), pk, "left_semi").isEmpty():
            raise ValueError(f"primary key {pk} violated: the table has a key of the batch")
    rows.write.insertInto(name)


def new_rows_only(target: DataFrame, batch: DataFrame, pk: list[str],
                  order_by: list[str]) -> DataFrame:
    """K3: rows of ``batch`` whose key is not in ``target``; within the batch
    the first row per key (``order_by``) wins.  The per-key pick is a
    ``min_by`` aggregate, combined map-side, so a key repeated in a third of
    the batch does not land in one task."""
    cols = [c for c in batch.columns]
    firsts = (batch.groupBy(*pk)
              .agg(F.min_by(F.struct(*cols), F.struct(*order_by)).alias("_r"))
              .select("_r.*"))
    return firsts.join(target.select(*pk), pk, "left_anti").select(*cols)


def upload_new_only(spark: SparkSession, name: str, batch: DataFrame,
                    order_by: list[str]) -> None:
    """K3: append with ON CONFLICT (pk) DO NOTHING semantics."""
    pk = primary_key(spark, name)
    upload(spark, name, new_rows_only(spark.table(name), batch, pk, order_by))


def insert_rows(spark: SparkSession, name: str, rows: list[dict]) -> None:
    """K5: small insert of dict rows; columns from the first row."""
    if not rows:
        return
    cols = list(rows[0])
    table = spark.table(name)
    schema = T.StructType([table.schema[c] for c in cols])
    upload(spark, name, spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows],
                                              schema))


def drop_table(spark: SparkSession, name: str, cascade: bool = False) -> None:
    """K8: DROP TABLE IF EXISTS (cascade has no meaning for Spark tables)."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def list_tables(spark: SparkSession) -> list[str]:
    """K9: table names in name order."""
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary)


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """(column_name, data_type, is_nullable) rows."""
    pk = primary_key(spark, name)
    rows = [(f.name, f.dataType.simpleString(), f.nullable and f.name not in pk)
            for f in spark.table(name).schema]
    return spark.createDataFrame(rows, "column_name string, data_type string, is_nullable boolean")


def table_ddl(spark: SparkSession, name: str) -> str:
    """``CREATE TABLE`` text with serial and jsonb columns, DEFAULTs, NOT NULL on
    key columns and the key."""
    pk, json, defaults = primary_key(spark, name), json_columns(spark, name), column_defaults(spark, name)
    serial = _column_property(spark, name, SERIAL_PROPERTY)
    lines = []
    for f in spark.table(name).schema:
        t = _DDL_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString())
        if f.name in serial:
            t = "bigserial" if isinstance(f.dataType, T.LongType) else "serial"
        t = "jsonb" if f.name in json else t
        lines.append(f"  {f.name} {t}" + (f" DEFAULT {defaults[f.name]}" if f.name in defaults else "")
                     + (" NOT NULL" if f.name in pk else ""))
    if pk:
        lines.append(f"  PRIMARY KEY ({', '.join(pk)})")
    return f"CREATE TABLE {name} (\n" + ",\n".join(lines) + "\n)"


def to_csv_frame(df: DataFrame, null_arrays: str = "empty") -> DataFrame:
    """Nested columns as JSON text; NULL arrays written as '[]' or left empty."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            if null_arrays == "empty":
                c = F.coalesce(c, F.array().cast(f.dataType))
            c = F.to_json(c)
        elif isinstance(f.dataType, (T.MapType, T.StructType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def export_csv(df: DataFrame, path: str, order_by_first: bool = True,
               null_arrays: str = "empty", gzip: bool | None = None) -> None:
    """K6: header row, JSON text for nested columns, ordered by the first
    column, gzip when asked or when the path ends in ``.gz``."""
    out = to_csv_frame(df, null_arrays)
    if order_by_first:
        out = out.orderBy(out.columns[0])
    compress = gzip if gzip is not None else path.endswith(".gz")
    w = (out.write.mode("overwrite").option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if compress:
        w = w.option("compression", "gzip")
    w.csv(path)


def export_all(spark: SparkSession, out_dir: str) -> None:
    """K7: every table as CSV.gz plus one ``schema.sql`` with their definitions."""
    names = list_tables(spark)
    ddl = ";\n\n".join(table_ddl(spark, n) for n in names) + (";\n" if names else "")
    spark.createDataFrame([(ddl,)], "value string").coalesce(1).write.mode("overwrite") \
        .text(f"{out_dir.rstrip('/')}/schema.sql")
    for n in names:
        export_csv(spark.table(n), f"{out_dir.rstrip('/')}/{n}.csv.gz", gzip=True)


def insert_column_after(df: DataFrame, column: str, after: str, value) -> DataFrame:
    """A new column placed right after ``after``; no-op when present."""
    if column in df.columns:
        return df
    cols = []
    for c in df.columns:
        cols.append(F.col(c))
        if c == after:
            cols.append(value.alias(column))
    return df.select(*cols)


def _cluster_record_rows(clusters: DataFrame, dist: DataFrame, links: DataFrame,
                         self_share: DataFrame) -> DataFrame:
    def dist_map(kind):
        return (dist.where(F.col("kind") == kind)
                .groupBy("bin", "cluster")
                .agg(F.map_from_entries(F.collect_list(F.struct("value", "share")))
                     .alias(f"{kind}_distribution")))
    lk = (links.groupBy("bin", "cluster")
          .agg(F.map_from_entries(F.collect_list(F.struct(
              F.concat_ws("-", F.col("dst_bin").cast("string"), F.col("dst_cluster").cast("string")),
              F.col("weight")))).alias("intracluster_links")))
    empty = F.create_map().cast("map<string,double>")
    return (clusters.join(dist_map("field"), ["bin", "cluster"], "left")
            .join(dist_map("domain"), ["bin", "cluster"], "left")
            .join(dist_map("topic"), ["bin", "cluster"], "left")
            .join(lk, ["bin", "cluster"], "left")
            .join(self_share.select("bin", "cluster", "intracluster_link_ratio"),
                  ["bin", "cluster"], "left")
            .select("bin", "cluster", F.struct(
                F.col("elements").cast("bigint").alias("elements"),
                F.coalesce("field_distribution", empty).alias("field_distribution"),
                F.coalesce("domain_distribution", empty).alias("domain_distribution"),
                F.coalesce("topic_distribution", empty).alias("topic_distribution"),
                F.coalesce("intracluster_links", empty).alias("intracluster_links"),
                F.coalesce("intracluster_link_ratio", F.lit(0.0)).alias("intracluster_link_ratio"),
            ).alias("rec")))


def cluster_records(clusters: DataFrame, dist: DataFrame, links: DataFrame,
                    self_share: DataFrame) -> DataFrame:
    """K12, line form: one JSON line per cluster with its bin and id.
    Each cluster's distributions are aggregated separately, so no row holds
    more than one cluster's record."""
    rec = _cluster_record_rows(clusters, dist, links, self_share)
    return rec.select(F.to_json(F.struct("bin", "cluster", "rec.*")).alias("value"))


def cluster_report_json(clusters: DataFrame, dist: DataFrame, links: DataFrame,
                        self_share: DataFrame) -> DataFrame:
    """K12, document form: ``{bin: {cluster: record}}`` as one text row.

    Its size is bins x top-n cluster records, so it is only built for a
    report cut to the top n clusters of each bin."""
    rec = _cluster_record_rows(clusters, dist, links, self_share)
    per_bin = (rec.groupBy("bin")
               .agg(F.map_from_entries(F.collect_list(F.struct(
                   F.col("cluster").cast("string"), "rec"))).alias("clusters")))
    doc = per_bin.agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("bin").cast("string"), "clusters"))).alias("report"))
    return doc.select(F.to_json("report").alias("value"))


def write_cluster_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").text(path)


def write_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables of every bin as JSON lines partitioned by
    bin (one line per node / per edge, so no bin is gathered in one row)."""
    nodes.write.mode("overwrite").partitionBy("bin").json(f"{path}/nodes")
    edges.select("bin", F.array("src", "dst").alias("edge")).write.mode("overwrite") \
        .partitionBy("bin").json(f"{path}/edges")
