"""Spark session settings and lineage cutting.

Every iterative operator (dedupe, expansion, community detection) cuts its
lineage once per round with a *reliable* checkpoint, written to the shared
folder the cluster names in ``spark.checkpoint.dir``.  Only when that is
unset and Spark runs in local mode (tests, the bench) do we pick a folder
ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Spark's setting to drop shuffle files at the end of the action that wrote them
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "citeweave", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _one_machine(sc) -> bool:
    """Local mode proper; ``local-cluster`` has executors of its own."""
    return sc.master.split("[")[0] == "local"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, reading ``spark.checkpoint.dir`` first.

    On a cluster the folder must be shared storage named by the cluster; a
    machine-local temporary folder is only chosen in local mode.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not _one_machine(sc):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative operators need a shared "
            "checkpoint folder on a cluster")
    path = tempfile.mkdtemp(prefix="citeweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is planned and run inside go as soon as it has run;
    otherwise they stay until the driver collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame, by: list | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table under the checkpoint folder and read it back;
    ``by`` names columns whose values get a folder each.

    The result has a fresh plan (a file scan), so iterative jobs keep a
    constant plan size, and it survives the loss of the executor that
    computed it, unlike cached or locally checkpointed blocks.  It costs one
    job, where an un-persisted reliable RDD checkpoint computes its input
    twice.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/citeweave-tables/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):  # the table is read from now on, not the shuffles it came from
        df.write.mode("overwrite").partitionBy(*by or []).parquet(path)
    # folders of values hold no file for an empty table, so its schema is given
    table = (spark.read.schema(df.schema) if by else spark.read).parquet(path)
    table._citeweave_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` wrote and that no later plan reads."""
    for t in tables:
        path = t.__dict__.pop("_citeweave_path", None)
        if path:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_for(spark: SparkSession, rows: int, per_partition: int = 20_000):
    """Inside, shuffles have a partition for each ``per_partition`` of ``rows`` rows, at
    least 8 and at most as many as the session has.  A map task opens a file for every
    partition, so rounds over a small table in 200 of them are mostly opening files."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(before), max(8, -(-rows // per_partition)))))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def ship_package(spark: SparkSession) -> None:
    """Make ``citeweave`` importable in Python workers (for the few Arrow
    UDFs).  In local mode the package is zipped once per context and added
    with ``addPyFile``; on a cluster it is deployed with the job
    (``spark-submit --py-files citeweave.zip`` or installed on the
    executors), so nothing is written to a machine-local folder."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_citeweave_shipped", False):
        return
    if not _one_machine(sc):
        sc._citeweave_shipped = True
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="citeweave-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._citeweave_shipped = True


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table as a JVM local relation (no Python worker reads
    it); ``schema`` is a DDL string such as ``"bin bigint, stride bigint"``."""
    from pyspark.sql import types as T
    st = T._parse_datatype_string(schema)
    names = [f.name for f in st.fields]
    casts = ", ".join(f"CAST(`c{i}` AS {f.dataType.simpleString()}) AS `{f.name}`"
                      for i, f in enumerate(st.fields))
    if not rows:
        return spark.createDataFrame([], st)
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    cols = ", ".join(f"c{i}" for i in range(len(names)))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({cols})")
