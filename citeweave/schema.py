"""Table schemas: one source of truth for works, edges and raw records."""

from __future__ import annotations

from pyspark.sql import types as T

# The decades the in-decade reference job covers (1920 to 2020
# inclusive, each spanning start..start+9), the default decade bins of the
# cluster report, the cluster size cutoff and the top-n per bin.
FIRST_DECADE = 1920
LAST_DECADE = 2020
DECADES = list(range(FIRST_DECADE, LAST_DECADE + 10, 10))
DEFAULT_BINS = [[1920, 1930, 1940, 1950, 1960, 1970], [1980, 1990], [2000], [2010], [2020]]
CLUSTER_SIZE_CUTOFF = 5
TOP_N_CLUSTERS = 10
LAYOUT_Y_SPACING = 1.4
PALETTE_SLOTS = 20

WORK = T.StructType([
    T.StructField("oa_id", T.StringType(), False),
    T.StructField("doi", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("publication_year", T.LongType(), True),
    T.StructField("cited_by_count", T.LongType(), True),
    T.StructField("abstract", T.StringType(), True),
    T.StructField("referenced_works", T.ArrayType(T.StringType()), True),
    T.StructField("domain", T.StringType(), True),
    T.StructField("field", T.StringType(), True),
    T.StructField("subfield", T.StringType(), True),
    T.StructField("topic", T.StringType(), True),
    T.StructField("layer", T.LongType(), True),
    T.StructField("in_decade_references", T.ArrayType(T.StringType()), True),
])

WORK_COLUMNS = [f.name for f in WORK.fields]

EDGE = T.StructType([
    T.StructField("from_id", T.StringType(), False),
    T.StructField("to_id", T.StringType(), False),
    T.StructField("decade_start", T.LongType(), True),
])

_NAMED = T.StructType([T.StructField("display_name", T.StringType(), True)])

RAW_WORK = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("doi", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("publication_year", T.LongType(), True),
    T.StructField("cited_by_count", T.LongType(), True),
    T.StructField("abstract_inverted_index",
                  T.MapType(T.StringType(), T.ArrayType(T.IntegerType())), True),
    T.StructField("referenced_works", T.ArrayType(T.StringType()), True),
    T.StructField("primary_topic", T.StructType([
        T.StructField("display_name", T.StringType(), True),
        T.StructField("domain", _NAMED, True),
        T.StructField("field", _NAMED, True),
        T.StructField("subfield", _NAMED, True),
    ]), True),
])

# Type names accepted in ``{column: type}`` table declarations (catalog K1).
SQL_TYPES = {
    "TEXT": T.StringType(), "STRING": T.StringType(), "VARCHAR": T.StringType(),
    "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "INT4": T.IntegerType(),
    "SERIAL": T.IntegerType(), "BIGINT": T.LongType(), "INT8": T.LongType(),
    "BIGSERIAL": T.LongType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(),
    "DOUBLE PRECISION": T.DoubleType(), "REAL": T.FloatType(), "BOOLEAN": T.BooleanType(),
    "TEXT[]": T.ArrayType(T.StringType()), "STRING[]": T.ArrayType(T.StringType()),
    "JSONB": T.StringType(), "JSON": T.StringType(),
}
