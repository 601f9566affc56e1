"""Names and schemas for operators that keep their input's columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """``name`` as a column reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores until no column has it (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def schema_with(df: DataFrame, columns: Iterable[str], **more: T.DataType) -> T.StructType:
    """Fields ``columns`` of ``df``, then ``more``; all nullable."""
    own = {f.name: f.dataType for f in df.schema.fields}
    return T.StructType([*[T.StructField(c, own[c]) for c in columns],
                         *[T.StructField(n, k) for n, k in more.items()]])
