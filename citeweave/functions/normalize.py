"""Record normalisation as column expressions.

All of it runs inside the JVM: a raw record becomes a normalised work in
one ``select``, no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Python's ``str.split()``/``strip()`` whitespace: Unicode White_Space plus the
# four information separators U+001C..U+001F.
_WS = r"[\s\x{1c}-\x{1f}]"
_LEAD_TRAIL_WS = rf"(?U)^{_WS}+|{_WS}+$"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x: str | Column) -> Column:
    """Remove leading/trailing Unicode whitespace (Python ``str.strip()``)."""
    return F.regexp_replace(_c(x), _LEAD_TRAIL_WS, "")


def oa_id(x: str | Column) -> Column:
    """last path segment of an id URL, else unchanged; missing -> ''."""
    c = _c(x)
    return F.coalesce(F.when(F.instr(c, "/") > 0, F.substring_index(c, "/", -1)).otherwise(c),
                      F.lit(""))


def normalize_doi(x: str | Column) -> Column:
    """trim, lower-case, empty -> NULL."""
    return F.nullif(F.lower(strip_ws(x)), F.lit(""))


def normalize_title(x: str | Column) -> Column:
    """trim, lower-case, collapse whitespace runs; NULL or '' -> NULL.

    A title of only whitespace becomes '' (not NULL), as in the rule."""
    c = _c(x)
    collapsed = strip_ws(F.regexp_replace(F.lower(c), rf"(?U){_WS}+", " "))
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).otherwise(collapsed)


def abstract_from_inverted_index(x: str | Column) -> Column:
    """F4 as one column expression (for use inside a single ``select``).

    ``with_abstract`` computes the same value in stages and is the faster
    form on whole tables."""
    entries = F.map_entries(_c(x))
    ordered = F.array_sort(_triples(entries))
    words = _last_per_slot(ordered)
    return _join_slots(words)


def _triples(entries: Column) -> Column:
    """(position, entry index, word) for every position of every entry."""
    return F.flatten(F.transform(
        entries,
        lambda e, k: F.transform(F.coalesce(e["value"], F.array().cast("array<int>")),
                                 lambda p: F.struct(p.alias("pos"), k.alias("k"),
                                                    e["key"].alias("w")))))


def _last_per_slot(ordered: Column) -> Column:
    # keep the last triple of every position (largest entry index wins): pair
    # each triple with its successor instead of indexing inside a lambda
    successor = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
    last = F.filter(F.zip_with(ordered, successor,
                               lambda t, nx: F.struct(t.alias("t"),
                                                      (nx.isNull() | (nx["pos"] != t["pos"]))
                                                      .alias("keep"))),
                    lambda z: z["keep"])
    return F.transform(last, lambda z: z["t"])


def _join_slots(words: Column) -> Column:
    previous = F.concat(F.array(F.lit(-1)), F.transform(words, lambda t: t["pos"]))
    # a slot gap of g empty words before a word is g extra spaces
    pieces = F.zip_with(words, previous,
                        lambda t, p: F.concat(F.repeat(F.lit(" "), t["pos"] - p - 1), t["w"]))
    return F.nullif(strip_ws(F.array_join(pieces, " ")), F.lit(""))


def with_abstract(df: DataFrame, index_col: str = "abstract_inverted_index",
                  out: str = "abstract") -> DataFrame:
    """F4 on a DataFrame: rebuild text from ``word -> [positions]``.

    The text has max(position)+1 slots; unfilled slots are empty words (so
    gaps leave runs of spaces), a later word wins a shared position, ends
    are trimmed and an empty result is NULL.  Per record this is one sort of
    (position, entry index, word) triples, O(n log n) in the text length,
    with no shuffle.  Each intermediate array is its own projection so it is
    computed once (Catalyst does not merge projections that would repeat an
    expensive expression).
    """
    return (df.withColumn("_ord", F.array_sort(_triples(F.map_entries(F.col(index_col)))))
            .withColumn("_slots", _last_per_slot(F.col("_ord")))
            .withColumn(out, _join_slots(F.col("_slots")))
            .drop("_ord", "_slots"))


def topic_fields(x: str | Column) -> list[Column]:
    """domain, field, subfield, topic from the nested primary topic."""
    pt = _c(x)
    return [pt["domain"]["display_name"].alias("domain"),
            pt["field"]["display_name"].alias("field"),
            pt["subfield"]["display_name"].alias("subfield"),
            pt["display_name"].alias("topic")]


def normalize_references(x: str | Column) -> Column:
    """normalise every reference id, skipping NULL and empty ones."""
    refs = F.coalesce(_c(x), F.array().cast("array<string>"))
    return F.transform(F.filter(refs, lambda r: r.isNotNull() & (r != "")), oa_id)


def normalize_works(raw: DataFrame) -> DataFrame:
    """a raw record becomes a normalised work; consumed fields dropped.

    Extra columns of ``raw`` (e.g. ``layer``) are carried through.  The
    result is a pure function of the raw record, so normalising twice
    cannot lose values.
    """
    consumed = {"id", "doi", "title", "abstract_inverted_index", "referenced_works",
                "primary_topic"}
    extra = [c for c in raw.columns if c not in consumed and c not in
             ("publication_year", "cited_by_count", "domain", "field", "subfield", "topic",
              "abstract", "oa_id", "_abstract")]
    return with_abstract(raw, "abstract_inverted_index", "_abstract").select(
        oa_id("id").alias("oa_id"),
        normalize_doi("doi").alias("doi"),
        normalize_title("title").alias("title"),
        F.col("publication_year").cast("bigint").alias("publication_year"),
        F.col("cited_by_count").cast("bigint").alias("cited_by_count"),
        F.col("_abstract").alias("abstract"),
        normalize_references("referenced_works").alias("referenced_works"),
        *topic_fields("primary_topic"),
        *extra,
    )


def empty_to_null(x: str | Column) -> Column:
    """'' -> NULL."""
    return F.nullif(_c(x), F.lit(""))


def fill_rate(df: DataFrame, column: str) -> DataFrame:
    """Rows with a non-empty value, all rows, and their ratio."""
    return df.agg(F.count(empty_to_null(column)).alias("n_filled"),
                  F.count(F.lit(1)).alias("n_rows")) \
             .withColumn("fill_rate", F.round(F.col("n_filled") / F.col("n_rows"), 9))
