"""Document fingerprints by winnowing, in Spark SQL functions only.

Tokens are the words of up to ``TOKEN`` characters and, in longer words and text
without spaces, the TOKEN characters from every position on; every ``GRAM`` neighbouring tokens are hashed, and of every ``WINDOW``
neighbouring hashes the smallest is kept, the rightmost on ties.  Hashes are
ordered by their upper 32 bits.  Two texts that share a run of
GRAM + WINDOW - 1 tokens share a kept hash (inside text without spaces: of
GRAM + WINDOW + TOKEN - 2 characters, wherever it stands).  Positions (token numbers) of the
kept hashes are returned with them.

Window minima come from doubling: minima over 1, 2, 4, 8 neighbours, each one
pass over the array, so a text costs time in proportion to its length.

Rows: null text counts as empty; a text without words has no fingerprint
(''), a text of fewer tokens than a gram one gram, of fewer grams than
a window one kept hash.  The likeness is the share of common hashes in all of
both (1 for two empty fingerprints).  Equal texts have equal fingerprints.
Documents follow each other by doc_id (null first), then text; repeated rows
follow one another.  A single document follows itself.  An empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.session import cut_lineage, small_table

TOKEN = 8
GRAM = 3
WINDOW = 8  # a power of two
_PLACE = (1 << 31) - 1


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window_minima(packed: Column) -> Column:
    """Minima of every WINDOW neighbours (one minimum for a shorter array)."""
    def step(width):
        def widen(a):
            return F.zip_with(a, F.slice(a, width + 1, F.greatest(F.size(a), F.lit(1))),
                              lambda x, y: F.least(x, y))
        return widen
    out, width = packed, 1
    while width < WINDOW:
        out = _bind(out, step(width))
        width *= 2
    return _bind(out, lambda a: F.slice(a, 1, F.greatest(F.size(a) - (WINDOW - 1), F.lit(1))))


def tokens_of(text: Column) -> Column:
    """Tokens in order of their first character."""
    word = r"[^\x20\x09-\x0D]"
    return F.regexp_extract_all(
        text, F.lit(rf"(?=({word}{{{TOKEN}}}|(?<!{word}){word}{{1,{TOKEN - 1}}}(?!{word}))){word}"), F.lit(1))


def fingerprint(text: Column) -> Column:
    """struct<hashes: array<bigint>, places: array<int>>: the kept hashes in
    order of position, and their positions."""
    tokens = tokens_of(text)
    low = F.lit(_PLACE).cast("long")

    def grams(t):
        heads = F.slice(t, 1, F.greatest(F.size(t) - (GRAM - 1), F.least(F.size(t), F.lit(1))))
        return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(t, i + j) for j in range(1, GRAM)]))

    def kept(g):
        # upper 32 bits of the hash, then the place counted down: least = rightmost
        packed = F.transform(g, lambda h, i: h.bitwiseAND(F.lit(-(1 << 32)).cast("long")).bitwiseOR(low - i))
        places = F.transform(F.array_distinct(_window_minima(packed)),
                             lambda v: (low - v.bitwiseAND(low)).cast("int"))
        places = F.when(F.size(g) > 0, places).otherwise(F.array().cast("array<int>"))
        return _bind(places, lambda p: F.struct(
            F.transform(p, lambda i: F.get(g, i)).alias("hashes"), p.alias("places")))

    return _bind(tokens, lambda t: _bind(grams(t), kept))


def likeness(a: Column, b: Column) -> Column:
    """Common hashes over all hashes of two arrays, repeats aside."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def as_text(hashes: Column) -> Column:
    """Hashes in hexadecimal, in order of position."""
    return F.array_join(F.transform(hashes, lambda v: F.hex(v)), " ")


def _bucket(edges: list[int]) -> Column:
    """Number of ``edges`` (sorted) at or below doc_id, by a search on two levels."""
    if not edges:
        return F.lit(0)
    step = max(1, int(len(edges) ** 0.5))
    lows = edges[::step]
    coarse = F.array(*[F.lit(e).cast("long") for e in lows])
    fine = F.array(*[F.array(*[F.lit(e).cast("long") for e in edges[i:i + step]])
                     for i in range(0, len(edges), step)])
    upto = lambda a: F.size(F.filter(a, lambda e: e <= F.col("doc_id")))
    block = upto(coarse) - 1
    return F.when(F.col("doc_id").isNull() | (block < 0), 0).otherwise(
        block * step + upto(F.get(fine, block)))


def with_next(documents: DataFrame, rows_per_bucket: int = 256) -> DataFrame:
    """doc_id, text and the next row's ``next_text``, in order of (doc_id, text);
    the first row follows the last.

    Rows are cut into ranges of doc_id at approximate quantiles (at most 10,000
    edges) and a window runs inside each range, after one shuffle of the texts.
    The last row of a range takes the first row of the next range: one row per
    range, joined on the range's number.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    buckets = max(1, min(10_000, docs.count() // rows_per_bucket))
    edges: list[int] = []
    if buckets > 1:
        marks = docs.select(F.percentile_approx(
            "doc_id", [i / buckets for i in range(1, buckets)], 100 * buckets).alias("q")).first()
        edges = sorted(set(marks["q"] or []))
    docs = docs.withColumn("bucket", _bucket(edges).cast("int"))
    heads = cut_lineage(docs.groupBy("bucket").agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "text")).alias("m"))
        .select("bucket", F.col("m.text").alias("head_text")))
    numbers = [r["bucket"] for r in heads.select("bucket").orderBy("bucket").collect()]
    after = small_table(docs.sparkSession, list(zip(numbers, numbers[1:] + numbers[:1])),
                        "own int, bucket int")
    follow = heads.join(F.broadcast(after), "bucket").drop("bucket").withColumnRenamed("own", "bucket")
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = docs.withColumn("next", F.lead("text").over(w))
    # rows already lie by bucket: the join moves only one row per range
    return (rows.join(follow, "bucket", "left")
            .select("doc_id", "text", F.coalesce("next", "head_text").alias("next_text")))


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, places.

    The edited text has its last floor(n_chars / 4) characters replaced by the first
    as many of the next document.
    """
    rows = with_next(documents)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = (rows.withColumn("n_chars", n.cast("long"))
              .withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter),
                                             F.substring("next_text", F.lit(1), quarter)))
              .withColumn("print", fingerprint(F.col("text")))
              .withColumn("edited_hashes", fingerprint(F.col("edited"))["hashes"])
              .withColumn("next_hashes", fingerprint(F.col("next_text"))["hashes"]))
    own = F.col("print.hashes")
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"), as_text(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(own, F.col("edited_hashes")).alias("near_edited"),
        likeness(own, F.col("next_hashes")).alias("near_next"),
        F.col("print.places").alias("places"))
