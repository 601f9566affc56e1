"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register
def op1_substring_dedup(spark, sf_dir):
    """Passages of 50 words or more that documents share with one of smaller id."""
    from citeweave.llm.substring_dedup import duplicate_passages
    return duplicate_passages(table(spark, sf_dir, "documents"))


@register
def op2_sharding(spark, sf_dir):
    """All documents in 8 shards of near equal bytes, by a map of 4,096 slots."""
    from citeweave.llm.sharding import shard_documents
    placed = shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@register
def op3_tokeniser_fertility(spark, sf_dir):
    """Base counts and tokeniser-fertility verdict of all documents."""
    from citeweave.llm.fertility import quality_rules
    q = quality_rules(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "n_tokens", "n_byte_tokens", "chars_per_token", "byte_share",
                    "token_entropy")


@register
def op4_document_fingerprints(spark, sf_dir):
    """Winnowed fingerprints of all documents and of their edited texts."""
    from citeweave.llm.winnowing import fingerprint_documents
    return fingerprint_documents(table(spark, sf_dir, "documents"))


@register
def op5_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate groups of all documents on 4-word shingles."""
    from citeweave.llm.minhash_dedup import near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@register
def op6_sentencepiece(spark, sf_dir):
    """Piece ids of all documents, decoded again and compared with the text."""
    from citeweave.llm.sentencepiece_fst import decode, encode
    coded = decode(encode(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.crc32("decoded").alias("decoded_crc32"),
                        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


@register
def op7_toxicity(spark, sf_dir):
    """Category probabilities of all documents by a classifier chain."""
    from citeweave.llm.toxicity import THRESHOLD, toxicity
    p = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return p.withColumn("toxic", F.col("p_toxic") >= THRESHOLD)


@register
def op8_quality_classifier(spark, sf_dir):
    """Expected grade, tail probabilities and selection of all documents."""
    from citeweave.llm.ordinal import quality, rated
    return quality(table(spark, sf_dir, "documents"), rated(table(spark, sf_dir, "labels")))


@register
def op9_lm_scoring(spark, sf_dir):
    """Base and PPM log10 probability of all documents, learnt from those whose
    crc32(doc_id) mod 7 is not 2."""
    from citeweave.llm.ppm import score_documents
    return score_documents(table(spark, sf_dir, "documents"))


@register
def op10_mixing(spark, sf_dir):
    """Mix of all documents to source weights 3, 1, 2 at 150% of all words."""
    from citeweave.llm.mixing import mix
    m = mix(table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0)
    return m.select("doc_id", "size", "source_size", "target", "taken")


@register
def op11_source_audit(spark, sf_dir):
    """Differences of the sources of each language, and each source's own terms."""
    from citeweave.llm.source_audit import audit
    return audit(table(spark, sf_dir, "documents"), least_docs=10, top=10)


@register
def op12_ngram_join(spark, sf_dir):
    """Groups of all documents linked by word 5-gram Jaccard of 0.8 or more."""
    from citeweave.llm.ngram_join import ngram_join
    return ngram_join(table(spark, sf_dir, "documents"), shingle=5, percent=80)


@register
def op13_spelling_variants(spark, sf_dir):
    """Words of all documents with their near words and most frequent form."""
    from citeweave.llm.spelling import runs_of, variant_groups, vocabulary
    runs = runs_of(table(spark, sf_dir, "documents"), least_length=6, thinned=199)
    return variant_groups(vocabulary(runs, least_length=6, least_count=5), times=5)


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

ORACLE["op10_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len({_WORDS}), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_value(3.0, 1.0, 2.0)[1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 2.0 * source_size AS cap, row_number() OVER o AS k,
         coalesce(sum(2.0 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS fixed,
         (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
         1.5 * sum(source_size) OVER () AS budget
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST)),
lv AS (
  SELECT ((budget - fixed) / rest)::DOUBLE AS level FROM r
  WHERE cap > w * ((budget - fixed) / rest)::DOUBLE ORDER BY k LIMIT 1),
t AS (
  SELECT s.source, s.source_size,
         least(2.0 * s.source_size, s.w * (SELECT level FROM lv))::DOUBLE AS target FROM s),
x AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + CASE
          WHEN upto <= target - whole * source_size THEN size
          WHEN upto - size <= target - whole * source_size
               AND 2 * (target - whole * source_size - upto + size) >= size THEN size
          ELSE 0 END)::BIGINT AS taken
FROM x"""

ORACLE["op5_minhash_near_dedup"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS t FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(t) = 0 OR t IS NULL THEN []
                               WHEN len(t) < 4 THEN [list_aggregate(t, 'string_agg', ' ')]
                               ELSE list_transform(range(1, len(t) - 2),
                                                   lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3]) END) AS s
    FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id"""



def _linked(k: int) -> str:
    """Documents, their sets of k-word shingles and the smallest id linked with each."""
    join = " || ' ' || ".join(f"t[i + {j}]" for j in range(k))
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS t FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(t) = 0 OR t IS NULL THEN []
                               WHEN len(t) < {k} THEN [list_aggregate(t, 'string_agg', ' ')]
                               ELSE list_transform(range(1, len(t) - {k - 2}), lambda i: {join}) END) AS s
    FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
"""


ORACLE["op12_ngram_join"] = _linked(5) + """
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id"""

ORACLE["op11_source_audit"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
w AS (SELECT row, lang, source, unnest(t) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
  FROM cells JOIN v USING (lang)),
q AS (
  SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY ALL) JOIN v USING (lang)),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10"""

ORACLE["op13_spelling_variants"] = """
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
    list_prepend(b, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents),
k AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= 6 GROUP BY ALL),
h AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
           string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
           lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195, ord(x)::BIGINT - 64] END))),
         lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h
  FROM k, tab),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2)
                   ELSE w END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.less
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.less),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(near.near, (-w.n, near.near)) AS form, max(w.n) AS form_n
  FROM near JOIN words w ON w.word = near.near GROUP BY near.word),
f AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN form_n >= 5 * words.n THEN form END AS form, CASE WHEN form_n >= 5 * words.n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at, form AS onward FROM f
  UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.onward)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM f JOIN walk ON walk.word = f.word AND walk.onward IS NULL"""
