"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each statement runs on the driver's pre-registered views.  ``WORKS`` is the
same stand-in corpus as ``citeweave.sources.tables.works_from_documents``.
"""

from __future__ import annotations

WORKS = """
works AS (
  SELECT 'W' || CAST(doc_id AS VARCHAR) AS oa_id,
         CASE WHEN doc_id % 10 = 3 THEN NULL
              ELSE '10.1000/' || lower(source) || '.' || CAST(n_chars % 997 AS VARCHAR) END AS doi,
         split_part(text, chr(10), 1) AS title,
         CAST(1920 + doc_id % 105 AS BIGINT) AS publication_year,
         CAST(n_chars % 200 AS BIGINT) AS cited_by_count,
         text AS abstract,
         list_transform(
           list_filter([doc_id - 1, doc_id - 2, CASE WHEN doc_id % 7 = 0 THEN doc_id - 105 END,
                        doc_id - 37, doc_id + 10000000], lambda x: x >= 0),
           lambda x: 'W' || CAST(x AS VARCHAR)) AS referenced_works,
         lang AS "domain", source AS field, source || '/' || lang AS subfield,
         source || '-' || lang AS topic, CAST(doc_id % 3 AS BIGINT) AS layer
  FROM documents)"""

DECADE = "CAST(floor(publication_year / 10) * 10 AS BIGINT)"

# (oa_id, decade, pos, ref) of references whose target is in the same decade
HITS = f"""
refs AS (
  SELECT oa_id, {DECADE} AS decade,
         unnest(referenced_works) AS ref,
         generate_subscripts(referenced_works, 1) AS pos
  FROM works WHERE publication_year BETWEEN 1920 AND 2029),
targets AS (
  SELECT oa_id AS ref, {DECADE} AS decade FROM works
  WHERE publication_year BETWEEN 1920 AND 2029),
hits AS (
  SELECT r.oa_id, r.decade, r.pos, r.ref FROM refs r
  JOIN targets t ON t.ref = r.ref AND t.decade = r.decade),
hit_lists AS (
  SELECT oa_id, list(ref ORDER BY pos) AS refs FROM hits GROUP BY oa_id),
idr AS (
  SELECT w.oa_id, {DECADE.replace('publication_year', 'w.publication_year')} AS decade,
         coalesce(h.refs, []::VARCHAR[]) AS in_decade_references
  FROM works w LEFT JOIN hit_lists h ON h.oa_id = w.oa_id)"""

ORACLE: dict[str, str] = {}

ORACLE["in_decade_refs"] = f"""
WITH {WORKS}, {HITS}
SELECT oa_id, decade, in_decade_references FROM idr"""

ORACLE["citation_edges"] = f"""
WITH {WORKS}, {HITS}
SELECT DISTINCT oa_id AS from_id, ref AS to_id, decade AS decade_start FROM hits"""

ORACLE["decade_scan"] = f"""
WITH {WORKS}, {HITS}
SELECT w.oa_id, i.in_decade_references, w.publication_year, w.referenced_works
FROM works w JOIN idr i ON i.oa_id = w.oa_id
WHERE w.publication_year BETWEEN 1970 AND 1979"""

ORACLE["decade_histogram"] = f"""
WITH {WORKS}
SELECT decade, n_works,
       CAST(decade AS VARCHAR) || '-' || CAST(decade + 9 AS VARCHAR) AS decade_label,
       format('{{:,}}', n_works) AS n_works_fmt
FROM (SELECT {DECADE} AS decade, count(*) AS n_works FROM works
      WHERE layer = 0 AND publication_year IS NOT NULL GROUP BY 1)"""

ORACLE["missing_year"] = f"""
WITH {WORKS}
SELECT count(*) AS n_total, count(*) FILTER (WHERE publication_year IS NULL) AS n_missing_year
FROM works WHERE layer = 0"""

RAW = """
raw AS (
  SELECT doc_id,
         'https://works.example.org/W' || CAST(doc_id AS VARCHAR) AS id,
         CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 10 = 7 THEN '   '
              ELSE '  HTTPS://DOI.ORG/10.1000/' || upper(source) || '.'
                   || CAST(n_chars % 997 AS VARCHAR) || ' ' END AS doi,
         CASE WHEN doc_id % 13 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS title,
         CAST(1920 + doc_id % 105 AS BIGINT) AS publication_year,
         CAST(n_chars % 200 AS BIGINT) AS cited_by_count,
         list_concat(
           list_transform(
             list_filter([doc_id - 1, doc_id - 2, CASE WHEN doc_id % 7 = 0 THEN doc_id - 105 END,
                          doc_id - 37, doc_id + 10000000], lambda x: x >= 0),
             lambda x: 'https://works.example.org/W' || CAST(x AS VARCHAR)),
           CASE WHEN doc_id % 11 = 0 THEN [''] ELSE []::VARCHAR[] END) AS referenced_works,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE lang END AS "domain",
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE source END AS field,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE source || '/' || lang END AS subfield,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE source || '-' || lang END AS topic
  FROM documents),
raw_words AS (
  SELECT doc_id, unnest(string_split(text, ' ')) AS word,
         generate_subscripts(string_split(text, ' '), 1) - 1 AS pos
  FROM documents),
inverted AS (
  SELECT doc_id, word, list(pos) AS positions FROM raw_words GROUP BY doc_id, word),
rebuilt AS (
  SELECT doc_id,
         nullif(regexp_replace(string_agg(word, ' ' ORDER BY pos), '^\\s+|\\s+$', '', 'g'), '')
           AS abstract
  FROM (SELECT doc_id, word, unnest(positions) AS pos FROM inverted)
  GROUP BY doc_id),
normalized AS (
  SELECT coalesce(CASE WHEN contains(r.id, '/') THEN string_split(r.id, '/')[-1] ELSE r.id END, '')
           AS oa_id,
         nullif(lower(regexp_replace(r.doi, '^\\s+|\\s+$', '', 'g')), '') AS doi,
         CASE WHEN r.title IS NULL OR r.title = '' THEN NULL
              ELSE regexp_replace(regexp_replace(lower(r.title), '\\s+', ' ', 'g'),
                                  '^\\s+|\\s+$', '', 'g') END AS title,
         r.publication_year, r.cited_by_count, b.abstract,
         list_transform(list_filter(r.referenced_works, lambda x: x IS NOT NULL AND x <> ''),
                        lambda x: CASE WHEN contains(x, '/') THEN string_split(x, '/')[-1]
                                       ELSE x END) AS referenced_works,
         r."domain", r.field, r.subfield, r.topic
  FROM raw r LEFT JOIN rebuilt b ON b.doc_id = r.doc_id)"""

ORACLE["normalize_ids"] = f"""
WITH {RAW}
SELECT * FROM normalized"""

ORACLE["fill_rate_subfield"] = f"""
WITH {RAW}
SELECT count(nullif(subfield, '')) AS n_filled, count(*) AS n_rows,
       round(count(nullif(subfield, '')) / count(*), 9) AS fill_rate
FROM normalized"""

MERGED = """CASE WHEN abstract IS NOT NULL AND title IS NOT NULL THEN title || chr(10) || abstract
            WHEN abstract IS NOT NULL THEN abstract ELSE title END"""

ORACLE["merge_text"] = f"""
WITH {WORKS}
SELECT oa_id, {MERGED} AS text FROM works"""


def _clean(x: str) -> str:
    from citeweave.functions import text as tx
    steps = [(tx.ZERO_WIDTH, ""), (tx.LATEX_MATH, " "), (tx.LATEX_COMMAND, " "),
             (tx.MATH_SYMBOLS, " "), (tx.REPEATED_OPERATORS, " "), (tx.NOT_KEPT, " "),
             (tx.WHITESPACE_RUN, " ")]
    for pat, rep in steps:
        x = f"regexp_replace({x}, '{pat}', '{rep}', 'g')"
    return f"trim({x})"


ORACLE["clean_text"] = f"""
WITH {WORKS},
cleaned AS (
  SELECT oa_id, {DECADE} AS decade, {_clean(f"lower({MERGED})")} AS clean
  FROM works WHERE ({MERGED}) IS NOT NULL)
SELECT oa_id, decade, clean, CAST(len(string_split(clean, ' ')) AS BIGINT) AS n_tokens
FROM cleaned"""

EDGES_DEC = """
simple AS (SELECT DISTINCT decade, oa_id AS src, ref AS dst FROM hits),
ends AS (SELECT decade, src AS node, 1 AS o, 0 AS i FROM simple
         UNION ALL SELECT decade, dst AS node, 0 AS o, 1 AS i FROM simple),
deg AS (SELECT decade, node, CAST(sum(i) AS BIGINT) AS in_degree,
               CAST(sum(o) AS BIGINT) AS out_degree FROM ends GROUP BY decade, node)"""

ORACLE["degree"] = f"""
WITH {WORKS}, {HITS}, {EDGES_DEC}
SELECT * FROM deg"""

ORACLE["sinks_sources"] = f"""
WITH {WORKS}, {HITS}, {EDGES_DEC}
SELECT decade, count(*) AS n_nodes, count(*) FILTER (WHERE out_degree = 0) AS n_sinks,
       count(*) FILTER (WHERE in_degree = 0) AS n_sources
FROM deg GROUP BY decade"""

ORACLE["top_topics"] = f"""
WITH {WORKS}, {HITS}, {EDGES_DEC},
counts AS (
  SELECT d.decade, coalesce(w.topic, 'None') AS value, count(*) AS n
  FROM deg d LEFT JOIN works w ON w.oa_id = d.node GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY decade ORDER BY n DESC, value ASC) AS rank
  FROM counts)
SELECT decade, value, n, rank FROM ranked WHERE rank <= 30"""

ORACLE["ref_membership"] = f"""
WITH {WORKS},
refs AS (SELECT {DECADE} AS decade, unnest(referenced_works) AS ref FROM works)
SELECT r.decade, (w.oa_id IS NOT NULL) AS in_corpus, count(*) AS n_refs
FROM refs r LEFT JOIN works w ON w.oa_id = r.ref GROUP BY 1, 2"""

NORM_TITLE = """CASE WHEN {t} IS NULL OR {t} = '' THEN NULL
     ELSE nullif(trim(regexp_replace(lower({t}), '\\s+', ' ', 'g')), '') END"""


def d1_sql(src: str, out: str) -> str:
    """CTEs computing the three-key greedy dedupe of CTE ``src`` (columns
    seq, oa_id, doi, title) as rounds of a recursive CTE; ``out`` holds the
    kept ``seq`` values."""
    t = NORM_TITLE.format(t="title")
    return f"""
{out}_keys AS (
  SELECT seq, kind, value FROM (
    SELECT seq, 'doi' AS kind, nullif(lower(trim(doi)), '') AS value FROM {src}
    UNION ALL SELECT seq, 'id', nullif(oa_id, '') FROM {src}
    UNION ALL SELECT seq, 'title', {t} FROM {src}) WHERE value IS NOT NULL),
{out}_state(it, seq, kind, value, status) AS (
  SELECT 0, seq, kind, value, 'U' FROM {out}_keys
  UNION ALL
  SELECT it + 1, seq, kind, value, CASE WHEN win THEN 'K' ELSE 'U' END FROM (
    SELECT *, bool_or(claimed) OVER (PARTITION BY seq) AS lost FROM (
      SELECT *, bool_or(win AND seq = first) OVER (PARTITION BY kind, value) AS claimed FROM (
        SELECT *, bool_and(seq = first) OVER (PARTITION BY seq) AS win FROM (
          SELECT it, seq, kind, value, min(seq) OVER (PARTITION BY kind, value) AS first
          FROM {out}_state WHERE status = 'U'))))
  WHERE win OR NOT lost),
{out} AS (
  SELECT DISTINCT seq FROM {out}_state WHERE status = 'K'
  UNION SELECT seq FROM {src} WHERE seq NOT IN (SELECT seq FROM {out}_keys))"""


ORACLE["dedupe3"] = f"""
WITH RECURSIVE {WORKS},
d_src AS (SELECT struct_pack(layer := layer, oa_id := oa_id) AS seq, * FROM works),
{d1_sql("d_src", "d_kept")}
SELECT oa_id, doi, title, layer FROM d_src WHERE seq IN (SELECT seq FROM d_kept)"""


def keys_sql(src: str) -> str:
    t = NORM_TITLE.format(t="title")
    return f"""(SELECT kind, value FROM (
    SELECT 'doi' AS kind, nullif(lower(trim(doi)), '') AS value FROM {src}
    UNION ALL SELECT 'id', nullif(oa_id, '') FROM {src}
    UNION ALL SELECT 'title', {t} FROM {src}) WHERE value IS NOT NULL)"""


def _blocked(src: str, kept: str) -> str:
    """rows of ``src`` holding none of the keys of ``kept``"""
    t = NORM_TITLE.format(t="s.title")
    return f"""(SELECT s.* FROM {src} s WHERE NOT EXISTS (
    SELECT 1 FROM {keys_sql(kept)} k WHERE
      (k.kind = 'doi' AND k.value = nullif(lower(trim(s.doi)), '')) OR
      (k.kind = 'id' AND k.value = nullif(s.oa_id, '')) OR
      (k.kind = 'title' AND k.value = {t})))"""


def _phrase(p: str) -> str:
    return (f"(coalesce(instr(lower(title), '{p}') > 0, false) OR "
            f"coalesce(instr(lower(abstract), '{p}') > 0, false))")


def _citing(frontier: str, min_c: int, year_gt: int) -> str:
    return f"""(SELECT oa_id AS seq, w.* FROM works w
    WHERE w.cited_by_count > {min_c} AND w.publication_year > {year_gt}
      AND EXISTS (SELECT 1 FROM (SELECT unnest(w.referenced_works) AS ref) r
                  WHERE r.ref IN (SELECT oa_id FROM {frontier})))"""


def _growth_sql() -> dict[str, str]:
    from citeweave.plans.queries import (HOP_MIN_CITATIONS, HOP_YEAR_GT, SEARCH_TERM,
                                         SEED_MIN_CITATIONS, SEED_YEAR_GT)
    seeds = f"""
s_src AS (SELECT oa_id AS seq, * FROM works
          WHERE {_phrase(SEARCH_TERM)} AND cited_by_count > {SEED_MIN_CITATIONS}
            AND publication_year > {SEED_YEAR_GT}),
{d1_sql("s_src", "s_kept")},
seeds AS (SELECT * EXCLUDE (seq) FROM s_src WHERE seq IN (SELECT seq FROM s_kept))"""
    hop1 = f"""
h1_src AS {_blocked(_citing("seeds", HOP_MIN_CITATIONS, HOP_YEAR_GT), "seeds")},
{d1_sql("h1_src", "h1_kept")},
hop1 AS (SELECT * EXCLUDE (seq) FROM h1_src WHERE seq IN (SELECT seq FROM h1_kept)),
kept1 AS (SELECT * FROM seeds UNION ALL SELECT * FROM hop1)"""
    hop2 = f"""
h2_src AS {_blocked(_citing("hop1", HOP_MIN_CITATIONS, HOP_YEAR_GT), "kept1")},
{d1_sql("h2_src", "h2_kept")},
hop2 AS (SELECT * EXCLUDE (seq) FROM h2_src WHERE seq IN (SELECT seq FROM h2_kept))"""
    cols = "oa_id, doi, title, publication_year, cited_by_count"
    return {
        "seed_search": f"WITH RECURSIVE {WORKS}, {seeds}\nSELECT {cols} FROM seeds",
        "citing_semijoin": f"""WITH RECURSIVE {WORKS}, {seeds}
SELECT {cols} FROM {_citing("seeds", HOP_MIN_CITATIONS, HOP_YEAR_GT)}""",
        "expand_khop": f"""WITH RECURSIVE {WORKS}, {seeds}, {hop1}, {hop2}
SELECT {cols}, CAST(0 AS BIGINT) AS layer FROM seeds
UNION ALL SELECT {cols}, CAST(1 AS BIGINT) FROM hop1
UNION ALL SELECT {cols}, CAST(2 AS BIGINT) FROM hop2""",
    }


ORACLE.update(_growth_sql())


def _bins_values() -> str:
    from citeweave.schema import DEFAULT_BINS
    rows = ", ".join(f"({b[0]}, {d})" for b in DEFAULT_BINS for d in b)
    return f"bins(bin, decade) AS (SELECT CAST(c1 AS BIGINT), CAST(c2 AS BIGINT) FROM (VALUES {rows}) v(c1, c2))"


REPORT = f"""
{_bins_values()},
members_all AS (
  SELECT b.bin, w.oa_id,
         CAST(floor(CAST(substr(w.oa_id, 2) AS BIGINT) / 105) * 10 + (b.decade - b.bin) / 10 AS BIGINT)
           AS cluster
  FROM works w JOIN bins b ON b.decade = {DECADE.replace('publication_year', 'w.publication_year')}),
sizes AS (SELECT bin, cluster, count(*) AS elements FROM members_all GROUP BY 1, 2),
sel AS (SELECT bin, cluster, elements FROM (
          SELECT *, row_number() OVER (PARTITION BY bin ORDER BY elements DESC, cluster ASC) AS r
          FROM sizes) WHERE r <= 10 AND elements > 5),
mem AS (SELECT m.* FROM members_all m JOIN sel s USING (bin, cluster)),
dist AS (
  SELECT bin, cluster, kind, value, n,
         round(n / sum(n) OVER (PARTITION BY bin, cluster, kind), 9) AS share FROM (
    SELECT bin, cluster, kind, value, count(*) AS n FROM (
      SELECT m.bin, m.cluster, 'field' AS kind, w.field AS value FROM mem m JOIN works w USING (oa_id)
      UNION ALL SELECT m.bin, m.cluster, 'domain', w."domain" FROM mem m JOIN works w USING (oa_id)
      UNION ALL SELECT m.bin, m.cluster, 'topic', w.topic FROM mem m JOIN works w USING (oa_id))
    WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4)),
dom AS (
  SELECT bin, cluster, value AS dominant_field, share AS dominant_share FROM (
    SELECT *, row_number() OVER (PARTITION BY bin, cluster ORDER BY share DESC, value ASC) AS r
    FROM dist WHERE kind = 'field') WHERE r = 1),
cc AS (SELECT bin, cluster, ref, count(*) AS n FROM (
         SELECT m.bin, m.cluster, unnest(w.referenced_works) AS ref
         FROM mem m JOIN works w USING (oa_id)) GROUP BY 1, 2, 3),
hit AS (SELECT c.*, t.bin AS dst_bin, t.cluster AS dst_cluster
        FROM cc c LEFT JOIN mem t ON t.oa_id = c.ref),
links AS (SELECT bin, cluster, dst_bin, dst_cluster, CAST(sum(n) AS BIGINT) AS links FROM hit
          WHERE dst_cluster IS NOT NULL AND NOT (dst_bin = bin AND dst_cluster = cluster)
          GROUP BY 1, 2, 3, 4),
weights AS (
  SELECT l.*, s.elements AS src_elements, d.elements AS dst_elements,
         round(l.links / (s.elements * d.elements), 9) AS weight
  FROM links l JOIN sel s ON s.bin = l.bin AND s.cluster = l.cluster
  JOIN sel d ON d.bin = l.dst_bin AND d.cluster = l.dst_cluster)"""

ORACLE["cluster_sizes"] = f"WITH {WORKS}, {REPORT}\nSELECT * FROM sizes"
ORACLE["topn_clusters"] = f"WITH {WORKS}, {REPORT}\nSELECT * FROM sel"
ORACLE["distributions"] = f"WITH {WORKS}, {REPORT}\nSELECT * FROM dist"
ORACLE["dominant_field"] = f"WITH {WORKS}, {REPORT}\nSELECT * FROM dom"
ORACLE["link_counts"] = f"WITH {WORKS}, {REPORT}\nSELECT * FROM links"
ORACLE["link_weights"] = f"WITH {WORKS}, {REPORT}\nSELECT * FROM weights"
ORACLE["self_citation_share"] = f"""WITH {WORKS}, {REPORT},
per AS (SELECT bin, cluster,
               sum(CASE WHEN dst_bin = bin AND dst_cluster = cluster THEN n ELSE 0 END) AS intra,
               sum(n) AS total FROM hit GROUP BY 1, 2)
SELECT s.bin, s.cluster, CAST(coalesce(intra, 0) AS BIGINT) AS intra_citations,
       CAST(coalesce(total, 0) AS BIGINT) AS total_citations,
       CASE WHEN coalesce(total, 0) > 0 THEN round(intra / total, 9) ELSE 0.0 END
         AS intracluster_link_ratio
FROM sel s LEFT JOIN per p USING (bin, cluster)"""
ORACLE["layout"] = f"""WITH {WORKS}, {REPORT},
ranks AS (SELECT value AS field, row_number() OVER (ORDER BY value) - 1 AS field_rank
          FROM (SELECT DISTINCT value FROM dist WHERE kind = 'field')),
nodes AS (
  SELECT s.*, d.dominant_field, r.field_rank,
         coalesce(r.field_rank, (SELECT count(*) FROM ranks) + 1) AS sort_rank
  FROM sel s LEFT JOIN dom d USING (bin, cluster) LEFT JOIN ranks r ON r.field = d.dominant_field)
SELECT CAST(bin AS VARCHAR) || '-' || CAST(cluster AS VARCHAR) AS node_id, bin, cluster, elements,
       dominant_field, CAST(sort_rank AS BIGINT) AS sort_rank, CAST(bin AS DOUBLE) AS x,
       round(CAST(row_number() OVER (PARTITION BY bin ORDER BY sort_rank, elements DESC, cluster) - 1
                  AS DOUBLE) * 1.4, 9) AS y,
       round(100 * ln(greatest(elements * 35, 1)), 9) AS display_size,
       CAST(field_rank % 20 AS BIGINT) AS palette_slot, field_rank IS NULL AS grey,
       CAST(cluster AS VARCHAR) AS label
FROM nodes"""
ORACLE["evolution_edges"] = f"""WITH {WORKS}, {REPORT}
SELECT CAST(bin AS VARCHAR) || '-' || CAST(cluster AS VARCHAR) AS src,
       CAST(dst_bin AS VARCHAR) || '-' || CAST(dst_cluster AS VARCHAR) AS dst,
       weight, round(100 * weight, 9) AS width
FROM weights"""
# read back from the saved document
ORACLE["report_layout"] = ORACLE["layout"]
ORACLE["report_evolution_edges"] = ORACLE["evolution_edges"]
ORACLE["report_distributions"] = f"SELECT bin, cluster, kind, value, share FROM ({ORACLE['distributions']})"
ORACLE["bin_network"] = f"""WITH {WORKS}, {REPORT}
SELECT b.bin, w.oa_id AS id, coalesce(w.topic, '') AS topic, coalesce(w.field, '') AS field,
       coalesce(w."domain", '') AS "domain", CAST(coalesce(m.cluster, -1) AS BIGINT) AS cluster
FROM works w JOIN bins b ON b.decade = {DECADE.replace('publication_year', 'w.publication_year')}
LEFT JOIN mem m ON m.bin = b.bin AND m.oa_id = w.oa_id"""
ORACLE["bin_network_edges"] = f"""WITH {WORKS}, {HITS}, {_bins_values()}
SELECT DISTINCT b.bin, h.oa_id AS src, h.ref AS dst FROM hits h JOIN bins b ON b.decade = h.decade"""


def phrase_pass_sql(p: str, toks: str) -> str:
    """CTEs of one phrase pass over CTE ``toks`` (oa_id, tokens): ``{p}_phr``
    holds the learned phrases, ``{p}_out`` the rewritten (oa_id, tokens)."""
    return f"""
{p}_tok1 AS (SELECT oa_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) - 1 AS pos
             FROM {toks}),
{p}_pairs AS (SELECT a.oa_id, a.pos, a.t AS a, b.t AS b FROM {p}_tok1 a
              JOIN {p}_tok1 b ON b.oa_id = a.oa_id AND b.pos = a.pos + 1),
{p}_vocab AS (SELECT k, count(*) AS n FROM (
                SELECT t AS k FROM {p}_tok1 UNION ALL SELECT a || '_' || b FROM {p}_pairs)
              GROUP BY k),
{p}_cand AS (SELECT DISTINCT a, b, a || '_' || b AS phrase FROM {p}_pairs),
{p}_scored AS (
  SELECT c.a, c.b, c.phrase, vab.n AS n_ab, va.n AS n_a, vb.n AS n_b,
         (vab.n - 5) / (va.n * vb.n) * (SELECT count(*) FROM {p}_vocab) AS score
  FROM {p}_cand c JOIN {p}_vocab vab ON vab.k = c.phrase JOIN {p}_vocab va ON va.k = c.a
  JOIN {p}_vocab vb ON vb.k = c.b WHERE vab.n > 5),
{p}_phr AS (SELECT a, b, phrase, n_ab, n_a, n_b, round(score, 9) AS score
            FROM {p}_scored WHERE score > 10),
{p}_hits AS (SELECT x.oa_id, x.pos, ph.phrase FROM {p}_pairs x
             JOIN {p}_phr ph ON ph.a = x.a AND ph.b = x.b),
{p}_runs AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY oa_id ORDER BY pos) <> pos - 1, true)
               AS st FROM {p}_hits),
{p}_runs2 AS (SELECT *, max(CASE WHEN st THEN pos END) OVER (
                PARTITION BY oa_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                AS rs FROM {p}_runs),
{p}_kept AS (SELECT oa_id, pos, phrase FROM {p}_runs2 WHERE (pos - rs) % 2 = 0),
{p}_marked AS (
  SELECT t.oa_id, t.pos,
         CASE WHEN k.phrase IS NOT NULL THEN k.phrase WHEN k2.pos IS NOT NULL THEN NULL
              ELSE t.t END AS tok
  FROM {p}_tok1 t LEFT JOIN {p}_kept k ON k.oa_id = t.oa_id AND k.pos = t.pos
  LEFT JOIN {p}_kept k2 ON k2.oa_id = t.oa_id AND k2.pos = t.pos - 1),
{p}_out AS (
  SELECT x.oa_id, coalesce(y.tokens, []::VARCHAR[]) AS tokens FROM {toks} x LEFT JOIN (
    SELECT oa_id, list(tok ORDER BY pos) AS tokens FROM {p}_marked
    WHERE tok IS NOT NULL AND tok <> '' GROUP BY oa_id) y ON y.oa_id = x.oa_id)"""


CORPUS = f"""
cleaned AS (
  SELECT oa_id, {_clean(f"lower({MERGED})")} AS clean
  FROM works WHERE ({MERGED}) IS NOT NULL),
toks AS (SELECT oa_id, string_split(clean, ' ') AS tokens FROM cleaned)"""

ORACLE["phrases"] = f"""WITH {WORKS}, {CORPUS}, {phrase_pass_sql("b1", "toks")}
SELECT * FROM b1_phr"""
ORACLE["phrase_apply"] = f"""WITH {WORKS}, {CORPUS}, {phrase_pass_sql("b1", "toks")}
SELECT * FROM b1_out"""
ORACLE["trigram_phrases"] = f"""WITH {WORKS}, {CORPUS}, {phrase_pass_sql("b1", "toks")},
{phrase_pass_sql("b2", "b1_out")}
SELECT * FROM b2_phr"""

ORACLE["vector_topk"] = """
WITH dims AS (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
cent AS (
  SELECT label AS query, list(m ORDER BY d) AS qv FROM (
    SELECT label, d, avg(CAST(x AS DOUBLE)) AS m FROM dims GROUP BY label, d) GROUP BY label),
vecs AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
scored AS (
  SELECT c.query, e.vec_id,
         round(list_sum(list_transform(list_zip(e.v, c.qv), lambda p: p[1] * p[2]))
               / (sqrt(list_sum(list_transform(e.v, lambda a: a * a)))
                  * sqrt(list_sum(list_transform(c.qv, lambda a: a * a)))), 9) AS similarity
  FROM vecs e, cent c
  WHERE list_sum(list_transform(e.v, lambda a: a * a)) > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id ASC) AS rank
  FROM scored)
SELECT query, vec_id, similarity, rank FROM ranked WHERE rank <= 20"""

ORACLE["embedding_neighbours"] = """
WITH vecs AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
sized AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda a: a * a))) AS n FROM vecs),
scored AS (
  SELECT q.vec_id AS query, e.vec_id,
         round(list_sum(list_transform(list_zip(e.v, q.v), lambda p: p[1] * p[2])) / (e.n * q.n), 9) AS similarity
  FROM sized e, sized q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id AND e.n > 0 AND q.n > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id ASC) AS rank FROM scored)
SELECT query, vec_id, similarity, rank FROM ranked WHERE rank <= 20"""

ORACLE["modularity_of_partition"] = f"""
WITH {WORKS}, {HITS}, {REPORT},
e AS (SELECT b.bin, h.oa_id AS src, h.ref AS dst FROM hits h JOIN bins b ON b.decade = h.decade),
ms AS (SELECT e.*, a.cluster AS cs, d.cluster AS cd FROM e
       JOIN members_all a ON a.bin = e.bin AND a.oa_id = e.src
       JOIN members_all d ON d.bin = e.bin AND d.oa_id = e.dst),
tot AS (SELECT bin, count(*) AS m, count(*) FILTER (WHERE cs = cd) AS inside FROM ms GROUP BY bin),
kc AS (SELECT bin, cluster, sum(ko) AS ko, sum(ki) AS ki FROM (
         SELECT bin, cs AS cluster, 1 AS ko, 0 AS ki FROM ms
         UNION ALL SELECT bin, cd, 0, 1 FROM ms) GROUP BY bin, cluster),
kk AS (SELECT bin, sum(ko * ki) AS kk FROM kc GROUP BY bin)
SELECT t.bin, round(t.inside / t.m - k.kk / (t.m * t.m), 9) AS modularity
FROM tot t JOIN kk k USING (bin)"""

ORACLE["phrase_index_search"] = f"""
WITH {WORKS},
p AS (SELECT DISTINCT lower(substr(title, 1, 9)) AS phrase FROM (SELECT title FROM works ORDER BY oa_id LIMIT 10))
SELECT p.phrase, w.oa_id FROM works w JOIN p
  ON contains(lower(coalesce(w.title, '')), p.phrase) OR contains(lower(coalesce(w.abstract, '')), p.phrase)"""

ORACLE["leiden_check"] = f"""
WITH {WORKS}, {HITS}, {REPORT},
e AS (SELECT b.bin, h.oa_id AS src, h.ref AS dst FROM hits h JOIN bins b ON b.decade = h.decade),
n AS (SELECT bin, src AS node FROM e UNION SELECT bin, dst FROM e)
SELECT bin, count(*) AS nodes, count(*) AS members, true AS reaches_planted FROM n GROUP BY bin"""

ORACLE["sbm_check"] = f"""
WITH {WORKS}, {HITS}, {REPORT},
e AS (SELECT b.bin, h.oa_id AS src, h.ref AS dst FROM hits h JOIN bins b ON b.decade = h.decade),
n AS (SELECT bin, src AS node FROM e UNION SELECT bin, dst FROM e)
SELECT bin, count(*) AS nodes, count(*) AS members, true AS within_one, true AS within_planted
FROM n GROUP BY bin"""

ORACLE["append_new_only"] = f"""
WITH {WORKS}, {RAW},
batch AS (SELECT oa_id, title, publication_year, 0 AS src FROM works
          UNION ALL SELECT oa_id, title, publication_year, 1 FROM normalized),
firsts AS (SELECT oa_id, title, publication_year FROM (
             SELECT *, row_number() OVER (PARTITION BY oa_id ORDER BY src) AS r FROM batch)
           WHERE r = 1)
SELECT f.* FROM firsts f WHERE f.oa_id NOT IN (
  SELECT oa_id FROM works WHERE publication_year < 1980)"""

ORACLE["update_from"] = f"""
WITH {WORKS}, {RAW}
SELECT w.oa_id, CASE WHEN n.oa_id IS NOT NULL THEN n.subfield ELSE w.subfield END AS subfield
FROM works w LEFT JOIN (SELECT * FROM normalized WHERE publication_year >= 1950) n
  ON n.oa_id = w.oa_id"""

ORACLE["enrich_left"] = f"""
WITH {WORKS}, {RAW}
SELECT w.oa_id, w.publication_year, n.topic AS api_topic
FROM works w LEFT JOIN (SELECT * FROM normalized WHERE publication_year >= 1950) n
  ON n.oa_id = w.oa_id"""

ORACLE["docs_per_decade"] = f"""
WITH {WORKS}
SELECT {DECADE} AS decade, count(*) AS n_docs FROM works WHERE ({MERGED}) IS NOT NULL GROUP BY 1"""

ORACLE["field_ranks"] = f"""
WITH {WORKS}, {REPORT}
SELECT field, field_rank, field_rank % 20 AS palette_slot FROM (
  SELECT value AS field, CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS field_rank
  FROM (SELECT DISTINCT value FROM dist WHERE kind = 'field'))"""

ORACLE["dominant_fields_set"] = f"""
WITH {WORKS}, {REPORT}
SELECT DISTINCT dominant_field AS field FROM dom"""

ORACLE["batches"] = f"""
WITH {WORKS}
SELECT oa_id, CAST(floor((row_number() OVER (ORDER BY oa_id) - 1) / 100) AS BIGINT) AS batch
FROM works"""

ORACLE["csv_roundtrip"] = f"""
WITH {WORKS}
SELECT oa_id, nullif(doi, '') AS doi, nullif(title, '') AS title, publication_year,
       nullif(abstract, '') AS abstract, referenced_works, nullif(topic, '') AS topic
FROM works"""

ORACLE["decade_scan_sql"] = f"""
WITH {WORKS}
SELECT oa_id, publication_year, cited_by_count FROM works
WHERE publication_year BETWEEN 1950 AND 1959 AND cited_by_count > 100"""


def _fetch_sql() -> str:
    seeds_cte = ORACLE["seed_search"].split("\nSELECT oa_id, doi, title, publication_year, cited_by_count FROM seeds")[0]
    return f"""{seeds_cte},
cited AS (SELECT DISTINCT unnest(referenced_works) AS oa_id FROM seeds)
SELECT w.oa_id, w.doi, w.publication_year FROM works w
WHERE w.oa_id IN (SELECT oa_id FROM cited) AND w.doi IS NOT NULL"""


ORACLE["fetch_cited_by_seeds"] = _fetch_sql()

ORACLE["decade_scan_partitioned"] = ORACLE["decade_scan"]
