"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables (through the stand-in corpus of
``citeweave.sources.tables``) and runs the library's operators over the
whole tables.  Doubles are rounded to 9 decimals so the oracle comparison
is insensitive to summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.operators import decades as dec
from citeweave.sources.tables import load_works

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    """Add a query to the registry; the package is shipped to the Python
    workers first so Arrow UDFs can import it."""
    import functools

    from citeweave.session import ship_package

    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@register
def in_decade_refs(spark, sf_dir):
    """J1 + A4: in-decade references of every work, in reference order."""
    return dec.in_decade_references(load_works(spark, sf_dir))


@register
def citation_edges(spark, sf_dir):
    """Per-decade citation edge table (from_id, to_id, decade_start)."""
    return dec.citation_edges(load_works(spark, sf_dir))


@register
def decade_scan(spark, sf_dir):
    """The 1970s with their in-decade references, year and references."""
    works = dec.with_in_decade_references(load_works(spark, sf_dir), [1970])
    return dec.fetch_per_decade_data(works, 1970, ["publication_year", "referenced_works"])


@register
def decade_histogram(spark, sf_dir):
    """A1 + F8: layer-0 works per decade with label and formatted count."""
    return dec.works_per_decade(load_works(spark, sf_dir), layer=0)


@register
def missing_year(spark, sf_dir):
    """A2 + A3: total layer-0 works and those without a year."""
    return dec.missing_year_report(load_works(spark, sf_dir), layer=0)


# --- normalisation and text -------------------------------------------------

from citeweave.functions import normalize as nz  # noqa: E402
from citeweave.functions import text as tx  # noqa: E402
from citeweave.operators import graph as gr  # noqa: E402
from citeweave.sources.tables import raw_works_from_documents, read_table  # noqa: E402


@register
def normalize_ids(spark, sf_dir):
    """Raw API records -> normalised works (ids, DOI, title, abstract
    rebuilt from its inverted index, references, topic fields)."""
    raw = raw_works_from_documents(read_table(spark, sf_dir, "documents"))
    return nz.normalize_works(raw)


@register
def merge_text(spark, sf_dir):
    """title + newline + abstract per work."""
    w = load_works(spark, sf_dir)
    return w.select("oa_id", tx.merge_title_abstract().alias("text"))


@register
def clean_text(spark, sf_dir):
    """Lower-cased, cleaned (NFKC + regex rules) text and its tokens."""
    w = load_works(spark, sf_dir)
    merged = tx.merge_title_abstract()
    cleaned = (w.where(merged.isNotNull())
               .select("oa_id", dec.decade_col("publication_year").alias("decade"),
                       tx.clean_text(F.lower(merged)).alias("clean")))
    return cleaned.select("oa_id", "decade", "clean",
                          F.size(tx.tokenize("clean")).cast("bigint").alias("n_tokens"))


@register
def fill_rate_subfield(spark, sf_dir):
    """A18 over normalised records: share of works with a non-empty subfield."""
    raw = raw_works_from_documents(read_table(spark, sf_dir, "documents"))
    return nz.fill_rate(nz.normalize_works(raw), "subfield")


# --- graph statistics --------------------------------------------------------

def _decade_edges(spark, sf_dir):
    return gr.decade_graph_edges(dec.with_in_decade_references(load_works(spark, sf_dir)))


@register
def degree(spark, sf_dir):
    """in/out degree of every node of each decade's citation graph."""
    return gr.degrees(_decade_edges(spark, sf_dir), keys=("decade",))


@register
def sinks_sources(spark, sf_dir):
    """Nodes, sinks and sources per decade graph."""
    return gr.sinks_and_sources(_decade_edges(spark, sf_dir), keys=("decade",))


@register
def top_topics(spark, sf_dir):
    """30 most frequent topics among each decade graph's nodes."""
    works = load_works(spark, sf_dir)
    edges = gr.decade_graph_edges(dec.with_in_decade_references(works))
    nodes = gr.node_attributes(gr.graph_nodes(edges, keys=("decade",)), works)
    return gr.top_values(nodes, "topic", 30, keys=("decade",))


@register
def ref_membership(spark, sf_dir):
    """References per decade that hit / miss the corpus."""
    return gr.reference_membership(load_works(spark, sf_dir))


# --- dedupe and corpus growth -------------------------------------------------

from citeweave.operators import dedupe as dd  # noqa: E402
from citeweave.operators import expand as ex  # noqa: E402

# Fixed query parameters of the corpus-growth queries on the stand-in corpus.
SEARCH_TERM = "ouvi"
SEED_MIN_CITATIONS = 50
SEED_YEAR_GT = 1950
HOP_MIN_CITATIONS = 20
HOP_YEAR_GT = 1920
HOPS = 2


@register
def dedupe3(spark, sf_dir):
    """Three-key greedy dedupe of the whole corpus in (layer, id) order."""
    kept = dd.greedy_dedupe(load_works(spark, sf_dir), ["layer", "oa_id"])
    return kept.select("oa_id", "doi", "title", "layer")

_GROWTH_COLS = ["oa_id", "doi", "title", "publication_year", "cited_by_count"]


def _seeds(spark, sf_dir):
    works = load_works(spark, sf_dir).drop("layer")
    return works, ex.build_seed(works, SEARCH_TERM, SEED_MIN_CITATIONS, SEED_YEAR_GT)


@register
def seed_search(spark, sf_dir):
    """G1: phrase search + citation/year thresholds + three-key dedupe."""
    return _seeds(spark, sf_dir)[1].select(*_GROWTH_COLS)


@register
def phrase_index_search(spark, sf_dir):
    """P7 by index: works whose title or abstract holds one of ten phrases, the beginnings
    of the ten first works' titles."""
    import uuid
    from citeweave.operators import phrase_index as pi
    from citeweave.session import ensure_checkpoint_dir
    works = load_works(spark, sf_dir).select("oa_id", "title", "abstract")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/citeweave-index/{uuid.uuid4().hex}"
    pi.write_index(works, path, parts=16)
    phrases = works.orderBy("oa_id").limit(10).select(F.substring("title", 1, 9).alias("phrase"))
    return pi.search(spark, path, phrases, parts=16)


@register
def citing_semijoin(spark, sf_dir):
    """Works citing any seed, passing the hop thresholds."""
    works, seeds = _seeds(spark, sf_dir)
    return ex.citing_works(works, seeds, HOP_MIN_CITATIONS, HOP_YEAR_GT).select(*_GROWTH_COLS)


@register
def expand_khop(spark, sf_dir):
    """Two-hop expansion from the seeds with per-hop dedupe and layers."""
    works, seeds = _seeds(spark, sf_dir)
    out = ex.expand(seeds, works, hops=HOPS, min_citations=HOP_MIN_CITATIONS,
                    year_gt=HOP_YEAR_GT)
    return out.select(*_GROWTH_COLS, "layer")


# --- cluster report on a given membership -----------------------------------

from citeweave.operators import clusters as cl  # noqa: E402
from citeweave.operators import evolution as ev  # noqa: E402
from citeweave.schema import CLUSTER_SIZE_CUTOFF, DEFAULT_BINS, TOP_N_CLUSTERS  # noqa: E402
from citeweave.sources.tables import planted_membership  # noqa: E402


def _report(spark, sf_dir):
    works = load_works(spark, sf_dir)
    membership = planted_membership(works, DEFAULT_BINS)
    return works, membership, cl.cluster_report(works, membership, TOP_N_CLUSTERS,
                                                CLUSTER_SIZE_CUTOFF)


@register
def cluster_sizes(spark, sf_dir):
    """Size of every cluster of the membership."""
    works = load_works(spark, sf_dir)
    return cl.cluster_sizes(planted_membership(works, DEFAULT_BINS))


@register
def topn_clusters(spark, sf_dir):
    """W3 + P12: top 10 clusters per bin by size, then size > 5."""
    return _report(spark, sf_dir)[2]["clusters"]


@register
def distributions(spark, sf_dir):
    """A5 + A6: normalised field/domain/topic distributions per cluster."""
    return _report(spark, sf_dir)[2]["distributions"]


@register
def dominant_field(spark, sf_dir):
    """Dominant field per selected cluster."""
    return _report(spark, sf_dir)[2]["dominant_field"]


@register
def link_counts(spark, sf_dir):
    """A7 + A8 + J5: citations between different selected clusters."""
    rep = _report(spark, sf_dir)[2]
    return rep["links"].select("bin", "cluster", "dst_bin", "dst_cluster", "links")


@register
def link_weights(spark, sf_dir):
    """A9 + J7: links normalised by the product of both cluster sizes."""
    return _report(spark, sf_dir)[2]["links"]


@register
def self_citation_share(spark, sf_dir):
    """A10: share of each cluster's references pointing into itself."""
    return _report(spark, sf_dir)[2]["self_share"]


@register
def layout(spark, sf_dir):
    """G11 + W1 + W2 + F15 + F16: evolution-graph node layout and display."""
    rep = _report(spark, sf_dir)[2]
    ranks = ev.field_ranks(rep["distributions"])
    return ev.layout(rep["clusters"], rep["dominant_field"], ranks)


@register
def evolution_edges(spark, sf_dir):
    """Weighted edges between cluster nodes."""
    return ev.evolution_edges(_report(spark, sf_dir)[2]["links"])


@register
def bin_network(spark, sf_dir):
    """G9 nodes: works of each bin with attributes and cluster (-1 if none)."""
    works, membership, rep = _report(spark, sf_dir)
    return cl.bin_network(works, dec.bins_table(spark, DEFAULT_BINS), rep["members"])


@register
def bin_network_edges(spark, sf_dir):
    """G9 edges: distinct in-bin citation edges."""
    works = dec.with_in_decade_references(load_works(spark, sf_dir))
    return cl.bin_network_edges(works, dec.bins_table(spark, DEFAULT_BINS))


# --- phrases and vectors ------------------------------------------------------

from citeweave.operators import phrases as ph  # noqa: E402


def _tokens(spark, sf_dir):
    """The cleaned token corpus, materialised once (phrase learning reads it
    several times)."""
    from citeweave.session import cut_lineage
    return cut_lineage(tx.corpus_tokens(load_works(spark, sf_dir)).select("oa_id", "tokens"))


@register
def phrases(spark, sf_dir):
    """M1: bigram phrases of the cleaned title+abstract corpus."""
    return ph.learn_phrases(_tokens(spark, sf_dir))


@register
def phrase_apply(spark, sf_dir):
    """M2: the corpus rewritten with its bigram phrases."""
    corpus = _tokens(spark, sf_dir)
    table = ph.learn_phrases(corpus)
    return ph.apply_phrases(corpus, table).select("oa_id", "tokens")


@register
def trigram_phrases(spark, sf_dir):
    """M3: phrases learned on the bigram-phrased corpus (second pass)."""
    _, tables = ph.phrase_corpus(_tokens(spark, sf_dir), passes=2)
    return tables[1]

from citeweave.operators import neighbours as nb
from citeweave.operators import vectors as vx  # noqa: E402
from citeweave.operators import word_vectors as wv  # noqa: E402


@register
def vector_topk(spark, sf_dir):
    """M5 general form: the 20 vectors nearest (cosine) to each label centroid."""
    emb = read_table(spark, sf_dir, "embeddings")
    cents = vx.centroids(emb).select(F.col("label").alias("query"),
                                     F.col("centroid").alias("query_vec"))
    return vx.cosine_topk(emb, cents, k=vx.TOP_K)


@register
def embedding_neighbours(spark, sf_dir):
    """M5/T4 for growing query sets: of every vector whose id is divisible by 50 the 20
    nearest others, from an inverted file of cells searched to the exact end."""
    emb = read_table(spark, sf_dir, "embeddings")
    asked = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_vec"))
    return nb.search(nb.build(emb), asked, k=vx.TOP_K, exact=True, exclude_self=True)


@register
def word2vec(spark, sf_dir):
    """M4: skip-gram vectors (300 dims, window 5, min count 10, 10 negative words,
    10 epochs, subsampling 1e-4) on the trigram-phrased corpus; the vector table."""
    corpus, _ = ph.phrase_corpus(_tokens(spark, sf_dir), passes=2)
    return wv.train_word_vectors(corpus)


# --- community detection ----------------------------------------------------------

from citeweave.operators import community as cm  # noqa: E402


def _bin_edges(spark, sf_dir):
    """G3 + U1: each bin's citation graph from in-decade references (parallel
    references and self-references kept)."""
    works = dec.with_in_decade_references(load_works(spark, sf_dir))
    bins = dec.bins_table(spark, DEFAULT_BINS)
    return (works.select(dec.decade_col("publication_year").alias("decade"), "oa_id",
                         "in_decade_references")
            .join(F.broadcast(bins), "decade")
            .select("bin", F.col("oa_id").alias("src"),
                    F.explode("in_decade_references").alias("dst")))


@register
def leiden(spark, sf_dir):
    """G4 + G7: communities of every bin by multi-level directed modularity."""
    return cm.detect(_bin_edges(spark, sf_dir), "leiden")


@register
def infomap(spark, sf_dir):
    """G5 + G7: communities of every bin by the two-level map equation."""
    return cm.detect(_bin_edges(spark, sf_dir), "infomap")


@register
def sbm(spark, sf_dir):
    """G6 + G7: blocks of every bin by degree-corrected SBM description length."""
    return cm.detect(_bin_edges(spark, sf_dir), "sbm")


@register
def leiden_check(spark, sf_dir):
    """Nodes of every bin and of its communities, and whether these reach the
    modularity of the planted groups."""
    from citeweave.session import cut_lineage
    edges = _bin_edges(spark, sf_dir)
    found = cut_lineage(cm.detect(edges, "leiden"))
    planted = planted_membership(load_works(spark, sf_dir), DEFAULT_BINS).withColumnRenamed("oa_id", "node")
    q = lambda m, name: cm.partition_modularity(edges, m).withColumnRenamed("modularity", name)
    ends = edges.select("bin", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return (ends.groupBy("bin").agg(F.count("*").alias("nodes"))
            .join(found.groupBy("bin").agg(F.count_distinct("node").alias("members")), "bin")
            .join(q(found, "own"), "bin").join(q(planted, "groups"), "bin")
            .select("bin", "nodes", "members", (F.col("own") >= F.col("groups")).alias("reaches_planted")))


@register
def sbm_check(spark, sf_dir):
    """Nodes of every bin and of its blocks, and whether these are described in no
    more than one block of all nodes, or the planted groups, take."""
    from citeweave.session import cut_lineage
    edges = _bin_edges(spark, sf_dir)
    found = cut_lineage(cm.detect(edges, "sbm"))
    planted = planted_membership(load_works(spark, sf_dir), DEFAULT_BINS).withColumnRenamed("oa_id", "node")
    length = lambda m, name: cm.partition_description_length(edges, m).withColumnRenamed(
        "description_length", name)
    ends = edges.select("bin", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return (ends.groupBy("bin").agg(F.count("*").alias("nodes"))
            .join(found.groupBy("bin").agg(F.count_distinct("node").alias("members")), "bin")
            .join(length(found, "own"), "bin").join(length(found.withColumn("cluster", F.lit(0)), "one"), "bin")
            .join(length(planted, "groups"), "bin")
            .select("bin", "nodes", "members", (F.col("own") <= F.col("one")).alias("within_one"),
                    (F.col("own") <= F.col("groups")).alias("within_planted")))


@register
def modularity_of_partition(spark, sf_dir):
    """Directed modularity of the planted partition of every bin."""
    works = load_works(spark, sf_dir)
    member = planted_membership(works, DEFAULT_BINS).withColumnRenamed("oa_id", "node")
    return cm.partition_modularity(_bin_edges(spark, sf_dir), member)


# --- table maintenance ----------------------------------------------------------

from citeweave.operators import merge as mg  # noqa: E402
from citeweave.sinks import tables as sk  # noqa: E402


def _normalized(spark, sf_dir):
    raw = raw_works_from_documents(read_table(spark, sf_dir, "documents"))
    return nz.normalize_works(raw)


@register
def append_new_only(spark, sf_dir):
    """K3: a batch holding every work twice (stored form first, then the
    re-normalised API record) appended to the works before 1980 with
    ON CONFLICT DO NOTHING: first row per key wins, stored keys are skipped."""
    works = load_works(spark, sf_dir).select("oa_id", "title", "publication_year")
    target = works.where(F.col("publication_year") < 1980)
    batch = (works.withColumn("_src", F.lit(0))
             .unionByName(_normalized(spark, sf_dir)
                          .select("oa_id", "title", "publication_year")
                          .withColumn("_src", F.lit(1))))
    return sk.new_rows_only(target, batch, ["oa_id"], ["_src"]).drop("_src")


@register
def update_from(spark, sf_dir):
    """Subfields of works from 1950 on replaced by the API records'
    (NULL when the record has no topic); earlier works keep theirs."""
    works = load_works(spark, sf_dir).select("oa_id", "subfield")
    updates = _normalized(spark, sf_dir).where(F.col("publication_year") >= 1950)
    return mg.update_from(works, updates.select("oa_id", "subfield"), "oa_id", "subfield")


@register
def enrich_left(spark, sf_dir):
    """Works enriched with the API records' topic for works from 1950 on."""
    works = load_works(spark, sf_dir).select("oa_id", "publication_year")
    lookup = (_normalized(spark, sf_dir).where(F.col("publication_year") >= 1950)
              .select("oa_id", F.col("topic").alias("api_topic")))
    return mg.enrich(works, lookup, "oa_id", "api_topic")


# --- more aggregates, export round trip, report document ----------------------


@register
def docs_per_decade(spark, sf_dir):
    """Works with text (title or abstract) per decade."""
    w = load_works(spark, sf_dir)
    return (w.where(tx.merge_title_abstract().isNotNull())
            .groupBy(dec.decade_col("publication_year").alias("decade"))
            .agg(F.count(F.lit(1)).alias("n_docs")))


@register
def field_ranks(spark, sf_dir):
    """A16 + W2: every field of the cluster distributions, its sorted rank
    and palette slot."""
    return ev.field_ranks(_report(spark, sf_dir)[2]["distributions"])


@register
def dominant_fields_set(spark, sf_dir):
    """The fields that dominate at least one selected cluster."""
    return ev.dominant_fields(_report(spark, sf_dir)[2]["dominant_field"])


@register
def batches(spark, sf_dir):
    """Works numbered into batches of 100 in id order (last one short)."""
    w = load_works(spark, sf_dir).select("oa_id")
    return mg.batch_numbers(w, 100, ["oa_id"])


@register
def csv_roundtrip(spark, sf_dir):
    """K6 + S3: the works table exported to CSV.gz (JSON text for arrays,
    header, ordered by id) and loaded back by header name."""
    import uuid

    from citeweave.schema import WORK
    from citeweave.session import ensure_checkpoint_dir
    from citeweave.sources.files import load_csv
    cols = ["oa_id", "doi", "title", "publication_year", "abstract", "referenced_works", "topic"]
    works = load_works(spark, sf_dir).select(*cols)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}.csv.gz"
    sk.export_csv(works, path)
    schema = F.struct(*[F.lit(None).cast(WORK[c].dataType).alias(c) for c in cols])
    return load_csv(spark, path, works.select(schema.alias("s")).select("s.*").schema)


@register
def cluster_report_document(spark, sf_dir):
    """The cluster report as one JSON document {bin: {cluster: record}}."""
    rep = _report(spark, sf_dir)[2]
    return sk.cluster_report_json(rep["clusters"], rep["distributions"], rep["links"],
                                  rep["self_share"])


def _saved_report(spark, sf_dir):
    """The path of the cluster report, written as one document."""
    import uuid
    from citeweave.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/citeweave-reports/{uuid.uuid4().hex}"
    sk.write_cluster_report(cluster_report_document(spark, sf_dir), path)
    return path


@register
def report_distributions(spark, sf_dir):
    """The distributions of a saved report, read back from its document."""
    from citeweave.sources.reports import read_report, report_tables
    return report_tables(read_report(spark, _saved_report(spark, sf_dir)))["distributions"]


@register
def report_layout(spark, sf_dir):
    """S8 + G11: evolution-graph layout from a saved report."""
    from citeweave.plans.report import evolution_from_report
    return evolution_from_report(spark, _saved_report(spark, sf_dir))["layout"]


@register
def report_evolution_edges(spark, sf_dir):
    """S8 + G11: evolution-graph edges from a saved report."""
    from citeweave.plans.report import evolution_from_report
    return evolution_from_report(spark, _saved_report(spark, sf_dir))["evolution_edges"]


@register
def decade_scan_sql(spark, sf_dir):
    """S2 + S10: the works table staged as a view and scanned by SQL with
    bound parameters (works of the 1950s with more than 100 citations)."""
    from citeweave.sources.files import execute_sql, register_view
    register_view(load_works(spark, sf_dir), "cw_works")
    return execute_sql(spark, "SELECT oa_id, publication_year, cited_by_count FROM cw_works "
                              "WHERE publication_year BETWEEN :lo AND :hi AND cited_by_count > :c",
                       {"lo": 1950, "hi": 1959, "c": 100})


@register
def fetch_cited_by_seeds(spark, sf_dir):
    """S7 + P8 + P10: records fetched by id (URL form) for every work the
    seeds cite, keeping those with a DOI."""
    works, seeds = _seeds(spark, sf_dir)
    ids = (seeds.select(F.explode("referenced_works").alias("ref"))
           .select(F.concat(F.lit("https://works.example.org/"), "ref").alias("oa_id")))
    return (ex.fetch_by_ids(works, ids, ["oa_id", "doi", "publication_year"])
            .where(ex.has_doi()))


@register
def decade_scan_partitioned(spark, sf_dir):
    """S1 with partition pruning: works with their in-decade references
    stored partitioned by decade, then the 1970s scanned back."""
    import uuid

    from citeweave.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/works-{uuid.uuid4().hex}"
    dec.write_works_by_decade(dec.with_in_decade_references(load_works(spark, sf_dir)), path)
    return dec.scan_decade(spark, path, 1970, ["publication_year", "referenced_works"])


@register
def nearest_words(spark, sf_dir):
    """M4 + M5/T4: word vectors trained on the trigram-phrased corpus, then
    the 20 nearest words (cosine) of its four most frequent phrase tokens;
    a query word missing from the vocabulary is reported with no neighbour."""
    from citeweave.session import cut_lineage
    corpus, _ = ph.phrase_corpus(_tokens(spark, sf_dir), passes=2)
    vectors = cut_lineage(wv.train_word_vectors(corpus))
    phrase_tokens = (corpus.select(F.explode("tokens").alias("word"))
                     .where(F.col("word").contains("_")))
    top = gr.top_values(phrase_tokens, "word", 4).select(F.col("value").alias("word"))
    queries = top.unionByName(spark.sql("SELECT 'vector_space' AS word"))
    return vx.nearest_words(vectors, queries, k=vx.TOP_K)
