"""Registered queries over the driver's tables. Their SQL is in ``oracles.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .functions.vectors import l2_normalize, l2_score
from .oracles import oracle_sql
from .operators import extract, fusion, graph, spell, vector
from .operators.chunk import ChunkConfig, chunks, fan_out
from .operators.embed import hash_encoders
from .plans import knowledge, retrieval
from .shared import cut, dealt, new_path
from .sources import articles as article_source
from .sources import html

__all__ = ["oracle_sql", "queries"]

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ENCODERS = ("bge-m3", "e5-large")
#: Queries of the vector searches: vectors whose id is divisible by this.
QUERY_STEP = 20
LOOKUPS = ("the", "and", "Ist", "que", "ou")


def query(f):
    REGISTRY[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the chunker takes them."""
    d = docs_of(spark, sf_dir)
    d = X.once(d, "texto", X.clean_text(F.col("text")))
    return d.select("doc_id", "texto", F.col("source").alias("fuente"), F.lit("pdf").alias("formato"), F.lit(1).alias("fenomeno"), F.col("lang").alias("idioma"))


# ---- text


@query
def clean_text(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.clean_text(F.col("text")).alias("texto"))


@query
def word_count(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.word_count(F.col("text")).alias("total_palabras"))


@query
def text_hash_dedup(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", X.text_hash(F.col("text")).alias("text_hash"))
    return d.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query
def clip_text(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.clip(F.col("text"), 250).alias("clipped"))


@query
def paragraphs(spark, sf_dir):
    # every third line break becomes a blank line, as the table has none
    t = F.regexp_replace("text", r"([^\n]*\n[^\n]*\n[^\n]*)\n", "$1\n \n")
    return docs_of(spark, sf_dir).select("doc_id", F.posexplode(X.paragraphs(t)).alias("pos", "paragraph"))


@query
def sentences(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.posexplode(X.document_sentences(F.col("text"))).alias("pos", "sentence"))


@query
def spelling_dictionary(spark, sf_dir):
    return spell.dictionary(docs_of(spark, sf_dir), "text").select("word", F.col("count").alias("n"))


@query
def doc_contract(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    raw = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("raw_text"), F.concat(F.lit("in/"), "source", F.lit(".html")).alias("path"), F.create_map(F.lit("title"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")), F.lit("lang"), F.col("lang")).alias("metadata"))
    p = extract.contract(raw, "html", language=F.col("metadata")["lang"])
    return p.select(F.md5(F.col("texto").cast("binary")).alias("texto_md5"), "metadata.*")


@query
def language_fallback(spark, sf_dir):
    return docs_of(spark, sf_dir).groupBy(X.clamp_language(F.col("lang")).alias("idioma")).agg(F.count("*").alias("n"))


@query
def language_rule(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.detect_language(F.col("text")).alias("idioma"))


# ---- rows, trees and features to text


@query
def csv_row_sentences(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select([F.col(c).cast("string").alias(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")])
    rows = rows.withColumn("c_mktsegment", F.when(F.col("c_custkey").cast("long") % 7 == 0, " ").otherwise(F.col("c_mktsegment")))
    return rows.select(F.col("c_custkey").cast("long").alias("c_custkey"), extract.row_sentence(rows.columns).alias("sentence"))


@query
def csv_document(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").withColumn("sentence", extract.row_sentence(["n_nationkey", "n_name", "n_regionkey"]))
    return extract.table_document(rows, ["n_regionkey"], ["n_nationkey"])


@query
def table_row_sentences(spark, sf_dir):
    o = table(spark, sf_dir, "supplier")
    row = F.array(F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 5 == 0, F.lit(" ")).otherwise(F.col("s_name")), F.col("s_nationkey").cast("string"), F.concat(F.lit("x\n"), "s_name"))
    cells = F.array(F.array(F.lit("llave"), F.lit(""), F.lit("na\nción")), row)
    return o.select("s_suppkey", F.element_at(extract.table_sentences(cells), 1).alias("sentence"))


@query
def json_article(spark, sf_dir):
    """Conversations as articles: one section per turn, the roles as lists."""
    c = table(spark, sf_dir, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("heading"), F.array(x["text"]).alias("paragraphs")))
    g = c.groupBy("conv_id").agg(turns.alias("sections"), F.array_sort(F.collect_set("role")).alias("lists"))
    title = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")))
    links = F.array(F.struct(F.lit("Source").alias("text"), F.concat(F.lit("https://example.org/"), F.col("conv_id").cast("string")).alias("url")), F.struct(F.lit("none").alias("text"), F.lit("").alias("url")))
    none = F.lit(None)
    return g.select("conv_id", extract.article_text(title, F.col("sections"), F.col("lists"), none.cast("string"), none.cast("array<string>"), links).alias("raw_text"))


@query
def json_props(spark, sf_dir):
    """Event properties through the metadata filter: how often each key stays."""
    e = table(spark, sf_dir, "events")
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("image_url"), F.lit("x"), F.lit("page_link_url"), F.lit("y"), F.lit("title"), F.lit("z")))
    kept = e.select(F.explode(extract.article_metadata(m)).alias("key", "value"))
    return kept.groupBy("key").agg(F.count("*").alias("n"))


@query
def repeated_lines(spark, sf_dir):
    return extract.repeated_lines(docs_of(spark, sf_dir), "source", "text")


@query
def line_filter(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    return extract.page_lines(d, "source", "doc_id", "text", extract.repeated_lines(d, "source", "text")).select("source", "doc_id", F.col("at").alias("pos"), "line")


@query
def paged_document(spark, sf_dir):
    """A source as a paged file: each document a page of its text and a table."""
    d = docs_of(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page"), "text", "lang")
    text = d.select("doc_id", "page", F.lit(10.0).alias("y0"), F.lit("text").alias("kind"), F.split("text", "\n").alias("lines"), F.lit(None).cast("array<array<string>>").alias("cells"))
    tab = d.select("doc_id", "page", F.lit(5.0).alias("y0"), F.lit("table").alias("kind"), F.lit(None).cast("array<string>").alias("lines"), F.array(F.array(F.lit("página"), F.lit("")), F.array(F.col("page").cast("string"), F.col("lang"))).alias("cells"))
    from .sources.paged import blocks_to_documents

    out = blocks_to_documents(text.unionByName(tab))
    return out.select("doc_id", F.length("raw_text").alias("n_chars"), F.md5(F.col("raw_text").cast("binary")).alias("raw_md5"))


@query
def html_title(spark, sf_dir):
    return dealt(table(spark, sf_dir, "pages")).select("page_id", html.title(F.col("html")).alias("title"))


@query
def html_blocks(spark, sf_dir):
    b = html.blocks(table(spark, sf_dir, "pages"), "page_id", "html")
    return b.select("page_id", "title", F.size("blocks").alias("n_blocks"), html.block_text(F.col("blocks")).alias("raw_text"))


@query
def geo_feature_text(spark, sf_dir):
    """Suppliers as geographic features: points, polygons and lines in turn."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    kind = F.when(key % 3 == 0, "Point").when(key % 3 == 1, "Polygon").otherwise("LineString")
    nested = F.concat(F.lit("[[["), key.cast("string"), F.lit(", 1], [2, 3]]]"))
    coordinates = F.when(key % 3 == 0, F.concat(F.lit("["), (key / 8).cast("string"), F.lit(", -7.5]"))).when(key % 3 == 1, nested).otherwise(F.lit("[[1, 2], [3, 4], [5, 6]]"))
    props = F.create_map(F.lit("au_country"), F.when(key % 4 == 0, "").otherwise(F.col("n_name")), F.lit("s_name"), F.col("s_name"), F.lit("notes_a"), F.concat(F.lit("in  "), F.col("n_name")))
    return s.select(key, extract.feature_text(props, kind, coordinates, F.lit("suppliers")).alias("raw_text"), extract.feature_id(props, key.cast("string")).alias("doc_id"))


@query
def incremental_skip(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", "source")
    return extract.not_yet(d, table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")


# ---- chunks


@query
def document_chunks(spark, sf_dir):
    c = chunks(corpus(spark, sf_dir))
    return c.select("doc_id", "chunk_id", "fuente", "formato", "fenomeno", "posicion", "num_tokens", "idioma", F.md5(F.col("texto").cast("binary")).alias("texto_md5"))


@query
def chunk_overlap_two(spark, sf_dir):
    c = chunks(corpus(spark, sf_dir), ChunkConfig(max_words=60, overlap_sentences=2))
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("num_tokens").alias("tokens"))


@query
def chunk_token_estimate(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.token_estimate(F.col("text")).alias("num_tokens"))


@query
def chunk_fanout(spark, sf_dir):
    return fan_out(chunks(corpus(spark, sf_dir)), list(ENCODERS)).groupBy("encoder").agg(F.count("*").alias("n_chunks"), F.sum("num_tokens").alias("tokens"))


# ---- vectors


def halves(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    a = e.select("vec_id", "label", F.lit(0).alias("list_no"), F.slice("embedding", 1, 32).alias("embedding"))
    return a.unionByName(e.select("vec_id", "label", F.lit(1).alias("list_no"), F.slice("embedding", 33, 32).alias("embedding")))


def split(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    return v.select(F.col("vec_id").alias("item_id"), "embedding"), v.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query
def l2_normalized(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    doubled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") % 3))
    rounded = F.transform(l2_normalize(doubled), lambda x: F.round(x, 6))
    # zeros without a sign, on both sides
    return e.select("vec_id", F.transform(rounded, lambda x: F.when(x == 0, 0.0).otherwise(x)).alias("unit"))


@query
def knn_flat_topk(spark, sf_dir):
    items, asked = split(table(spark, sf_dir, "embeddings"))
    return vector.Flat().build(items).search(asked, 50).select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


@query
def knn_l2_topk(spark, sf_dir):
    items, asked = split(table(spark, sf_dir, "embeddings"))
    return vector.Flat("l2").build(items).search(asked, 10).select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


@query
def l2_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    d = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x.cast("double") - 0.5) * (x.cast("double") - 0.5))
    return e.select("vec_id", F.round(l2_score(d), 9).alias("score"))


def half_candidates(spark, sf_dir, lists: tuple[int, ...] = (0, 1)) -> DataFrame:
    every = None
    for no in lists:
        items, asked = split(halves(spark, sf_dir).where(F.col("list_no") == no))
        found = vector.Flat().build(items).search(asked, 50).withColumn("list_no", F.lit(no))
        every = found if every is None else every.unionByName(found)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    met = every.join(labels, "item_id")
    return met.select("query_id", "list_no", "rank", "score", F.col("label").cast("string").alias("doc_id"), F.col("item_id").cast("string").alias("chunk_id"), F.concat(F.lit("text "), (F.col("item_id") - F.col("item_id") % 3).cast("string")).alias("texto"))


@query
def rrf_fused_topk(spark, sf_dir):
    """Two encoders (halves of the vectors), fused; three vectors in a row share a text."""
    f = fusion.rrf(half_candidates(spark, sf_dir))
    return f.where("position <= 20").select("query_id", "position", "score", "doc_id", "chunk_id")


@query
def single_encoder_dedup(spark, sf_dir):
    f = fusion.single(half_candidates(spark, sf_dir, (0,)))
    return f.select("query_id", "position", F.round("score", 6).alias("score"), "doc_id", "chunk_id")


@query
def doc_max_pool(spark, sf_dir):
    f = fusion.document_max(half_candidates(spark, sf_dir, (0,)))
    return f.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def label_centroids(spark, sf_dir) -> list[tuple[int, list[float]]]:
    e = table(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: F.round(p["m"], 9)).alias("c")).orderBy("label").collect()
    return [(r["label"], r["c"]) for r in rows]


@query
def ivf_assign(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vector.assign(e.select("vec_id", "embedding"), label_centroids(spark, sf_dir)).select("vec_id", "cell")


@query
def ivf_search(spark, sf_dir):
    items, asked = split(table(spark, sf_dir, "embeddings"))
    found = vector.IVF(probes=2).build(items, label_centroids(spark, sf_dir)).search(asked, 10)
    return found.select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


@query
def ivf_kmeans_topk(spark, sf_dir):
    items, asked = split(table(spark, sf_dir, "embeddings"))
    return vector.IVF(cells=100, probes=4).build(items).search(asked, 10).select("query_id", "item_id", "rank")


@query
def nsw_topk(spark, sf_dir):
    items, asked = split(table(spark, sf_dir, "embeddings"))
    return vector.NSW().build(items).search(asked, 10).select("query_id", "item_id", "rank")


# ---- questions and answers


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.format_string("q%05d", "item_id").alias("query_id"), F.col("text").alias("query_text"))


@query
def query_preprocess(spark, sf_dir):
    q = questions(spark, sf_dir).withColumn("query_text", F.concat(F.lit("  ¿¿Café "), "query_text", F.lit(" \n\t *#")))
    return q.select("query_id", X.clean_query(F.col("query_text")).alias("cleaned"))


@query
def acronym_guard(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.has_acronym(F.col("text")).alias("has_acronym"))


@query
def spell_nearest(spark, sf_dir):
    words = spell.dictionary(docs_of(spark, sf_dir), "text")
    asked = spell.dictionary(questions(spark, sf_dir), "query_text").where(F.length("word") >= 4).select(F.concat("word", F.lit("x")).alias("token"))
    return spell.nearest(asked, words)


@query
def spell_correct(spark, sf_dir):
    words = cut(spell.dictionary(docs_of(spark, sf_dir), "text"), "dictionary")
    asked = questions(spark, sf_dir).select("query_id", X.clean_query(F.col("query_text")).alias("corrected"))
    return spell.correct_texts(asked, "corrected", words)


def answered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    q = cut(retrieval.prepare_queries(questions(spark, sf_dir)), "queries")
    return q, retrieval.candidates(q, cut(chunks(corpus(spark, sf_dir)), "chunks"), hash_encoders())


@query
def candidate_filter(spark, sf_dir):
    _, c = answered(spark, sf_dir)
    return c.select("query_id", "list_no", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query
def response_fragments(spark, sf_dir):
    _, c = answered(spark, sf_dir)
    f = fusion.fragments(fusion.rrf(c), max_words=40)
    return f.select("query_id", "rank", "chunk_id", "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def response_documents(spark, sf_dir):
    _, c = answered(spark, sf_dir)
    return fusion.documents(fusion.rrf(c))


@query
def results_by_query(spark, sf_dir):
    q, c = answered(spark, sf_dir)
    r = fusion.responses(cut(fusion.rrf(c), "fused"), q)
    return r.select("query_id", F.array_join(F.transform("documents", lambda d: d["doc_id"]), ",").alias("documents"), F.array_join(F.transform("fragments", lambda d: d["chunk_id"]), ",").alias("fragments")).orderBy("query_id")


# ---- knowledge graph


def metadata(spark, sf_dir) -> DataFrame:
    """Documents as chunk metadata of two encoders, the second with other texts."""
    d = docs_of(spark, sf_dir)
    e = d.select(F.explode(F.array(*[F.lit(x) for x in ENCODERS])).alias("encoder"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("doc_id"), F.format_string("%s-chunk-%03d", F.col("doc_id").cast("string"), F.lit(0)).alias("chunk_id"), F.col("source").alias("fuente"), F.lit(1).alias("fenomeno"), "text")
    return e.withColumn("texto", F.when(F.col("encoder") == ENCODERS[0], F.col("text")).otherwise(F.lit("other"))).drop("text")


@query
def metadata_dedup(spark, sf_dir):
    u = graph.unique_chunks(metadata(spark, sf_dir))
    return u.select("doc_id", "chunk_id", "fuente", "fenomeno", F.md5(F.col("texto").cast("binary")).alias("texto_md5"))


@query
def entities(spark, sf_dir):
    s = graph.sentence_entities(graph.unique_chunks(metadata(spark, sf_dir)))
    return s.select("chunk_id", "sent", F.array_join(F.transform("entities", lambda e: e["text"]), "|").alias("entities"), "relation")


def triple_table(spark, sf_dir) -> DataFrame:
    return graph.triples(graph.sentence_entities(graph.unique_chunks(metadata(spark, sf_dir))))


@query
def triples(spark, sf_dir):
    return triple_table(spark, sf_dir).select("sujeto", "tipo_sujeto", "relacion", "objeto", "tipo_objeto", "chunk_id", "doc_id", "fenomeno")


@query
def graph_nodes(spark, sf_dir):
    return graph.nodes(triple_table(spark, sf_dir)).select("id", "label", "entity_type")


@query
def graph_edges(spark, sf_dir):
    e = graph.edges(triple_table(spark, sf_dir))
    return e.select("src", "dst", "relation", F.array_join("chunk_id", ",").alias("chunk_id"), "doc_id", "fenomeno")


@query
def graph_checks(spark, sf_dir):
    _, n, e = knowledge.build(metadata(spark, sf_dir))
    return graph.checks(n, e)


@query
def noise_ratio(spark, sf_dir):
    return graph.noise_ratio(graph.nodes(triple_table(spark, sf_dir)))


@query
def degree_top15(spark, sf_dir):
    return graph.degrees(graph.edges(triple_table(spark, sf_dir)))


@query
def entity_lookup(spark, sf_dir):
    asked = spark.createDataFrame([(x,) for x in LOOKUPS], "query string")
    return graph.lookup(graph.nodes(triple_table(spark, sf_dir)), asked)


@query
def one_hop_chunks(spark, sf_dir):
    asked = spark.createDataFrame([(x,) for x in LOOKUPS], "query string")
    t = triple_table(spark, sf_dir)
    return graph.one_hop(graph.lookup(graph.nodes(t), asked), graph.edges(t))


# ---- streaming


@query
def stream_ingest_counts(spark, sf_dir):
    """Ingest the documents as a stream, twice; the second run finds nothing new."""
    from .streaming import ingest

    home = new_path(spark, "stream")
    schema = docs_of(spark, sf_dir).schema.simpleString()[7:-1].replace(":", " ")
    for _ in range(2):
        stream = ingest.documents(spark, f"{sf_dir}/documents*.parquet", schema)
        ingest.ingest(stream, f"{home}/out", f"{home}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{home}/out").groupBy("fuente").agg(F.count("*").alias("n_chunks"), F.sum("num_tokens").alias("tokens"))


@query
def article_documents(spark, sf_dir):
    """Whole articles, from JSON text to raw documents, by conversation."""
    c = table(spark, sf_dir, "conversations")
    text = F.to_json(F.struct(F.col("conv_id").alias("id"), F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("titulo"), F.col("text").alias("body_text"), F.array(F.struct(F.col("role").alias("text"), F.lit("https://example.org").alias("url"))).alias("related"), F.col("role")))
    files = c.select(F.concat_ws("/", "conv_id", "turn").alias("path"), text.cast("binary").alias("content"))
    d = article_source.documents(files)
    return d.select("path", "doc_id", "title", "raw_text", F.col("metadata")["role"].alias("role"), F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("keys"))


@query
def consecutive_gap(spark, sf_dir):
    """Words between a document's sentences and the running total before each."""
    s = docs_of(spark, sf_dir).select("doc_id", F.posexplode(F.transform(X.document_sentences(F.col("text")), X.word_count)).alias("pos", "words"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return s.select("doc_id", "pos", "words", F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
