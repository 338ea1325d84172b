"""Knowledge graph: entities, triples, node and edge tables, checks, lookup, one hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .extract import first_per

#: An entity of the built-in recogniser: one or more capitalised words in a row.
ENTITY = r"\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)*"
#: Language whose recogniser others take.
FALLBACK = "es"
NO_RELATION, RELATION_LENGTH, LEAST_LENGTH = "relacionado_con", 40, 10
# Node names that count as noise.
NOISE_WORDS = (
    "el", "la", "los", "las", "un", "una", "unos", "unas", "y", "o", "de", "del", "a", "en", "con", "por", "para", "que", "se", "su", "sus",
    "the", "an", "and", "or", "of", "to", "in", "on", "for", "with", "by", "this", "that", "it",
)
#: Verb forms of the built-in relation rule: whole words of letters, digits, marks and underscores.
WORD = r"[\p{L}\p{N}\p{M}_]"
VERB = rf"(?<!{WORD})(?:is|are|was|were|has|have|had|be|es|son|fue|está|tiene|ha|é|foi|tem|{WORD}*\p{{Ll}}(?:ed|ing|aron|ieron|ando|iendo))(?!{WORD})"


def unique_chunks(metadata: DataFrame) -> DataFrame:
    """``encoder, ord, doc_id, chunk_id, fuente, fenomeno, texto``: each chunk once, as its
    first encoder (by name, then line) has it."""
    some = metadata.where(F.coalesce("chunk_id", F.lit("")) != "")
    one = first_per(some, "chunk_id", ["encoder", "ord"])
    return one.select(F.coalesce("doc_id", F.lit("")).alias("doc_id"), "chunk_id", F.coalesce("fuente", F.lit("")).alias("fuente"), F.coalesce("fenomeno", F.lit(0)).alias("fenomeno"), F.coalesce("texto", F.lit("")).alias("texto"))


def sentence_entities(chunks: DataFrame, recognise: Column | None = None, relate: Column | None = None, routes: dict[str, tuple[Column, Column | None]] | None = None) -> DataFrame:
    """One row per chunk and sentence: ``sent``, ``entities`` array<struct<text, kind>> and
    ``relation``. A recogniser is a Column over ``sentence``; the built-in one takes runs of
    capitalised words, and the first two verb forms as relation. ``routes`` gives languages
    recognisers (and relations) of their own: a chunk's language is detected from its text, and
    one without a route takes that of FALLBACK, or the general one where that has none either."""
    some = chunks.where(F.length(X.strip(F.col("texto"))) >= LEAST_LENGTH)
    language = X.detect_language(F.col("texto")) if routes else F.lit(FALLBACK)
    s = some.select("doc_id", "chunk_id", "fenomeno", language.alias("language"), F.posexplode(X.document_sentences(F.col("texto"))).alias("sent", "sentence"))
    found = F.transform(F.regexp_extract_all("sentence", F.lit(ENTITY), F.lit(0)), lambda e: F.struct(e.alias("text"), F.when(F.contains(e, F.lit(" ")), "MULTI").otherwise("MISC").alias("kind")))
    low = F.lower(F.translate("sentence", "Σİ", "σi"))  # letter by letter, wherever it stands
    verbs = F.array_join(F.slice(F.regexp_extract_all(low, F.lit(VERB), F.lit(0)), 1, 2), "_")
    entities = recognise if recognise is not None else found
    relation = relate if relate is not None else verbs
    if routes:
        general = entities, relation
        rest = routes.get(FALLBACK, general)
        entities, relation = rest[0], general[1] if rest[1] is None else rest[1]
        for name, (own, own_relation) in routes.items():
            entities = F.when(F.col("language") == name, own).otherwise(entities)
            relation = F.when(F.col("language") == name, general[1] if own_relation is None else own_relation).otherwise(relation)
    s = s.withColumn("entities", F.filter(entities, lambda e: F.length(X.strip(e["text"])) > 1))
    return s.withColumn("relation", F.left(F.when(relation == "", NO_RELATION).otherwise(relation), F.lit(RELATION_LENGTH))).drop("sentence", "language")


def triples(sentences: DataFrame) -> DataFrame:
    """Neighbouring entities of a sentence, where they differ by more than case. ``at``: order
    of the triple within its chunk."""
    some = sentences.where(F.size("entities") >= 2)
    name = F.transform("entities", lambda e: F.struct(F.replace(X.strip(e["text"]), F.lit("\n"), F.lit(" ")).alias("text"), e["kind"].alias("kind")))
    pairs = F.zip_with(F.slice(name, F.lit(1), F.size(name) - 1), F.slice(name, F.lit(2), F.size(name) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    t = some.select("doc_id", "chunk_id", "fenomeno", "sent", "relation", F.posexplode(pairs).alias("i", "p")).where(F.lower("p.a.text") != F.lower("p.b.text"))
    return t.select(F.col("p.a.text").alias("sujeto"), F.col("p.a.kind").alias("tipo_sujeto"), F.col("relation").alias("relacion"), F.col("p.b.text").alias("objeto"), F.col("p.b.kind").alias("tipo_objeto"), F.col("chunk_id").cast("string"), F.col("doc_id").cast("string"), F.col("fenomeno").cast("int"), F.struct("chunk_id", "sent", "i").alias("at"))


def nodes(t: DataFrame) -> DataFrame:
    """Entities with the type they were first seen with; a subject comes before its object."""
    ends = F.array(F.struct(F.col("sujeto").alias("id"), F.col("tipo_sujeto").alias("kind"), F.lit(0).alias("side")), F.struct(F.col("objeto").alias("id"), F.col("tipo_objeto").alias("kind"), F.lit(1).alias("side")))
    e = t.select("at", F.inline(ends)).withColumn("seen", F.struct("at", "side"))
    return e.groupBy("id").agg(F.lit("Entidad").alias("label"), F.min_by("kind", "seen").alias("entity_type"), F.min("seen").alias("seen"))


def edges(t: DataFrame) -> DataFrame:
    """Directed, one per pair: attributes of the first triple, distinct chunk ids in order.
    Repeats of a pair within a chunk are combined before its chunk ids are collected."""
    per_chunk = t.groupBy(F.col("sujeto").alias("src"), F.col("objeto").alias("dst"), "chunk_id").agg(F.min(F.struct("at", "relacion", "doc_id", "fenomeno")).alias("first"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("first.at", "chunk_id"))), lambda x: x["chunk_id"])
    e = per_chunk.groupBy("src", "dst").agg(F.min("first").alias("x"), ids.alias("chunk_id"))
    return e.select("src", "dst", F.col("x.relacion").alias("relation"), "chunk_id", F.col("x.doc_id").alias("doc_id"), F.col("x.fenomeno").alias("fenomeno"))


def checks(n: DataFrame, e: DataFrame) -> DataFrame:
    """Counts of nodes and edges, and of edges that lack an attribute."""
    lacking = F.when((F.size("chunk_id") == 0) | (F.coalesce(X.strip(F.col("doc_id")), F.lit("")) == "") | (F.coalesce(X.strip(F.col("relation")), F.lit("")) == ""), 1).otherwise(0)
    return n.agg(F.count("*").alias("nodes")).join(e.agg(F.count("*").alias("edges"), F.coalesce(F.sum(lacking), F.lit(0)).alias("incomplete")), F.lit(True))


def noise_ratio(n: DataFrame) -> DataFrame:
    s = X.strip(F.col("id"))
    return n.agg(F.count("*").alias("nodes"), F.sum(F.when((F.length(s) <= 1) | F.lower(s).isin(*NOISE_WORDS), 1).otherwise(0)).alias("noise")).withColumn("ratio", F.round(F.col("noise") / F.col("nodes"), 6))


def degrees(e: DataFrame, top: int = 15) -> DataFrame:
    """The ``top`` nodes by in- plus out-degree, ties by name."""
    ends = e.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(top)


def lookup(n: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """Nodes whose name contains the query, ignoring case: the first ``top`` as they were seen.
    ``queries`` (``query``) is a short list, checked before it is broadcast."""
    if queries.limit(10_001).count() > 10_000:
        raise ValueError("look up at most 10,000 queries at a time")
    hits = n.join(F.broadcast(queries), F.contains(F.lower("id"), F.lower("query")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("seen"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top).select("query", "rank", "id")


def one_hop(matched: DataFrame, e: DataFrame) -> DataFrame:
    """Chunk ids on the edges that leave the matched nodes."""
    hop = matched.join(e, matched.id == e.src)
    return hop.select("query", F.explode("chunk_id").alias("chunk_id")).distinct()
