"""From a corpus and a batch of questions to aligned answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fusion
from ..operators.embed import Encoder, embed
from ..operators.spell import correct_texts
from ..operators.vector import INDEXES, load_index, save_index
from ..shared import cut


def prepare_queries(queries: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """``query_id, query_text`` cleaned, and spelling-corrected where a dictionary is given."""
    q = queries.withColumn("query_text", X.clean_query(F.col("query_text")))
    return q if dictionary is None else correct_texts(q, "query_text", dictionary)


def index_chunks(chunks: DataFrame, encoders: list[Encoder], path: str, kinds: tuple[str, ...] = tuple(INDEXES)) -> None:
    """Every encoder's vectors, indexed in each of the ways and stored under ``path``."""
    for e in encoders:
        vectors = cut(chunk_vectors(chunks, e), "vectors")
        for kind in kinds:
            save_index(INDEXES[kind]().build(vectors), path, e.name)


def chunk_vectors(chunks: DataFrame, e: Encoder) -> DataFrame:
    return embed(chunks, e, F.col("texto"), "chunk_id").select(F.col("chunk_id").alias("item_id"), "embedding")


def candidates(queries: DataFrame, chunks: DataFrame, encoders: list[Encoder], k: int = 50, index: str = "flat", language: bool = False, stored: str | None = None) -> DataFrame:
    """Every encoder's top k for every query, filtered after ranking and numbered again:
    ``query_id, list_no, rank, score, doc_id, chunk_id, texto, idioma``. ``stored``: where
    :func:`index_chunks` wrote; without it the index is built here."""
    every = None
    for no, e in enumerate(encoders):
        made = load_index(queries.sparkSession, stored, e.name, index) if stored else INDEXES[index]().build(chunk_vectors(chunks, e))
        asked = embed(queries, e, F.col("query_text"), "query_id", query=True)
        found = made.search(asked, k).withColumn("list_no", F.lit(no))
        every = found if every is None else every.unionByName(found)
    met = every.withColumnRenamed("item_id", "chunk_id").join(chunks.select("chunk_id", "doc_id", "texto", "idioma"), "chunk_id")
    return fusion.valid_candidates(met, language).select("query_id", "list_no", "rank", "score", "doc_id", "chunk_id", "texto", "idioma")


def answer(queries: DataFrame, chunks: DataFrame, encoders: list[Encoder], dictionary: DataFrame | None = None, k: int = 50, index: str = "flat", stored: str | None = None) -> DataFrame:
    """One response per query: documents and fragments. Chunks are read once per encoder and
    once for their texts, answers twice: both are written between."""
    q = cut(prepare_queries(queries, dictionary), "queries")
    c = candidates(q, cut(chunks, "chunks"), encoders, k, index, stored=stored)
    return fusion.responses(cut(fusion.single(c) if len(encoders) == 1 else fusion.rrf(c), "fused"), q)
