"""Candidates to answers: filtering, fusion of rank lists, deduplication, aligned responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .extract import first_per

K_RRF, TOP_DOCUMENTS, TOP_FRAGMENTS, MAX_WORDS = 60, 3, 10, 250


def valid_candidates(candidates: DataFrame, language: bool = False) -> DataFrame:
    """``query_id, list_no, rank, ...``: drop what :func:`~lodestack.functions.text.candidate_ok`
    rejects, after the top k was taken, and number again from 1."""
    ok = candidates.where(X.candidate_ok(F.col("texto"), F.col("idioma") if language else None))
    return ok.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "list_no").orderBy("rank")))


def keyed(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("chunk_key", F.concat_ws("::", "doc_id", "chunk_id")).withColumn("text_hash", X.text_hash(F.col("texto")))


def rrf(candidates: DataFrame, k_rrf: int = K_RRF) -> DataFrame:
    """Reciprocal rank fusion. Rows with a text seen before count for the key under which it
    was seen first (by list, then rank); a key's first row lends its attributes; equal scores
    keep the order of first sight. Adds ``score`` and ``position``."""
    first = Window.partitionBy("query_id", "text_hash").orderBy("list_no", "rank")
    c = keyed(candidates).withColumn("key", F.first("chunk_key").over(first))
    seen = F.struct("list_no", "rank", "doc_id", "chunk_id", "texto")
    fused = c.groupBy("query_id", "key").agg(F.round(F.sum(1 / (F.lit(k_rrf) + F.col("rank"))), 12).alias("score"), F.min(seen).alias("x"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "x.list_no", "x.rank")
    return fused.withColumn("position", F.row_number().over(order)).select("query_id", "position", "score", "x.doc_id", "x.chunk_id", "x.texto")


def single(candidates: DataFrame) -> DataFrame:
    """One rank list: the first row of every text, with its own score."""
    one = first_per(keyed(candidates), ["query_id", "text_hash"], ["rank"])
    order = Window.partitionBy("query_id").orderBy("rank")
    return one.withColumn("position", F.row_number().over(order)).select("query_id", "position", "score", "doc_id", "chunk_id", "texto")


def fragments(fused: DataFrame, top: int = TOP_FRAGMENTS, max_words: int = MAX_WORDS) -> DataFrame:
    return fused.where(F.col("position") <= top).select("query_id", F.col("position").alias("rank"), "chunk_id", "doc_id", X.clip(F.col("texto"), max_words).alias("text"))


def documents(fused: DataFrame, top: int = TOP_DOCUMENTS) -> DataFrame:
    """The first distinct documents in order of appearance. As the fragments are the first
    candidates, this also fills up from later ones where the fragments hold too few."""
    seen = fused.groupBy("query_id", "doc_id").agg(F.min("position").alias("at"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    return seen.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "doc_id")


def responses(fused: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query: ``documents`` and ``fragments``, each in rank order."""
    f = fragments(fused).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "text"))).alias("fragments"))
    d = documents(fused).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("documents"))
    none_f, none_d = F.array().cast("array<struct<rank:int,chunk_id:string,doc_id:string,text:string>>"), F.array().cast("array<struct<rank:int,doc_id:string>>")
    out = queries.select("query_id").join(d, "query_id", "left").join(f, "query_id", "left")
    return out.select("query_id", F.coalesce("documents", none_d).alias("documents"), F.coalesce("fragments", none_f).alias("fragments"))


def document_max(candidates: DataFrame, top: int = TOP_DOCUMENTS) -> DataFrame:
    """Documents by their best candidate."""
    best = candidates.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top)
