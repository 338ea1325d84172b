"""Sentence-complete chunks of bounded words, with overlap."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


@dataclass(frozen=True)
class ChunkConfig:
    max_words: int = 250
    overlap_sentences: int = 1
    encoders: tuple[str, ...] = field(default=())


def windows(sizes: list[int], max_words: int, overlap: int) -> list[tuple[int, int]]:
    """Sentence ranges of the chunks of one document. A chunk takes sentences while their
    words fit, at least one; the next starts ``overlap`` sentences before its end, but further
    than it began; the last ends with the document."""
    ends = [0, *accumulate(sizes)]
    out, start = [], 0
    while start < len(sizes):
        end = max(start + 1, bisect_right(ends, ends[start] + max_words) - 1)
        out.append((start, end))
        if end >= len(sizes):
            break
        start = max(end - overlap, start + 1)
    return out


def chunk_ranges(sizes: Column, config: ChunkConfig) -> Column:
    """array<struct<start, stop>> from the sentences' word counts: only integers go to Python."""
    w, o = config.max_words, config.overlap_sentences

    @F.arrow_udf("array<struct<start: int, stop: int>>")
    def of(arrays: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.array([[{"start": a, "stop": b} for a, b in windows(x or [], w, o)] for x in arrays.to_pylist()], kind)

    return of(sizes)


def chunks(docs: DataFrame, config: ChunkConfig = ChunkConfig(), count_tokens: Callable[[Column], Column] = X.token_estimate) -> DataFrame:
    """``docs``: doc_id, texto, fuente, formato, fenomeno, idioma. One row per chunk.
    ``count_tokens`` gives a chunk's tokens from its text: an encoder's tokenizer plugs in here."""
    d = X.once(docs, "sents", X.document_sentences(F.col("texto")))
    d = X.once(d, "sizes", F.transform("sents", X.word_count))
    d = X.once(d, "ranges", chunk_ranges(F.col("sizes"), config))
    # texts are cut out before the explode, so that its rows do not each carry the document
    texts = F.transform("ranges", lambda r: X.strip(F.array_join(F.slice(F.col("sents"), r["start"] + 1, r["stop"] - r["start"]), " ")))
    c = d.select("doc_id", "fuente", "formato", "fenomeno", "idioma", F.posexplode(texts).alias("posicion", "texto"))
    out = c.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.format_string("%s-chunk-%03d", F.col("doc_id").cast("string"), "posicion").alias("chunk_id"),
        "fuente",
        X.clamp_format(F.col("formato")).alias("formato"),
        F.coalesce(F.col("fenomeno").cast("string").try_cast("int"), F.lit(1)).alias("fenomeno"),
        "posicion",
        "texto",
        X.clamp_language(F.col("idioma")).alias("idioma"),
    )
    return out.withColumn("num_tokens", count_tokens(F.col("texto")))


def fan_out(chunk_table: DataFrame, encoders: list[str]) -> DataFrame:
    """Each chunk once per encoder (a fixed list)."""
    return chunk_table.withColumn("encoder", F.explode(F.array(*[F.lit(e) for e in encoders])))
