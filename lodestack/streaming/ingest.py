"""Incremental ingest: a file stream whose checkpoint remembers what was processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators.chunk import ChunkConfig, chunks


def documents(spark: SparkSession, path: str, schema: str, pattern: str = "*.parquet", per_batch: int = 1000) -> DataFrame:
    """A stream of document rows from files that appear under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", pattern).parquet(path)


def chunk_stream(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Document rows (``doc_id, text, source, lang``) to chunks: no state, so append output."""
    d = docs.select("doc_id", X.clean_text(F.col("text")).alias("texto"), F.col("source").alias("fuente"), F.lit("pdf").alias("formato"), F.lit(1).alias("fenomeno"), F.col("lang").alias("idioma"))
    return chunks(d, config)


def ingest(docs: DataFrame, out: str, checkpoint: str, config: ChunkConfig = ChunkConfig()) -> StreamingQuery:
    """Process what is there and not yet processed, then stop. Files are taken once over any
    number of runs; a batch that is run again after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return chunk_stream(docs, config).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
