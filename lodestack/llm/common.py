"""Shared plumbing: tables written to the shared folder, safe column handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, discard, new_path, shared_dir, shuffles_removed, write

__all__ = ["cut", "discard", "new_path", "shared_dir", "shuffles_removed", "write"]

#: Bytes of an Arrow batch on its way to Python (a longer row goes alone).
BATCH_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not rows only: texts differ in length by orders of
    magnitude. The setting holds for the session, as plans are run after they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8_len(c: Column) -> Column:
    return F.octet_length(c).cast("long")


def word_count(c: Column) -> Column:
    """Number of maximal runs outside space and U+0009 to U+000D."""
    return F.regexp_count(c, F.lit("[^\\x20\\x09-\\x0D]++")).cast("long")


def fold_bucket(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
