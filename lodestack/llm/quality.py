"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import bound_batches, cut, fold_bucket

#: Bound on the labelled rows that the trees are fitted on (a hash sample), and their shape.
TRAIN_ROWS, TREES, DEPTH, RATE = 60_000, 120, 4, 0.12
#: A row is predicted to be of quality from this score on.
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "lower", "digits", "high", "spaces", "newlines", "commas_stops",
    "exclaim", "pipes", "symbols", "brackets", "quotes", "entropy", "distinct_words", "top_word", "short_words", "no_letter_words", "capital_words",
    "mean_line", "repeated_lines", "repeated_pairs", "stop_per_line",
)

_ALL = np.arange(256)


def _byte_set(chars: bytes) -> np.ndarray:
    return np.isin(_ALL, np.frombuffer(chars, np.uint8))


_UPPER, _LOWER, _DIGIT = (_ALL >= 65) & (_ALL <= 90), (_ALL >= 97) & (_ALL <= 122), (_ALL >= 48) & (_ALL <= 57)
_SETS = (_UPPER, _LOWER, _DIGIT, _ALL >= 128, _byte_set(b" \t"), _byte_set(b"\n\r"), _byte_set(b",.;:"), _byte_set(b"!?"), _byte_set(b"|"), _byte_set(b"$&%#*@^~+=<>_\\/"), _byte_set(b"()[]{}"), _byte_set(b"\"'`"))
_LETTERS = _UPPER | _LOWER | (_ALL >= 128)
_DROP_LETTERS = bytes(np.flatnonzero(_LETTERS).astype(np.uint8))


def statistics(text: bytes) -> list[float]:
    """FEATURES of one whole text (UTF-8)."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    freq = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = [float(freq[s].sum()) / n for s in _SETS]
    p = freq[freq > 0] / n
    words = text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    bare = sum(c for w, c in counts.items() if not len(w) - len(w.translate(None, _DROP_LETTERS)))
    capital = sum(c for w, c in counts.items() if w[:1].isupper())
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(words) - 1 - len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 0
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.mean()), float(lengths.max()), *share,
        float(-(p * np.log2(p)).sum()), len(counts) / m, max(counts.values(), default=0) / m, float((lengths <= 3).mean()), bare / m, capital / m,
        n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), pairs / m, float(freq[46]) / max(1, len(lines)),
    ]


def statistics_column(text: Column) -> Column:
    """FEATURES of every text as array<float>; null counts as empty."""

    @F.arrow_udf("array<float>")
    def of(texts: pa.Array) -> pa.Array:
        rows = [statistics(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in texts.cast(pa.binary())]
        return pa.array(rows, pa.list_(pa.float32()))

    return of(text)


def fit(rows: DataFrame, labels: DataFrame, train: Column, max_rows: int = TRAIN_ROWS, label: str = "quality") -> gbt.Trees:
    """``rows``: ``id``, ``x`` (statistics). ``labels``: ``doc_id`` and the label (0 or 1; where
    a document has several, the largest; null: none). At most about ``max_rows`` labelled rows
    for which ``train`` holds reach the driver, chosen by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(label).cast("int").alias("y"))
    some = rows.where(train).join(known, "id").select("id", "x", "y")
    n = some.count()
    if n > max_rows:
        some = some.where(F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    got = some.orderBy("id", "x").toArrow()
    x = np.array(got["x"].combine_chunks().flatten().to_numpy(), np.float64).reshape(-1, len(FEATURES)) if len(got) else np.empty((0, len(FEATURES)))
    return gbt.fit(x, got["y"].to_numpy().astype(np.float64), trees=TREES, depth=DEPTH, rate=RATE)


def predict(rows: DataFrame, trees: gbt.Trees) -> DataFrame:
    """Adds ``score``; the flat arrays (some kilobytes) are broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("double")
    def of(xs: pa.Array) -> pa.Array:
        x = np.asarray(xs.flatten()).astype(np.float64).reshape(-1, len(FEATURES))
        return pa.array(shared.value.probability(x), pa.float64())

    return rows.withColumn("score", of("x"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``score``, ``predicted``.

    Learns from labelled rows whose crc32(id as text) mod 5 is not 0. A null text counts as
    empty and is scored like any other; a null id has no label and counts as the empty text in
    the fold; without labels, or with one class only, every score is the smoothed share of
    class 1; repeated rows each get a row; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    held = fold_bucket(5, id_col) == 0
    rows = cut(docs.select(F.col(id_col).alias("id"), held.alias("held_out"), statistics_column(F.col(text_col).cast("string")).alias("x")), "statistics")
    trees = fit(rows, labels, ~F.col("held_out"))
    out = predict(rows, trees)
    return out.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
