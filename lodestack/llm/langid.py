"""Language identification: word-first backoff.

A known word is scored by its log frequency in each language; an unseen word falls back to
character n-grams of its padded form, the longest length with a known n-gram first. Words and
n-grams are counted in Spark over all words of the documents that the model is fitted on.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, discard, fold_bucket, free_name


def _not_letters() -> str:
    """Ranges of the code points that ``\\w`` matches beside letters, digits and the underscore."""
    at = [c for c in range(sys.maxunicode + 1) if (x := chr(c)).isalnum() and not x.isalpha() and not x.isdecimal()]
    edges = [i for i in range(len(at)) if not i or at[i] != at[i - 1] + 1] + [len(at)]
    return "".join(f"\\U{at[a]:08x}-\\U{at[b - 1]:08x}" for a, b in zip(edges, edges[1:], strict=False))


#: Runs of letters.
WORDS = re.compile(rf"[^\W\d_{_not_letters()}]+")
#: Bound of the model: labelled documents it is fitted on (a hash sample, whole texts). Lengths
#: of n-grams.
TRAIN_DOCS, LENGTHS = 20_000, (5, 4, 3, 2, 1)
#: Words whose fallback score a worker remembers.
MEMO = 100_000
UNKNOWN = "und"


class WordFirstModel:
    """Score vectors over the languages for words and n-grams."""

    def __init__(self, langs: list[str], words: tuple[pa.Array, np.ndarray], grams: dict[int, tuple[pa.Array, np.ndarray]]):
        """``words`` and, by length, ``grams``: each with its occurrences by language."""
        tables = {0: words, **grams}
        self.langs, self.names = langs, {n: names for n, (names, _) in tables.items()}
        self.scores = {n: self._log(table) for n, (_, table) in tables.items()}

    def __getstate__(self):
        return self.langs, self.names, self.scores

    def __setstate__(self, state):
        self.langs, self.names, self.scores = state

    @cached_property
    def find(self) -> dict[int, dict[str, int]]:
        """Places of words (0) and n-grams by length; built where texts are scored."""
        return {n: {w: i for i, w in enumerate(names.to_pylist())} for n, names in self.names.items()}

    @cached_property
    def memo(self) -> dict[str, int]:
        self.memo_scores = np.zeros((MEMO, len(self.langs)))
        return {}

    @staticmethod
    def _log(table: np.ndarray) -> np.ndarray:
        """Smoothed log frequency within each language, relative to the languages' mean."""
        if not table.size:
            return table
        logs = np.log(table + 0.5) - np.log(table.sum(0) + 0.5 * len(table))
        logs -= logs.mean(1, keepdims=True)
        return logs

    @staticmethod
    def split(word: str, n: int) -> list[str]:
        padded = f"<{word}>"
        return [padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n] not in "<>"]

    def unseen(self, word: str) -> np.ndarray:
        at = self.memo.get(word)
        if at is None:
            got = np.zeros(len(self.langs))
            for n in LENGTHS:
                find = self.find[n]
                known = [find[g] for g in self.split(word, n) if g in find]
                if known:
                    got = self.scores[n][known].mean(0)
                    break
            if len(self.memo) >= MEMO:
                self.memo.clear()
            at = self.memo[word] = len(self.memo)
            self.memo_scores[at] = got
        return self.memo_scores[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORDS.findall(text.lower()) if text else []
        if not words or not self.langs:
            return UNKNOWN, 0.0
        known = list(map(self.find[0].get, words))
        at = np.array([i for i in known if i is not None], np.int64)
        total = self.scores[0][at].sum(0)
        if len(at) < len(words):
            for w, n in Counter(w for w, i in zip(words, known, strict=True) if i is None).items():
                total = total + n * self.unseen(w)
        total = total / math.sqrt(len(words))
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def flush():
        rows = [(lang, w, c) for lang, by in counts.items() for w, c in by.items()]
        counts.clear()
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            counts[lang.as_py()].update(WORDS.findall(text.as_py().lower()))
            if sum(map(len, counts.values())) > 500_000:
                yield flush()
    yield flush()


def grams(word: Column, n: int) -> Column:
    """All n-grams of the padded word; the bare pads do not count."""
    padded = F.concat(F.lit("<"), word, F.lit(">"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1)))
    each = F.transform(starts, lambda i: F.substr(padded, i, F.lit(n)))
    return F.filter(each, lambda g: (F.length(g) == n) & ~g.isin("<", ">"))


def fit(docs: DataFrame, train: Column, max_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> WordFirstModel:
    """Learn from at most about ``max_docs`` of the labelled rows for which ``train`` holds,
    chosen by a hash of the id. The model holds all their words and n-grams."""
    bound_batches(docs.sparkSession)
    some = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = some.count()
    if n > max_docs:
        some = some.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("langid")), F.lit(1 << 30)) < int((1 << 30) * max_docs / n))
    words = some.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(_count_words, "lang string, word string, n long")
    words = cut(words.groupBy("word", "lang").agg(F.sum("n").alias("n")), "words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())

    def table(rows: DataFrame) -> tuple[pa.Array, np.ndarray]:
        sums = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
        got = rows.groupBy("word").agg(F.lit(0).alias("z"), *sums).toArrow().combine_chunks().sort_by("word")
        names = got.column("word").combine_chunks()
        counts = [got.column(f"n{i}").to_numpy() for i in range(len(langs))]
        return names, np.array(counts, np.float64).T.reshape(len(names), len(langs))

    model = WordFirstModel(langs, table(words), {k: table(words.select("lang", "n", F.explode(grams(F.col("word"), k)).alias("word"))) for k in LENGTHS})
    discard(words)
    return model


def predict(docs: DataFrame, model: WordFirstModel, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (in place of columns of that name). Null text or text
    without a letter: ``und``, 0."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def of(texts: pa.Array) -> pa.Array:
        got = [shared.value.predict(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])

    found = free_name(docs, "found")
    out = docs.withColumn(found, of(F.col(text_col).cast("string")))
    return out.withColumn("lang_pred", F.col(found)["lang_pred"]).withColumn("score", F.col(found)["score"]).drop(found)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, ``held_out``, ``lang_pred``, ``score``.

    Learns from rows whose crc32(id as text) mod 4 is not 2. A null id counts as the empty
    text; a null text or one without a letter (numerals such as \u00b2 or \u2163 are none) is ``und`` with
    score 0, as is everything when no labelled row exists; repeated rows each get a row; an empty
    table gives an empty result; other columns, whatever their names, are ignored; ties between
    languages go to the first in code-point order. Whole texts, of any length.
    """
    held = fold_bucket(4, id_col) == 2
    model = fit(docs, ~held, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
