"""The corpus pipeline: documents in, encoded training mix out.

Stages, in order: language ID (documents that it rejects go), SimHash near-dedup (one document
of each group stays), PII (spans are replaced), mixing sources to target weights (documents are
dropped or repeated), byte-level BPE encoding. Each stage's result is written as Parquet and
read again as the next one's ``docs``; all but the last return the columns of ``documents``
that they were given, under any names and with any others beside them. :func:`run` deletes the
tables that a stage needed for itself when it has been written, its input when the next one has.
A stage that is called by itself leaves its tables to the next call of a stage, which deletes
them unless its own input still reads them: write a stage's result before calling the next.

Nulls and ties: a null text is rejected by the first stage; of a group of near-duplicates the
row with the smallest id stays (nulls last), and of repeated rows one. An empty table stays
empty; texts of any length are taken whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bpe, langid, mixing, pii, simhash
from lodestack.llm.common import fold_bucket
from lodestack.shared import dealt, discard, discard_unread, in_block, new_path, noted, temporary, write

#: Share of the probability that the best language needs.
LEAST_SCORE = 0.5


#: Tables of the stage that was called last.
_left: list[DataFrame] = []
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if in_block():
            return f(spark, docs, sf_dir)
        _left[:] = discard_unread(_left, docs)
        with noted() as tables:
            out = f(spark, docs, sf_dir)
        _left.extend(tables)
        return out

    return call


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised: not ``und`` and at LEAST_SCORE or more.
    Null texts and those without a letter go; repeated rows stay what they are."""
    model = langid.fit(docs, fold_bucket(4) != 2)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    found = langid.predict(rows, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near-duplicates: the smallest id, nulls last."""
    return simhash.keep_one(docs)


@stage
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; ``n_chars``, where there, follows. Null texts stay."""
    return pii.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources meet their targets. A null source is one of its
    own; texts without a word are never taken."""
    return mixing.blend(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the byte offset of each, and whether they decode to
    the document's text. A null text has no ids; repeated rows each get a row."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", "ids", "id_starts", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("PII", redact),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL cannot express the learnt stages; tests hold run() against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for _, step in STAGES:
        path = new_path(spark, "stage")
        with temporary():
            write(step(spark, docs, sf_dir).write, spark, path)
        discard(docs)
        docs = spark.read.parquet(path)
        docs._lodestack_path = path
    return docs
