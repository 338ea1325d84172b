"""CSV: every row a sentence, every file one document. All values are text."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import row_sentence, table_document


def read(spark: SparkSession, path: str) -> DataFrame:
    """One table of text columns; empty cells stay empty, quoted line breaks are kept."""
    return spark.read.option("header", True).option("inferSchema", False).option("emptyValue", "").option("multiLine", True).option("escape", '"').csv(path)


def table(spark: SparkSession, path: str) -> DataFrame:
    """The document of one large CSV file, read in parallel by Spark's own reader."""
    rows = read(spark, path).fillna("")
    names = rows.columns
    rows = rows.withColumn("sentence", row_sentence(names)).withColumn("ord", F.monotonically_increasing_id()).withColumn("path", F.lit(path))
    return table_document(rows, ["path"], ["ord"])


def documents(files: DataFrame) -> DataFrame:
    """Raw documents of many small CSV files (``path, content``), each with its own header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {"path": [], "raw_text": [], "n": [], "error": []}
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text, n, error = None, 0, None
                try:
                    reader = csv.reader(io.StringIO(content.decode("utf-8")))
                    names = next(reader)
                    cells = ([f"{k.strip()}: {v.strip()}" for k, v in zip(names, row, strict=False) if v.strip()] for row in reader)
                    sentences = [" | ".join(c) + "." for c in cells if c]
                    text, n = " ".join(sentences), len(sentences)
                except Exception as e:  # one file must not stop the others
                    error = f"{type(e).__name__}: {e}"
                for k, v in zip(rows, (path, text, n, error), strict=True):
                    rows[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "n" else pa.string()) for k, v in rows.items()})

    out = files.select("path", "content").mapInArrow(run, "path string, raw_text string, n long, error string")
    attribute = F.concat(F.lit("total_filas_consolidadas_"), F.col("n").cast("string"))
    return out.select("path", F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("string").alias("title"), "raw_text", F.create_map(F.lit("atributo_adicional"), attribute).alias("metadata"), "error")
