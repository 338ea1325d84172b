"""Paged documents: text bands and tables of pages (schemas.PAGED_BLOCK).

There is no PDF decoder here; one plugs in as a function from bytes to blocks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators.extract import paged_documents, repeated_lines

ATTRIBUTE = "procesamiento_espacial_tabular_fila_por_fila"
Decoder = Callable[[bytes], list[dict]]


def blocks_to_documents(blocks: DataFrame) -> DataFrame:
    """Find each document's repeated lines over its pages, then assemble it."""
    pages = blocks.where("kind = 'text'").groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "lines"))), lambda x: F.array_join(x["lines"], "\n")), "\n").alias("text"))
    return paged_documents(blocks, repeated_lines(pages, "doc_id", "text"))


def documents(files: DataFrame, decode: Decoder | None = None) -> DataFrame:
    """Raw documents of paged files (``path, content``); without a decoder the content must be
    the blocks as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = decode(content) if decode else json.loads(content)
                    rows += [(path, json.dumps(x | {"doc_id": path}, ensure_ascii=False), None) for x in found]
                except Exception as e:  # one file must not stop the others
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_pydict({k: pa.array(c, pa.string()) for k, c in zip(("path", "block", "error"), cols, strict=True)})

    rows = files.select("path", "content").mapInArrow(run, "path string, block string, error string")
    blocks = rows.where("error IS NULL").select(F.from_json("block", schemas.PAGED_BLOCK).alias("b")).select("b.*")
    texts = blocks_to_documents(blocks).withColumnRenamed("doc_id", "path")
    none = F.lit(None).cast("string")
    good = texts.select("path", F.sha2("path", 256).alias("doc_id"), none.alias("title"), "raw_text", F.create_map(F.lit("atributo_adicional"), F.lit(ATTRIBUTE)).alias("metadata"), none.alias("error"))
    bad = rows.where("error IS NOT NULL").select("path", none.alias("doc_id"), none.alias("title"), none.alias("raw_text"), F.lit(None).cast("map<string,string>").alias("metadata"), "error")
    return good.unionByName(bad)
