"""Directory scans, per-format dispatch, and the processed-document sink.

Formats become plans that are united; a file that cannot be read becomes a row with an
``error`` and does not stop the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.extract import contract, not_yet
from ..shared import cut
from . import articles, csvs, geo, html, paged

EXTENSIONS = ("pdf", "csv", "html", "json", "pbf")


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """All files under ``root`` whose lower-cased extension is accepted: path, length, ext, content.
    Others are not listed, let alone read."""
    either = ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in e) for e in extensions)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{either}}}").load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("ext", ext).where(F.col("ext").isin(*extensions))


def extract(spark: SparkSession, root: str, done: DataFrame | None = None, phenomenon: str = "1") -> tuple[DataFrame, DataFrame]:
    """Processed documents of a tree, and the files that failed (``path, error``). ``done``
    (``path``) holds what an earlier run has processed. Paths keep their extension as key, so
    files of one name in two formats stay apart. A file is read and parsed once, by its format's
    reader, into a table that both results come from."""
    good, bad = [], []
    for kind, reader in {"html": html.documents, "json": articles.documents, "csv": csvs.documents, "pdf": paged.documents, "pbf": geo.documents}.items():
        files = scan(spark, root, (kind,))
        if done is not None:
            files = not_yet(files, done, "path")
        found = cut(reader(files), f"read-{kind}")
        good.append(contract(found.where("error IS NULL"), kind, phenomenon).withColumn("path", F.col("metadata.fuente")))
        bad.append(found.where("error IS NOT NULL").select("path", "error"))

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    return union(good).drop("path"), union(bad)


def write_processed(docs: DataFrame, path: str) -> None:
    """JSON, one folder per source type."""
    docs.withColumn("tipo_fuente", F.col("metadata.tipo_fuente")).write.mode("append").partitionBy("tipo_fuente").json(path)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Processed documents, one JSON object (or list) a file or a line; unreadable ones are skipped."""
    lines = spark.read.schema(schemas.PROCESSED_DOCUMENT).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    return lines.where("texto IS NOT NULL OR metadata IS NOT NULL")


def chunk_inputs(processed: DataFrame, path: str | None = None) -> DataFrame:
    """The chunker's columns, with the defaults for what is missing."""
    m = F.col("metadata")
    name = F.col(path) if path else F.lit("")
    stem = F.regexp_extract(name, r"([^/]*?)(?:\.[^./]*)?$", 1)
    filled = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), d)
    return processed.select(
        filled(m["doc_id"], stem).alias("doc_id"),
        "texto",
        filled(m["fuente"], F.regexp_extract(name, "[^/]*$", 0)).alias("fuente"),
        F.lower(filled(m["tipo_fuente"], F.lit("pdf"))).alias("formato"),
        F.coalesce(m["Fenomeno"].try_cast("int"), F.lit(1)).alias("fenomeno"),
        filled(m["idioma"], F.lit("es")).alias("idioma"),
    )
