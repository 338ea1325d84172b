"""Line and table sinks: chunk metadata, dictionary, question set, results, GraphML."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def write_chunks(chunks: DataFrame, path: str, encoders: list[str], max_words: int, overlap: int) -> None:
    """Chunk lines per encoder, and the encoders with their settings as a table of their own."""
    spark = chunks.sparkSession
    header = spark.createDataFrame([("encoder_header", e, max_words, overlap) for e in encoders], schemas.ENCODER_HEADER)
    header.coalesce(1).write.mode("overwrite").json(f"{path}/encoders")
    every = chunks.withColumn("encoder", F.explode(F.array(*[F.lit(e) for e in encoders])))
    every.write.mode("overwrite").partitionBy("encoder").json(f"{path}/chunks")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk lines: headers, blank and broken lines and lines without a chunk id are skipped."""
    lines = spark.read.schema(f"type string, {schemas.CHUNK}, encoder string").option("mode", "DROPMALFORMED").json(path)
    return lines.where("type IS NULL OR type <> 'encoder_header'").where("coalesce(chunk_id, '') <> ''").drop("type")


def write_dictionary(words: DataFrame, path: str) -> None:
    words.select("word", "count").write.mode("overwrite").option("sep", " ").csv(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DICTIONARY).option("sep", " ").csv(path)


def read_questions(spark: SparkSession, *paths: str) -> DataFrame:
    """A JSON object from query id to text, from the first path that is there."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            text = spark.read.option("wholetext", True).text(path)
        except AnalysisException:
            continue
        return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("query_id", "query_text"))
    raise FileNotFoundError(f"none of {paths}")


def write_results(responses: DataFrame, path: str) -> None:
    """One line a response, in the order of the query ids, in one file."""
    responses.orderBy("query_id").coalesce(1).write.mode("overwrite").json(path)


GRAPHML_LIMIT = 5_000_000


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph file for other tools; it is written by the driver, row by row, up to a checked
    size. Larger graphs stay in their two tables."""
    if nodes.count() + edges.count() > GRAPHML_LIMIT:
        raise ValueError("too large for one GraphML file; write the node and edge tables")
    keys = [("label", "node", "string"), ("entity_type", "node", "string"), ("relation", "edge", "string"), ("chunk_id", "edge", "string"), ("doc_id", "edge", "string"), ("fenomeno", "edge", "long")]
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for name, of, kind in keys:
            f.write(f'<key id="{name}" for="{of}" attr.name="{name}" attr.type="{kind}"/>\n')
        f.write('<graph edgedefault="directed">\n')
        for r in nodes.orderBy("seen").toLocalIterator():
            f.write(f"<node id={quoteattr(r['id'])}><data key=\"label\">{escape(r['label'])}</data><data key=\"entity_type\">{escape(r['entity_type'])}</data></node>\n")
        for r in edges.orderBy("src", "dst").toLocalIterator():
            f.write(f"<edge source={quoteattr(r['src'])} target={quoteattr(r['dst'])}>")
            for name, value in (("relation", r["relation"]), ("chunk_id", ",".join(r["chunk_id"])), ("doc_id", r["doc_id"]), ("fenomeno", str(r["fenomeno"]))):
                f.write(f'<data key="{name}">{escape(value)}</data>')
            f.write("</edge>\n")
        f.write("</graph>\n</graphml>\n")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of a GraphML file; chunk ids are split at commas."""
    import xml.etree.ElementTree as ET

    ns = "{http://graphml.graphdrawing.org/xmlns}"
    nodes, edges = [], []
    for _, e in ET.iterparse(path):
        data = {d.get("key"): d.text or "" for d in e.findall(f"{ns}data")}
        if e.tag == f"{ns}node":
            nodes.append((e.get("id"), data.get("label"), data.get("entity_type")))
            e.clear()
        elif e.tag == f"{ns}edge":
            edges.append((e.get("source"), e.get("target"), data.get("relation"), data.get("chunk_id", "").split(","), data.get("doc_id"), int(data.get("fenomeno", "0"))))
            e.clear()
    return spark.createDataFrame(nodes, schemas.NODE), spark.createDataFrame(edges, schemas.EDGE)


def read_config(path: str) -> dict:
    """max_words, overlap_sentences, log_interval, encoders; a missing file raises."""
    with open(path, encoding="utf-8") as f:
        return {"max_words": 250, "overlap_sentences": 1, "log_interval": 25, "encoders": []} | json.load(f)
