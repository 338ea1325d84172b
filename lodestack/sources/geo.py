"""Geographic features. GeoJSON collections are read directly; binary tiles need a decoder,
given as a function from bytes to GeoJSON text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators.extract import feature_id, feature_text

COLLECTION = "PBF_FeatureCollection"


def features(content: str) -> tuple[str, list[dict]]:
    """Name and features (schemas.GEO_FEATURE) of a collection; anything else has none."""
    data = json.loads(content)
    if not (isinstance(data, dict) and data.get("type") == "FeatureCollection" and isinstance(data.get("features"), list)):
        return "", []
    out = []
    for f in data["features"]:
        if isinstance(f, dict):
            shape = f.get("geometry")
            properties = {k: None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in (f.get("properties") or {}).items()}
            own = f.get("id")
            out.append({"id": None if own is None else str(own), "properties": properties, "geometry": {"type": shape.get("type", "N/A"), "coordinates": json.dumps(shape.get("coordinates"))} if isinstance(shape, dict) else None})
    return str(data.get("name", COLLECTION)), out


def flatten(rows: DataFrame) -> DataFrame:
    """``path, collection, id, properties, geometry`` to raw documents; the geometry goes."""
    text = feature_text(F.col("properties"), F.coalesce(F.col("geometry.type"), F.lit("N/A")), F.coalesce(F.col("geometry.coordinates"), F.lit("")), F.col("collection"))
    meta = F.create_map(F.lit("format"), F.lit("pbf"), F.lit("geometry_type"), F.coalesce(F.col("geometry.type"), F.lit("N/A")), F.lit("atributo_adicional"), F.lit("pbf_document"))
    return rows.select("path", F.coalesce(feature_id(F.col("properties"), F.col("id")), F.sha2(F.concat_ws("|", "path", text), 256)).alias("doc_id"), F.regexp_extract(text, r"(?s)^(.*?)\.", 1).alias("title"), text.alias("raw_text"), meta.alias("metadata"))


def documents(files: DataFrame, decode: Callable[[bytes], str] | None = None) -> DataFrame:
    """Raw documents of feature files (``path, content``). A file that cannot be decoded gives
    no documents and no error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    name, found = features(decode(content) if decode else content.decode("utf-8"))
                    rows += [(path, name, json.dumps(f, ensure_ascii=False)) for f in found]
                except Exception:  # noqa: BLE001, S112 - by contract such a file is empty
                    continue
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_pydict({k: pa.array(c, pa.string()) for k, c in zip(("path", "collection", "feature"), cols, strict=True)})

    rows = files.select("path", "content").mapInArrow(run, "path string, collection string, feature string")
    return flatten(rows.select("path", "collection", F.from_json("feature", schemas.GEO_FEATURE).alias("f")).select("path", "collection", "f.*")).withColumn("error", F.lit(None).cast("string"))
