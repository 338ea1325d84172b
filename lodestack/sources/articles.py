"""JSON articles: whole files or one object a line, lists unpacked, flattened to text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..operators.extract import IMAGE_MARKS, TEXT_KEYS, article_metadata, article_text


def objects(content: str) -> list[Any]:
    """The values of a file: line by line if the first line is JSON by itself and all lines
    are, else the whole file."""
    lines = content.split("\n")
    try:
        json.loads(lines[0].strip())
        return [json.loads(x) for x in lines if x.strip()]
    except json.JSONDecodeError:
        return [json.loads(content)]


def unpacked(value: Any) -> Iterator[Any]:
    """Lists within lists to their elements."""
    if isinstance(value, list):
        for v in value:
            yield from unpacked(v)
    else:
        yield value


def _is_link(v: Any) -> bool:
    return isinstance(v, dict) and "url" in v


def normalised(value: Any) -> dict[str, Any]:
    """An object in the shape of schemas.ARTICLE; a scalar is a document of its own text."""
    if not isinstance(value, dict):
        return {"body_text": str(value)}
    text = lambda v: None if v is None else str(v)
    texts = lambda v: [str(x) for x in v] if isinstance(v, list) else None
    out: dict[str, Any] = {k: text(value.get(k)) for k in ("doc_id", "id", "title", "titulo", "body_text")}
    sections = value.get("sections")
    if isinstance(sections, list):
        out["sections"] = [{"heading": text(s.get("heading")), "paragraphs": texts(s.get("paragraphs"))} for s in sections if isinstance(s, dict)]
    out["lists"] = texts(value.get("lists"))
    body = value.get("body_paragraphs")
    out["body_paragraphs"] = texts(body) if isinstance(body, list) else [str(body)] if body else None
    links, metadata = [], {}
    for k, v in value.items():
        if isinstance(v, list) and v and all(map(_is_link, v)):
            links += v
        elif _is_link(v):
            links.append(v)
        elif k not in TEXT_KEYS and ("link" in k.lower() or not any(m in k.lower() for m in IMAGE_MARKS)):
            metadata[k] = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    out["links"] = [{"text": str(x.get("text", "Link")), "url": str(x.get("url", ""))} for x in links]
    out["metadata"] = metadata
    return out


def flatten(articles: DataFrame, path: str = "path") -> DataFrame:
    """Rows of schemas.ARTICLE (and ``path``) to raw documents."""
    title = X.first_filled(F.col("title"), F.col("titulo"))
    text = article_text(title, F.col("sections"), F.col("lists"), F.col("body_text"), F.col("body_paragraphs"), F.col("links"))
    own = X.first_filled(F.col("doc_id"), F.col("id"))
    return articles.select(
        path,
        F.coalesce(own, F.sha2(F.concat_ws("|", path, text), 256)).alias("doc_id"),
        X.strip(F.coalesce(title, F.lit("Untitled"))).alias("title"),
        text.alias("raw_text"),
        article_metadata(F.coalesce("metadata", F.create_map().cast("map<string,string>"))).alias("metadata"),
    )


def documents(files: DataFrame) -> DataFrame:
    """Raw documents of JSON files (``path, content``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = [json.dumps(normalised(x), ensure_ascii=False) for v in objects(content.decode("utf-8")) for x in unpacked(v)]
                    rows += [(path, x, None) for x in found]
                except Exception as e:  # one file must not stop the others
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_pydict({k: pa.array(c, pa.string()) for k, c in zip(("path", "article", "error"), cols, strict=True)})

    rows = files.select("path", "content").mapInArrow(run, "path string, article string, error string")
    parsed = rows.select("path", "error", F.from_json("article", schemas.ARTICLE).alias("a")).select("path", "error", "a.*")
    good = flatten(parsed.where("error IS NULL")).withColumn("error", F.lit(None).cast("string"))
    bad = parsed.where("error IS NOT NULL").select("path", F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("raw_text"), F.lit(None).cast("map<string,string>").alias("metadata"), "error")
    return good.unionByName(bad)
