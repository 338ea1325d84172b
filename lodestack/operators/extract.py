"""Extraction projections: rows, trees and features to text, and the document contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

NO_ATTRIBUTE = "sin_atributo_especifico"
#: Repeated lines: least normalised length, least count, share of the pages.
ARTEFACT_LENGTH, ARTEFACT_COUNT, ARTEFACT_SHARE = 5, 3, 0.3
# Keys of an article that hold text, and marks of keys about images.
TEXT_KEYS = ("title", "titulo", "sections", "lists", "body_text", "body_paragraphs", "id", "doc_id")
IMAGE_MARKS = ("image", "img", "thumbnail", "picture", "figure", "photo", "url", "cover", "portada")
# Marks of property keys that hold prose.
PROSE_MARKS = ("popup", "description", "resumen", "texto", "notes")


def contract(docs: DataFrame, source_type: str, phenomenon: str = "1", language: Column | None = None) -> DataFrame:
    """Raw documents (``doc_id, raw_text, metadata, path``) to processed ones; empty texts go.
    A missing id becomes a hash of path and text, so that reruns agree."""
    d = X.once(docs, "texto", X.clean_text(F.col("raw_text"))).where(F.col("texto") != "")
    meta = F.col("metadata")
    return d.select(
        "texto",
        F.struct(
            X.word_count(F.col("texto")).alias("total_palabras"),
            F.coalesce(X.first_filled(meta["atributo_adicional"], meta["title"]), F.lit(NO_ATTRIBUTE)).alias("atributo_adicional"),
            F.regexp_extract("path", "[^/]+$", 0).alias("fuente"),
            F.lit(source_type).alias("tipo_fuente"),
            X.clamp_language(language if language is not None else X.detect_language(F.col("texto"))).alias("idioma"),
            F.coalesce(F.col("doc_id"), F.sha2(F.concat_ws("|", "path", "raw_text"), 256)).alias("doc_id"),
            F.lit(phenomenon).alias("Fenomeno"),
        ).alias("metadata"),
    )


def labelled(names: list[str], values: list[Column]) -> Column:
    """``name: value`` of the filled values, joined by bars and closed; null if none is."""
    cells = [F.when(X.strip(v.cast("string")) != "", F.concat(F.lit(f"{n.strip()}: "), X.strip(v.cast("string")))) for n, v in zip(names, values, strict=True)]
    row = F.concat_ws(" | ", *cells)
    return F.when(row != "", F.concat(row, F.lit(".")))


def row_sentence(columns: list[str]) -> Column:
    return labelled(columns, [F.col(f"`{c}`") for c in columns])


def table_document(rows: DataFrame, keys: list[str], order: list[str], sentence: str = "sentence") -> DataFrame:
    """One text per key: its rows' sentences in order, and how many there were."""
    item = F.struct(*order, F.col(sentence).alias("s"))
    some = rows.where(F.col(sentence).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))
    return some.select(*keys, F.array_join(F.transform("all", lambda x: x["s"]), " ").alias("raw_text"), F.concat(F.lit("total_filas_consolidadas_"), F.size("all").cast("string")).alias("atributo_adicional"))


def table_sentences(cells: Column) -> Column:
    """Sentences of a table whose first row is its header; tables of one row give none."""
    flat = F.transform(cells, lambda r: F.transform(r, lambda c: X.strip(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "))))
    head = F.element_at(flat, 1)

    def sentence(r: Column) -> Column:
        named = F.transform(r, lambda v, i: F.when(v != "", F.concat(F.coalesce(F.nullif(F.get(head, i), F.lit("")), F.concat(F.lit("Columna_"), (i + 1).cast("string"))), F.lit(": "), v)))
        return F.concat(F.array_join(F.filter(named, lambda x: x.isNotNull()), " | "), F.lit("."))

    rows = F.filter(F.slice(flat, F.lit(2), F.greatest(F.size(flat) - 1, F.lit(0))), lambda r: F.exists(r, lambda v: v != ""))
    return F.when(F.size(cells) > 1, F.transform(rows, sentence)).otherwise(F.array().cast("array<string>"))


def artefact_form(line: Column) -> Column:
    return F.lower(X.strip(F.regexp_replace(line, r"(?U)\d+", "")))


def repeated_lines(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that repeat within a document of several pages: key, line, occurrences."""
    lines = pages.select(key, F.explode(F.split(text, "\n")).alias("line")).select(key, artefact_form(F.col("line")).alias("line"))
    counts = lines.where(F.length("line") >= ARTEFACT_LENGTH).groupBy(key, "line").agg(F.count("*").alias("occurrences"))
    n_pages = pages.groupBy(key).agg(F.count("*").alias("pages"))
    least = F.greatest(F.lit(ARTEFACT_COUNT), F.floor(F.col("pages") * ARTEFACT_SHARE))
    return counts.join(n_pages, key).where(F.col("occurrences") >= least).select(key, "line", "occurrences")


def page_lines(pages: DataFrame, key: str, page: str, text: str, artefacts: DataFrame) -> DataFrame:
    """Lines that stay, closed: not blank, no repeated line, no page number. The comparison
    form is stripped before its digits go, not after, so a line that ends in a number is
    compared with the space before it."""
    rows = pages.select(key, page, F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("line", X.strip(F.col("line")))
    rows = rows.where((F.col("line") != "") & ~F.col("line").rlike(r"(?iu)^(p[áa]gina\s+\d+|page\s+\d+)"))
    form = F.lower(F.regexp_replace("line", r"(?U)\d+", ""))
    rows = rows.withColumn("form", form)
    kept = rows.join(artefacts.select(F.col(key), F.col("line").alias("form")), [key, "form"], "left_anti")
    return kept.select(key, page, "at", X.closed(F.col("line"), ".?!;:,").alias("line"))


def paged_documents(blocks: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Blocks (``doc_id, page, y0, kind`` text or table, ``lines``, ``cells``) to one text a
    document: bands and tables from top to bottom, tables row by row."""
    order = ["doc_id", "page", "y0", "part"]
    tables = blocks.where("kind = 'table'").select("doc_id", "page", "y0", F.lit(1).alias("part"), F.posexplode(table_sentences(F.col("cells"))).alias("at", "line"))
    bands = blocks.where("kind = 'text'").select("doc_id", F.struct("page", "y0", F.lit(0).alias("part")).alias("place"), F.array_join("lines", "\n").alias("text"))
    bands = page_lines(bands, "doc_id", "place", "text", artefacts).select("doc_id", "place.*", "at", "line")
    every = bands.unionByName(tables.select("doc_id", "page", "y0", "part", "at", "line"))
    lines = every.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order[1:], "at", "line"))).alias("all"))
    joined = F.array_join(F.transform("all", lambda x: x["line"]), " ")
    return lines.select("doc_id", X.strip(F.regexp_replace(joined, r"(?U)\s+", " ")).alias("raw_text"))


def article_text(title: Column, sections: Column, lists: Column, body_text: Column, body_paragraphs: Column, links: Column) -> Column:
    """The text of an article, in this order, joined by spaces; nulls and blanks are skipped."""

    def filled(a: Column) -> Column:
        return F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), X.strip), lambda s: s != "")

    t = X.strip(F.coalesce(X.first_filled(title), F.lit("Untitled")))
    head = F.when(t != "Untitled", F.array(F.concat(t, F.lit(".")))).otherwise(F.array().cast("array<string>"))
    parts = F.flatten(
        F.transform(
            F.coalesce(sections, F.array().cast("array<struct<heading:string,paragraphs:array<string>>>")),
            lambda s: F.array_compact(F.array(F.when(F.coalesce(s["heading"], F.lit("")) != "", F.concat(X.strip(s["heading"]), F.lit("."))), F.when(s["paragraphs"].isNotNull(), F.array_join(filled(s["paragraphs"]), " ")))),
        )
    )
    items = F.when(lists.isNotNull(), F.array(F.array_join(F.transform(filled(lists), lambda s: F.concat(s, F.lit("."))), " ")))
    body = F.when(F.coalesce(body_text, F.lit("")) != "", F.array(X.strip(body_text)))
    more = F.when(F.size(F.coalesce(body_paragraphs, F.array().cast("array<string>"))) > 0, F.array(F.array_join(filled(body_paragraphs), " ")))
    urls = F.transform(F.filter(F.coalesce(links, F.array().cast("array<struct<text:string,url:string>>")), lambda x: X.strip(F.coalesce(x["url"], F.lit(""))) != ""), lambda x: F.concat(X.strip(F.coalesce(x["text"], F.lit("Link"))), F.lit(": "), X.strip(x["url"]), F.lit(".")))
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(head, parts, F.coalesce(items, none), F.coalesce(body, none), F.coalesce(more, none), urls), " ")


def article_metadata(m: Column) -> Column:
    """Metadata of an article: no text keys, no keys about images (links stay), and the format."""
    image = "|".join(IMAGE_MARKS)
    kept = F.map_filter(m, lambda k, v: ~k.isin(*TEXT_KEYS) & (F.lower(k).contains("link") | ~F.lower(k).rlike(image)))
    return F.map_concat(F.map_filter(kept, lambda k, v: k != "format"), F.create_map(F.lit("format"), F.lit("json")))


def feature_text(properties: Column, kind: Column, coordinates: Column, collection: Column) -> Column:
    """The text of a geographic feature: place, shape, properties, prose. ``coordinates`` is
    the raw JSON; nodes are counted by its closing brackets."""

    def prop(*names: str) -> Column:
        return X.first_filled(*[properties[n] for n in names])

    place = F.concat_ws(", ", prop("au_level2", "b_ADM2_PT"), prop("au_level1", "b_ADM1_PT"), prop("au_country", "b_adm1_geral"))
    place = F.when(place != "", place).otherwise(F.lit("Ubicación no especificada"))
    title = F.concat(F.when(F.coalesce(collection, F.lit("")) != "", F.concat(collection, F.lit(" - "))).otherwise(F.lit("")), F.lit("Registro Geográfico: "), place, F.lit("."))
    nodes = F.floor((F.length(coordinates) - F.length(F.replace(coordinates, F.lit("]"), F.lit("")))) / 2).cast("string")
    low = F.lower(kind)
    at = F.split(F.regexp_replace(coordinates, r"[\[\]\s]", ""), ",")

    def rounded(c: Column) -> Column:
        return F.bround(c.cast("double"), 4).cast("string")

    shape = (
        F.when((low == "point") & (F.size(at) >= 2), F.concat(F.lit("Punto de interés espacial ubicado en las coordenadas: latitud "), rounded(F.get(at, F.lit(1))), F.lit(", longitud "), rounded(F.get(at, F.lit(0))), F.lit(".")))
        .when(low.isin("polygon", "multipolygon"), F.concat(F.lit("Delimitación espacial estructurada como "), kind, F.lit(". Esta área geográfica está definida por un polígono cerrado compuesto por aproximadamente "), F.coalesce(nodes, F.lit("0")), F.lit(" nodos topológicos.")))
        .when(low.isin("linestring", "multilinestring"), F.concat(F.lit("Estructura lineal geográfica de tipo "), kind, F.lit(", trazada a través de "), F.coalesce(nodes, F.lit("0")), F.lit(" puntos de referencia.")))
    )
    entries = F.filter(F.transform(F.map_entries(properties), lambda e: F.struct(e["key"].alias("k"), X.strip(F.coalesce(e["value"], F.lit(""))).alias("v"))), lambda e: (e["v"] != "") & (e["k"] != "geometry"))
    prose = "|".join(PROSE_MARKS)
    plain = F.array_join(F.transform(F.filter(entries, lambda e: ~F.lower(e["k"]).rlike(prose)), lambda e: F.concat(e["k"], F.lit(": "), e["v"])), " | ")
    told = F.array_join(F.transform(F.filter(entries, lambda e: F.lower(e["k"]).rlike(prose)), lambda e: F.concat(F.lit("Información Detallada ("), e["k"], F.lit("): "), X.closed(X.strip(F.regexp_replace(e["v"], r"(?U)\s+", " "))))), " ")
    return F.concat_ws(" ", title, shape, F.nullif(X.closed(plain), F.lit("")), F.nullif(told, F.lit("")))


def feature_id(properties: Column, own: Column) -> Column:
    return X.first_filled(properties["b_ID_concatenated"], properties["au_ID_concatenated"], own, properties["fid"])


def not_yet(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet, by their full key."""
    return inputs.join(done.select(key), key, "left_anti")


def first_per(df: DataFrame, key: str | list[str], order: list) -> DataFrame:
    """The first row of every key."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
