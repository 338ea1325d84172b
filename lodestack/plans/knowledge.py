"""From chunks to a knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph


def build(metadata: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triples, nodes and edges of chunk metadata (``encoder, ord`` and a chunk's columns)."""
    t = graph.triples(graph.sentence_entities(graph.unique_chunks(metadata)))
    return t, graph.nodes(t), graph.edges(t)
