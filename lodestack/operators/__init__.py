"""Operators: extraction, chunking, embedding, vector search, spelling, fusion, graph."""
