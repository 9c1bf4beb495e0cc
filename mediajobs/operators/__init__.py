"""Operators over DataFrames: normalising, routing, health, text, vectors, ingest, search, rerank."""
