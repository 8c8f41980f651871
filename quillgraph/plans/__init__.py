"""Bounded retrieval plans over the graph."""
