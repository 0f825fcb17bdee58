"""Catalogue search and ingest analytics on Spark."""
