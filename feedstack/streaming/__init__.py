"""Structured Streaming ingestion (ST1-ST3)."""
