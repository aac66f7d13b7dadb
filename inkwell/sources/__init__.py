"""Scans, strict ingestion and sinks."""
