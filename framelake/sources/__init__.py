"""Readers, extractors and sinks."""
