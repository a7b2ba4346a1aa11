"""Streaming forms of the counting and packing operators."""
