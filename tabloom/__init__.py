"""Everyday tabular, JSON, text and file work as Spark DataFrame operators with exact cell semantics."""
