"""Tessella: a Spark-first engine for typed fact graphs and versioned document corpora."""
