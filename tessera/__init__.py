"""Tessera: a Spark-first analytics engine for assay tables and training text."""
