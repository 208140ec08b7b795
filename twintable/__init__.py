"""Spark-first analytics over catalog metadata: lineage, similarity, consolidation."""
