"""Spark-first analytics over tables keyed by hierarchical cells."""
