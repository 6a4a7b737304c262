"""Spark operators for session/step fact tables: metrics, cells, sequences, quality gates."""
