"""Spark-first engine for building, auditing and scoring question-answering datasets."""
