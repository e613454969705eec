"""Operators of a training-data pipeline. Nothing outside this folder imports it but the
guarded registration in ``__spark_entry__.py`` and ``corpus_pipeline.py``."""
