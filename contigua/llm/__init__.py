"""Operators of a training-data pipeline.

Nothing outside this folder imports it; it can be deleted with ``tests/llm`` and ``corpus_pipeline.py``.
"""
