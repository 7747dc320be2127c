"""Training-data operators.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
