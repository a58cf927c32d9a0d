"""Training-data operators: deduplication, quality, packing, mixing, scoring.

Nothing outside this subpackage imports it; deleting the folder (together with
``corpus_pipeline.py`` and ``tests/llm``) leaves the rest of the library whole.
"""
