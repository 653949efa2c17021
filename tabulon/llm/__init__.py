"""Training-data operators: search, filtering, deduplication, mixing, tokens.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
