"""Training-data operators: dedup, filtering, mixing, packing, extraction, counting.

Nothing else in the library imports this subpackage. ``queries.py`` registers one query
per operator; ``corpus_pipeline.py`` at the top of the repository chains five of them.
"""
