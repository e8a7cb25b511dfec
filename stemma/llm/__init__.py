"""Training-data operators: tokenising, archives, deduplication, filtering and classification.

Nothing else in the library imports this subpackage; ``corpus_pipeline.py`` belongs to it.
"""
