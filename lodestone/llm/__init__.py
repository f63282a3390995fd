"""Training-data operators: scoring, fingerprints, filters, deduplication and mixing.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when it is present.
"""
