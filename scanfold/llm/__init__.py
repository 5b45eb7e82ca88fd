"""Training-data operators: deduplication, packing, redaction, filtering and mixing of document tables.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries when it can be imported.
"""
