"""Training-data operators: classifiers, packing, deduplication, joins, mixing, extraction and exact search.

Nothing else in the library imports this subpackage.
"""
