"""Training-data operators: filters, deduplication, packing, media and archive formats.

Nothing else in the library imports this subpackage.
"""
