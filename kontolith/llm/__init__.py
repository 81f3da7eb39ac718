"""Training-data operators: tokenising, scoring, archives, filters, deduplication, packing and extraction.

Nothing outside this subpackage imports it; delete the folder and the rest of the library still works.
"""
