"""Training-data operators: media, dedup, filtering, tokenising, packing.

Nothing else in the library imports this package.
"""
