"""Training-data operators: packing, dedup, formatting, language id, mixing,
quality and URL rules. Nothing else in the library imports this subpackage.
"""
