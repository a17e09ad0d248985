"""Training-data operators: dedup, tokenising, language, search, scoring, cleaning, rendering.

Nothing else in the package imports this subpackage.
"""
