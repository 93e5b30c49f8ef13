"""Training-data operators: similarity joins, classifiers, counting, mixing, scoring.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
