"""Training-data operators: dedup, scans, classifiers, mixing and token output.

Nothing else in the library imports this subpackage.
"""
