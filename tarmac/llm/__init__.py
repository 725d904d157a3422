"""Training-data operators: capture index, language, duplicates, quality, toxicity, PII, mixing.

Nothing else in the library imports this package.  ``catalog.py`` registers its
queries; ``__spark_entry__.py`` adds them when the package is present.
"""
