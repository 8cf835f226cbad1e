"""Training-data operators: tokenising, formatting, scoring, archiving, deduplication and mixing.

Nothing else in the package imports this subpackage; it can be removed without
touching the rest of the engine.
"""
