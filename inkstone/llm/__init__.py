"""Training-data operators: thirteen numbered operators and what they share.

Nothing else in the library imports this subpackage; it may be deleted.
"""
