"""Operators that prepare text corpora for training language models.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` holds the registered queries
that apply them to whole tables.
"""
