"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface; ``queries`` binds them to the tables of a
data folder.
"""
