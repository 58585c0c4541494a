"""Operators for building training corpora.

Nothing else in the library imports this subpackage; each operator has a
module of its own and ``queries`` binds them to the driver's tables.
"""
