"""Operators that prepare text collections for training language models.

Nothing outside this subpackage imports it; the query registry adds its
queries only where the subpackage can be imported.
"""
