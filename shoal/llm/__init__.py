"""Operators for preparing training corpora.

Nothing outside this subpackage imports it, so the folder can be removed and
the rest of the library keeps working.
"""
