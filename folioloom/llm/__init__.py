"""Operators that prepare text for training language models.

Nothing outside this package imports it.  Each module holds one operator; `registry`
lists their queries and the SQL they are checked against.
"""
