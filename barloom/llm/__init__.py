"""Operators over text, page and vector tables for preparing training data.

Nothing outside this package imports it. Each module holds one operator with its general interface; ``queries`` and
``checks`` hold the registered queries and their SQL.
"""
