"""Operators for preparing training text.

Each module holds one operator with its own general interface; ``queries``
holds the thin registered queries built on them.  Nothing else in the package
imports this subpackage.
"""
