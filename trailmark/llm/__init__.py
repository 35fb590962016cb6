"""Operators for preparing training text at corpus scale, their queries and their SQL counterparts.

Nothing else in the library imports this subpackage.
"""
