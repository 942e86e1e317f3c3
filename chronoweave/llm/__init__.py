"""Operators for preparing training text at scale, one module for each.

Nothing outside this subpackage imports it.
"""
