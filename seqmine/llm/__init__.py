"""Operators for large training-data pipelines, one module each.

Nothing outside this subpackage imports it; ``queries`` registers its operators.
"""
