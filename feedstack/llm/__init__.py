"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it; ``queries`` registers one query per operator.
"""
