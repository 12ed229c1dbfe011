"""Operators for preparing training data at corpus scale.

Nothing outside this package imports it; the package can be removed without
touching the structural-source engine.
"""
