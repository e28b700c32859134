"""Operators for building language-model training corpora at scale.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
