"""Operators that prepare texts for model training. Nothing outside this subpackage imports it."""
