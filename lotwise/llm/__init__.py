"""Operators for building language-model training data. Nothing outside this subpackage imports it."""
